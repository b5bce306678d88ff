"""Language identification by a convolutional network over bytes, trained and applied in numpy.

Windows of WINDOW bytes cover the whole text. Bytes are embedded, filters of
several widths slide over them, each filter's largest value over the window
feeds a softmax. A text's prediction is the mean of its windows' log
probabilities, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of

WINDOW, EMBEDDING, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
SPAN = max(WIDTHS)
#: Documents of each language, about, and of all languages together, and excerpts of each document, that the network is
#: fitted on. Where languages are many, each has fewer documents, but one at least: none is left out.
TRAIN_DOCS, TRAIN_ALL, EXCERPTS = 1_000, 40_000, 3
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.004, 11
UNKNOWN = "und"


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of bytes, padded by zero), the bytes in each, and the first window of each text."""
    counts = [max(1, -(-len(x) // WINDOW)) for x in texts]
    flat = np.frombuffer(b"".join(x.ljust(n * WINDOW, b"\0") for x, n in zip(texts, counts, strict=True)), np.uint8).reshape(-1, WINDOW)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    sizes = np.full(len(flat), WINDOW, np.int64)
    last = first + np.array(counts, np.int64) - 1
    sizes[last] = [len(x) - (n - 1) * WINDOW for x, n in zip(texts, counts, strict=True)]
    return flat, sizes, first


def prepared(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def _columns(net: dict, x: np.ndarray) -> np.ndarray:
    """For each window and place, the embedded bytes of the next SPAN places side by side."""
    e = net["embedding"][np.pad(x, ((0, 0), (0, SPAN - 1)))]
    return np.concatenate([e[:, k : k + WINDOW] for k in range(SPAN)], axis=2)


def _forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled features, before and without the rectifier's bias, and the columns."""
    cols = _columns(net, x)
    scores = (cols.reshape(-1, SPAN * EMBEDDING) @ net["filters"]).reshape(len(x), WINDOW, -1)
    return scores, cols


def log_probs(net: dict, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(net["out_bias"])), np.float32)
    for i in range(0, len(x), BATCH):
        scores, _ = _forward(net, x[i : i + BATCH])
        pooled = np.maximum(scores.max(axis=1) + net["bias"], 0)
        z = pooled @ net["out"] + net["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        out[i : i + BATCH] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def _mask() -> np.ndarray:
    """Narrow filters see the first bytes of the span only."""
    mask = np.zeros((SPAN, EMBEDDING, len(WIDTHS), FILTERS), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i] = 1
    return mask.reshape(SPAN * EMBEDDING, -1)


def train(texts: list[bytes], labels: list[str], epochs: int = EPOCHS) -> dict | None:
    """The fitted network, None if there is nothing to learn from."""
    if not texts:
        return None
    names = sorted(set(labels))
    rng = np.random.default_rng(SEED)
    n_filters = len(WIDTHS) * FILTERS
    mask = _mask()
    net = {
        "embedding": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), "filters": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        "bias": np.zeros(n_filters, np.float32), "out": rng.normal(0, 0.1, (n_filters, len(names))).astype(np.float32), "out_bias": np.zeros(len(names), np.float32),
    }
    net["embedding"][0] = 0
    x, sizes, first = windows_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(x))))
    y = np.searchsorted(names, labels)[owner]
    weight = 1 / np.bincount(y, minlength=len(names)).clip(1)
    weight = (weight / weight[y].mean())[y].astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at : at + BATCH]
            short = np.where(rng.random(len(pick)) < 0.5, rng.integers(6, WINDOW, len(pick)), WINDOW)
            batch = np.where(np.arange(WINDOW) < short[:, None], x[pick], 0).astype(np.uint8)
            scores, cols = _forward(net, batch)
            where = scores.argmax(axis=1)
            best = np.take_along_axis(scores, where[:, None], 1)[:, 0] + net["bias"]
            pooled = np.maximum(best, 0)
            z = pooled @ net["out"] + net["out_bias"]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick, None] / len(pick)
            back = (p @ net["out"].T) * (best > 0)
            seen = cols[np.arange(len(pick))[:, None], where]
            spread = (back[:, :, None] * net["filters"].T[None]).reshape(len(pick), n_filters, SPAN, EMBEDDING)
            grad_e = np.zeros_like(net["embedding"])
            places = where[:, :, None] + np.arange(SPAN)
            letters = np.pad(batch, ((0, 0), (0, SPAN - 1)))[np.arange(len(pick))[:, None, None], places]
            np.add.at(grad_e, letters.ravel(), spread.reshape(-1, EMBEDDING))
            grad_e[0] = 0
            grads = {"embedding": grad_e, "filters": np.einsum("nf,nfd->df", back, seen) * mask, "bias": back.sum(axis=0), "out": pooled.T @ p, "out_bias": p.sum(axis=0)}
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net | {"names": names}


def predict(net: dict, texts: list[str]) -> tuple[list[str], np.ndarray]:
    x, sizes, first = windows_of([prepared(t) for t in texts])
    mean = np.add.reduceat(log_probs(net, x) * np.maximum(sizes, 1)[:, None], first, axis=0) / np.add.reduceat(np.maximum(sizes, 1), first)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return [net["names"][i] for i in p.argmax(axis=1)], p.max(axis=1)


def fold(id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0, which is never learned from, if the id is null."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5, F.lit(0))


def has_letter(text: Column) -> Column:
    return text_of(text).rlike(r"\p{L}")


def excerpts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", docs_each: int = TRAIN_DOCS, docs_all: int = TRAIN_ALL) -> DataFrame:
    """lang and text of the excerpts that the network is fitted on: about docs_each documents of each language.

    Only documents of the folds 1 to 4 with a label and a letter count. They are drawn by a hash of id and text, so that
    many rows under one id are told apart and repeats count once. Of each language the document with the least hash is
    drawn as well, which leaves no language without one.
    """
    known = docs.where((fold(id_column) != 0) & F.col(lang_column).isNotNull() & has_letter(F.col(text_column)))
    known = known.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"), F.xxhash64(F.col(id_column).cast("string"), text_column).alias("h"))
    draw = F.shiftrightunsigned("h", 11)
    counts = saved(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min(draw).alias("least")), "langid_counts")
    each = min(docs_each, max(1, docs_all // max(1, counts.count())))
    drawn = known.join(counts, "lang").where((draw / float(1 << 53) * F.col("n") < each) | (draw == F.col("least")))
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))
    starts = F.array_distinct(F.array(*(F.floor(F.greatest(F.length("text") - WINDOW, F.lit(0)) * i / max(1, EXCERPTS - 1)) for i in range(EXCERPTS))))
    return drawn.select("lang", F.explode(F.transform(starts, lambda s: F.substr("text", (s + 1).cast("int"), F.lit(WINDOW)))).alias("text"))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> dict | None:
    rows = excerpts(docs, id_column, text_column, lang_column).toPandas().sort_values(["lang", "text"], kind="stable")
    return train([prepared(x)[:WINDOW] for x in rows.text], list(rows.lang))


def identified(net: dict | None, text: Column) -> Column:
    """struct of lang and score of a whole text; UNKNOWN and 0 without a letter, for null, or without a network."""

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = predict(net, list(texts)) if len(texts) else ([], [])
            yield pd.DataFrame({"lang": lang, "score": np.asarray(score, np.float64)})

    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if net is None:
        return unknown
    return F.when(has_letter(text), predicted(text_of(text))).otherwise(unknown)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Each row of docs as struct `row`, with held_out, lang_pred and score; learns from the labelled rows of docs.

    Id and language only choose the rows that are learned from; a prediction sees the text alone. Null, empty and
    letterless texts are UNKNOWN with score 0, and so are all rows where no row has a label to learn from. A null id is
    held out. Equal texts get equal predictions; the whole of a long text counts. An empty table gives no rows. Other
    columns stay in `row`, whatever their names.
    """
    net = fit(docs, id_column, text_column, lang_column)
    found = docs.select(F.struct(*docs.columns).alias("row"), (fold(id_column) == 0).alias("held_out"), identified(net, F.col(text_column)).alias("found"))
    return found.select("row", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
