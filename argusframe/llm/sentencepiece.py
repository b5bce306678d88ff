"""SentencePiece encoding and decoding by a max-plus parallel scan.

The encoding of a text is its best-scoring segmentation into pieces. No piece
crosses a cut: the place before a space, and either side of a character that
no longer piece has. Between cuts the best segmentation is found once for
each distinct string.

A giant text is split into chunks at any places. The state at a chunk's end
is how far the last piece reaches beyond it, so a chunk is a matrix of best
scores from state to state. Matrices are combined by max-plus products in
blocks; the products give the scores at each block's and then at each chunk's
start. With these each chunk alone tells, for each state at its end, the state
at its start; composing these maps backwards fixes the states, and each chunk
is traced back on its own. Scores are whole numbers, so sums are exact, and of
equal segmentations the one with the longest last piece is taken everywhere:
results do not depend on where the text is split.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small_batches, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a text is split, of a chunk, and chunks of a block.
GIANT, CHUNK, BLOCK = 1 << 16, 1 << 15, 64
#: Distinct strings between cuts whose encoding a task remembers.
REMEMBERED = 200_000
#: Bytes of text, about, that a task encodes at once.
AT_ONCE = 1 << 18
#: Score units of a factor of two in a piece's rank.
UNITS = 256
LOW = -math.inf


class Vocabulary:
    """Pieces with whole-number scores.

    A Unigram model's log probabilities are taken as they are, in units. A BPE model has only the order of its merges,
    which follows frequency; its pieces are scored by Zipf's law from their ranks. Spaces stand for the meta symbol, so
    that the symbol itself, which has no piece of its own here, is encoded as bytes and decodes exactly.
    """

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = [sp.get_score(i) for i in normal]
        unigram = all(-40 < x <= 0 for x in raw)
        self.ids, self.scores, self.bytes_of = {}, {}, {}
        for rank, (i, score) in enumerate(zip(normal, raw, strict=True)):
            piece = sp.id_to_piece(i).replace("▁", " ")
            self.ids[piece] = i
            self.scores[piece] = round(score * UNITS / math.log(2)) if unigram else -round(UNITS * math.log2(rank + 2))
            self.bytes_of[i] = piece.encode()
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes_of |= {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.unknown = min(self.scores.values()) - 10 * UNITS
        self.longest = max(map(len, self.ids))
        self.packs: dict[str, bytes] = {}
        long = [p for p in self.ids if len(p) > 1]
        self.joined = frozenset(c for p in long for c in p if c != " ")
        self.space_cuts = not any(" " in p.lstrip(" ") for p in long)
        letters = "[" + "".join(map(re.escape, sorted(self.joined))) + "]" if self.joined else r"(?!)"
        self.between = re.compile(f" *{letters}+| +|(?s:.)" if self.space_cuts else f"(?: |{letters})+|(?s:.)")
        self.by_id = [self.bytes_of.get(i, b"") for i in range(n)]

    @cached_property
    def reach(self) -> dict[str, float]:
        """Scores of pieces and, as LOW, of beginnings of pieces that are none: where there is no entry, no piece goes on."""
        return {p[:i]: LOW for p in self.ids for i in range(1, len(p))} | self.scores

    @cached_property
    def ends(self) -> dict[str, float]:
        """The same from the other end."""
        return {p[i:]: LOW for p in self.ids for i in range(1, len(p))} | self.scores

    def cut(self, before: str, after: str) -> bool:
        inside = lambda c: c == " " or c in self.joined
        return not (inside(before) and inside(after)) or (self.space_cuts and after == " " and before != " ")

    def forward(self, text: str, entry: list[float], n: int) -> tuple[list[float], list[int]]:
        """Best scores and starts of last pieces at 0..len(text); pieces start before n, from entry's states on."""
        reach, unknown, size = self.reach, self.unknown, len(text)
        best, start = [LOW] * (size + 1), [-1] * (size + 1)
        best[: len(entry)] = entry[: size + 1]
        for i in range(n):
            here = best[i]
            if here == LOW:
                continue
            j = i + 1
            score = reach.get(text[i:j], LOW)
            score = here + (unknown if score == LOW else score)
            if score > best[j]:
                best[j], start[j] = score, i
            while j < size:
                j += 1
                score = reach.get(text[i:j])
                if score is None:
                    break
                score += here
                if score > best[j]:
                    best[j], start[j] = score, i
        return best, start

    def ids_of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.byte_ids[b] for b in piece.encode()]

    def trace(self, text: str, start: list[int], end: int) -> tuple[int, list[int]]:
        """Where the first piece begins, and the ids, of the best path to end."""
        back = []
        while start[end] >= 0:
            back.append(text[start[end] : end])
            end = start[end]
        return end, [i for piece in reversed(back) for i in self.ids_of(piece)]

    def segment(self, text: str) -> list[int]:
        best, start = self.forward(text, [0], len(text))
        return self.trace(text, start, len(text))[1]

    def learn(self, words: set[str], known: dict[str, bytes]) -> None:
        """Adds the ids of words, as bytes of int32, to known. In sorted order, words share the work on their beginnings."""
        ends, scores, unknown = self.ends, self.scores, self.unknown
        best, made, before = [0], [b""], ""
        for word in sorted(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del best[same + 1 :], made[same + 1 :]
            for j in range(same + 1, len(word) + 1):
                at = i = j - 1
                top = best[i] + scores.get(word[i:j], unknown)
                while i:
                    i -= 1
                    score = ends.get(word[i:j])
                    if score is None:
                        break
                    score += best[i]
                    if score >= top:
                        top, at = score, i
                best.append(top)
                made.append(made[at] + self.packed(word[at:j]))
            known[word] = made[-1]
            before = word

    def packed(self, piece: str) -> bytes:
        found = self.packs.get(piece)
        if found is None:
            found = self.packs[piece] = np.array(self.ids_of(piece), np.int32).tobytes()
        return found

    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """The ids of each text, as bytes of int32."""
        if len(known) > REMEMBERED:
            known.clear()
        parts = [self.between.findall(" " + x) if x else [] for x in texts]
        self.learn(set().union(*parts) - known.keys(), known)
        return [b"".join([known[w] for w in x]) for x in parts]

    def decode(self, ids) -> str:
        by_id = self.by_id
        return b"".join([by_id[i] for i in ids])[1:].decode("utf-8", "replace")

    def transfer(self, text: str, n: int) -> np.ndarray:
        """Best score from each state at the chunk's start to each at its end, n characters on."""
        size = self.longest
        out = np.full((size, size), LOW)
        meet = next((p for p in range(size, n) if self.cut(text[p - 1], text[p])), None)
        if meet is None:
            for i in range(min(size, n + 1)):
                best, _ = self.forward(text, [LOW] * i + [0], n)
                tail = best[n : n + size]
                out[i, : len(tail)] = tail
            return out
        tail = self.forward(text[meet:], [0], n - meet)[0][n - meet : n - meet + size]
        for i in range(size):
            head = self.forward(text[:meet], [LOW] * i + [0], meet)[0][meet]
            out[i, : len(tail)] = np.array(tail) + head
        return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus, of vectors or matrices with a matrix."""
    return (a[..., :, None] + b).max(axis=-2)


def _chunks(longest: int, chunk: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for uid, body in zip(rows.uid, rows.body, strict=True):
                text = " " + body
                n = -(-len(text) // chunk)
                for at in range(0, n, 16):
                    some = range(at, min(n, at + 16))
                    yield pd.DataFrame({"uid": uid, "c": list(some), "n": [min(chunk, len(text) - c * chunk) for c in some], "body": [text[c * chunk : (c + 1) * chunk + longest - 1] for c in some]})

    return split


def _per_chunk(model: str, f, columns: list[str]):
    """mapInPandas function: f(vocabulary, row) for each row, next to the row's uid and c."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(model)
        for rows in batches:
            made = [f(vocabulary, r) for r in rows.itertuples()]
            yield pd.DataFrame({"uid": rows.uid, "c": rows.c} | {k: [x[i] for x in made] for i, k in enumerate(columns)})

    return run


def _matrix(v: Vocabulary, r) -> tuple:
    return (v.transfer(r.body, r.n).ravel(),)


def _entries(v: Vocabulary, r) -> tuple:
    """For each state at the end, the state at the start."""
    best, start = v.forward(r.body, list(r.alpha), r.n)
    return ([v.trace(r.body, start, r.n + o)[0] if r.n + o < len(best) and best[r.n + o] > LOW else 0 for o in range(v.longest)],)


def _traced(v: Vocabulary, r) -> tuple:
    _, start = v.forward(r.body, list(r.alpha), r.n)
    return (v.trace(r.body, start, r.n + r.ends)[1],)


def _square(rows: pd.Series) -> list[np.ndarray]:
    return [np.array(x).reshape(math.isqrt(len(x)), -1) for x in rows]


def _block_product(rows: pd.DataFrame) -> pd.DataFrame:
    made = None
    for m in _square(rows.sort_values("c").matrix):
        made = m if made is None else product(made, m)
    return pd.DataFrame({"uid": [rows.uid.iloc[0]], "block": [rows.block.iloc[0]], "matrix": [made.ravel()]})


def _scanned(order: str):
    """Scores at the start of each row's part, from the scores at the start of the first, in alpha of its row."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        matrices, out = _square(rows.matrix), []
        alpha = np.array(rows.alpha.iloc[0])
        for m in matrices:
            out.append(alpha)
            alpha = product(alpha, m)
        return pd.DataFrame({"uid": rows.uid, order: rows[order], "alpha": out})

    return scan


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    made = None
    for m in rows.sort_values("c", ascending=False).entries:
        made = np.array(m) if made is None else np.array(m)[made]
    return pd.DataFrame({"uid": [rows.uid.iloc[0]], "block": [rows.block.iloc[0]], "entries": [made]})


def _ended(order: str):
    """The state at the end of each row's part, from that at the end of the last, in ends of each row."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ascending=False)
        at, out = int(rows.ends.iloc[0]), []
        for m in rows.entries:
            out.append(at)
            at = int(m[at])
        return pd.DataFrame({"uid": rows.uid, order: rows[order], "ends": out})

    return walk


def _giants(rows: DataFrame, model: str, chunk: int, block: int) -> DataFrame:
    """uid and ids of texts, by the parallel scan."""
    longest = Vocabulary(model).longest
    chunks = saved(rows.mapInPandas(_chunks(longest, chunk), "uid long, c int, n int, body string"), "pieces_chunks")
    of_block = F.floor(F.col("c") / block).cast("int").alias("block")
    matrices = saved(chunks.mapInPandas(_per_chunk(model, _matrix, ["matrix"]), "uid long, c int, matrix array<double>").select("*", of_block), "pieces_matrices")
    blocks = matrices.groupBy("uid", "block").applyInPandas(_block_product, "uid long, block int, matrix array<double>")
    first = F.array(F.lit(0.0), *(F.lit(LOW) for _ in range(longest - 1)))
    starts = blocks.withColumn("alpha", first).groupBy("uid").applyInPandas(_scanned("block"), "uid long, block int, alpha array<double>")
    alphas = matrices.join(starts, ["uid", "block"]).groupBy("uid", "block").applyInPandas(_scanned("c"), "uid long, c int, alpha array<double>")
    ready = saved(chunks.join(alphas, ["uid", "c"]), "pieces_ready")
    maps = saved(ready.mapInPandas(_per_chunk(model, _entries, ["entries"]), "uid long, c int, entries array<int>").select("*", of_block), "pieces_maps")
    over = maps.groupBy("uid", "block").applyInPandas(_composed, "uid long, block int, entries array<int>").withColumn("ends", F.lit(0))
    block_ends = over.groupBy("uid").applyInPandas(_ended("block"), "uid long, block int, ends int")
    ends = maps.join(block_ends, ["uid", "block"]).groupBy("uid", "block").applyInPandas(_ended("c"), "uid long, c int, ends int")
    traced = ready.join(ends, ["uid", "c"]).mapInPandas(_per_chunk(model, _traced, ["ids"]), "uid long, c int, ids array<int>")
    return traced.groupBy("uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x.getField("ids"))).alias("ids"))


def _encoder(model: str):
    """mapInArrow function: row as it is, ids of body, and whether they decode to it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = Vocabulary(model), {}
        for batch in batches:
            lengths = np.cumsum(pc.binary_length(batch["body"]).to_numpy(zero_copy_only=False))
            ends = np.flatnonzero(np.diff(lengths // AT_ONCE, append=-1)) + 1
            for at, end in zip([0, *ends[:-1]], ends, strict=True):
                texts = batch["body"].slice(at, end - at).to_pylist()
                packs = vocabulary.encode(texts, known)
                arrays = [np.frombuffer(x, np.int32) for x in packs]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(packs), np.int32))
                same = [vocabulary.decode(x.tolist()) == t for x, t in zip(arrays, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["row"].slice(at, end - at), ids, pa.array(same)], ["row", "ids", "round_trip"])

    return encode


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of token ids; null for null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(model)
        for rows in batches:
            yield rows.map(lambda x: None if x is None else vocabulary.decode(x))

    return decode(ids)


def encoded(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Each row of docs, or its columns in keep, as struct `row`, with its token ids and round_trip: they decode to the text.

    Null and empty texts have no ids. Texts of over `giant` characters are split and scanned in parallel. chunk must be
    over the longest piece.
    """
    small_batches(docs.sparkSession)
    row, body = F.struct(*(keep or docs.columns)).alias("row"), text_of(text_column)
    rows = docs.select(row, body.alias("body"))
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    small = rows.where(F.length("body") <= giant).mapInArrow(_encoder(model), schema)
    large = saved(rows.where(F.length("body") > giant).withColumn("uid", F.monotonically_increasing_id()), "pieces_giants")
    if large.isEmpty():
        return small
    ids = _giants(large.select("uid", "body"), model, chunk, block)
    return small.unionByName(large.join(ids, "uid").select("row", "ids", (decoded(F.col("ids"), model) == F.col("body")).alias("round_trip")))
