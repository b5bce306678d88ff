"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A string of LENGTH bytes is removed where it also starts in a document with a
smaller id. Suffixes are told apart by LENGTH bytes only, so their order need
not be refined any further.

1. Of the suffixes those are anchors whose gram of GRAM bytes has the smallest
   hash in some window of LENGTH bytes. Equal windows have equal anchors, so a
   repeated string shows at its anchors, about one in 14 suffixes. Documents
   are written once, in chunks, with a bit for each anchor.
2. The initial buckets are those of equal grams. Chunks send sorted compressed
   hashes of their grams to owners, which answer with a bit for each: is it in
   another chunk too. Buckets of one suffix are done.
3. What is left meets at the owner of its bucket with a hash of all bytes that
   windows over the anchor can reach. Suffixes that agree in all of them are
   settled by the smallest id. Only buckets that still hold different ones ask
   the chunks for those bytes.
4. These are refined: suffixes are sorted by the bucket of their first 8 bytes
   and the bucket of the suffix 8 further on, which gives buckets of 16; the
   new buckets at once serve the next step, 32, and then LENGTH bytes. The
   smallest id in a last bucket decides for all its suffixes. Buckets with too
   many suffixes for one task are first split by bytes further out.
5. Chunks turn what was decided into spans of bytes.

Each chunk sends a string of equal reach once, with its smallest id, so a
passage that a third of the documents have costs a row for each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, met, saved, saved_bucketed, text_of
from .exact_dedup import _answer, _cut
from .golomb import rice_encode

#: Bytes of a string that counts as repeated, and of the grams that make the initial buckets.
LENGTH, GRAM = 50, 24
#: Bytes of text in a chunk, of text in a bucket of the chunks' table, and suffixes that are looked at at once.
CHUNK, IN_BUCKET, AT_ONCE = 4 << 20, 48 << 20, 1 << 19
#: Anchors of an owner, suffixes that are refined at once, and those of one bucket from which it is split.
OWNED, REFINED, HOT_BUCKET = 250_000, 16_384, 32_768
#: Stands for an id that is null, which is larger than all others.
NO_ID = (1 << 63) - 1

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_MOST = np.uint64(2**64 - 1)


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number; a view."""
    return np.lib.stride_tricks.as_strided(np.frombuffer(buf.data, np.uint64, 1), (len(buf) - 7,), (1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FACTORS[0]
    return x ^ (x >> np.uint64(29))


def _hashed(words: np.ndarray, at: np.ndarray | slice, offsets: list[int], seed: np.ndarray | np.uint64) -> np.ndarray:
    """Hashes of the words at these offsets from each place."""
    h = seed
    for o in offsets:
        w = words[at.start + o : at.stop + o] if isinstance(at, slice) else words[at + o]
        h = _mixed((h ^ w) * _FACTORS[1] + _FACTORS[2])
    return h


def _cover(begin: int, end: int) -> list[int]:
    """Offsets of words of eight bytes that cover the bytes from begin to end."""
    return [*range(begin, end - 7, 8)] + ([end - 8] if (end - begin) % 8 else [])


def _over(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least, or the most, of each `width` numbers in a row."""
    f, size = (np.minimum if least else np.maximum), 1
    while 2 * size <= width:
        a, size = f(a[:-size], a[size:]), 2 * size
    return f(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def _inside(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """True from each start for so many places; what starts does not overlap."""
    edge = np.zeros(n + 1, np.int8)
    some = sizes > 0
    edge[starts[some]] += 1
    edge[(starts + sizes)[some]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


class Texts:
    """The texts of a chunk in one buffer, with zeros around each, and their anchors."""

    def __init__(self, text: bytes, lens: np.ndarray, length: int):
        self.length, self.wide = length, length - GRAM + 1
        pad = length + 8
        self.lens, self.starts = lens, pad + np.concatenate([[0], np.cumsum(lens + pad)[:-1]]).astype(np.int64)
        self.buf = np.zeros(int((lens + pad).sum()) + 3 * pad, np.uint8)
        whole, begin = np.frombuffer(text, np.uint8), 0
        for s, n in zip(self.starts.tolist(), lens.tolist(), strict=True):
            self.buf[s : s + n] = whole[begin : begin + n]
            begin += n
        self.words = _words(self.buf)

    def grams(self, at: np.ndarray | slice) -> np.ndarray:
        return _hashed(self.words, at, _cover(0, GRAM), _FACTORS[3])

    def buckets(self, at: np.ndarray) -> np.ndarray:
        """Grams as numbers that are spread evenly, which the hashes of anchors, being the smallest, are not."""
        return _mixed(self.grams(at) * _FACTORS[1] + _FACTORS[2])

    def anchors(self) -> np.ndarray:
        """Places whose gram has the smallest hash of all grams in some window, ties included."""
        w, n = self.wide, len(self.buf)
        long = self.lens >= self.length
        gram_fits = _inside(n, self.starts[long], self.lens[long] - GRAM + 1)
        window_fits = _inside(n, self.starts[long], self.lens[long] - self.length + 1)
        found, first, last = [], self.length, n - 2 * self.length - 8
        for a in range(first, last, AT_ONCE):
            b = min(a + AT_ONCE, last)
            lo, hi = a - w + 1, b + w - 1
            h = self.grams(slice(lo, hi))
            h[~gram_fits[lo:hi]] = _MOST
            least = _over(h, w, True)
            least[~window_fits[lo:b]] = 0
            found.append(a + np.flatnonzero((_over(least, w, False) == h[w - 1 : w - 1 + b - a]) & gram_fits[a:b]))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def reach(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place the document, and how many bytes before and after its gram a window over it can have."""
        doc = np.searchsorted(self.starts, at, side="right") - 1
        before, after = at - self.starts[doc], self.starts[doc] + self.lens[doc] - GRAM - at
        return doc, np.minimum(before, self.wide - 1), np.minimum(after, self.wide - 1)

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """All bytes in reach of each place, a row each, zero where the text has ended."""
        side = self.wide - 1
        return self.buf[at[:, None] + np.arange(-side, GRAM + side)[None, :]]


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _chunker(length: int):
    def chunk(docs: list[int], texts: list[bytes]) -> dict:
        lens = np.array([len(t) for t in texts], np.int64)
        held = Texts(b"".join(texts), lens, length)
        at = held.anchors()
        flags = np.zeros(len(held.buf), bool)
        flags[at] = True
        return {"docs": np.array(docs, np.int64).tobytes(), "lens": lens.tobytes(), "text": b"".join(texts), "anchors": _packed(flags), "n": len(at)}

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, texts, size = [], [], 0
        for rows in batches:
            for doc, text in zip(rows["doc"], rows["text"], strict=True):
                docs.append(doc)
                texts.append(bytes(text))
                size += len(text)
                if size >= CHUNK or len(docs) >= CHUNK >> 4:
                    yield pd.DataFrame([chunk(docs, texts)])
                    docs, texts, size = [], [], 0
        if docs:
            yield pd.DataFrame([chunk(docs, texts)])

    return chunks


def _opened(row, length: int) -> tuple[Texts, np.ndarray, np.ndarray]:
    """A chunk's texts, ids and anchors."""
    held = Texts(row.text, np.frombuffer(row.lens, np.int64), length)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(row.anchors, np.uint8), count=len(held.buf)))
    return held, np.frombuffer(row.docs, np.int64), at


def _sender(length: int, bits: int, owners: int):
    head, owner_of = _cut(bits, owners)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                held, _, at = _opened(row, length)
                values = np.unique(head(held.buckets(at).view(np.int64)))
                who, start = np.unique(owner_of(values), return_index=True)
                if len(values):
                    yield pd.DataFrame({"bucket": row.chunk, "owner": who, "blob": [rice_encode(x) for x in np.split(values, start[1:])]})

    return send


class Local:
    """A chunk's anchors whose gram another document has too, by what is in their reach.

    same: for each such anchor the place, among `first`, of the first of its class; late: it has a larger id than that.
    """

    def __init__(self, row, length: int, head, owner_of):
        self.texts, ids, self.at = _opened(row, length)
        gram = self.texts.buckets(self.at)
        doc, before, after = self.texts.reach(self.at)
        values, index = np.unique(head(gram.view(np.int64)), return_inverse=True)
        who, start = np.unique(owner_of(values), return_index=True)
        elsewhere = np.zeros(len(values), bool)
        answers = {a["owner"]: a["bitmap"] for a in row.answers} if len(values) else {}
        for owner, where in zip(who.tolist(), np.split(np.arange(len(values)), start[1:]), strict=False):  # none where there are no values
            elsewhere[where] = np.unpackbits(np.frombuffer(answers[owner], np.uint8), count=len(where)).astype(bool)
        lowest, highest = np.full(len(values), len(ids)), np.full(len(values), -1)
        np.minimum.at(lowest, index, doc)
        np.maximum.at(highest, index, doc)
        self.chosen = np.flatnonzero((elsewhere | (highest > lowest))[index])
        at, side = self.at[self.chosen], self.texts.wide - 1
        seed = (before[self.chosen] * (side + 1) + after[self.chosen]).astype(np.uint64) * _FACTORS[3]
        reach = _hashed(self.texts.words, at, _cover(-side, 0) + _cover(GRAM, GRAM + side), seed)
        # bytes beyond the end of a text are zeros, and bytes beyond the cover of the other side belong to the gram
        self.gram, self.reach, self.doc = gram[self.chosen], reach, ids[doc[self.chosen]]
        order = np.lexsort((self.doc, self.reach, self.gram))
        new = np.ones(len(order), bool)
        new[1:] = (self.gram[order][1:] != self.gram[order][:-1]) | (self.reach[order][1:] != self.reach[order][:-1])
        self.first = order[new]
        self.same = np.empty(len(order), np.int64)
        self.same[order] = np.cumsum(new) - 1
        self.late = self.doc > self.doc[self.first][self.same] if len(order) else np.zeros(0, bool)


def _survivors(length: int, bits: int, owners: int):
    head, owner_of = _cut(bits, owners)

    def survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                local = Local(row, length, head, owner_of)
                f = local.first
                owner = owner_of(head(local.gram[f].view(np.int64)))
                cuts = np.flatnonzero(np.diff(owner)) + 1  # first is in the order of grams, and so of owners
                parts = [np.split(x, cuts) for x in (local.gram[f], local.reach[f], local.doc[f], local.chosen[f].astype(np.int32))]
                if len(f):
                    yield pd.DataFrame({"owner": owner[np.r_[0, cuts]], "chunk": row.chunk, **{k: [x.tobytes() for x in p] for k, p in zip(("gram", "reach", "doc", "place"), parts, strict=True)}})

    return survivors


def _decider(hot_bucket: int):
    def decided(rows: pd.DataFrame) -> pd.DataFrame:
        """For each chunk: places whose reach an earlier document has too, and those whose bytes are asked for, of small and of large buckets."""
        sizes = [len(x) // 4 for x in rows.place]
        chunk = np.repeat(rows.chunk.to_numpy(np.int64), sizes)
        gram, reach, doc = (np.frombuffer(b"".join(rows[c]), k) for c, k in (("gram", np.uint64), ("reach", np.uint64), ("doc", np.int64)))
        place = np.frombuffer(b"".join(rows.place), np.int32)
        order = np.lexsort((doc, reach, gram))
        chunk, gram, reach, doc, place = (x[order] for x in (chunk, gram, reach, doc, place))
        bucket = np.cumsum(np.r_[0, gram[1:] != gram[:-1]])
        begins = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (reach[1:] != reach[:-1])])
        least = np.repeat(doc[begins], np.diff(np.r_[begins, len(doc)]))
        full = doc > least
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        # refining can only decide where an id that is the least of its class is above that of another class
        apart = np.minimum.reduceat(least, heads) < np.maximum.reduceat(least, heads)
        asked = ~full & apart[bucket]
        many = (np.add.reduceat(asked.astype(np.int64), heads) > hot_bucket)[bucket]
        out = []
        by = np.argsort(chunk, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(chunk[by]) != 0])
        for part in np.split(by, edges[1:]):
            out.append((chunk[part[0]], *(place[part[x[part]]].tobytes() for x in (full, asked & ~many, asked & many))))
        return pd.DataFrame(out, columns=["chunk", "full", "few", "many"])

    return decided


def _contexts(length: int):
    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                held, ids, at = _opened(row, length)
                place = np.concatenate([np.frombuffer(x, np.int32) for x in row.asked])
                for k in range(0, len(place), REFINED):
                    part = place[k : k + REFINED]
                    doc, before, after = held.reach(at[part])
                    yield pd.DataFrame({
                        "gram": held.buckets(at[part]).view(np.int64), "doc": ids[doc], "chunk": row.chunk, "place": part,
                        "low": (held.wide - 1 - before).astype(np.int32), "high": after.astype(np.int32), "bytes": [x.tobytes() for x in held.contexts(at[part])],
                    })

    return contexts


def pointers(contexts: np.ndarray, length: int) -> np.ndarray:
    """The bucket of each suffix of each row that has `length` bytes left: equal for equal strings of that length.

    Buckets of 8 bytes are refined to 16, 32 and so on by the pair of a suffix's bucket and that of the suffix as many
    bytes further on; the last step takes the bucket of an overlapping suffix.
    """
    n, width = contexts.shape
    data = np.ascontiguousarray(contexts)
    words = np.lib.stride_tricks.as_strided(np.frombuffer(data.data, np.uint64, 1), (n, width - 7), (width, 1))
    bucket = np.unique(words, return_inverse=True)[1].reshape(n, -1)
    size = 8
    while size < length:
        step = min(size, length - size)
        left, right = bucket[:, : width - size - step + 1], bucket[:, step : width - size + 1]
        bucket = np.unique(left * (int(bucket.max()) + 1) + right, return_inverse=True)[1].reshape(n, -1)
        size += step
    return bucket


def _refine(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """chunk, place and the windows, as bits, whose string a row with a smaller id has too."""
    data = np.frombuffer(b"".join(rows.bytes), np.uint8).reshape(len(rows), -1)
    bucket = pointers(data, length)
    window = np.arange(bucket.shape[1])
    fits = (window >= rows.low.to_numpy()[:, None]) & (window <= rows.high.to_numpy()[:, None])
    doc = np.broadcast_to(rows.doc.to_numpy(np.int64)[:, None], bucket.shape)
    least = np.full(int(bucket.max()) + 1, NO_ID)
    np.minimum.at(least, bucket[fits], doc[fits])
    bits = ((fits & (doc > least[bucket])).astype(np.int64) << window).sum(axis=1)
    some = bits != 0
    return pd.DataFrame({"chunk": rows.chunk[some], "place": rows.place[some], "bits": bits[some]})


def _refiner(length: int):
    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come bucket by bucket; whole buckets are refined together."""
        held, size = [], 0
        for rows in batches:
            held, size = [*held, rows], size + len(rows)
            if size >= REFINED:
                rows = pd.concat(held, ignore_index=True)
                last = rows.gram.to_numpy() == rows.gram.iloc[-1]
                if not last.all():
                    yield _refine(rows[~last], length)
                    rows = rows[last]
                held, size = [rows], len(rows)
        if size:
            yield _refine(pd.concat(held, ignore_index=True), length)

    return refine


_DECIDED = "chunk long, place int, bits long"


def _refined(contexts: DataFrame, length: int) -> DataFrame:
    return contexts.repartition("gram").sortWithinPartitions("gram").mapInPandas(_refiner(length), _DECIDED)


def _split(contexts: DataFrame, length: int, hot_bucket: int, hot_rows: int) -> DataFrame:
    """As _refined, for buckets of any size: windows are halved by where they start, which gives buckets of longer strings.

    All windows that start from `a` to `b` hold the bytes from b to a + length. A bucket that is still too large is halved again;
    down at one start its strings have all their bytes, and the smallest id is all that counts.
    """
    side = length - GRAM
    nodes, done = contexts.withColumns({"a": F.lit(0), "b": F.lit(side)}), []
    for _ in range(side.bit_length()):
        middle = ((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b")))
        nodes = nodes.withColumn("half", F.explode(halves)).withColumns({"a": F.col("half.a"), "b": F.col("half.b")}).drop("half").where("a <= b AND b >= low AND a <= high")
        nodes = saved(nodes.withColumn("gram", F.xxhash64("a", "b", F.expr(f"substring(bytes, b + 1, a + {length} - b)"))), "suffix_nodes")
        sizes = saved(nodes.groupBy("gram").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"), F.max(F.col("b") - F.col("a")).alias("wide")).where("least < most"), "suffix_sizes")
        single = met(nodes.where("a = b"), sizes.where("wide = 0").select("gram", "least", "n"), "gram", hot_rows).where("doc > least")
        done.append(single.select("chunk", "place", F.expr("shiftleft(1L, a)").alias("bits")))
        small, large = sizes.where((F.col("wide") > 0) & (F.col("n") <= hot_bucket)), sizes.where((F.col("wide") > 0) & (F.col("n") > hot_bucket))
        cut = {"low": F.greatest("low", "a"), "high": F.least("high", "b")}
        done.append(_refined(nodes.join(small.select("gram"), "gram", "left_semi").withColumns(cut).drop("a", "b"), length))
        if large.isEmpty():
            break
        nodes = met(nodes, large.select("gram", "n"), "gram", hot_rows)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _finisher(length: int, bits: int, owners: int):
    head, owner_of = _cut(bits, owners)

    def covered(row) -> tuple[Texts, np.ndarray]:
        """The chunk's texts, and a flag for each byte of its buffer."""
        local = Local(row, length, head, owner_of)
        side = local.texts.wide - 1
        full = local.late.copy()
        by_place = np.full(len(local.at), -1)
        by_place[local.chosen[local.first]] = np.arange(len(local.first))
        whole = np.zeros(len(local.first), bool)
        for x in row.full if row.full is not None else ():
            whole[by_place[np.frombuffer(x, np.int32)]] = True
        windows = np.zeros(len(local.first), np.int64)
        for x in row.windows if row.windows is not None else ():
            windows[by_place[x["place"]]] |= x["bits"]
        full |= whole[local.same]
        at = local.at[local.chosen]
        _, before, after = local.texts.reach(at)
        edge = np.zeros(len(local.texts.buf) + 1, np.int32)
        np.add.at(edge, (at - before)[full], 1)
        np.add.at(edge, (at + GRAM + after)[full], -1)
        of = np.where(full, 0, windows[local.same])
        for k in range(side + 1):
            begins = (at - side + k)[(of >> k) & 1 == 1]
            np.add.at(edge, begins, 1)
            np.add.at(edge, begins + length, -1)
        return local.texts, np.cumsum(edge[:-1]) > 0

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                texts, gone = covered(row)
                ids, out = np.frombuffer(row.docs, np.int64), []
                for doc, s, n in zip(ids.tolist(), texts.starts.tolist(), texts.lens.tolist(), strict=True):
                    cut = gone[s : s + n]
                    if not cut.any():
                        out.append((doc, n, [], texts.buf[s : s + n].tobytes()))
                        continue
                    step = np.diff(cut.astype(np.int8), prepend=0, append=0)
                    spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
                    out.append((doc, n, spans, texts.buf[s : s + n][~cut].tobytes()))
                yield pd.DataFrame(out, columns=["doc", "n_bytes", "spans", "kept"])

    return finish


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, hot_bucket: int = HOT_BUCKET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id, n_bytes, spans (start and end of each maximal run of removed bytes) and kept (the other bytes) of each row of docs.

    Removed is each byte that a string of `length` bytes, 32 or more, covers which also starts in a row with a smaller id;
    strings are judged on the texts as they came. Null texts count as empty. A null id is larger than any other; rows of
    one id, and rows without, take nothing from each other. Ids are longs. Each row gives one row, an empty table none;
    other columns play no part, whatever their names. What is kept may begin or end inside a character.
    """
    spark = docs.sparkSession
    parallel = spark.sparkContext.defaultParallelism
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"), text_of(text_column).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = rows.mapInPandas(_chunker(length), "docs binary, lens binary, text binary, anchors binary, n long").withColumn("chunk", F.monotonically_increasing_id())
    # with fewer buckets than Spark has partitions for a shuffle, a join would shuffle the texts
    buckets = max(2 * parallel, math.ceil(size / IN_BUCKET), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / CHUNK)))
    chunks = saved_bucketed(chunks, "suffix_chunks", buckets, "chunk")
    n = chunks.agg(F.sum("n")).first()[0] or 0
    owners, bits = max(2 * parallel, math.ceil(n / OWNED)), min(63, 16 + max(1, n).bit_length())
    opened = ["chunk", "docs", "lens", "text", "anchors"]

    sent = chunks.select(*opened).mapInPandas(_sender(length, bits, owners), "bucket long, owner long, blob binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "bucket long, owner long, bitmap binary")
    answers = saved(answers.groupBy(F.col("bucket").alias("chunk")).agg(F.collect_list(F.struct("owner", "bitmap")).alias("answers")), "suffix_answers")
    answered = chunks.select(*opened).join(answers.hint("shuffle_hash"), "chunk", "left")

    left = answered.mapInPandas(_survivors(length, bits, owners), "owner long, chunk long, gram binary, reach binary, doc binary, place binary")
    decided = saved(left.groupBy("owner").applyInPandas(_decider(hot_bucket), "chunk long, full binary, few binary, many binary"), "suffix_decided")

    def asked(column: str) -> DataFrame:
        places = decided.where(F.length(column) > 0).groupBy("chunk").agg(F.collect_list(column).alias("asked"))
        return chunks.select(*opened).join(places.hint("shuffle_hash"), "chunk").mapInPandas(_contexts(length), "gram long, doc long, chunk long, place int, low int, high int, bytes binary")

    found = [saved(_refined(asked("few"), length), "suffix_refined")]
    if not decided.where(F.length("many") > 0).isEmpty():
        found.append(saved(_split(saved(asked("many"), "suffix_hot"), length, hot_bucket, hot_rows), "suffix_refined"))
    windows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    windows = windows.groupBy("chunk").agg(F.collect_list(F.struct("place", "bits")).alias("windows"))
    full = decided.where(F.length("full") > 0).groupBy("chunk").agg(F.collect_list("full").alias("full"))
    replies = saved(answers.join(full, "chunk", "left").join(windows, "chunk", "left"), "suffix_replies")
    done = chunks.select(*opened).join(replies.hint("shuffle_hash"), "chunk", "left")
    kinds = "doc long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary"
    return done.mapInPandas(_finisher(length, bits, owners), kinds).select(F.nullif("doc", F.lit(NO_ID)).alias("id"), "n_bytes", "spans", "kept")
