"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each partition hashes its texts; the rows are written once, bucketed by
   partition, and never shuffled as a whole.
2. A partition sends each owner of a fingerprint range its distinct
   fingerprints of that range, sorted and Golomb-coded.
3. An owner answers every sender with a bitmap of the fingerprints that more
   than one partition holds.
4. Rows that the bitmaps mark are suspects; only their texts are shuffled and
   compared byte by byte, after map-side aggregation of equal ones.

A fingerprint has 16 bits more than the number of rows has, so about one row
in 65,000 is a false suspect; comparing the texts clears it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import placed, saved, text_of
from .golomb import rice_decode, rice_encode

#: Rows of a bucket, and fingerprints of an owner, that a Python worker holds at once (24 bytes each).
ROWS_AT_ONCE = 500_000
#: Parts that the rows of one group of copies are split into where they meet their group.
SALTS = 16


def _cut(bits: int, owners: int):
    """Fingerprint to its leading bits; leading bits to owner."""
    width = -(-(1 << bits) // owners)

    def head(fp: np.ndarray) -> np.ndarray:
        return (fp.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)

    return head, lambda values: values // width


def _encoder(bits: int, owners: int):
    head, owner_of = _cut(bits, owners)

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(head(rows.fp.to_numpy(np.int64)))
        who, start = np.unique(owner_of(values), return_index=True)
        parts = np.split(values, start[1:])
        return pd.DataFrame({"bucket": rows.bucket.iloc[0], "owner": who, "blob": [rice_encode(x) for x in parts]})

    return encode


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """What an owner answers: for each sender, a bit for each fingerprint that it sent."""
    sent = [rice_decode(x) for x in rows.blob]
    _, index, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    parts = np.split((count > 1)[index], np.cumsum([len(x) for x in sent])[:-1])
    return pd.DataFrame({"bucket": rows.bucket, "owner": rows.owner, "bitmap": [np.packbits(x).tobytes() for x in parts]})


def _marker(bits: int, owners: int):
    head, owner_of = _cut(bits, owners)

    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """One row for the bucket: its scan partitions, where each starts, and a bit for each row."""
        if rows.empty:
            return pd.DataFrame({"bucket": [], "parts": [], "starts": [], "words": []})
        values, index, count = np.unique(head(rows.fp.to_numpy(np.int64)), return_inverse=True, return_counts=True)
        twice = count > 1
        bitmap = dict(zip(answers.owner, answers.bitmap, strict=True))
        who, start = np.unique(owner_of(values), return_index=True)
        for owner, where in zip(who, np.split(np.arange(len(values)), start[1:]), strict=True):
            twice[where] |= np.unpackbits(np.frombuffer(bitmap[owner], np.uint8), count=len(where)).astype(bool)
        part, pos = rows.part.to_numpy(np.int64), rows.pos.to_numpy(np.int64)
        parts = np.unique(part)
        size = np.zeros(len(parts), np.int64)
        np.maximum.at(size, np.searchsorted(parts, part), pos + 1)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        flags = np.zeros(-(-int(size.sum()) // 64) * 64, np.uint8)
        flags[starts[np.searchsorted(parts, part)] + pos] = twice[index]
        words = np.packbits(flags, bitorder="little").view(np.int64)
        return pd.DataFrame({"bucket": [rows.bucket.iloc[0]], "parts": [parts], "starts": [starts], "words": [words]})

    return mark


def _marked(docs: DataFrame, text: Column, bits: int | None) -> DataFrame:
    """docs as struct row, with fp, sha, uid and suspect."""
    body = text_of(text)
    rows = placed(docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(body).alias("fp"), F.sha2(body, 256).alias("sha")), "exact_dedup", ROWS_AT_ONCE)
    n = rows.count()
    owners = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS_AT_ONCE))
    bits = bits or min(63, 16 + max(1, n).bit_length())
    sent = rows.select("bucket", "fp").groupBy("bucket").applyInPandas(_encoder(bits, owners), "bucket int, owner long, blob binary")
    answers = sent.groupBy("owner").applyInPandas(_answer, "bucket int, owner long, bitmap binary")
    marks = (
        rows.select("bucket", "part", "pos", "fp").groupBy("bucket").cogroup(answers.groupBy("bucket"))
        .applyInPandas(_marker(bits, owners), "bucket int, parts array<long>, starts array<long>, words array<long>")
    )
    bit = "(starts[cast(array_position(parts, cast(part AS bigint)) AS int) - 1] + pos)"
    suspect = F.expr(f"shiftright(words[cast({bit} div 64 AS int)], cast({bit} % 64 AS int)) & 1L = 1L")
    return rows.join(saved(marks, "exact_dedup_marks"), "bucket").withColumn("suspect", suspect)


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int | None = None) -> DataFrame:
    """Every row of docs as struct `row`, with keep_id, group_size, kept and sha.

    Rows are one group when their texts are the same bytes (null: empty). The row with the largest id stays; a null
    id counts as smaller than any, and of rows that share the largest id one stays. An empty table gives no rows.
    Columns of docs keep their names inside `row`, whatever they are. bits: of a fingerprint, for tests.
    """
    marked = _marked(docs, F.col(text_column), bits)
    id_of, body = F.col("row").getField(id_column), text_of(F.col("row").getField(text_column))
    suspects = marked.where("suspect")
    equal = (
        suspects.groupBy("fp", body.alias("body"))
        .agg(F.max(F.struct(id_of.alias("id"), "uid")).alias("keep"), F.count("*").alias("group_size"))
        .select("fp", F.sha2("body", 256).alias("sha"), "keep", "group_size")
    )
    salted = equal.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    met = (
        suspects.select("row", "fp", "sha", "uid", F.pmod("uid", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["fp", "sha", "salt"])
        .select("row", F.col("keep.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "sha")
    )
    alone = marked.where("not suspect").select("row", id_of.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(met)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    return exact_groups(docs, id_column, text_column).where("kept").select("row.*")
