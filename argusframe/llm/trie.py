"""Prefix trie of conversations, family by family.

A family is what shares a base id: twenty conversations at most, which may
open with turns of their base. Turns are sent to their family as digests and
word counts, never as texts. A task rebuilds the conversations of a family and
builds the family's small trie; only its combined nodes are shuffled, and
nodes of equal paths merge.

Sums over subtrees are mostly known within a family already. What families
add up wrongly, a node that several of them have counted as their own each, is
put right by one number for each shared node, which is passed to all nodes
above it in steps of 1, 2, 4, ... levels.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, WORD, met, saved, text_of

#: Conversations of a family, and the most turns that one takes from the base (less one).
FAMILY, OPENINGS = 20, 4
#: Ids that are joined in one text before they are hashed.
IDS_AT_ONCE = 4096
ROOT = bytes(16)

_NODES = "key binary, parent binary, depth long, conv long, n long, words long, total long, own long, leaf long, leaves long, ends array<long>"


def opening(conv: int) -> int:
    """Turns that a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % OPENINGS


def _trie(base: int, convs: list[tuple[int, list[bytes], list[int]]]) -> list[list]:
    """A family's nodes, parents first. convs: id, digests and word counts of the original turns; the base comes first, if it is there."""
    first = list(zip(convs[0][1][: OPENINGS - 1], convs[0][2][: OPENINGS - 1], strict=True)) if convs[0][0] == base else []
    nodes, place, up = [[ROOT, None, 0, convs[0][0], 0, 0, 0, 0, 1, 0, []]], {ROOT: 0}, [0]
    for conv, digests, words in convs:
        h = opening(conv)
        at, path = 0, [0]
        for digest, n in [*first[:h], *zip(digests[h:], words[h:], strict=True)]:
            key = hashlib.blake2b(nodes[at][0] + digest, digest_size=16).digest()
            if key not in place:
                place[key] = len(nodes)
                nodes[at][8] = 0
                nodes.append([key, nodes[at][0], nodes[at][2] + 1, conv, 0, n, 0, 0, 1, 0, []])
                up.append(at)
            at = place[key]
            path.append(at)
        nodes[at][10].append(conv)
        rest = 0
        for i in reversed(path):
            node = nodes[i]
            rest += node[5]
            node[3], node[4], node[6] = min(node[3], conv), node[4] + 1, node[6] + rest
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node[7] += node[5]
        node[9] += node[8]
        if i:
            nodes[up[i]][7] += node[7]
            nodes[up[i]][9] += node[9]
    return nodes


def _families(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come family by family and conversation by conversation, in order; one family's digests are held at a time."""
    names = [c.split()[0] for c in _NODES.split(", ")]
    base, convs, found = None, [], []
    for rows in batches:
        for family, conv, digest, n in zip(rows["family"], rows["conv"], rows["digest"], rows["words"], strict=True):
            if family != base:
                found += _trie(base, convs) if convs else []
                base, convs = family, []
            if not convs or convs[-1][0] != conv:
                convs.append((conv, [], []))
            convs[-1][1].append(bytes(digest))
            convs[-1][2].append(n)
        if len(found) > 10_000:
            yield pd.DataFrame(found, columns=names)
            found = []
    if convs:
        yield pd.DataFrame(found + _trie(base, convs), columns=names)


def family_nodes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each family's nodes: key of the path, its parent's, and what the family's members add to them."""
    who, what = text_of(role), text_of(text)
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256)), 1, 16)
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(what, F.lit(WORD)).cast("long").alias("words"))
    rows = rows.withColumn("family", F.col("conv") - F.col("conv") % FAMILY).repartition("family")
    rows = rows.sortWithinPartitions("family", F.col("conv") != F.col("family"), "conv", F.asc_nulls_first("turn"), "digest")
    return rows.select("family", "conv", "digest", "words").mapInPandas(_families, _NODES)


def _carried(nodes: DataFrame, values: tuple[str, ...], hot_rows: int) -> DataFrame:
    """nodes: key, parent, depth and values. Returns key and the values summed over each node's descendants in nodes, itself included.

    nodes must hold the parents of all that they hold. After a step of s levels a node has the sums of what lies fewer
    than 2 s levels below it.
    """
    at = saved(nodes.select("key", "depth", F.when(F.col("depth") >= 1, F.col("parent")).alias("to"), *values), "trie_sums")
    deepest, step = at.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        below = at.where("to IS NOT NULL").groupBy(F.col("to").alias("key")).agg(*(F.sum(v).alias(f"_{v}") for v in values), F.count("*").alias("n"))
        summed = at.join(saved(below, "trie_below"), "key", "left").withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values})
        summed = saved(summed.select("key", "depth", "to", "n", *values), "trie_sums")
        further = summed.where(F.col("depth") >= 2 * step).select("key", F.col("to").alias("via"))
        targets = summed.where("n IS NOT NULL").select(F.col("key").alias("via"), F.col("to").alias("next"), "n")
        hops = met(further, targets, "via", hot_rows).select("key", "next")
        at = saved(summed.drop("to", "n").join(hops, "key", "left").withColumnRenamed("next", "to"), "trie_sums")
        step *= 2
    return at.select("key", *values)


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's texts, comma-joined; they come in order, and only the hash is held."""
    key, digest = None, None
    for rows in batches:
        done = []
        for k, text in zip(rows["key"], rows["ids"], strict=True):
            if k != key:
                done += [(key, digest.hexdigest())] if digest else []
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pd.DataFrame(done, columns=["key", "sha"])
    if digest:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "sha"])


def _ends(nodes: DataFrame, ids_at_once: int) -> DataFrame:
    """key and sha: of the ids that end at a node, ascending and comma-joined. A node without such ids has no row."""
    ids = nodes.select("key", F.explode("ends").alias("id"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    blocks = saved(ids.groupBy("key", F.floor(F.col("id") / ids_at_once).alias("block")).agg(joined.alias("ids")), "trie_ends")
    counted = saved(blocks.groupBy("key").agg(F.count("*").alias("n"), F.min("block").alias("block")), "trie_ends")
    one = blocks.join(counted.where("n = 1").select("key", "block"), ["key", "block"]).select("key", F.sha2("ids", 256).alias("sha"))
    many = blocks.join(counted.where("n > 1").select("key"), "key", "left_semi").repartition("key").sortWithinPartitions("key", "block")
    return one.unionByName(many.mapInPandas(_streamed, "key binary, sha string"))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hot_rows: int = HOT_ROWS, ids_at_once: int = IDS_AT_ONCE) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, with their smallest member, counts and subtree sums.

    A conversation's turns are ordered by turn, null first; rows of one turn by the digest of role and text, repeated rows
    stay. Null role or text counts as empty. Rows without a conversation id belong to none and play no part. An empty
    table has no node, not even a root. Columns of turns that are not named play no part, whatever their names.
    """
    families = saved(family_nodes(turns, conv, turn, role, text), "trie_families")
    sums = [F.sum(c).alias(c) for c in ("n", "total", "own", "leaf", "leaves")]
    merged = families.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.max("words").alias("words"), F.count("*").alias("shared"), *sums)
    children = families.where("parent IS NOT NULL").select("key", "parent").distinct().groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"))
    nodes = saved(merged.join(children, "key", "left").withColumn("children", F.coalesce("children", F.lit(0))), "trie_nodes")
    repeated = (F.col("shared") - 1) * F.col("words")
    leaf_too_many = F.col("leaf") - (F.col("children") == 0).cast("long")
    extra = _carried(nodes.where("shared > 1").select("key", "parent", "depth", repeated.alias("repeated"), leaf_too_many.alias("too_many")), ("repeated", "too_many"), hot_rows)
    parents = nodes.where("children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"), F.col("children").alias("n"))
    plain = nodes.withColumnRenamed("n", "members")
    placed = met(plain.where("depth > 0"), parents, "parent", hot_rows).unionByName(plain.where("depth = 0").withColumn("parent_conv", F.lit(None).cast("long")))
    full = placed.join(extra, "key", "left").join(_ends(families, ids_at_once), "key", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    columns: dict[str, Column] = {
        "conv_id": F.col("conv"), "depth": F.col("depth"), "parent_conv_id": F.col("parent_conv"), "n_convs": F.col("members"), "n_children": F.col("children"),
        "n_leaves": F.col("leaves") - none("too_many"), "saved_tokens": F.col("total") - F.col("own") + none("repeated"), "ends_sha256": F.coalesce("sha", F.sha2(F.lit(""), 256)),
    }
    return full.select(*(c.alias(k) for k, c in columns.items()))
