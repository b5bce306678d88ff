import hashlib
import random
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from argusframe.llm import trie
from argusframe.llm.queries_conversations import OP13_SQL
from tests.oracle import rows_of


def plain(rows):
    """All nodes from all prefixes of all rebuilt conversations. rows: conv_id, turn, role, text, with distinct turns."""
    turns = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            turns[c].append((r or "", x or ""))
    members = defaultdict(list)
    whole = {c: tuple((turns.get(c - c % 20, [])[: trie.opening(c)]) + own[trie.opening(c) :]) for c, own in turns.items()}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        here = (0 if children[p] else 1, (len(members[p]) - 1) * len(p[-1][1].split()) if p else 0)
        return tuple(map(sum, zip(here, *(below(q) for q in children[p]), strict=True)))

    out = []
    for p, who in members.items():
        leaves, tokens = below(p)
        ends = ",".join(map(str, sorted(c for c in who if len(whole[c]) == len(p))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), leaves, tokens, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, convs, texts, most):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(200), convs):
        kept = [("user" if t % 2 == 0 else None, pick.choice(texts)) for t in range(pick.randint(1, most))]
        rows += [(c, t if t else None, *r) for t, r in enumerate(kept)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "texts"), [(1, ["a", "b c", None, ""]), (2, ["one two"]), (3, [f"t{i} x" for i in range(40)])])
def test_trie_against_all_prefixes_and_sql(spark, seed, texts):
    """Deep shared paths, one path for all, and mostly single ones; hot nodes and long lists of ends are split."""
    rows = made(seed, 120, texts, 9) + [(1000 + 20 * i, t, "user", "same") for i in range(40) for t in range(12)] + [(None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = trie.prefix_trie(df, hot_rows=4, ids_at_once=16).toPandas()
    as_rows = sorted((tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in got.itertuples(index=False)), key=repr)
    assert as_rows == plain(rows)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    assert rows_of(con.sql(OP13_SQL).df()) == rows_of(got)


def test_trie_of_odd_tables(spark):
    """No rows; a conversation that is left without turns; repeated rows; a very long text and a long conversation; columns with inner names."""
    make = lambda rows: spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n long")
    assert trie.prefix_trie(make([])).collect() == []
    lone = next(c for c in range(1, 20) if trie.opening(c) == 3)
    only = trie.prefix_trie(make([(lone, 1, "user", "gone")])).collect()
    assert [tuple(r) for r in only] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    twice = trie.prefix_trie(make([(0, 1, None, None)] * 3 + [(20, t, "user", "w " * 30_000) for t in range(300)])).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in twice)[:4] == [(0, 0, 2), (0, 1, 1), (0, 2, 1), (0, 3, 1)]
    assert max(r.depth for r in twice) == 300
