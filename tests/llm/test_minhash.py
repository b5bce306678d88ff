import random

import numpy as np
import pytest

import corpus_pipeline
from argusframe.llm import minhash, simhash


def plain(rows):
    """The smallest id of each group that pairs of similarity 0.8 link, from all pairs."""
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    token = {t: k for k, t in enumerate({t for x in sets.values() for t in x})}
    has = np.zeros((len(ids), len(token)), np.float32)
    for row, i in enumerate(ids):
        has[row, [token[t] for t in sets[i]]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    for a, b in zip(*np.nonzero(np.triu(both.astype(float) / (size[:, None] + size[None, :] - both) >= 0.8, 1)), strict=True):
        x, y = sorted((find(ids[a]), find(ids[b])))
        root[y] = x
    return sorted({find(i) for i in root})


@pytest.mark.parametrize("hot", [32, 3])
def test_similar_dedup_against_all_pairs(spark, hot):
    """A large group of near copies, a chain, pairs on both sides of 0.8, and short, empty and null texts."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(50)] + [(100 + i, " ".join(f"c{k}" for k in range(8 * i, 8 * i + 200))) for i in range(8)]
    rows += [(200, " ".join(f"v{k}" for k in range(104))), (201, " ".join(f"v{k}" for k in range(104 + 25))), (202, " ".join(f"v{k}" for k in range(104 + 60)))]
    rows += [(300, "one two"), (301, "one two"), (302, "one three"), (303, None), (304, "")]
    got = simhash.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot_band=hot, hot_rows=hot)
    assert sorted(r.doc_id for r in got.collect()) == plain(rows) == [0, 100, 200, 202, 300, 302, 303]


def test_the_stage_drops_near_copies(spark):
    """Texts of the test table whose shingles are similar, but whose SimHashes are more than two bits apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id IN (56, 914, 643, 770, 709, 944, 3, 4)")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert not {914, 770, 944} & set(want)
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == want


def changed(seed, n, words, changes):
    """n copies of a text of so many words with some of them changed, side by side or not."""
    pick = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        w, c = list(base), pick.choice(changes)
        begin = pick.randrange(words)
        for k in pick.sample(range(words), c) if pick.random() < 0.5 else range(begin, min(begin + c, words)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "cell"), [(33, 2048), (600, 2048), (3000, 4096)])
def test_groups_around_the_threshold(spark, n, cell):
    """Copies with 3 to 6 of 120 words changed, of which few pairs are similar enough: as many merges as all pairs give, however rows are dealt."""
    rows = changed(n, n, 120, (3, 4, 5, 6))
    want = plain(rows)
    for parts in (2, 11) if n == 600 else (4,):
        got = simhash.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), cell_rows=cell)
        assert sorted(r.doc_id for r in got.collect()) == want
    assert 1 < len(want) < n


@pytest.mark.parametrize("cell", [20])
def test_cells_that_are_split(spark, cell):
    """Keys too large for a cell, with copies so close that they stay together in all splits, and a few that are linked through others only."""
    rows = changed(1, 400, 150, (0, 1, 1, 2, 3)) + [(1000 + i, f"{t} tail {'of words ' * (i % 7)}") for i, t in changed(2, 60, 150, (1, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(r.doc_id for r in simhash.similar_dedup(df.repartition(p), hot_band=8, cell_rows=cell, hot_rows=50).collect()) for p in (3, 8)]
    assert got[0] == got[1] == plain(rows)


def test_links_of_a_cell_against_all_pairs():
    """Chains, lone rows, equal sets; and with some rows compared with all others only."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(80)] + [np.arange(100 + i, 180 + i) for i in range(0, 60, 8)] + [np.array([7])] * 3
    sets = [s.astype(np.int64) for s in sets]
    for firsts in (len(sets), 30, 1, 0):
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(firsts):
            for b in range(len(sets)):
                both = len(np.intersect1d(sets[a], sets[b]))
                if both / (len(sets[a]) + len(sets[b]) - both) >= 0.6:
                    root[max(find(a), find(b))] = min(find(a), find(b))
        want = {frozenset(k for k in range(len(sets)) if find(k) == r) for r in set(map(find, range(len(sets))))}
        group = {k: {k} for k in range(len(sets))}
        for a, b in minhash.linked(np.arange(len(sets)), sets, 0.6, firsts):
            merged = group[a] | group[b]
            for k in merged:
                group[k] = merged
        assert {frozenset(g) for g in group.values()} == want
