import random

import numpy as np
import pytest

from argusframe.llm import suffix_dedup as sd


def plain(rows, length):
    """Spans and kept bytes of each row, from the smallest id of every string."""
    ids = [i if i is not None else sd.NO_ID for i, _ in rows]
    data = [(t or "").encode() for _, t in rows]
    least = {}
    for i, b in zip(ids, data, strict=True):
        for p in range(len(b) - length + 1):
            least[b[p : p + length]] = min(i, least.get(b[p : p + length], i))
    out = []
    for (i, _), key, b in zip(rows, ids, data, strict=True):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < key:
                gone[p : p + length] = [True] * length
        spans, start = [], None
        for p, x in enumerate([*gone, False]):
            if x and start is None:
                start = p
            if not x and start is not None:
                spans.append((start, p))
                start = None
        out.append((i, len(b), spans, bytes(c for c, x in zip(b, gone, strict=True) if not x)))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, chunk string, doc string, gram string").repartition(4)
    found = sd.suffix_dedup(df, **options).collect()
    return sorted(((r.id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found), key=repr)


def made(seed):
    """Passages of 20 to 400 bytes at random places, copies, near copies, runs of one letter, and bytes of several to a character."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(pick.randint(4, 80)) for _ in range(12)] + ["q" * 70, "\x00" * 60, "ab" * 40]
    rows = [(i, text(pick.randint(0, 60)) + "".join(pick.choice(shared) + text(pick.randint(0, 12)) for _ in range(pick.randint(0, 4)))) for i in range(60)]
    base = text(80)
    for i in range(60, 90):
        w = base.split(" ")
        w[pick.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, shared[0]) for i in (200, 201, 202)] + [(203, None), (204, ""), (None, base), (None, base), (7, rows[3][1]), (3, rows[3][1]), (90, "q" * 500)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 32_768), (2, 3)])
def test_against_all_strings(spark, monkeypatch, seed, hot):
    """Small chunks, so that strings meet across them; in the second case buckets are split down to single strings."""
    monkeypatch.setattr(sd, "CHUNK", 1500)
    rows = made(seed)
    assert got(spark, rows, hot_bucket=hot, hot_rows=hot) == plain(rows, 50)


def test_a_line_in_all_documents(spark, monkeypatch):
    """One gram in one bucket of a thousand different surroundings, and no string of 50 bytes but within copies."""
    monkeypatch.setattr(sd, "CHUNK", 4000)
    pick = random.Random(5)
    noise = lambda n: "".join(pick.choice("abcdefghij") for _ in range(n))
    rows = [(i, noise(60) + "the line that all of them have" + noise(60)) for i in range(300)]
    rows += [(1000 + i, rows[i][1][40:] + noise(9)) for i in range(0, 300, 7)]
    assert got(spark, rows, hot_bucket=20, hot_rows=50) == plain(rows, 50)


def test_ends(spark):
    """No rows; empty and null texts only; texts of 49, 50 and 51 bytes; a very long text of one word."""
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, [], b""), (2, 0, [], b"")]
    line = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNO"
    rows = [(i, line[:n]) for i, n in enumerate((49, 50, 51, 51, 50, 49))]
    assert got(spark, rows) == plain(rows, 50)
    long = [(1, "word " * 200_000), (2, "word " * 11)]
    found = got(spark, long)
    assert [(r[0], r[2]) for r in found] == [(1, []), (2, [(0, 55)])]


def test_pointers_are_equal_for_equal_strings_only():
    data = np.frombuffer(random.Random(1).randbytes(40 * 76), np.uint8).reshape(40, 76) % 2
    found = sd.pointers(data, 50)
    strings = [[bytes(r[k : k + 50]) for k in range(27)] for r in data]
    assert len({s for r in strings for s in r}) == len(np.unique(found))
    assert len({(s, p) for r, q in zip(strings, found, strict=True) for s, p in zip(r, q, strict=True)}) == len(np.unique(found))
