from pathlib import Path

from argusframe.llm import licences, registry

from ..oracle import agree


def test_entire_published_texts(spark):
    """Each published text, titles of the short ones, and a line that reserves all rights below the copyright line."""
    folder, short = Path(licences.__file__).parent / "licence_texts", {n: t for n, t in reversed(licences.KNOWN) if n in licences.TITLES and len(t) > 500}
    cases = [(n, (folder / f).read_text("utf-8")) for f, n in licences.TEXTS.items()]
    cases += [(n, f"{title}\n\nCopyright (c) 2020, Someone\n\n{short[n]}") for n, titles in licences.TITLES.items() for title in titles]
    cases += [("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n{short['BSD-3-Clause']}")]
    apache = next(t for n, t in cases if n == "Apache-2.0")
    cases += [("Apache-2.0", apache[: apache.index("APPENDIX")]), (None, apache + "\nand more"), (None, short["MIT"] + "\nAll rights reserved.")]
    got = {r.id: r.licence for r in licences.licences(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [n for n, _ in cases]


def test_whole_texts_agree_with_sql(spark, tmp_path):
    """Every known text as it is, in capitals, under a copyright line that reserves all rights, and with a word more; odd rows, and columns named as inner ones."""
    texts = [t for _, t in licences.bodies()]
    held = "Copyright (c) 2024 A. Person\nAll rights reserved.\n"
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.upper()) for i, t in enumerate(texts)] + [(200 + i, held + t) for i, t in enumerate(texts)] + [(300 + i, f"{t}\nand more") for i, t in enumerate(texts)]
    rows += [(None, None), (None, ""), (1, "All rights reserved."), (1, "All rights reserved."), (2, "Released under the MIT License.\n" * 3 + "x " * 50_000), (3, held), (4, "\n\n")]
    names = "doc_id long, text string, digest string, licence string, notices string, uid string, lines string, body string, other string"
    spark.createDataFrame([(*r, *["MIT"] * 7) for r in rows], names).write.parquet(f"{tmp_path}/in")
    spark.read.parquet(f"{tmp_path}/in").coalesce(1).write.parquet(f"{tmp_path}/one")
    part = next((tmp_path / "one").glob("part-*.parquet"))
    (tmp_path / "sf").mkdir()
    part.rename(tmp_path / "sf/documents.parquet")
    found = {(r.doc_id, r.licence) for r in registry.queries()["op4_licences"](spark, f"{tmp_path}/sf").collect()}
    lost = [(n, licence) for k, (licence, _) in enumerate(licences.bodies()) for n in (k, 100 + k, 200 + k) if k > 4 and (n, licence) not in found]
    assert not lost
    agree(spark, registry.queries()["op4_licences"], registry.oracle_sql()["op4_licences"], f"{tmp_path}/sf")
