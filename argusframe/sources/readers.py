"""Sources: files, directories, listeners and exports, as batch or streaming frames of raw lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..shared import saved


def _with_metadata(df: DataFrame, source: str, collector: str) -> DataFrame:
    return df.select(F.col("value").alias("raw"), F.create_map(F.lit("source"), F.lit(source), F.lit("collector"), F.lit(collector)).alias("metadata"), F.current_timestamp().alias("ingest_time"))


def read_lines(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, streaming: bool = False) -> DataFrame:
    """Lines of a file or directory, compressed ones too."""
    reader = (spark.readStream if streaming else spark.read).option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return _with_metadata(reader.format("text").load(path), path, "directory" if pattern or recursive else "file")


def read_table(spark: SparkSession, path: str, kind: str = "csv", delimiter: str = ",", schema: str | None = None) -> DataFrame:
    """CSV or TSV with a header, JSON lines, or Parquet."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.csv(path, header=True, sep="\t" if kind == "tsv" else delimiter)
    return reader.json(path) if kind == "json" else reader.parquet(path)


def read_records(spark: SparkSession, path: str, root: str | None = None, lines: bool = False) -> DataFrame:
    """Exports of cloud logs: JSON documents whose records lie in the array `root`; one row for each record, as JSON.

    A file is one document, on any number of lines, or with `lines` has one on each line; such files are read in parts by many tasks.
    """
    docs = spark.read.text(path, wholetext=not lines, lineSep="\n" if lines else None)
    records = F.from_json(F.get_json_object("value", f"$.{root}") if root else F.col("value"), "array<string>")
    return _with_metadata(docs.select(F.explode(records).alias("value")), path, "export")


_SIGNS = re.compile(r'\\.|["{}\[\]]', re.S)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\Z')


def _walked(text: str, quoted: bool, depth: int) -> Iterator[tuple[int, str, bool, int]]:
    """(place, sign, whether a text is open after it, depth after it) of each sign that counts."""
    for m in _SIGNS.finditer(text):
        c = m[0]
        if c == '"':
            quoted = not quoted
        elif quoted or c[0] == "\\":
            continue
        else:
            depth += 1 if c in "{[" else -1
        yield m.start(), c, quoted, depth


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, str]]:
    for rows in batches:
        yield from zip(rows["file"], rows["begin"], rows["value"], strict=True)


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each block does to the state before it: whether a text is open at its end and how much deeper it ends, if none was open at its start and if one was."""
    found: dict[tuple[str, int], list] = {}
    for file, begin, value in _blocks(batches):
        states = found.setdefault((file, begin), [[False, 0], [True, 0]])
        for s in states:
            for _, _, s[0], s[1] in _walked(value, s[0], s[1]):
                pass
    yield pd.DataFrame([(f, b, x[0], x[1], y[0], y[1]) for (f, b), (x, y) in found.items()], columns=["file", "begin", "quoted0", "deeper0", "quoted1", "deeper1"])


def _opened(starts: dict[tuple[str, int], tuple[bool, int]]):
    """The key of the last array that each block opens one level down, None if it opens none."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[str, int], str | None] = {}
        at, state = None, (False, 0)
        for file, begin, value in _blocks(batches):
            if at != (file, begin):
                at = (file, begin)
                state = starts[at]
                found[at] = None
            for place, c, quoted, depth in _walked(value, *state):
                state = (quoted, depth)
                if c == "[" and depth == 2:
                    m = _KEY.search(value, 0, place)
                    found[at] = m[1] if m else ""
        yield pd.DataFrame([(f, b, k) for (f, b), k in found.items()], columns=["file", "begin", "key"])

    return opened


def _cut(starts: dict[tuple[str, int], tuple[bool, int]], keys: dict[tuple[str, int], str], root: str | None):
    """Records of each block: whole ones, and the parts of those that go on from the block before or into the next."""
    level = 1 if root is None else 2

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, out, state, inside, held, first = None, [], (False, 0), False, [], False

        def flush(kind: str) -> None:
            nonlocal held, first
            text = ",".join(held)
            if kind != "tail" and first:
                kind = "head"
            if text.strip() or kind in ("head", "tail"):
                out.append((*at, kind, text))
            held, first = [], False

        def end() -> None:
            # what is open at a block's end goes on in the next; all of a block may lie within one record
            if at is not None and inside and (held or first):
                if first:
                    out.append((*at, "middle", ",".join(held)))
                else:
                    flush("tail")

        for file, begin, value in _blocks(batches):
            if at != (file, begin):
                end()
                at, held = (file, begin), []
                state = starts.get(at, (False, 0))
                inside = state[1] >= level and (root is None or keys.get(at) == root)
                first = inside and (state[0] or state[1] > level)
            start = 0
            for place, c, quoted, depth in _walked(value, *state):
                if c == "[" and depth == level and not inside and (root is None or (m := _KEY.search(value, 0, place)) and m[1] == root):
                    inside, start, held = True, place + 1, []
                elif c == "]" and depth == level - 1 and inside:
                    held.append(value[start:place])
                    flush("whole")
                    inside = False
                state = (quoted, depth)
            if inside:
                held.append(value[start:])
                if not state[0] and state[1] == level:
                    flush("whole")
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["file", "begin", "kind", "value"])
                out = []
        end()
        yield pd.DataFrame(out, columns=["file", "begin", "kind", "value"])

    return cut


def _joined(parts: pd.DataFrame) -> pd.DataFrame:
    """Records of one file that lie in several blocks, from their parts."""
    out, held = [], []
    order = {"head": 0, "middle": 1, "tail": 2}
    for r in parts.assign(o=parts.kind.map(order)).sort_values(["begin", "o"]).itertuples(index=False):
        if r.kind == "tail":
            held = [r.value]
        else:
            held.append(r.value)
            if r.kind == "head":
                out.append(",".join(held))
                held = []
    return pd.DataFrame({"value": out})


def read_array(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """As read_records, for documents of any size: a file is read in blocks by many tasks, and no task holds more than one record and one block's line.

    root: a key of the document, or None for a document that is an array. Spark reads the text between commas; whether a
    block begins within a quoted text, and how deep, follows from what each block before it does to both states, a row for
    each block. Records that lie in several blocks are put together from their parts.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value", F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_length").alias("part"))
    several = pieces.where("part < size").select("file", "begin", "value")
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    at, state = None, (False, 0)
    for r in sorted(several.mapInPandas(_effects, "file string, begin long, quoted0 boolean, deeper0 long, quoted1 boolean, deeper1 long").collect(), key=lambda r: (r.file, r.begin)):
        state = state if r.file == at else (False, 0)
        at = r.file
        starts[r.file, r.begin] = state
        state = (r.quoted1, state[1] + r.deeper1) if state[0] else (r.quoted0, state[1] + r.deeper0)
    keys: dict[tuple[str, int], str] = {}
    if root is not None and starts:
        key = None
        for r in sorted(several.mapInPandas(_opened(starts), "file string, begin long, key string").collect(), key=lambda r: (r.file, r.begin)):
            key = key if r.begin else None
            keys[r.file, r.begin] = key
            key = r.key if r.key is not None else key
    found = saved(pieces.select("file", "begin", "value").mapInPandas(_cut(starts, keys, root), "file string, begin long, kind string, value string"), "records")
    joined = found.where("kind != 'whole'").groupBy("file").applyInPandas(_joined, "value string")
    return _with_metadata(found.where("kind = 'whole'").select(F.trim("value").alias("value")).unionByName(joined.select(F.trim("value").alias("value"))), path, "export")


def read_tables(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Exports of log queries: JSON documents of tables, each with columns and rows; one row for each, as JSON with the columns' names. lines: as in read_records."""
    docs = spark.read.text(path, wholetext=not lines, lineSep="\n" if lines else None)
    kind = "struct<tables: array<struct<columns: array<struct<name: string>>, rows: array<array<string>>>>>"
    tables = docs.select(F.explode(F.from_json("value", kind)["tables"]).alias("t"))
    rows = tables.select(F.col("t.columns.name").alias("names"), F.explode("t.rows").alias("cells"))
    fits = F.transform(F.col("names"), lambda _, i: F.get("cells", i))  # a short row has nulls at its end
    return _with_metadata(rows.select(F.to_json(F.map_from_arrays("names", fits)).alias("value")), path, "export")


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Newline-framed syslog over TCP."""
    return _with_metadata(spark.readStream.format("socket").option("host", host).option("port", port).load(), f"{host}:{port}", "syslog")


def rows_of(spark: SparkSession, lines: list[str], source: str = "api") -> DataFrame:
    """Lines given by a caller, split at newlines."""
    return _with_metadata(spark.createDataFrame([(x,) for x in lines], "value string").select(F.explode(F.split("value", "\n")).alias("value")).where("value != ''"), source, "webhook")


class PollSource(DataSource):
    """`http_poll`: a URL polled for JSON lines; the offset is the number of records read, sent as `since`."""

    @classmethod
    def name(cls) -> str:
        return "http_poll"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema):
        return _PollReader(self.options)


class _PollReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.url = options["url"]

    def initialOffset(self) -> dict:
        return {"since": 0}

    def _get(self, since: int) -> list[str]:
        from urllib.request import urlopen

        with urlopen(f"{self.url}{'&' if '?' in self.url else '?'}since={since}", timeout=30) as answer:
            return [x for x in answer.read().decode().split("\n") if x]

    def read(self, start: dict):
        lines = self._get(start["since"])
        return iter([(x,) for x in lines]), {"since": start["since"] + len(lines)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(x,) for x in self._get(start["since"])[: end["since"] - start["since"]]])

    def commit(self, end: dict) -> None:
        pass


def simulated(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n lines of five kinds, alike for one seed."""
    i = F.col("id")
    ip = F.concat(F.lit("10.0."), (i % 7).cast("string"), F.lit("."), (F.pmod(F.xxhash64(i + seed), F.lit(250)) + 1).cast("string"))
    kind = F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(5))
    line = (
        F.when(kind == 0, F.concat(F.lit("<34>Jan 15 10:30:00 host"), (i % 9).cast("string"), F.lit(" sshd[12]: Failed password for root from "), ip))
        .when(kind == 1, F.concat(F.lit('{"source_ip":"'), ip, F.lit('","action":"logon","severity":"high"}')))
        .when(kind == 2, F.concat(F.lit("CEF:0|Acme|Wall|1.0|100|Blocked|7|src="), ip, F.lit(" dst=8.8.8.8 act=deny")))
        .when(kind == 3, F.concat(ip, F.lit(' - - [15/Jan/2024:10:30:00 +0000] "GET /index.html HTTP/1.1" 200 512 "-" "curl"')))
        .otherwise(F.concat(F.lit("date=2024-01-15 time=10:30:00 src="), ip, F.lit(" dst=10.0.0.1 action=allow")))
    )
    return spark.range(n).select(line.alias("raw"))
