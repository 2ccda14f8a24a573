"""Quoted CSV and JSON arrays or objects, read by byte ranges.

Spark's text source cuts a large file into byte ranges at a separator: line feeds for CSV, commas for JSON. Whether a
separator ends a record depends on what stands before it, from the file's beginning on. So each range is read twice:

1. A range is summed up as a function: for each state in which it may begin, the state in which it ends and how many records
   it ends. A CSV range begins outside or inside of quotes. A JSON range begins outside or inside of a string, at a depth that
   only shifts its own; records end at commas one level deep, and these are counted for each level relative to the beginning.
2. Composing the functions from left to right over a file's ranges (a row a range) gives each range's true state and how many
   records end before it. With these the ranges are cut into records; the pieces of a record that crosses ranges meet by the
   record's number, and only they are shuffled.

So one large file is read by many tasks, and a task holds one range of it at a time.

Defined cases: quotes within an unquoted cell are text, as are separators within quotes; records may cross any number of
ranges; an empty file has no records; a JSON file has one array or one object, and null or scalar elements are records too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.common import shared_path

_PIECES = "file string, place long, ord long, first boolean, last boolean, text string, deep boolean, opened long"
_CUT_SCHEMA = pa.schema([("file", pa.string()), ("place", pa.int64()), ("ord", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("text", pa.string()), ("deep", pa.bool_()), ("opened", pa.int64())])


def _segments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(value, file, place): what stands between separators, in order within a range; place is where the range begins."""
    rows = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"))


def _ranges(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[tuple[tuple, Iterator[pa.Array]]]:
    """For each range of a task (file and place, the columns from `at` on, and what is known of it) its segments, a batch at a time."""

    def parts() -> Iterator[tuple[tuple, pa.Array]]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(max(n - 1, 0), bool)
            for c in (b.column(at), b.column(at + 1)):
                new |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), n]
            for begin, end in zip(edges, edges[1:], strict=False):
                yield tuple(b.column(i)[begin].as_py() for i in range(at, b.num_columns)), b.column(0).slice(begin, end - begin)

    for key, group in groupby(parts(), key=lambda p: p[0]):
        yield key, (values for _, values in group)


def _joined(values: pa.Array) -> bytes:
    """Segments of JSON with a comma after each, as bytes."""
    lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pc.binary_join(lists, pa.scalar(",", values.type))[0].as_buffer().to_pybytes() + b","


def _cut(segments: DataFrame, starts: DataFrame, state: list[str], f: Callable) -> DataFrame:
    """(file, ord, text, deep, opened): all records. f(segments of a range, state) gives (text, ends a record, and for JSON whether it
    is deep and what it opens) in turn."""
    s = starts.select(F.col("file").alias("of"), F.col("place").alias("at"), *state, "before")
    rows = segments.join(F.broadcast(s), (F.col("file") == F.col("of")) & (F.col("place") == F.col("at"))).select("value", "file", "place", *state, "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in _ranges(batches):
            file, place, *known, ord_ = key
            out: list[tuple] = []
            first = True  # whether the record may have begun in an earlier range
            for text, ends, *more in f(parts, *known):
                out.append((file, place, ord_, not first, ends, text, *(more or (True, 0))))
                first, ord_ = False, ord_ + 1
                if len(out) >= 1024:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    path = shared_path(segments.sparkSession, "pieces")  # they are read twice here, and by all that reads the records
    rows.mapInArrow(run, _PIECES).write.parquet(path)
    pieces = segments.sparkSession.read.schema(_PIECES).parquet(path)
    whole = pieces.where("first and last").select("file", "ord", "text", "deep", "opened")
    # the pieces of a record: the end of one range, ranges without any end, and the beginning of another
    rest = pieces.where("not (first and last)").groupBy("file", "ord").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"), F.bool_or("deep").alias("deep"), F.sum("opened").alias("opened"))
    return whole.union(rest.select("file", "ord", F.array_join(F.transform("p", lambda x: x["text"]), ""), "deep", "opened"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _CUT_SCHEMA, strict=True)], schema=_CUT_SCHEMA)


# -- CSV ---------------------------------------------------------------------------------------------------------------


class Quotes:
    """Whether a line of CSV ends inside of a quoted cell, from whether it begins in one."""

    def __init__(self, separator: str = ",", quote: str = '"'):
        q, s = re.escape(quote), re.escape(separator)
        self.quote = quote
        self.close = re.compile(f"(?:[^{q}]|{q}{q})*+{q}")  # to the end of a quoted cell
        self.plain = re.compile(f"[^{s}]*(?:{s}|$)")  # the rest of a cell, or all of an unquoted one

    def __call__(self, line: str, inside: bool) -> bool:
        if self.quote not in line:
            return inside
        at, n = 0, len(line)
        while at < n or inside:
            if not inside and line[at] == self.quote:
                at, inside = at + 1, True
            if inside:
                m = self.close.match(line, at)
                if m is None:
                    return True
                at, inside = m.end(), False
            m = self.plain.match(line, at)
            if m is None or m.end() == at:
                break
            at = m.end()
        return inside


def csv_records(spark: SparkSession, path: str, separator: str = ",", quote: str = '"') -> DataFrame:
    """(file, ord, text): the records of CSV files, headers among them, numbered from 0; line ends are line feeds, or a carriage return before them."""
    scan = Quotes(separator, quote)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, place), parts in _ranges(batches):
            state, ends = [False, True], [0, 0]
            for values in parts:
                for line in values.to_pylist():
                    state = [scan(line, x) for x in state] if quote in line else state
                    ends = [n + (not x) for n, x in zip(ends, state, strict=True)]
            yield pa.RecordBatch.from_pydict({"file": [file], "place": [place], "out": [state[0]], "out_n": [ends[0]], "in": [state[1]], "in_n": [ends[1]]})

    segments = _segments(spark, path, "\n")
    found = segments.mapInArrow(sums, "file string, place long, out boolean, out_n long, in boolean, in_n long")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("before"))
    per = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "out", "out_n", "in", "in_n"))).alias("r"))
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, r: F.concat(acc, F.array(F.struct(F.when(last(acc)["inside"], r["in"]).otherwise(r["out"]).alias("inside"), (last(acc)["before"] + F.when(last(acc)["inside"], r["in_n"]).otherwise(r["out_n"])).alias("before"))))
    known = per.select("file", "r", F.aggregate("r", F.array(start), step).alias("s"))
    starts = known.select("file", F.posexplode("r").alias("i", "r"), "s").select("file", "r.place", F.get("s", F.col("i"))["inside"].alias("inside"), F.get("s", F.col("i"))["before"].alias("before"))

    def cut(parts: Iterator[pa.Array], inside: bool) -> Iterator[tuple[str, bool]]:
        held: list[str] = []
        for values in parts:
            for line in values.to_pylist():
                inside = scan(line, inside)
                held.append(line)
                if not inside:
                    yield "\n".join(held), True
                    held = []
        if held:
            yield "\n".join(held) + "\n", False

    return _cut(segments, starts, ["inside"], cut)


def read_csv_ranges(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted cells over several lines and doubled quotes, as one reader of whole files gives it; ord in file order.

    Without a schema the columns are text, named by the first file's header. Blank records are skipped.
    """
    records = csv_records(spark, path).select("file", "ord", "text")
    cells = lambda c, kind: F.from_csv(F.regexp_replace(c, r"\r$", ""), kind, {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    if schema is None:
        names = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path).columns  # reads the first record alone
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        if not schema:
            return spark.createDataFrame([], "ord long")
    rows = records.where("ord > 0 and trim(text) not in ('', '\r')").select(cells(F.col("text"), schema).alias("r"), "file", (F.col("ord") - 1).alias("ord"))
    return _numbered(rows, path).select("r.*", "ord")


def _numbered(rows: DataFrame, path: str) -> DataFrame:
    """rows (file, ord, ...) of the files at path with ord over all files, in the order of their names; that of a single file stays."""
    plain = lambda n: re.sub("^([a-z]+):/+", r"\1:/", n)  # noqa: E731  Spark writes the same path with one slash and with three
    names = sorted({plain(n) for n in _segments(rows.sparkSession, path, "\n").inputFiles()})
    if len(names) < 2:
        return rows
    spark = rows.sparkSession
    known = F.broadcast(spark.createDataFrame(list(enumerate(names)), "no long, name string"))  # Spark's own list of the files, as it planned the scan
    return rows.join(known, F.regexp_replace("file", "^([a-z]+):/+", "$1:/") == F.col("name"), "left").withColumn("ord", F.shiftleft(F.coalesce("no", F.lit(len(names)).cast("long")), 40) + F.col("ord")).drop("no", "name")


# -- JSON --------------------------------------------------------------------------------------------------------------

_QUOTE, _SLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("{"), ord("[")]], _DEPTH[[ord("}"), ord("]")]] = 1, -1


def _strings(raw: np.ndarray) -> tuple[np.ndarray, bool]:
    """Which bytes are inside of strings or open them, for bytes that begin outside; and whether they end inside.

    For bytes that begin inside all of it is the other way round. A quote counts if an even number of backslashes stands before it.
    """
    at = np.flatnonzero(raw == _QUOTE)
    if (raw == _SLASH).any():
        index = np.arange(len(raw))
        plain = np.maximum.accumulate(np.where(raw != _SLASH, index, -1))
        before = np.where(at > 0, plain[np.maximum(at - 1, 0)], -1)
        at = at[(at - 1 - before) % 2 == 0]
    flips = np.zeros(len(raw), np.int8)
    flips[at] = 1
    return np.cumsum(flips) % 2 == 1, len(at) % 2 == 1


def _levels(raw: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Depth after each byte, relative to the beginning."""
    return np.cumsum(np.where(inside, 0, _DEPTH[raw]).astype(np.int64))


def _events(raw: np.ndarray, inside: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a piece may end, and at which depth it does so: at a comma of its depth, when its depth opens, when it closes."""
    change = np.where(inside, 0, _DEPTH[raw])
    at = np.flatnonzero((change != 0) | ((raw == _COMMA) & ~inside))
    return at, level[at] + (change[at] < 0)


def json_pieces(spark: SparkSession, path: str, depth: int = 1, opening: int = 0) -> DataFrame:
    """(file, ord, text, deep, opened): JSON files cut at one depth. Deep pieces are the elements or members at that depth; what stands
    between two containers of them is one shallow piece, from the closing bracket of one to the opening bracket of the next.

    opened: how many brackets the piece opens at the depth `opening`, which is less than depth.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, place), parts in _ranges(batches):
            state, at_depth = [False, True], [0, 0]
            ends: list[dict[int, int]] = [{}, {}]
            for values in parts:
                raw = np.frombuffer(_joined(values), np.uint8)
                inside, odd = _strings(raw)
                new = []
                for k in range(2):
                    own = ~inside if state[k] else inside
                    level = _levels(raw, own)
                    for d, n in zip(*np.unique(_events(raw, own, level)[1] + at_depth[k], return_counts=True), strict=True):
                        ends[k][int(d)] = ends[k].get(int(d), 0) + int(n)
                    at_depth[k] += int(level[-1])
                    new.append(state[k] != odd)
                state = new
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([place], pa.int64()), *[pa.array([v], t) for k in range(2) for v, t in ((state[k], pa.bool_()), (at_depth[k], pa.int64()), (list(ends[k].items()), pa.map_(pa.int64(), pa.int64())))]], names=["file", "place", "out", "out_d", "out_n", "in", "in_d", "in_n"])

    segments = _segments(spark, path, ",")
    found = segments.mapInArrow(sums, "file string, place long, out boolean, out_d long, out_n map<long,long>, in boolean, in_d long, in_n map<long,long>")
    pairs = found.withColumns({"out_n": F.map_entries("out_n"), "in_n": F.map_entries("in_n")})
    per = pairs.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("place", "out", "out_d", "out_n", "in", "in_d", "in_n"))).alias("r"))
    long = lambda n: F.lit(n).cast("long")
    start = F.struct(F.lit(False).alias("inside"), long(0).alias("depth"), long(0).alias("before"))
    last = lambda acc: F.element_at(acc, -1)

    def step(acc, r):  # type: ignore[no-untyped-def]
        s = last(acc)
        pick = lambda c: F.when(s["inside"], r[f"in{c}"]).otherwise(r[f"out{c}"])
        ended = F.get(F.filter(pick("_n"), lambda e: e["key"] == depth - s["depth"]), F.lit(0))["value"]
        return F.concat(acc, F.array(F.struct(pick("").alias("inside"), (s["depth"] + pick("_d")).alias("depth"), (s["before"] + F.coalesce(ended, long(0))).alias("before"))))

    known = per.select("file", "r", F.aggregate("r", F.array(start), step).alias("s"))
    starts = known.select("file", F.posexplode("r").alias("i", "r"), "s").select("file", "r.place", *[F.get("s", F.col("i"))[c].alias(c) for c in ("inside", "depth", "before")])

    def cut(parts: Iterator[pa.Array], inside: bool, above: int) -> Iterator[tuple[str, bool, bool, int]]:
        held: list[str] = []
        opened = 0
        for values in parts:
            raw = np.frombuffer(text := _joined(values), np.uint8)
            own, odd = _strings(raw)
            own = ~own if inside else own
            level = _levels(raw, own) + above
            opens = np.flatnonzero((level == opening) & ~own & (_DEPTH[raw] > 0)) if opening else np.zeros(0, np.int64)
            at, deep = _events(raw, own, level)
            begin = seen = 0
            for end in at[deep == depth].tolist():
                kind = raw[end]
                to = end + 1 if _DEPTH[kind] > 0 else end  # an opening bracket ends what stands before its container
                upto = int(np.searchsorted(opens, to)) if len(opens) else 0
                held.append(text[begin:to].decode())
                yield "".join(held), True, bool(_DEPTH[kind] <= 0), opened + upto - seen
                held, opened, seen, begin = [], 0, upto, to + (kind == _COMMA)
            held.append(text[begin:].decode())
            opened += len(opens) - seen
            inside, above = inside != odd, int(level[-1])
        if "".join(held):
            yield "".join(held), False, False, opened

    pieces = _cut(segments, starts, ["inside", "depth"], cut)
    return pieces.withColumn("text", F.when(F.col("deep"), F.regexp_replace("text", r"^\s+|\s+$", "")).otherwise(F.col("text")))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, text): the elements of an array, or the members of an object (`"key": value`), of each file, numbered from 0."""
    return json_pieces(spark, path).where("deep and text <> ''").select("file", (F.col("ord") - 1).alias("ord"), "text")  # the first piece is the bracket


def read_json_ranges(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON arrays with ord, the place in the array; elements that are no objects are dropped."""
    rows = json_records(spark, path).where(F.col("text").startswith("{"))
    return _numbered(rows.select(F.from_json("text", schema).alias("r"), "file", "ord"), path).select("r.*", "ord")


def read_json_members(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): the members of JSON objects, values as JSON text."""
    one = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), "map<string,string>")
    return json_records(spark, path).where(F.col("text").startswith('"')).select(F.explode(one).alias("key", "value"))
