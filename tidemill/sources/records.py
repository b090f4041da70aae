"""Records of text files whose lines alone do not make records: quoted CSV values over several lines, JSON arrays,
JSON objects over several lines.

Spark splits text at line ends, wherever a record stands. A first pass tells for every split how it changes the
state of a reader (inside quotes or not; how deep in braces), a prefix over the splits of a file gives the state each
split starts in, and a second pass cuts every split into records by itself. What crosses a border comes out as
pieces, at most two for each split, which a grouping puts together. So one large file is read by many tasks.

A split is named by its file and the byte it starts at; both passes read with the same separator. JSON is split at
commas, so that an array on one line has many splits too.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.session import stage
from tidemill.sources.paths import filesystem

# The head of a JSON file that is looked at.
_HEAD = 1 << 20


def _scan_csv(data: np.ndarray, quoted: bool, depth: int) -> tuple[np.ndarray, bool, int]:
    inside = (np.cumsum(data == ord('"')) + quoted) & 1
    return np.flatnonzero((data == ord("\n")) & (inside == 0)) + 1, bool(inside[-1]), 0


def _json_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotes that begin or end text, summed up, and +1 and -1 for braces wherever they stand."""
    quotes, slash = data == ord('"'), data == ord("\\")
    if slash.any():
        # A quote behind an odd number of backslashes is part of the text.
        at = np.arange(len(data))
        other = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.zeros(len(data), np.int64)
        run[1:] = at[:-1] - other[:-1]
        quotes &= run % 2 == 0
    return np.cumsum(quotes), (data == ord("{")).astype(np.int64) - (data == ord("}"))


def _scan_json(data: np.ndarray, quoted: bool, depth: int) -> tuple[np.ndarray, bool, int]:
    quotes, braces = _json_marks(data)
    inside = (quotes + quoted) & 1
    depths = depth + np.cumsum(np.where(inside == 0, braces, 0))
    return np.flatnonzero((braces < 0) & (inside == 0) & (depths == 0)) + 1, bool(inside[-1]), int(depths[-1])


@dataclass(frozen=True)
class Format:
    """``scan`` gives where records end in bytes, and the state behind them; ``between`` may stand between records."""

    separator: str
    between: str
    scan: Callable[[np.ndarray, bool, int], tuple[np.ndarray, bool, int]]

    def clean(self, value: pa.Array) -> pa.Array:
        value = pc.utf8_trim(value, characters=self.between)
        return pc.replace_substring(value, "\r\n", "\n") if self.separator == "\n" else value

    def clean_column(self, value: Column) -> Column:
        value = F.trim(value, F.lit(self.between))
        return F.replace(value, F.lit("\r\n"), F.lit("\n")) if self.separator == "\n" else value


CSV = Format("\n", "\r\n", _scan_csv)
# Lines as they are, whatever quotes they hold.
LINES = Format("\n", "\r\n", lambda data, quoted, depth: (np.flatnonzero(data == ord("\n")) + 1, False, 0))
JSON = Format(",", " \t\r\n,[]", _scan_json)


def units(spark: SparkSession, path, form: Format) -> DataFrame:
    """What stands between separators, in the order of the splits: (value, file_path, start)."""
    text = spark.read.option("lineSep", form.separator).text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"))


def _stretches(batch: pa.RecordBatch, form: Format) -> Iterator[tuple[tuple[str, int], bytes]]:
    """The bytes of a batch split by split, separators included."""
    if not batch.num_rows:
        return
    start, path = batch.column("start").to_numpy(), batch.column("file_path")
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)
    bounds = [*np.flatnonzero(new).tolist(), len(start)]
    for a, b in zip(bounds, bounds[1:]):
        values = batch.column("value")[a:b]
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), values), form.separator)
        yield (path[a].as_py(), int(start[a])), whole[0].as_buffer().to_pybytes() + form.separator.encode()


def json_changes(text: DataFrame) -> DataFrame:
    """(file_path, start, flips, outside, inside) of every split: quotes, and what it adds to the depth if it starts
    outside or inside of quotes."""

    def run(batches):
        found: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for split, data in _stretches(batch, JSON):
                quotes, braces = _json_marks(np.frombuffer(data, np.uint8))
                before = found.setdefault(split, [0, 0, 0])
                odd = (quotes + before[0]) & 1
                inside = int(braces[odd == 1].sum())
                before[0] += int(quotes[-1])
                before[1] += int(braces.sum()) - inside
                before[2] += inside
        columns = list(zip(*((*k, *v) for k, v in found.items()))) or [[]] * 5
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["file_path", "start", "flips", "outside", "inside"])

    changes = text.mapInArrow(run, "file_path string, start long, flips long, outside long, inside long")
    return changes.groupBy("file_path", "start").agg(*(F.sum(c).alias(c) for c in ("flips", "outside", "inside")))


def starting_states(changes: DataFrame, label: str) -> DataFrame:
    """(file_path, start, quoted, depth) of every split, staged; a file that ends inside quotes or braces ends the job."""
    before = Window.partitionBy("file_path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    # What a split adds to the depth depends on the quotes it starts in, so these come first.
    quoted = changes.withColumn("quoted", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    deep = quoted.withColumn("_added", F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside")))
    deep = deep.withColumn("depth", F.coalesce(F.sum("_added").over(before), F.lit(0)))
    unclosed = (F.sum("flips").over(whole) % 2 == 1) | (F.sum("_added").over(whole) != 0)
    states = stage(deep.select("file_path", "start", "quoted", "depth", unclosed.alias("unclosed")), label)
    for row in states.where("unclosed").limit(1).collect():
        raise ValueError(f"MALFORMED: quotes or braces do not match in {row['file_path']}")
    return states.drop("unclosed")


_PIECES = "file_path string, start long, part int, opens boolean, whole boolean, first boolean, value string"


class _Cutter:
    """Cuts one split after another into records."""

    def __init__(self, form: Format, states: dict[tuple[str, int], tuple[bool, int]]):
        self.form, self.states, self.split = form, states, None
        self.rest: list[bytes] = []

    def feed(self, split: tuple[str, int], data: bytes) -> Iterator[pa.RecordBatch]:
        if split != self.split:
            yield from self.end()
            self.split = split
            self.quoted, self.depth = self.states.get(split, (False, 0))
            # What the split starts with belongs to a record that began before it.
            self.continues = self.quoted or self.depth > 0
            self.named = split[1] > 0
        ends, self.quoted, self.depth = self.form.scan(np.frombuffer(data, np.uint8), self.quoted, self.depth)
        start = 0
        if len(ends) and (self.rest or self.continues):
            start = int(ends[0])
            text = b"".join([*self.rest, data[:start]])
            yield self.pieces([text], 0 if self.continues else 1, False, not self.continues)
            self.rest, self.continues, ends = [], False, ends[1:]
        if len(ends):
            stop = int(ends[-1])
            offsets = pa.py_buffer((np.append(start, ends) - start).astype(np.int32))
            records = pa.Array.from_buffers(pa.string(), len(ends), [None, offsets, pa.py_buffer(data[start:stop])])
            yield self.pieces(records, 1, False, True)
            start = stop
        if start < len(data):
            self.rest.append(data[start:])

    def end(self) -> Iterator[pa.RecordBatch]:
        """The split is over; what is open goes on in the next one."""
        text, self.rest = b"".join(self.rest), []
        if text and (self.quoted or self.depth > 0 or self.continues):
            yield self.pieces([text], 0 if self.continues else 1, not self.continues, False)
        elif text:
            yield self.pieces([text], 1, False, True)

    def pieces(self, values, part: int, opens: bool, whole: bool) -> pa.RecordBatch:
        values = pa.array([v.decode() for v in values], pa.string()) if isinstance(values, list) else values
        if whole:
            values = self.form.clean(values)
            filled = pc.not_equal(pc.utf8_trim_whitespace(values), "")
            values = values.filter(filled)
        n = len(values)
        first = np.zeros(n, bool)
        if n and not self.named:
            first[0] = self.named = True
        names = [c.split()[0] for c in _PIECES.split(", ")]
        path, start = self.split
        columns = [pa.array([path] * n, pa.string()), pa.array(np.full(n, start, np.int64)), pa.array(np.full(n, part, np.int32))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.full(n, x)) for x in (opens, whole)), pa.array(first), values], names=names)


def records(text: DataFrame, states: DataFrame, form: Format) -> DataFrame:
    """(file_path, first, value) of all records that are not blank; ``first`` marks the first one of a file.

    Splits that start inside a record are sent to all tasks: some bytes for each of them, less than the list of all
    splits that Spark's driver holds.
    """
    inner = {(r["file_path"], r["start"]): (r["quoted"], int(r["depth"])) for r in states.where("quoted OR depth > 0").toLocalIterator()}
    shared = text.sparkSession.sparkContext.broadcast(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(form, shared.value)
        for batch in batches:
            for split, data in _stretches(batch, form):
                yield from cutter.feed(split, data)
        yield from cutter.end()

    pieces = text.mapInArrow(run, _PIECES)
    whole = pieces.where("whole").select("file_path", "first", "value")
    if not inner:
        return whole
    # A split without any end is all one piece, and goes on in the next one.
    order = Window.partitionBy("file_path").orderBy("start", "part")
    broken = pieces.where("NOT whole").withColumn("record", F.sum(F.col("opens").cast("int")).over(order))
    in_order = F.array_sort(F.collect_list(F.struct("start", "part", "value")))
    joined = broken.groupBy("file_path", "record").agg(F.max("first").alias("first"), F.array_join(F.transform(in_order, lambda x: x["value"]), "").alias("value"))
    return whole.union(joined.select("file_path", "first", form.clean_column(F.col("value")).alias("value")))


def parsed(values: DataFrame, reader, kind: str) -> DataFrame:
    """Records, the text column ``value``, as Spark's reader of ``kind`` (csv or json) reads lines."""
    spark = values.sparkSession
    # The reader takes a Dataset of text, which Python has no type for.
    text = getattr(values.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(getattr(reader._jreader, kind)(text), spark)


def all_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line of every file is a JSON object by itself. Heads are read by range, one after the other in
    the tasks that hold the files' names; where that is impossible the answer is no, which is always safe."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path).select("path")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_starts_with_object(p) for p in batch.column(0).to_pylist()], pa.bool_())], names=["lines"])

    return bool(names.mapInArrow(run, "lines boolean").agg(F.coalesce(F.min("lines"), F.lit(True))).first()[0])


def _starts_with_object(path: str) -> bool:
    try:
        files, name = filesystem(path)
        with files.open_input_file(name) as f:
            head = f.read(_HEAD).lstrip()
    except (OSError, ValueError, pa.ArrowException):
        return False
    line, newline, _ = head.partition(b"\n")
    if not head or (not newline and len(head) == _HEAD):
        return not head
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        # Something that is no JSON is for the reader to refuse.
        return line.startswith(b"{") and line.rstrip().endswith(b"}")
