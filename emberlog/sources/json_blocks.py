"""JSON arrays, and values that span lines, in files of any size, read block by block.

A file is read as rows that end at `}`, which Spark splits wherever it splits files. A first pass gives each block's effect
for both states it may begin in, inside and outside of a string: whether it turns the one into the other, by how much the
depth of brackets changes, and how deep its closing brackets go. Windows over the blocks of a file compose the effects, so
that a second pass knows the state that each block begins in and cuts its values by itself. Values that blocks divide are
put together from their parts. Effects and values are each worked out once and kept, values on the executors' disks, as both
what is taken and what is rejected are read from them: until the session ends, or `spark.catalog.clearCache()`.

A file whose first byte, but for blanks, is `[` is an array: its elements are values up to the first that is no JSON, which
is one reject and ends the file, as does the closing bracket. Any other file, one with a byte order mark among them, holds values one after another: lines add up
until they make one value. Where some value is none, brackets no longer tell where values end: lines of such files are
gathered by file and taken in order, a value at a time, and a line that can't go on a value is rejected with what it
was to go on.

The place of a value in its file (`line_no`) is its first byte's, or its first line's in a file taken by lines, however files are split.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions import scalars as S

END = b"}"
FEW = 100_000  # blocks of files that are composed at a time, and whose states are sent to all tasks
TASKS = 1000  # of files taken by lines, at most
PACKED = (".gz", ".gzip", ".deflate", ".bz2", ".zst", ".lz4", ".snappy")
BLANK, BOM = b" \t\r\n", "\ufeff".encode()
_blanks = re.compile(r"[ \t\r\n]*")
_escaped = re.compile(rb"\\.", re.S)
_step = np.zeros(256, np.int8)
_step[[ord("{"), ord("[")]], _step[[ord("}"), ord("]")]] = 1, -1
_marking = np.zeros(256, bool)
_marking[list(b'"{}[],\n')] = True
EFFECT = "file string, start long, file_size long, n long, turns int, d0 long, d1 long, low0 long, low1 long, first string"
PIECE = "file string, line_no long, value string, length long, form string, part int"


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of quotes, brackets, commas and ends of lines that aren't escaped, their bytes, whether each is inside of a string that isn't open at the start)."""
    x = np.frombuffer(_escaped.sub(b"  ", data) if b"\\" in data else data, np.uint8)
    at = np.flatnonzero(_marking[x])
    x = x[at]
    return at, x, (np.cumsum(x == 34, dtype=np.uint8) & 1).astype(bool)


def _rows(spark: SparkSession, path) -> DataFrame:
    """(file, start, file_size, value): the rows of a file's blocks in order, each without the `}` at its end."""
    m = "_metadata.file_"
    return spark.read.option("lineSep", END.decode()).text(path).select(F.col(f"{m}path").alias("file"), F.col(f"{m}block_start").alias("start"), F.col(f"{m}size").alias("file_size"), F.col("value").cast("binary").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, bytes, bool]]:
    """(block, bytes, whether the block ends with them); of a block's last row its own bytes come last, without the `}` that may be missing."""
    key, held = None, None
    for b in batches:
        if not b.num_rows:
            continue
        files, starts, sizes, values = b.column("file").dictionary_encode(), b.column("start").to_numpy(), b.column("file_size"), b.column("value")
        codes = files.indices.to_numpy()
        turns = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        for k, to in pairwise([0, *turns.tolist(), b.num_rows]):
            now = files.dictionary[int(codes[k])].as_py(), int(starts[k]), sizes[k].as_py()
            if now != key:
                if key is not None:
                    yield key, held, True
                key, held = now, None
            front = b"" if held is None else held + END
            if to - k > 1:
                front += pc.binary_join(pa.ListArray.from_arrays([0, to - 1 - k], values[k : to - 1]), END)[0].as_py() + END
            held = values[to - 1].as_py()
            if front:
                yield key, front, False
    if key is not None:
        yield key, held, True


def effects(rows: DataFrame) -> DataFrame:
    """Each block's effect (see EFFECT): bytes, quotes odd or not, and for a start outside and inside of a string the change of depth and the least depth after a closing bracket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, turns, depth, low, first = None, 0, 0, [0, 0], [None, None], None
        for now, data, last in _blocks(batches):
            if now != key:
                key, n, turns, depth, low, first = now, 0, 0, [0, 0], [None, None], None
            data += END if last else b""
            n += len(data)
            if first is None and (text := data.lstrip(BLANK)):
                first = text[:1].decode("latin-1")
            _, x, inside = _marks(data)
            step = _step[x]
            for k in (0, 1) if len(x) else ():
                own = np.where(inside ^ bool(turns ^ k), 0, step)
                after = depth[k] + np.cumsum(own, dtype=np.int64)
                closing = after[own < 0]
                if len(closing):
                    low[k] = min(int(closing.min()), low[k] if low[k] is not None else int(closing.min()))
                depth[k] = int(after[-1])
            turns ^= int(inside[-1]) if len(x) else 0
            if last:
                yield pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "file_size": key[2], "n": n, "turns": turns, "d0": depth[0], "d1": depth[1], "low0": low[0], "low1": low[1], "first": first}], schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("file_size", pa.int64()), ("n", pa.int64()), ("turns", pa.int32()), *[(c, pa.int64()) for c in ("d0", "d1", "low0", "low1")], ("first", pa.string())]))

    return rows.mapInArrow(run, EFFECT)


def compose(blocks: DataFrame) -> DataFrame:
    """(file, start, offset, inside, depth, closed, form, last, spare, marked): the state that each block begins in.

    offset: of its first byte; closed: whether the array ended before; last: of its file; spare: whether the last row has no `}` of its own, null if the file's size doesn't tell.
    marked: whether the file begins with a byte order mark, which is no JSON.
    """
    w = Window.partitionBy("file").orderBy("start")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    out = blocks.withColumn("inside", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    out = out.withColumn("d", F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0"))).withColumn("low", F.when(F.col("inside") == 1, F.col("low1")).otherwise(F.col("low0")))
    out = out.withColumn("depth", F.coalesce(F.sum("d").over(before), F.lit(0)))
    packed = F.lit(False)
    for end in PACKED:
        packed |= F.lower("file").endswith(end)
    total = F.sum("n").over(whole)
    marked = ~packed & (total < F.col("file_size"))  # Spark leaves a byte order mark out
    return out.select(
        "file", "start",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        (F.col("inside") == 1).alias("inside"), "depth",
        F.coalesce(F.max(F.col("depth") + F.col("low") <= 0).over(before), F.lit(False)).alias("closed"),
        F.when((F.first("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == "[") & ~marked, "array").otherwise("values").alias("form"),
        (F.col("start") == F.max("start").over(whole)).alias("last"),
        F.when(~packed, total + F.when(marked, len(BOM)).otherwise(0) > F.col("file_size")).alias("spare"),
        marked.alias("marked"),
    )


class _Cutter:
    """Cuts the values of one block; rows of PIECE gather in `out`. part: 0 whole, 1 begins only, 2 neither begins nor ends, 3 ends only."""

    def __init__(self, file: str, state: dict, max_bytes: int):
        self.file, self.form, self.most = file, state["form"], max_bytes
        self.at, self.inside, self.depth = state["offset"], state["inside"], state["depth"]
        self.array = self.form == "array"
        self.done = self.array and state["closed"]
        self.level = 1 if self.array else 0
        self.begun = not (self.array and self.depth == 0 and not self.inside)  # an array's first value begins after its bracket
        self.midway = self.inside or self.depth > self.level or state["offset"] > 0  # the first value began before this block
        self.begin, self.held, self.length, self.alone, self.out = self.at, [], 0, False, []

    def keep(self, data: bytes) -> None:
        """More of the value that isn't at its end; of one that is too long only the first bytes."""
        room = self.most + 1 - sum(map(len, self.held))
        if room > 0:
            self.held.append(data[:room])
        self.length += len(data)

    def give(self, end: bool) -> None:
        value, length, part = b"".join(self.held), self.length, (3 if end else 2) if self.midway else (0 if end else 1)
        self.held, self.length, self.midway = [], 0, False
        if part == 0 and not value.strip(BLANK) and length <= self.most and (not self.array or self.alone):
            return  # a blank line, or nothing in an array
        self.out.append((self.file, self.begin, value, length, self.form, part))

    def feed(self, data: bytes) -> None:
        if self.done or not data:
            self.at += len(data)
            return
        at, x, inside = _marks(data)
        inside ^= self.inside
        step = np.where(inside, 0, _step[x])
        depth = self.depth + np.cumsum(step, dtype=np.int64)
        if len(x):
            self.inside, self.depth = bool(inside[-1]), int(depth[-1])
        begin = 0
        if not self.begun:
            opening = at[step > 0]
            if not len(opening):
                self.at += len(data)
                return
            begin, self.begun, self.midway, self.alone = int(opening[0]) + 1, True, False, True
            self.begin = self.at + begin
        cuts = at[~inside & (depth == self.level) & (x == (44 if self.array else 10))]
        end = at[(step < 0) & (depth <= 0)] if self.array else cuts[:0]
        end = end[end >= begin]
        if len(end):
            cuts = np.append(cuts[cuts < end[0]], end[0])
            self.done = True
        for cut in cuts[cuts >= begin].tolist():
            self.keep(data[begin:cut])
            self.give(True)
            begin, self.alone = cut + 1, False
            self.begin = self.at + begin
        if not self.done:
            self.keep(data[begin:])
        self.at += len(data)

    def close(self, last: bool) -> None:
        """The end of the block: what is left goes on in the next one, or ends with the file."""
        if self.begun and not self.done and (self.length or last and self.midway or self.array and not self.alone):
            self.give(last)


def pieces(spark: SparkSession, path, states: dict, max_bytes: int) -> DataFrame:
    """The values, and parts of values, of the blocks (see PIECE); states: by file and start."""
    shared = spark.sparkContext.broadcast(states)
    names = [c.split()[0] for c in PIECE.split(", ")]
    types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, state = None, None, None
        for now, data, last in _blocks(batches):
            if now != key:
                if now[:2] not in shared.value:
                    raise ValueError(f"{now[0]} is split otherwise than when it was first read")
                key, state = now, shared.value[now[:2]]
                cutter = _Cutter(now[0], state, max_bytes)
            if last:
                whole = not state["last"] or (state["spare"] is False)
                cutter.feed(data)
                if whole or state["spare"] is None and not cutter.inside and cutter.depth > 0:
                    cutter.feed(END)
                cutter.close(state["last"])
            else:
                cutter.feed(data)
            if cutter.out and (last or len(cutter.out) > 1000):
                columns = [pa.array(c, t) for c, t in zip(zip(*cutter.out, strict=True), types, strict=True)]
                columns[2] = _text(columns[2])
                cutter.out = []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _rows(spark, path).mapInArrow(run, PIECE)


def _text(column: pa.Array) -> pa.Array:
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:  # no UTF-8, or cut within a character where a value is too long
        return pa.array([v.decode("utf-8", "replace") for v in column.to_pylist()], pa.string())


def joined(found: DataFrame, max_bytes: int) -> DataFrame:
    """(file, line_no, value, length, form) with the parts of divided values put together; these are two for each block at most."""
    names = [c for c in found.columns if c != "part"]
    parts = found.where("part > 0")
    order = Window.partitionBy("file").orderBy("line_no", "part")
    parts = parts.withColumn("run", F.sum((F.col("part") == 1).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.sum("length").over(Window.partitionBy("file", "run"))
    parts = parts.withColumn("total", length).withColumn("value", F.when(F.col("total") > max_bytes, F.substring("value", 1, 64)).otherwise(F.col("value")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part", "value"))), lambda p: p["value"]), "")
    whole = parts.groupBy("file", "run").agg(F.min("line_no").alias("line_no"), text.alias("value"), F.max("total").alias("length"), F.first("form").alias("form"))
    whole = whole.withColumn("_ok", _is_value(max_bytes)) if "_ok" in names else whole
    whole = whole.where((F.col("form") == "array") | (F.trim(F.translate("value", "\t\r\n", "   ")) != ""))
    return found.where("part = 0").select(*names).unionByName(whole.select(*names))


def _is_value(max_bytes: int) -> Column:
    return (F.col("length") > max_bytes) | S.json_value(F.col("value")).isNotNull()


def _in_files(df: DataFrame, files: list[str], col="_metadata.file_path") -> DataFrame:
    if len(files) <= 1000:
        return df.where(F.col(col).isin(files))
    known = df.sparkSession.createDataFrame([(f,) for f in files], "_file string")
    return df.join(F.broadcast(known), F.col(col) == F.col("_file"), "left_semi")


def by_lines(lines: DataFrame, files: list[str], max_bytes: int) -> DataFrame:
    """(file, line_no, value, length) of files taken in order of lines (file, line_no, value), of which a task holds one value. Tasks get as many files each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder(parse_constant=_no_constant)

        def ready(rows: list[tuple[int, str]], over: bool) -> Iterator[tuple[int, str, int]]:
            """Values of the front of rows; what may still go on stays, unless all rows are there."""
            text = "".join(v + "\n" for _, v in rows)
            begins = list(accumulate((len(v) + 1 for _, v in rows), initial=0))
            sizes = begins if text.isascii() else list(accumulate((len(v.encode()) + 1 for _, v in rows), initial=0))
            filled, k = len(text.rstrip(" \t\r\n")), 0
            while k < len(rows):
                if not rows[k][1].strip(" \t\r"):
                    k += 1
                    continue
                end = _reach(decoder, text, begins[k], filled)
                to = len(rows) if end is None else bisect_right(begins, end)
                most = bisect_right(sizes, sizes[k] + max_bytes)  # lines that add up to more than a value may have
                if end is None and most > len(rows) and not over:
                    break
                to = min(to, most, len(rows))
                yield rows[k][0], text[begins[k] : begins[to] - 1], sizes[to] - sizes[k] - 1
                k = to
            del rows[:k]

        key, rows, size, asked = None, [], 0, 0

        def batch(made: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key] * len(made), pa.string()), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.int64())], names=["file", "line_no", "value", "length"])

        for b in batches:
            for file, line, value in zip(b.column("file").to_pylist(), b.column("line_no").to_pylist(), b.column("value").to_pylist(), strict=True):
                if file != key:
                    if rows and (made := list(ready(rows, True))):
                        yield batch(made)
                    key, rows, size, asked = file, [], 0, 0
                rows.append((line, value))
                size += len(value)
                if size > max(2 * asked, 1 << 16) or size > 2 * max_bytes:
                    made = list(ready(rows, False))
                    size = asked = sum(len(v) for _, v in rows)
                    if made:
                        yield batch(made)
        if rows and (made := list(ready(rows, True))):
            yield batch(made)

    tasks = min(len(files), TASKS)
    known = lines.sparkSession.createDataFrame([(f, k % tasks) for k, f in enumerate(sorted(files))], "_file string, _task int")
    dealt = lines.join(F.broadcast(known), F.col("file") == F.col("_file")).repartitionById(tasks, F.col("_task"))
    ordered = dealt.select("file", "line_no", "value").sortWithinPartitions("file", "line_no")
    return ordered.mapInArrow(run, "file string, line_no long, value string, length long")


def _no_constant(name: str):
    raise ValueError(f"no JSON: {name}")


def _reach(decoder: json.JSONDecoder, text: str, begin: int, filled: int) -> int | None:
    """A place on the line where it is known what begins there: where the value ends or goes wrong; None if it goes on beyond text."""
    begin = _blanks.match(text, begin).end()
    try:
        return max(decoder.raw_decode(text, begin)[1] - 1, begin)
    except json.JSONDecodeError as e:
        return None if e.msg.startswith("Unterminated string") or e.pos >= filled else e.pos
    except (ValueError, RecursionError):
        return begin


def _fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values that are none: the value at the front of each, if there is one, and what is wrong."""
    decoder = json.JSONDecoder(parse_constant=_no_constant)
    for b in batches:
        out = []
        for file, at, value in zip(b.column("file").to_pylist(), b.column("line_no").to_pylist(), b.column("value").to_pylist(), strict=True):
            try:
                end = decoder.raw_decode(value, _blanks.match(value, 0).end())[1]
                out.append((file, at, value[:end], None))
                at, value = at + len(value[:end].encode()), value[end:]
            except (ValueError, RecursionError):
                pass
            out.append((file, at, value, "invalid JSON array"))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.string())], names=["file", "line_no", "value", "error"])


def read_values(spark: SparkSession, path: str, *, max_bytes: int) -> DataFrame:
    """(file, line_no, value, error) of the files at path: a row per value, or per reject with what is wrong."""
    found = effects(_rows(spark, path)).persist()  # a row per block
    known = compose(found)
    files = known.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy("file")
    groups, size = [[]], 0
    for r in files.toLocalIterator():  # groups of files, of which the states of all blocks are held at once
        if size and size + r.n > FEW:
            groups.append([])
            size = 0
        groups[-1].append(r.file)
        size += r.n
    out = None
    for group in groups:
        own = known if len(groups) == 1 else _in_files(known, group, "file")
        states = {(r.file, r.start): r.asDict() for r in own.collect()}  # FEW rows, or those of one file
        if not states:
            continue
        source = path if len(groups) == 1 else group
        made = _of_group(spark, source, states, max_bytes)
        out = made if out is None else out.unionByName(made)
    found.unpersist()
    return out if out is not None else spark.createDataFrame([], "file string, line_no long, value string, error string")


def _of_group(spark: SparkSession, path, states: dict, max_bytes: int) -> DataFrame:
    from emberlog.sources.readers import numbered

    cut = pieces(spark, path, states, max_bytes).withColumn("_ok", F.when(F.col("part") == 0, _is_value(max_bytes)))
    found = joined(cut.persist(StorageLevel.DISK_ONLY), max_bytes)
    long = F.col("length") > max_bytes
    # of arrays the first value that is none; of others whether there is one, or one so long that lines must tell
    bad = found.where(~F.col("_ok") | (long & (F.col("form") == "values"))).groupBy("file", "form").agg(F.min("line_no").alias("first"))
    bad = {(r.file, r.form): r.first for r in bad.toLocalIterator()}  # a row per file that is broken
    marked = sorted({file for (file, _), s in states.items() if s["marked"]})
    bad |= {(file, "values"): 0 for file in marked}
    error = F.when(long, F.lit(f"record longer than {max_bytes} bytes"))
    if not bad:
        return found.select("file", "line_no", "value", error.alias("error"))
    wrong = spark.createDataFrame([(f, form, at) for (f, form), at in bad.items()], "file string, form string, first long")
    met = found.join(F.broadcast(wrong) if len(bad) <= FEW else wrong, ["file", "form"], "left")
    error = F.when(long, F.lit(f"record longer than {max_bytes} bytes"))
    kept = met.where(F.col("first").isNull() | ((F.col("form") == "array") & (F.col("line_no") < F.col("first")))).select("file", "line_no", "value", error.alias("error"))
    fronts = met.where((F.col("form") == "array") & (F.col("line_no") == F.col("first"))).select("file", "line_no", "value")  # a row per broken array
    kept = kept.unionByName(fronts.mapInArrow(_fronts, "file string, line_no long, value string, error string"))
    by = [f for f, form in bad if form == "values"]
    if not by:
        return kept
    lines = numbered(_in_files(spark.read.text(path), by)).select("file", "line_no", "value")
    if marked:
        known = spark.createDataFrame([(f,) for f in marked], "marked string")
        lines = lines.join(F.broadcast(known), F.col("file") == F.col("marked"), "left")
        begins = F.col("marked").isNotNull() & (F.col("line_no") == 0)
        lines = lines.withColumn("value", F.when(begins, F.concat(F.lit(BOM.decode()), "value")).otherwise(F.col("value"))).drop("marked")
    lines = by_lines(lines, by, max_bytes).persist(StorageLevel.DISK_ONLY)
    return kept.unionByName(lines.select("file", "line_no", "value", F.when(F.col("length") > max_bytes, F.lit(f"record longer than {max_bytes} bytes")).alias("error")))
