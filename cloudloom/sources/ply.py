"""PLY files as a Spark data source: spark.read.format("ply").load(path), and a writer.

The header is read once on the driver. Binary vertex data are split into ranges of whole records; each
task decodes its own range with numpy and yields Arrow batches. Rows carry idx, their ordinal in the file,
which follows from the offset. Paths go through pyarrow's file systems, so a store that it knows is read
without a local copy. read_ply() scans ASCII files with Spark's own text reader (read_ascii): lines are
numbered within each split and splits start where the counts of those before end. The data source can
read ASCII files, too, but counts their lines on the driver.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Numpy codes of the type names; accepted names of the channels.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
RED, GREEN, BLUE = ("red", "diffuse_red", "r"), ("green", "diffuse_green", "g"), ("blue", "diffuse_blue", "b")
INTENSITY = ("intensity", "intensity_0", "reflectance", "greyscale")
RANGE_BYTES = 32 << 20
BATCH_ROWS = 65_536
MAX_HEADER = 4 << 20

SCHEMA = T.StructType([T.StructField("idx", T.LongType(), False), *(T.StructField(a, T.DoubleType()) for a in "xyz"), T.StructField("rgb", T.LongType()), T.StructField("intensity", T.DoubleType())])


class PlyError(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    form: str
    version: str
    count: int
    properties: tuple[tuple[str, str], ...]
    size: int
    comments: tuple[str, ...] = ()
    obj_info: tuple[str, ...] = ()
    skipped: int = 0  # bytes of binary elements before the vertices
    skipped_rows: int = 0  # lines of ASCII elements before them
    filled: int = 0  # lines of the header that are not blank
    said: tuple[str, ...] = ()  # comments and obj_info in their order

    @property
    def binary(self) -> bool:
        return self.form != "ascii"

    def dtype(self) -> np.dtype:
        order = ">" if self.form == "binary_big_endian" else "<"
        return np.dtype([(f"{i}:{n}", order + TYPES[t]) for i, (t, n) in enumerate(self.properties)])

    def place(self, names: tuple[str, ...]) -> int | None:
        own = [n for _, n in self.properties]
        return next((own.index(n) for n in names if n in own), None)

    def color(self) -> tuple[int, int, int] | None:
        at = tuple(self.place(n) for n in (RED, GREEN, BLUE))
        return at if None not in at else None


def parse_header(raw: bytes) -> Header:
    """The header at the start of a file; PlyError if it is not one that can be read."""
    lines, at = [], 0
    while True:
        end = raw.find(b"\n", at)
        if end < 0:
            raise PlyError("end_header is missing")
        line = raw[at:end].decode("utf-8", "ignore").strip()
        at = end + 1
        lines.append(line)
        if lines[0].lower() != "ply":
            raise PlyError("not a PLY file")
        if line.lower() == "end_header":
            break
    form = version = None
    comments, info, said, properties = [], [], [], []
    count, element, skipped, skipped_rows, size_of, rows_of = None, None, 0, 0, 0, 0
    for line in lines[1:-1]:
        word, _, rest = line.partition(" ")
        word, rest = word.lower(), rest.strip()
        parts = rest.split()
        if word == "format" and len(parts) >= 2:
            form, version = parts[0].lower(), parts[1]
        elif word == "comment":
            comments.append(rest)
            said.append(rest)
        elif word == "obj_info":
            info.append(rest)
            said.append(rest)
        elif word == "element" and len(parts) >= 2:
            if element not in (None, "vertex") and count is None:
                skipped, skipped_rows = skipped + size_of * rows_of, skipped_rows + rows_of
            element, rows_of, size_of = parts[0].lower(), int(parts[1]), 0
            if element == "vertex":
                count = rows_of
        elif word == "property" and parts:
            if parts[0].lower() == "list":
                if element == "vertex" or count is None:
                    raise PlyError("list properties of vertices, or before them, cannot be read")
            elif element == "vertex":
                properties.append((parts[0].lower(), parts[-1].lower()))
            else:
                size_of += np.dtype(TYPES.get(parts[0].lower(), "u1")).itemsize
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise PlyError(f"format {form} is not supported")
    if count is None:
        raise PlyError("element vertex is missing")
    names = {n for _, n in properties}
    if missing := [a for a in "xyz" if a not in names]:
        raise PlyError(f"vertex properties are missing: {', '.join(missing)}")
    if form != "ascii" and (odd := sorted({t for t, _ in properties} - TYPES.keys())):
        raise PlyError(f"unknown property types: {', '.join(odd)}")
    return Header(form, version, count, tuple(properties), at, tuple(comments), tuple(info), skipped, skipped_rows, sum(map(bool, lines)), tuple(said))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_header(path: str) -> Header:
    fs, p = _open(path)
    try:
        with fs.open_input_stream(p) as f:
            raw = b""
            while not re.search(rb"(?im)^\s*end_header\s*$", raw) and len(raw) < MAX_HEADER:
                more = f.read(1 << 16)
                if not more:
                    break
                raw += more
    except FileNotFoundError as e:
        raise PlyError(f"{path} does not exist") from e
    except PermissionError as e:
        raise PlyError(f"{path} cannot be read") from e
    return parse_header(raw)


@dataclass
class _Range(InputPartition):
    path: str
    begin: int
    end: int
    first: int
    header: Header = field(repr=False)


def _number(token: str) -> float:
    m = re.match(r"\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)", token)
    return float(m[1]) if m else 0.0


class PlyReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, strict: bool):
        self.path, self.range_bytes, self.strict = path, range_bytes, strict
        self.header = read_header(path)

    def partitions(self) -> list[_Range]:
        head = read_header(self.path)
        if (head.form, head.count) != (self.header.form, self.header.count):
            raise PlyError(f"{self.path} changed while it was read")
        fs, p = _open(self.path)
        size = fs.get_file_info(p).size
        if head.binary:
            step = head.dtype().itemsize
            there = max(0, size - head.size - head.skipped) // step
            if there < head.count and self.strict:
                raise PlyError(f"{self.path} holds {there} of {head.count} vertices")
            n, each = min(head.count, there), max(1, self.range_bytes // step)
            base = head.size + head.skipped
            return [_Range(self.path, base + a * step, base + min(n, a + each) * step, a, head) for a in range(0, n, each)] or [_Range(self.path, 0, 0, 0, head)]
        # ASCII: ranges end at a line's end; ordinals follow from the number of filled lines in the ranges before
        out, at, first = [], head.size, 0
        with fs.open_input_file(p) as f:
            while at < size:
                end = min(size, at + self.range_bytes)
                if end < size:
                    f.seek(end)
                    while (more := f.read(1 << 16)) and b"\n" not in more:
                        end += len(more)
                    end += more.find(b"\n") + 1 if more else 0
                f.seek(at)
                out.append(_Range(self.path, at, end, first, head))
                if end < size:
                    first += sum(1 for line in f.read(end - at).split(b"\n") if line.strip())
                at = end
        return out or [_Range(self.path, 0, 0, 0, head)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        fs, p = _open(part.path)
        head = part.header
        if part.begin >= part.end:
            return
        with fs.open_input_file(p) as f:
            f.seek(part.begin)
            if head.binary:
                dtype, left, idx = head.dtype(), part.end - part.begin, part.first
                while left > 0:
                    raw = f.read(min(left, BATCH_ROWS * dtype.itemsize))
                    rows = np.frombuffer(raw, dtype, len(raw) // dtype.itemsize)
                    if not len(rows):
                        break
                    left -= len(rows) * dtype.itemsize
                    yield self._batch(head, idx, lambda i, rows=rows: rows[rows.dtype.names[i]], len(rows))
                    idx += len(rows)
            else:
                yield from self._ascii(part, f.read(part.end - part.begin))

    def _ascii(self, part: _Range, raw: bytes) -> Iterator[pa.RecordBatch]:
        head, rows = part.header, [line.split() for line in raw.decode("utf-8", "replace").splitlines() if line.strip()]
        skip = max(0, head.skipped_rows - part.first)
        idx = max(part.first - head.skipped_rows, 0)
        rows = rows[skip:]
        if head.count:
            rows = rows[: max(0, head.count - idx)]
        for at in range(0, len(rows), BATCH_ROWS):
            own = rows[at : at + BATCH_ROWS]
            yield self._batch(head, idx + at, lambda i, own=own: np.array([_number(r[i]) if i < len(r) else 0.0 for r in own]), len(own))

    @staticmethod
    def _batch(head: Header, idx: int, column, n: int) -> pa.RecordBatch:
        xyz = [pa.array(np.asarray(column(head.place((a,))), np.float64)) for a in "xyz"]
        color, shade = head.color(), head.place(INTENSITY)
        rgb = pa.nulls(n, pa.int64())
        if color:
            r, g, b = (np.asarray(column(i)).astype(np.int64) & 255 for i in color)
            rgb = pa.array(r << 16 | g << 8 | b)
        intensity = pa.array(np.asarray(column(shade), np.float64)) if shade is not None else pa.nulls(n, pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(idx, idx + n, dtype=np.int64)), *xyz, rgb, intensity], SCHEMA.fieldNames())


class PlySource(DataSource):
    """Options: path; rangeBytes (bytes of a task); strict (a truncated binary file is an error; else its whole records are read)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        read_header(self.options["path"])
        return SCHEMA

    def reader(self, schema: T.StructType) -> PlyReader:
        return PlyReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)), str(self.options.get("strict", "false")).lower() == "true")


def read_ply(spark: SparkSession, path: str, unit_scale: float | None = None, **options: object) -> DataFrame:
    """A PLY file as idx, x, y, z, rgb, intensity; coordinates times unit_scale if one is given."""
    from ..functions.units import scale

    spark.dataSource.register(PlySource)
    head = read_header(path)
    df = read_ascii(spark, path, head) if not head.binary else spark.read.format("ply").options(**{k: str(v) for k, v in options.items()}).load(path)
    return scale(df, unit_scale) if unit_scale else df


def read_ascii(spark: SparkSession, path: str, head: Header | None = None) -> DataFrame:
    """An ASCII PLY file by Spark's text reader. Blank lines do not count; missing tokens and such without a number at their start are 0."""
    from ..functions.text import leading_float

    head = head or read_header(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).filter(F.col("value").rlike(r"\S"))
    counts = lines.groupBy("block").agg(F.count("*").alias("n"))
    before = counts.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))  # a row for each split
    place = F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1 - head.filled - head.skipped_rows
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    token = lambda i: leading_float(F.try_element_at(tokens, F.lit(i + 1)))
    rgb, shade = F.lit(None).cast("long"), head.place(INTENSITY)
    if head.color():
        r, g, b = (token(i).cast("long").bitwiseAND(255) for i in head.color())
        rgb = F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)
    rows = lines.join(F.broadcast(before), "block").withColumn("idx", place).filter(F.col("idx") >= 0)
    if head.count:
        rows = rows.filter(F.col("idx") < head.count)
    intensity = token(shade) if shade is not None else F.lit(None).cast("double")
    return rows.select(F.col("idx").cast("long").alias("idx"), *(token(head.place((a,))).alias(a) for a in "xyz"), rgb.alias("rgb"), intensity.alias("intensity"))


def header_info(spark: SparkSession, path: str) -> DataFrame:
    """One row: format, version, vertices, comments and obj_info of a file's header."""
    h = read_header(path)
    return spark.createDataFrame([(h.form, h.version, h.count, list(h.comments), list(h.obj_info))], "format string, version string, vertices long, comments array<string>, obj_info array<string>")


HEADERS = "path string, format string, version string, vertices long, strings array<string>, error string"


def headers(spark: SparkSession, folder: str, names: str = "*.ply") -> DataFrame:
    """The headers of all files below a folder: path, format, version, vertices, strings (comments and obj_info in order); error instead, where a file has none that can be read.

    The listing and the first bytes of each file are read by the executors; no contents are.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(folder).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    h = read_header(path)
                    rows.append((path, h.form, h.version, h.count, list(h.said), None))
                except (PlyError, ValueError, OSError) as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "format", "version", "vertices", "strings", "error"]).astype({"vertices": "Int64"})

    return paths.mapInPandas(run, HEADERS)


def unit_factors(found: DataFrame, target: str | None = None, explicit: float | None = None, model_code: int | None = None) -> DataFrame:
    """headers with unit (that of the first string that names one) and factor, by units.choose."""
    from ..functions import units

    named = F.filter(F.transform(F.coalesce("strings", F.array().cast("array<string>")), units.detect), lambda u: u.isNotNull())
    lit = lambda v, kind: F.lit(v).cast(kind)
    return found.withColumn("unit", F.get(named, F.lit(0))).withColumn("factor", units.choose(F.col("unit"), lit(target, "string"), lit(explicit, "double"), lit(model_code, "int")))


def read_folder(spark: SparkSession, folder: str, names: str = "*.ply", target: str | None = None, explicit: float | None = None, model_code: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The points of all files below a folder, with path, each file in its own unit: path, idx (in the file), x, y, z, rgb, intensity. Files without a readable header are left out (headers names them).

    Files are cut into ranges by the executors, and the ranges are dealt out anew, so one large file is many tasks.
    """
    files = unit_factors(headers(spark, folder, names).filter("error is null"), target, explicit, model_code).select("path", "factor")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, factor in zip(b["path"], b["factor"], strict=True):
                own = PlyReader(path, range_bytes, False).partitions()
                yield pd.DataFrame({"path": path, "factor": factor, "begin": [r.begin for r in own], "end": [r.end for r in own], "first": [r.first for r in own]})

    ranges = files.mapInPandas(cut, "path string, factor double, begin long, end long, first long")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader = PlyReader(r["path"], range_bytes, False)
                for rows in reader.read(_Range(r["path"], r["begin"], r["end"], r["first"], reader.header)):
                    same = [pa.array([r[c]] * rows.num_rows, t) for c, t in (("path", pa.string()), ("factor", pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*same, *rows.columns], ["path", "factor", *SCHEMA.fieldNames()])

    points = ranges.repartition(n, "path", "begin").mapInArrow(read, T.StructType([T.StructField("path", T.StringType()), T.StructField("factor", T.DoubleType()), *SCHEMA.fields]))
    return points.select("path", "idx", *((F.col(a) * F.col("factor")).alias(a) for a in "xyz"), "rgb", "intensity")


def ply_line(rgb: bool, intensity: bool) -> Column:
    """The text of a vertex: six decimals, white for no colour, 0 for no intensity."""
    from ..functions.color import WHITE, unpack
    from ..functions.text import fixed

    parts = [fixed(F.col(a), 6) for a in "xyz"]
    if rgb:
        parts += [c.cast("string") for c in unpack(F.coalesce(F.col("rgb"), F.lit(WHITE)))]
    if intensity:
        parts.append(fixed(F.coalesce(F.col("intensity"), F.lit(0.0)), 6))
    return F.concat_ws(" ", *parts)


def ply_rows(points: DataFrame, *more: str) -> DataFrame:
    """idx, line (and more columns) of each whole point."""
    from ..operators.aggregates import whole_point

    return points.filter(whole_point()).select("idx", *more, ply_line("rgb" in points.columns, "intensity" in points.columns).alias("line"))


def _head_lines(points: DataFrame) -> list[str]:
    out = [f"property float {a}" for a in "xyz"]
    out += [f"property uchar {c}" for c in ("red", "green", "blue")] if "rgb" in points.columns else []
    return out + (["property float intensity"] if "intensity" in points.columns else [])


def write_folder(points: DataFrame, folder: str) -> int:
    """Write a cloud of any size as a folder of ASCII PLY files, each a whole file with its own header, in the order of idx over the files' names; returns the number of vertices.

    Points are cut into ranges of idx; the executors format, sort and write them, and only the counts pass the driver. read_folder(names="*.txt") reads them back.
    """
    from ..operators.numbering import with_range

    ranged = with_range(points, F.col("idx"), "__part")
    lines = ply_rows(ranged, "__part").select(F.format_string("%06d", F.col("__part")).alias("part"), "idx", F.lit(1).alias("place"), F.col("line").alias("value"))
    counts = lines.groupBy("part").agg(F.count("*").alias("n"))
    tail = "\n" + "\n".join([*_head_lines(points), "end_header"])
    heads = counts.select("part", F.lit(None).cast("long").alias("idx"), F.lit(0).alias("place"), F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n").cast("string"), F.lit(tail)).alias("value"))
    n = counts.agg(F.sum("n")).first()[0]
    if not n:
        raise PlyError("the cloud is empty")
    both = lines.unionByName(heads).repartition(max(2, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part").sortWithinPartitions("part", "place", "idx")
    both.select("part", "value").write.partitionBy("part").text(folder)
    return n


def write_ply(points: DataFrame, path: str) -> int:
    """Write one ASCII PLY file in the order of idx (write_folder takes clouds of any size); returns the number of vertices (points without coordinates are left out of the count too).

    Lines are formatted and sorted by Spark and streamed to the file part by part.
    """
    if not path:
        raise PlyError("no path")
    rows = ply_rows(points).persist()
    try:
        n = rows.count()
        if not n:
            raise PlyError("the cloud is empty")
        head = ["ply", "format ascii 1.0", f"element vertex {n}", *_head_lines(points)]
        fs, p = _open(path)
        with fs.open_output_stream(p) as raw, io.BufferedWriter(raw, 1 << 20) as f:
            f.write("\n".join([*head, "end_header", ""]).encode())
            for r in rows.orderBy("idx").toLocalIterator():
                f.write(r["line"].encode() + b"\n")
        return n
    finally:
        rows.unpersist()
