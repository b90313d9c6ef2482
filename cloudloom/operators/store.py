"""A stored cloud: points in octree order, the tree beside them, and manifests that only a current build may publish.

Points are written in the order of their path (as a number, `code`), in folders by zone. A zone is a node near the root with few enough
points, or at the last zone level, so there are 8^ZONE_DEPTH folders at most and each is one interval of codes. A frustum is
tested against the upper nodes first (8^TOP_DEPTH at most, the only ones that pass the driver); what it meets there becomes a
bounded list of code intervals. Folders beside them are not opened, and the intervals go to the scan as filters, which skip
row groups and pages by their statistics. The leaves in sight are then joined on equal keys, so the rows are exactly those of
`octree.frustum_query`.

A build writes to a folder of its own. Publishing creates the manifest of the next generation, which only one of several
builds can do; a build that began on an older generation publishes nothing and takes its folder away.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import octree, sampling
from .aggregates import AXES, Box, box_of
from .lineage import written

#: Levels of zones and of the nodes tested first; rows of a zone; intervals given to a scan. Only speed depends on them.
ZONE_DEPTH, TOP_DEPTH, ZONE_ROWS, MOST_INTERVALS = 3, 4, 8_000_000, 64
#: A code has three bits for each level of the path.
MOST_DEPTH = 20


@dataclass(frozen=True)
class Index:
    """What a manifest says: where the data lies, how the tree was built, and whether it holds a sample."""

    folder: str
    depth: int
    most: int
    box: tuple[float, float, float, float, float, float] | None
    sampled: bool
    sample_size: int
    total_points: int
    schema: str
    generation: int = 0


def _code(path: Column, depth: Column | int, total: int, last: bool = False) -> Column:
    """The first (or last) code below a node."""
    padded = F.rpad(path, total, "7" if last else "0")
    return F.coalesce(F.conv(padded, 8, 10).cast("long"), F.lit(0).cast("long")) if total else F.lit(0).cast("long")


def _prefixes(path: Column, most: Column | int) -> Column:
    return F.transform(F.sequence(F.lit(0), most if isinstance(most, Column) else F.lit(most)), lambda d: F.substring(path, F.lit(1), d))


def build(points: DataFrame, root: str, most: int, depth: int = 9, sample: int | None = None, zone_rows: int = ZONE_ROWS, row_group: int = 16 << 20) -> Index:
    """Writes points (idx, x, y, z and what else they have) and their tree to a new folder below root. sample: of at most so many points, by a stride."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"the depth must lie in 0 .. {MOST_DEPTH}")
    taken = {"path", "code", "leaf", "zone"} & set(points.columns)
    if taken:
        raise ValueError(f"a stored cloud has columns of its own: {sorted(taken)}")
    folder = f"{root.rstrip('/')}/data-{uuid.uuid4().hex}"
    total = points.count()
    held = points if sample is None else sampling.by_limit(points, sample).drop("pos")
    box = box_of(held)
    placed = octree.paths(held, box or octree.EMPTY, depth)
    full = written(placed.groupBy("path").agg(F.count("*").alias("n")))
    tree = written(octree.tree_of(full, most, depth))
    held_tree = tree.select("node", "depth", "n", "leaf", _code(F.col("node"), F.col("depth"), depth).alias("low"), _code(F.col("node"), F.col("depth"), depth, last=True).alias("high"))
    held_tree.repartitionByRange("low", "depth").sortWithinPartitions("low", "depth").write.parquet(f"{folder}/nodes")
    # the zone of a leaf: the first node on the way to it that is small enough
    ends = tree.filter(F.col("leaf") | (F.col("depth") == ZONE_DEPTH) | (F.col("n") <= zone_rows)).select(F.col("node").alias("up"))
    leaf = tree.filter("leaf").select(F.col("node").alias("leaf"), F.explode(_prefixes(F.col("node"), F.least(F.col("depth"), F.lit(ZONE_DEPTH)))).alias("up"))
    leaves = leaf.join(ends.filter(F.length("up") <= ZONE_DEPTH), "up").groupBy("leaf").agg(F.min(F.struct(F.length("up").alias("d"), "up")).alias("z"))
    leaves = written(leaves.select("leaf", F.col("z.up").alias("zone")))
    zones = leaves.select("zone").distinct().select(F.concat(F.lit("z"), "zone").alias("zone"), _code(F.col("zone"), 0, depth).alias("low"), _code(F.col("zone"), 0, depth, last=True).alias("high"))
    zones.coalesce(1).write.parquet(f"{folder}/zones")
    of_path = full.select("path", F.explode(_prefixes(F.col("path"), depth)).alias("leaf")).join(leaves, "leaf")
    rows = placed.join(of_path, "path").select(*held.columns, "leaf", _code(F.col("path"), depth, depth).alias("code"), F.concat(F.lit("z"), "zone").alias("zone"))
    # zones are intervals of codes, so one order serves both; idx lets a crowded cell be split
    ordered = rows.repartitionByRange("code", "idx").sortWithinPartitions("zone", "code")
    ordered.write.partitionBy("zone").option("parquet.block.size", row_group).parquet(f"{folder}/points")
    size = total if sample is None else held.count()
    ends = None if box is None else tuple(getattr(box, f"{n}_{a}") for n in ("min", "max") for a in AXES)
    return Index(folder, depth, most, ends, sample is not None, size, total, rows.schema.json())


# --- manifests -------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    fs, at = _fs(spark, f"{root.rstrip('/')}/manifests")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n[:-5]), n) for n in names if n.endswith(".json") and n[:-5].isdigit())


def generation(spark: SparkSession, root: str) -> int:
    """The number of the last manifest, 0 before the first."""
    return max((g for g, _ in _manifests(spark, root)), default=0)


def publish(spark: SparkSession, root: str, index: Index, base: int) -> Index | None:
    """index as generation base + 1, if base is still the last one; else nothing is published and its folder goes."""
    number = base + 1
    if generation(spark, root) == base:
        fs, at = _fs(spark, f"{root.rstrip('/')}/manifests/{number:012d}.json")
        made = Index(**(asdict(index) | {"generation": number}))
        try:
            out = fs.create(at, False)  # fails if the file is there
        except Exception as e:
            if "exists" not in str(e):
                raise
        else:
            out.write(bytearray(json.dumps(asdict(made)).encode()))
            out.close()
            return made
    fs, at = _fs(spark, index.folder)
    fs.delete(at, True)
    return None


def current(spark: SparkSession, root: str) -> Index | None:
    """The last published index. A manifest that was never written to its end is passed over."""
    for _, name in reversed(_manifests(spark, root)):
        text = "\n".join(r["value"] for r in spark.read.text(f"{root.rstrip('/')}/manifests/{name}").collect())
        try:
            said = json.loads(text)
        except ValueError:
            continue
        return Index(**(said | {"box": said["box"] and tuple(said["box"])}))
    return None


def rebuild(points: DataFrame, root: str, most: int, depth: int = 9, sample: int | None = None, **options: int) -> Index | None:
    """Build and publish; None if another build was published meanwhile."""
    spark = points.sparkSession
    base = generation(spark, root)
    return publish(spark, root, build(points, root, most, depth, sample, **options), base)


# --- reading ---------------------------------------------------------------------------------------


def nodes(spark: SparkSession, index: Index) -> DataFrame:
    return spark.read.schema("node string, depth int, n long, leaf boolean, low long, high long").parquet(f"{index.folder}/nodes")


def points(spark: SparkSession, index: Index) -> DataFrame:
    """All stored points, with leaf, code and zone."""
    return spark.read.schema(T.StructType.fromJson(json.loads(index.schema))).parquet(f"{index.folder}/points")


def _merged(spans: list[tuple[int, int]], most: int = MOST_INTERVALS) -> list[tuple[int, int]]:
    """Intervals united where they touch, then over the smallest gaps until there are `most` of them."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    gaps = sorted(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1])
    closed = {*gaps[: max(len(out) - most, 0)]}
    held: list[list[int]] = []
    for k, (low, high) in enumerate(out):
        if k in closed:
            held[-1][1] = high
        else:
            held.append([low, high])
    return [(low, high) for low, high in held]


def intervals(spark: SparkSession, index: Index, planes: list) -> list[tuple[int, int]]:
    """Intervals of codes that hold every leaf in sight, from the upper nodes of the tree."""
    if index.box is None:
        return []
    top = nodes(spark, index).filter(F.col("depth") <= TOP_DEPTH)
    met = octree.marked(top, Box(*index.box), planes).filter(F.col("meets") & (F.col("leaf") | (F.col("depth") == TOP_DEPTH)))
    return _merged([(r["low"], r["high"]) for r in met.select("low", "high").collect()])  # 8^TOP_DEPTH rows at most


def _within(low: str, high: str, spans: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in spans:
        out = out | ((F.col(high) >= a) & (F.col(low) <= b))
    return out


def frustum(spark: SparkSession, index: Index, planes: list) -> DataFrame:
    """All points of the leaves that meet the frustum, with leaf: the rows of octree.frustum_query."""
    spans = intervals(spark, index, planes)
    zones = [r["zone"] for r in spark.read.schema("zone string, low long, high long").parquet(f"{index.folder}/zones").filter(_within("low", "high", spans)).collect()]  # 8^ZONE_DEPTH rows at most
    near = points(spark, index).filter(F.col("zone").isin(zones) & _within("code", "code", spans))
    leaves = nodes(spark, index).filter("leaf").filter(_within("low", "high", spans))
    seen = octree.marked(leaves, Box(*index.box) if index.box else octree.EMPTY, planes).filter("meets").select(F.col("node").alias("leaf"))
    return near.join(seen, "leaf", "left_semi").drop("code", "zone")


def coarse(spark: SparkSession, index: Index, planes: list, per_leaf: int) -> DataFrame:
    """At most per_leaf points (the least idx) of each leaf in sight: a first picture of a large cloud."""
    order = Window.partitionBy("leaf").orderBy("idx")
    return frustum(spark, index, planes).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= per_leaf).drop("__n")
