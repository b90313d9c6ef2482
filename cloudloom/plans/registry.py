"""The registered queries of the point-cloud operators, and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, text, units
from ..operators import aggregates as agg
from ..operators import batches as held_batches
from ..operators import clouds, display, kdstats, numbering, octree, poisson, reports, sampling, spatial, store, telemetry, updates
from ..operators.aggregates import AXES, micros
from ..operators.lineage import shared_folder
from ..sources import ply

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BOUNDS = [f"{n}_{a}" for n in ("min", "max") for a in AXES]
SQL_BOUNDS = ", ".join(f"{n}({a}) AS {n}_{a}" for n in ("min", "max") for a in AXES)


def _with(*names: str) -> str:
    return "WITH " + ", ".join(clouds.SQL[n] for n in names)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- aggregates ------------------------------------------------------------------------------------


@query(f"{_with('c4')} SELECT {SQL_BOUNDS} FROM c4")
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return agg.bounds(clouds.lineitem(spark, sf)).select(*((F.col(n) + 0.0).alias(n) for n in BOUNDS))


@query(f"{_with('c1')} SELECT {', '.join(f'{n[:3]}({n}) AS {n}' for n in BOUNDS)} FROM (SELECT idx // 1000 AS chunk, {SQL_BOUNDS} FROM c1 GROUP BY 1)")
def bounds_partial_merge(spark: SparkSession, sf: str) -> DataFrame:
    parts = agg.bounds(clouds.events(spark, sf).withColumn("chunk", F.floor(F.col("idx") / 1000)), "chunk")
    return agg.merge_bounds(parts)


@query(f"{_with('c1')} SELECT min(intensity) AS min_intensity, max(intensity) AS max_intensity FROM c1 WHERE isfinite(intensity)")
def intensity_range(spark: SparkSession, sf: str) -> DataFrame:
    return agg.intensity_range(clouds.events(spark, sf))


@query(f"""{_with('c2')}, b AS (SELECT {SQL_BOUNDS} FROM c2), m AS (SELECT (min_x + max_x) * 0.5 AS cx, (min_y + max_y) * 0.5 AS cy, (min_z + max_z) * 0.5 AS cz,
 sqrt((max_x - min_x) * (max_x - min_x) + (max_y - min_y) * (max_y - min_y) + (max_z - min_z) * (max_z - min_z)) * 0.5 AS half FROM b)
SELECT round(cx, 9) AS cx, round(cy, 9) AS cy, round(cz, 9) AS cz, round(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))), 9) AS radius, round(any_value(half), 9) AS half_diagonal FROM c2, m GROUP BY cx, cy, cz""")
def center_radius(spark: SparkSession, sf: str) -> DataFrame:
    return agg.center_radius(clouds.embeddings(spark, sf)).select(*(F.round(c, 9).alias(c) for c in ("cx", "cy", "cz", "radius", "half_diagonal")))


@query(f"{_with('c1')} SELECT count(*)::BIGINT AS n, count(rgb) > 0 AS has_rgb, count(intensity) > 0 AS has_intensity FROM c1")
def presence(spark: SparkSession, sf: str) -> DataFrame:
    return agg.presence(clouds.events(spark, sf))


@query("""SELECT event_type, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration, max(event_id)::BIGINT AS peak, count(*)::BIGINT AS processed,
 round(CASE WHEN epoch_us(max(ts)) > epoch_us(min(ts)) THEN count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) ELSE 0 END, 9) AS rate FROM events GROUP BY 1""")
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    out = agg.rates(clouds.table(spark, sf, "events"), "event_type", "ts", "event_id")
    return out.select("event_type", F.round("duration", 6).alias("duration"), "peak", "processed", F.round("rate", 9).alias("rate"))


# --- projections and colours -----------------------------------------------------------------------


@query(f"{_with('c1')} SELECT idx, x * (1.0::DOUBLE / 25.4::DOUBLE) AS x, y * (1.0::DOUBLE / 25.4::DOUBLE) AS y, z * (1.0::DOUBLE / 25.4::DOUBLE) AS z FROM c1")
def unit_scale(spark: SparkSession, sf: str) -> DataFrame:
    return units.scale(clouds.events(spark, sf), 1.0 / 25.4).select("idx", *AXES)


_LINES = ["units: meters", "generated by scanner", "unit mm", "scale = 0.0393700787", "Scale: 12.1", "scale=5", "unit in meters", "scale feet", "units yd", "unit: км", "meters", "scale: abc", ""]
_UNIT_CASES = " ".join(f"WHEN regexp_matches(l, '(^|[^\\w\\x{{80}}-\\x{{10FFFF}}])({'|'.join(u[3].split())})s?($|[^\\w\\x{{80}}-\\x{{10FFFF}}])') THEN '{u[0]}'" for u in units.UNITS)
_UNIT_TABLE = ", ".join(f"({i}, '{u[0]}', {u[2]!r}::DOUBLE)" for i, u in enumerate(units.UNITS))


def _pick(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], k: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({k}) % {len(values)} + 1]"


@query(f"""WITH t AS (SELECT p_partkey AS i, CASE p_partkey % 3 WHEN 0 THEN 'scale = ' || p_size || '.' || (p_partkey % 1000) ELSE {_sql_pick(_LINES, 'p_partkey')} || ' ' || p_brand END AS line FROM part),
n AS (SELECT i, lower(line) AS l, TRY_CAST(nullif(regexp_extract(lower(line), 'scale\\s*[:=]\\s*([\\d.e+-]+)', 1), '') AS DOUBLE) AS v FROM t),
u(k, key, f) AS (VALUES {_UNIT_TABLE}), near AS (SELECT n.i, u.key, u.f, abs(u.f - n.v) AS d, row_number() OVER (PARTITION BY n.i ORDER BY abs(u.f - n.v), u.k) AS r FROM n, u WHERE n.v IS NOT NULL)
SELECT n.i::BIGINT AS i, CASE WHEN l LIKE '%unit%' OR l LIKE '%scale%' THEN coalesce(CASE {_UNIT_CASES} END, CASE WHEN near.d <= near.f * 0.05 THEN near.key END) END AS unit FROM n LEFT JOIN near ON near.i = n.i AND near.r = 1""")
def unit_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Header lines made of the parts: a number after `scale`, or a phrase before the brand."""
    p = clouds.table(spark, sf, "part")
    number = F.concat(F.lit("scale = "), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 1000).cast("string"))
    line = F.when(F.col("p_partkey") % 3 == 0, number).otherwise(F.concat(_pick(_LINES, F.col("p_partkey")), F.lit(" "), "p_brand"))
    return p.select(F.col("p_partkey").alias("i"), units.detect(line).alias("unit"))


@query("SELECT p_partkey AS idx, CASE p_size % 10 " + " ".join(f"WHEN {u[1]} THEN {u[2]!r}::DOUBLE" for u in units.UNITS) + " ELSE 1.0::DOUBLE END AS factor FROM part")
def unit_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), units.by_code(F.col("p_size") % 10).alias("factor"))


@query(f"{_with('c1')} SELECT idx, rgb FROM c1")
def pack_rgb(spark: SparkSession, sf: str) -> DataFrame:
    e = clouds.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("idx"), color.pack(F.col("user_id"), F.col("event_id"), F.col("user_id") + F.col("event_id")).alias("rgb"))


@query(f"{_with('c1')} SELECT idx, (rgb >> 16) & 255 AS r, (rgb >> 8) & 255 AS g, rgb & 255 AS b FROM c1")
def unpack_rgb(spark: SparkSession, sf: str) -> DataFrame:
    r, g, b = color.unpack(F.col("rgb"))
    return clouds.events(spark, sf).select("idx", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"{_with('c1')} SELECT idx, '#' || lpad(lower(to_hex(rgb)), 6, '0') AS hex, rgb AS back FROM c1")
def hex_color(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.events(spark, sf).select("idx", color.to_hex(F.col("rgb")).alias("hex")).withColumn("back", color.from_hex(F.col("hex")))


def _sql_stops(name: str) -> str:
    """SQL for the packed colour at t, between the stops of a gradient."""
    stops = color.GRADIENTS[name]
    at = lambda k, c: f"round({stops[k][1][c]} + ({stops[k + 1][1][c] - stops[k][1][c]}) * ((t - {stops[k][0]}) / {stops[k + 1][0] - stops[k][0]}))::BIGINT"
    return "CASE " + " ".join(f"WHEN t <= {stops[k + 1][0]} THEN ({at(k, 0)} << 16) | ({at(k, 1)} << 8) | {at(k, 2)}" for k in range(len(stops) - 1)) + " END"


@query(f"SELECT event_id AS idx, {_sql_stops('viridis')} AS viridis, {_sql_stops('magma')} AS magma, {_sql_stops('jet')} AS jet, {_sql_stops('grayscale')} AS grayscale FROM (SELECT event_id, (event_id % 256)::DOUBLE / 255 AS t FROM events)")
def gradient_lut(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry of every gradient, at the events' numbers."""
    t = (F.col("event_id") % 256) / 255.0
    return clouds.table(spark, sf, "events").select(F.col("event_id").alias("idx"), *(color.gradient(t, n).alias(n) for n in ("viridis", "magma", "jet", "grayscale")))


def _sql_gradient(t: str, name: str) -> str:
    """SQL that interpolates between the table's entries at t (an expression in 0..1)."""
    table = "[" + ", ".join(map(str, color.lut(name))) + "]"
    ch = lambda v, s: f"(({v} >> {s}) & 255)"
    mixed = " | ".join(f"(round({ch('lo', s)} + ({ch('hi', s)} - {ch('lo', s)}) * w)::BIGINT << {s})" for s in (16, 8, 0))
    return f"SELECT idx, CASE WHEN w < 2.220446049250313e-16 THEN lo ELSE {mixed} END AS rgb FROM (SELECT idx, s - k AS w, {table}[k + 1]::BIGINT AS lo, {table}[least(k + 2, 256)]::BIGINT AS hi FROM (SELECT idx, s, floor(s)::BIGINT AS k FROM (SELECT idx, ({t}) * 255 AS s FROM n)))"


def _normal(axis: str) -> str:
    return f"CASE WHEN max_{axis} - min_{axis} < 2.220446049250313e-16 THEN 0.5 ELSE least(greatest(({axis} - min_{axis}) / (max_{axis} - min_{axis}), 0.0), 1.0) END"


def _normalized(points: DataFrame, a: str) -> F.Column:
    box = agg.box_of(points)
    return color.normalized(F.col(a), getattr(box, f"min_{a}", None), getattr(box, f"max_{a}", None))


@query(f"{_with('c1')}, b AS (SELECT {SQL_BOUNDS} FROM c1), n AS (SELECT * FROM c1, b) {_sql_gradient(_normal('z'), 'viridis')}")
def color_height(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.events(spark, sf)
    return p.select("idx", color.gradient(_normalized(p, "z"), "viridis").alias("rgb"))


@query(f"{_with('c3')}, b AS (SELECT min(intensity) AS min_intensity, max(intensity) AS max_intensity FROM c3), n AS (SELECT * FROM c3, b) {_sql_gradient(_normal('intensity'), 'magma')}")
def color_intensity(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.orders(spark, sf)
    r = agg.intensity_range(p).first()
    return p.select("idx", color.gradient(color.normalized(F.col("intensity"), *r, missing=0.0), "magma").alias("rgb"))


@query(f"{_with('c1')}, b AS (SELECT {SQL_BOUNDS} FROM c1), n AS (SELECT idx, coalesce(CASE WHEN idx % 3 <> 0 THEN intensity END, NULL) AS i, z, min_z, max_z, (SELECT min(intensity) FROM c1 WHERE idx % 3 <> 0) AS lo, (SELECT max(intensity) FROM c1 WHERE idx % 3 <> 0) AS hi FROM c1, b) SELECT idx, round({_normal('z')}, 12) AS height, round(CASE WHEN i IS NULL THEN {_normal('z')} ELSE least(greatest((i - lo) / (hi - lo), 0.0), 1.0) END, 12) AS scalar FROM n")
def scalar_cache(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.events(spark, sf).withColumn("intensity", F.when(F.col("idx") % 3 != 0, F.col("intensity")))
    r = agg.intensity_range(p).first()
    height = _normalized(p, "z")
    own = F.when(F.col("intensity").isNotNull(), color.normalized(F.col("intensity"), *r))
    return p.select("idx", F.round(height, 12).alias("height"), F.round(F.coalesce(own, height), 12).alias("scalar"))


@query(f"{_with('c1')} SELECT idx, CASE WHEN idx % 7 = 0 THEN 16777215 ELSE rgb END AS rgb FROM c1")
def color_original(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.events(spark, sf).select("idx", F.coalesce(F.when(F.col("idx") % 7 != 0, F.col("rgb")), F.lit(color.WHITE).cast("long")).alias("rgb"))


@query(f"{_with('c1')} SELECT idx, 3368703::BIGINT AS rgb FROM c1")
def color_single(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.events(spark, sf).select("idx", color.from_hex(F.lit("#3366ff")).alias("rgb"))


_SEED = color.fnv1a("events")
_JUMPS = ["SELECT idx, {0}::BIGINT AS s0 FROM c1".format(_SEED % (1 << 24))]
for _k, (_a, _c) in enumerate(color.jumps(24)):
    _JUMPS.append(f"SELECT idx, CASE WHEN ((idx + 1) >> {_k}) & 1 = 1 THEN (s{_k} * {_a} + {_c}) % 16777216 ELSE s{_k} END AS s{_k + 1} FROM j{_k}")


@query(f"{_with('c1')}, " + ", ".join(f"j{k} AS ({s})" for k, s in enumerate(_JUMPS)) + " SELECT idx, (round(((s24 >> 16) & 255) / 2.0 + 64)::BIGINT << 16) | (round(((s24 >> 8) & 255) / 2.0 + 64)::BIGINT << 8) | round((s24 & 255) / 2.0 + 64)::BIGINT AS rgb FROM j24")
def color_random(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.events(spark, sf).select("idx", color.random_color(F.col("idx"), _SEED).alias("rgb"))


@query(f"{_with('c3')}, b AS (SELECT {SQL_BOUNDS} FROM c3) SELECT idx, " + " | ".join(f"(round({_normal(a)} * 255)::BIGINT << {s})" for a, s in zip(AXES, (16, 8, 0), strict=True)) + " AS rgb FROM c3, b")
def color_rgb_xyz(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.orders(spark, sf)
    return p.select("idx", color.rgb_xyz(*(_normalized(p, a) for a in AXES)).alias("rgb"))


_SHOWN = [("Height", "color_height"), ("single", "color_single"), ("random", "color_random"), ("sparkling", None), ("intensity", "color_height")]


@query(" UNION ALL ".join(f"SELECT '{mode}' AS mode, idx, rgb FROM (" + (ORACLE_SQL[other] if other else f"{_with('c1')} SELECT idx, rgb FROM c1") + ")" for mode, other in _SHOWN))
def display_colors(spark: SparkSession, sf: str) -> DataFrame:
    """The colours of one cloud in five modes: of these one is unknown (original) and one asks for intensities that the cloud lacks (height)."""
    p, out = clouds.events(spark, sf).drop("intensity"), None
    for mode, _ in _SHOWN:
        own = display.colorize(p, mode, "viridis", "#3366ff", _SEED).select(F.lit(mode).alias("mode"), "idx", "rgb")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT event_id AS idx, t.* FROM events JOIN (VALUES " + ", ".join(f"('{k}', '{label}', {str(g).lower()}, {str(s).lower()}, {i})" for i, (k, label, g, s) in enumerate(color.MODES)) + f") AS v(mode, label, gradient, single_color, i) ON v.i = user_id % {len(color.MODES)}, LATERAL (SELECT mode, label, gradient, single_color) AS t")
def color_modes(spark: SparkSession, sf: str) -> DataFrame:
    """The table of modes, looked up by the mode of each event."""
    e = clouds.table(spark, sf, "events").select(F.col("event_id").alias("idx"), _pick([m[0] for m in color.MODES], F.col("user_id")).alias("mode"))
    modes = spark.createDataFrame(color.MODES, "mode string, label string, gradient boolean, single_color boolean")
    return e.join(modes, "mode")


@query("SELECT event_id AS idx, CASE WHEN w >= 0.999 THEN 255 WHEN w <= 0 THEN 0 ELSE round(255 * w)::BIGINT END AS alpha FROM (SELECT event_id, value / 400.0 - 0.1 AS w FROM events)")
def alpha_blend(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.table(spark, sf, "events").select(F.col("event_id").alias("idx"), display.alpha(F.col("value") / 400.0 - 0.1).alias("alpha"))


#: A header line of each region's file.
_REGION_LINES = ["comment units: meters", "obj_info scale = 0.0393700787", "comment unit feet", "comment generated by scanner", "comment\ncomment units mm"]


def _region_files(spark: SparkSession, sf: str) -> str:
    """One ASCII file for each region: its customers as points, in the order of their keys."""
    folder = shared_folder(spark, "ply")
    c = clouds.table(spark, sf, "customer").join(clouds.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat_ws(" ", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string"))
    rows = c.select("n_regionkey", F.col("c_custkey").alias("k"), line.alias("value"))
    said = F.element_at(F.array(*map(F.lit, _REGION_LINES)), F.col("n_regionkey") + 1)
    head = F.concat(F.lit("ply\nformat ascii 1.0\n"), said, F.lit("\nelement vertex "), F.col("n").cast("string"), F.lit("\nproperty double x\nproperty double y\nproperty double z\nend_header"))
    heads = rows.groupBy("n_regionkey").agg(F.count("*").alias("n")).select("n_regionkey", F.lit(-1).cast("long").alias("k"), head.alias("value"))
    rows.unionByName(heads).repartition(8, "n_regionkey").sortWithinPartitions("n_regionkey", "k").select("n_regionkey", "value").write.partitionBy("n_regionkey").text(folder)
    return folder


_SQL_FACTORS = "[" + ", ".join(f"{f!r}::DOUBLE" for f in (1000.0 / 25.4, 1.0 / 25.4, 12.0, 2.5, 1.0 / 25.4)) + "]"


@query(f"SELECT r_regionkey::BIGINT AS region, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey)::BIGINT AS vertices, round({_SQL_FACTORS}[r_regionkey + 1], 9) AS factor FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def ply_units(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of a folder of files as a table, and the factor of each file's unit; a file that names none takes the explicit one."""
    found = ply.unit_factors(ply.headers(spark, _region_files(spark, sf), "*.txt"), explicit=2.5)
    return found.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("region"), "vertices", F.round("factor", 9).alias("factor"))


@query(f"SELECT n_regionkey::BIGINT AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) - 1 AS idx, round(c_custkey * f, 6) AS x, round(c_acctbal * f, 6) AS y, round(c_nationkey * f, 6) AS z FROM (SELECT *, {_SQL_FACTORS}[n_regionkey + 1] AS f FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def ply_folder(spark: SparkSession, sf: str) -> DataFrame:
    """The points of all files of a folder, each in its own unit; ranges of 4 KB, so that a file is several tasks."""
    p = ply.read_folder(spark, _region_files(spark, sf), "*.txt", explicit=2.5, range_bytes=4096)
    return p.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("region"), "idx", *(F.round(a, 6).alias(a) for a in AXES))


@query(f"{_with('c1')} SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, rgb, round(intensity, 6) AS intensity FROM c1")
def ply_written_folder(spark: SparkSession, sf: str) -> DataFrame:
    """The cloud of events written as a folder of files by the executors, and read back."""
    folder = shared_folder(spark, "ply")
    ply.write_folder(clouds.events(spark, sf).drop("ts"), folder)
    return ply.read_folder(spark, folder, "*.txt").select(*(F.round(c, 6).alias(c) for c in AXES), "rgb", F.round("intensity", 6).alias("intensity"))


@query(f"{_with('c1')} SELECT 3::BIGINT AS batches, count(*)::BIGINT AS n, {SQL_BOUNDS}, min(intensity) AS min_intensity, max(intensity) AS max_intensity FROM c1")
def batch_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds and range of a cloud of three batches, from the rows kept with each: one batch brings all its aggregates, one its range, one none."""
    root, p = shared_folder(spark, "cloud"), clouds.events(spark, sf)
    part = [p.filter(F.col("idx") % 3 == k) for k in range(3)]
    held_batches.append(part[0], root, "0", agg.box_of(part[0]), tuple(agg.intensity_range(part[0]).first()))
    held_batches.append(part[1], root, "1", intensity=tuple(agg.intensity_range(part[1]).first())[::-1])
    held_batches.append(part[2], root, "2")
    return held_batches.summary(spark, root)


@query("""SELECT event_id::VARCHAR AS cloud, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, user_id::VARCHAR AS generation, CASE WHEN event_id % 3 = 0 THEN '1' ELSE '0' END AS success, CASE WHEN event_id % 4 > 0 THEN trunc(value)::BIGINT ELSE 0 END::VARCHAR AS processed,
CASE WHEN event_id % 5 > 0 THEN printf('%.3f', value * 8) ELSE '' END AS duration, printf('%.3f', value) AS rate, '0' AS total, '0' AS primary_total, '' AS primary_duration, '0' AS peak_memory, event_type AS color_mode, '0' AS economy_enabled, '0' AS economy_step, '0' AS economy_visible, '0' AS economy_threshold FROM events""")
def rebuild_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the colour-rebuild table from events, some of whose counts, flags and durations are missing."""
    e = clouds.table(spark, sf, "events")
    own = e.select(
        F.col("event_id").alias("cloud"), reports.iso(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").alias("generation"), F.when(F.col("event_id") % 3 == 0, True).alias("success"),
        F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("processed"), F.when(F.col("event_id") % 5 > 0, F.col("value") * 8).alias("duration"), F.col("value").alias("rate"), F.col("event_type").alias("color_mode"),
    )
    return reports.rows(own, "color_rebuild")


# --- sampling and levels of detail -----------------------------------------------------------------


@query(f"{_with('c1')}, p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS pos FROM c1) SELECT idx, (pos // 3)::BIGINT AS pos FROM p WHERE pos % 3 = 0")
def stride_density(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.by_density(clouds.events(spark, sf), 0.3).select("idx", "pos")


@query(f"{_with('c3')}, p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS pos, ceil(count(*) OVER () / 1000.0)::BIGINT AS step FROM c3) SELECT idx, (pos // step)::BIGINT AS pos FROM p WHERE pos % step = 0 AND pos // step < 1000")
def display_limit(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.by_limit(clouds.orders(spark, sf), 1000).select("idx", "pos")


@query(f"{_with('c1')}, p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS pos FROM c1) SELECT idx, pos::BIGINT AS pos FROM p WHERE pos < 2500")
def base_cache_head(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.base_cache(clouds.events(spark, sf), 1.0, 2500).select("idx", "pos")


@query(f"{_with('c1')}, p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS pos, ceil(count(*) OVER () / 2500.0)::BIGINT AS step FROM c1), k AS (SELECT idx, pos, greatest(step, 1) AS step FROM p) SELECT idx, (pos // step)::BIGINT AS pos FROM k WHERE pos % step = 0 AND pos // step < 2500")
def base_cache_stride(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.base_cache(clouds.events(spark, sf), 1.0, 2500, "stride").select("idx", "pos")


@query(f"{_with('c1')}, p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS pos FROM c1), l(level, step) AS (VALUES (1.0::DOUBLE, 1), (0.5::DOUBLE, 2), (0.25::DOUBLE, 4), (0.1::DOUBLE, 10), (0.05::DOUBLE, 20)) SELECT level, (pos // step)::BIGINT AS pos, idx FROM p, l WHERE pos % step = 0")
def lod_levels(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.levels(sampling.by_density(clouds.events(spark, sf), 1.0))


@query(f"{_with('c1')} SELECT idx, CASE WHEN r <= 1.5 THEN 1.0 WHEN r <= 2.5 THEN 0.5 WHEN r <= 3.5 THEN 0.25 WHEN r <= 5.0 THEN 0.1 ELSE 0.05 END::DOUBLE AS level FROM (SELECT idx, z / 80.0 AS r FROM c1)")
def lod_select(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.events(spark, sf).select("idx", sampling.first_level(F.col("z") / 80.0).alias("level"))


@query(f"{_with('c3')}, p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS pos, greatest(ceil(least(count(*) OVER (), 50000) / 2000.0)::BIGINT, 1) AS step FROM c3) SELECT idx FROM p WHERE pos < 50000 AND pos % step = 0 ORDER BY pos LIMIT 2000")
def preview_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.preview(clouds.orders(spark, sf)).select("idx")


@query(f"{_with('c3')}, p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS pos, greatest(ceil(count(*) OVER () / 4000.0)::BIGINT, 1) AS step FROM c3) SELECT idx, (pos // step)::BIGINT AS pos FROM p WHERE pos % step = 0 AND pos // step < 4000")
def guide_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.by_limit(clouds.orders(spark, sf), 4000).select("idx", "pos")


@query(f"{_with('c1')}, k AS (SELECT idx FROM c1 WHERE idx % 5 <> 0 AND idx % 7 <> 0), g AS (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS g FROM k) SELECT min(idx)::BIGINT AS start_idx, max(idx)::BIGINT AS end_idx, count(*)::BIGINT AS n FROM g GROUP BY g")
def run_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return numbering.runs(clouds.events(spark, sf).filter("idx % 5 != 0 and idx % 7 != 0"))


@query(f"{_with('c1')} SELECT (idx // 300)::BIGINT AS chunk_id, count(*)::BIGINT AS n, min(idx)::BIGINT AS first_idx, max(idx)::BIGINT AS last_idx FROM c1 GROUP BY 1")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.chunk_ids(clouds.events(spark, sf), 300)


@query(f"{_with('c1')}, p AS (SELECT row_number() OVER (ORDER BY idx) - 1 AS pos FROM c1) SELECT (pos // 750)::BIGINT AS batch, min(pos)::BIGINT AS start_pos, max(pos)::BIGINT AS end_pos, count(*)::BIGINT AS n FROM p GROUP BY 1")
def batches(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.batches(clouds.events(spark, sf), 750)


# --- octree and view ------------------------------------------------------------------------------

MOST, DEPTH = 200, 8


def _sql_octree(cloud: str, depth: int = DEPTH, most: int = MOST) -> str:
    """CTEs up to nodes(node, depth, n, leaf) and pts(idx, path)."""
    out = [f"b AS (SELECT {SQL_BOUNDS} FROM {cloud})", f"o0 AS (SELECT idx, x, y, z, '' AS path, " + ", ".join(f"min_{a} AS l{a}, max_{a} AS h{a}" for a in AXES) + f" FROM {cloud}, b)"]
    for k in range(depth):
        m = {a: f"((l{a} + h{a}) / 2)" for a in AXES}
        out.append(f"o{k + 1} AS (SELECT idx, x, y, z, path || (" + " + ".join(f"(CASE WHEN {a} >= {m[a]} THEN {1 << i} ELSE 0 END)" for i, a in enumerate(AXES)) + ")::VARCHAR AS path, " + ", ".join(f"CASE WHEN {a} >= {m[a]} THEN {m[a]} ELSE l{a} END AS l{a}, CASE WHEN {a} >= {m[a]} THEN h{a} ELSE {m[a]} END AS h{a}" for a in AXES) + f" FROM o{k})")
    out.append(f"pts AS (SELECT idx, path FROM o{depth})")
    out.append(f"cnt AS (SELECT path[1:d] AS node, d AS depth, count(*) AS n FROM pts, (SELECT unnest(range({depth + 1})) AS d) GROUP BY 1, 2)")
    out.append(f"nodes AS (SELECT c.node, c.depth, c.n, NOT (c.n > {most} AND c.depth < {depth}) AS leaf FROM cnt c LEFT JOIN cnt p ON p.depth = c.depth - 1 AND p.node = c.node[1:c.depth - 1] WHERE c.depth = 0 OR p.n > {most})")
    return ", ".join(out)


@query(f"{_with('c3')}, b AS (SELECT {SQL_BOUNDS} FROM c3) SELECT idx, (CASE WHEN x >= (min_x + max_x) / 2 THEN 1 ELSE 0 END + CASE WHEN y >= (min_y + max_y) / 2 THEN 2 ELSE 0 END + CASE WHEN z >= (min_z + max_z) / 2 THEN 4 ELSE 0 END)::BIGINT AS octant FROM c3, b")
def octant(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.orders(spark, sf)
    box = agg.box_of(p)
    mid = tuple(F.lit((getattr(box, f"min_{a}") + getattr(box, f"max_{a}")) / 2) for a in AXES)
    return p.select("idx", octree.octant(F.col("x"), F.col("y"), F.col("z"), mid).cast("long").alias("octant"))


@query(f"{_with('c3')}, {_sql_octree('c3')} SELECT p.idx, n.node AS leaf FROM pts p JOIN nodes n ON n.leaf AND n.node = p.path[1:n.depth]")
def octree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return octree.leaves(clouds.orders(spark, sf), MOST, DEPTH).select("idx", "leaf")


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, agg.Box]:
    p = clouds.orders(spark, sf)
    box = agg.box_of(p)
    return octree.nodes(octree.paths(p, box, DEPTH), MOST, DEPTH), box


@query(f"{_with('c3')}, {_sql_octree('c3')} SELECT node, depth::BIGINT AS depth, n::BIGINT AS n, leaf FROM nodes")
def octree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _tree(spark, sf)[0].select("node", F.col("depth").cast("long").alias("depth"), "n", "leaf")


@query(f"{_with('c3')}, {_sql_octree('c3')} SELECT count(*)::BIGINT AS total_nodes, count(*) FILTER (WHERE leaf)::BIGINT AS leaf_count, round(avg(n) FILTER (WHERE leaf), 9) AS avg_points_per_leaf, max(depth)::BIGINT AS max_depth FROM nodes")
def octree_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = octree.stats(_tree(spark, sf)[0])
    return s.select("total_nodes", "leaf_count", F.round("avg_points_per_leaf", 9).alias("avg_points_per_leaf"), F.col("max_depth").cast("long").alias("max_depth"))


@query(f"{_with('c3')}, b AS (SELECT {SQL_BOUNDS} FROM c3) SELECT k::BIGINT AS corner, " + ", ".join(f"CASE WHEN (k >> {i}) & 1 = 1 THEN max_{a} ELSE min_{a} END AS {a}" for i, a in enumerate(AXES)) + " FROM b, (SELECT unnest(range(8)) AS k)")
def box_corners(spark: SparkSession, sf: str) -> DataFrame:
    b = agg.bounds(clouds.orders(spark, sf))
    corners = octree.box_corners(tuple(F.col(f"min_{a}") for a in AXES), tuple(F.col(f"max_{a}") for a in AXES))
    return b.select(F.posexplode(F.array(*(F.struct(*(c.alias(a) for c, a in zip(k, AXES, strict=True))) for k in corners))).alias("corner", "p")).select(F.col("corner").cast("long").alias("corner"), "p.x", "p.y", "p.z")


PLANES = octree.frustum((-200.0, 100000.0, 8000.0), (700.0, 250000.0, 9500.0), fov=50.0, aspect=1.4, near=1.0, far=400000.0)


def _sql_planes(which: str) -> str:
    dist = lambda p, k: " + ".join(f"({'max' if k >> i & 1 else 'min'}_{a} - ({p[0][i]!r})) * ({p[1][i]!r})" for i, a in enumerate(AXES))
    return " AND ".join(f"{'greatest' if which == 'meets' else 'least'}({', '.join(dist(p, k) for k in range(8))}) >= 0.0" for p in PLANES)


def _sql_boxes(depth: int = DEPTH) -> str:
    out = ["x0 AS (SELECT node, depth, n, leaf, " + ", ".join(BOUNDS) + " FROM nodes, b)"]
    for k in range(depth):
        d = f"TRY_CAST(nullif(node[{k + 1}:{k + 1}], '') AS INTEGER)"
        up = {a: f"(({d} >> {i}) & 1) = 1" for i, a in enumerate(AXES)}
        out.append(f"x{k + 1} AS (SELECT node, depth, n, leaf, " + ", ".join(f"CASE WHEN depth > {k} AND {up[a]} THEN (min_{a} + max_{a}) / 2 ELSE min_{a} END AS min_{a}, CASE WHEN depth > {k} AND NOT {up[a]} THEN (min_{a} + max_{a}) / 2 ELSE max_{a} END AS max_{a}" for a in AXES) + f" FROM x{k})")
    return ", ".join(out) + f", mk AS (SELECT node, depth, n, leaf, {_sql_planes('meets')} AS meets, {_sql_planes('inside')} AS inside FROM x{depth})"


@query(f"{_with('c3')}, {_sql_octree('c3')}, {_sql_boxes()} SELECT node, depth::BIGINT AS depth, n::BIGINT AS n, inside FROM mk WHERE leaf AND meets")
def frustum_nodes(spark: SparkSession, sf: str) -> DataFrame:
    tree, box = _tree(spark, sf)
    return octree.frustum_leaves(tree, box, PLANES).withColumn("depth", F.col("depth").cast("long"))


@query(f"{_with('c3')}, {_sql_octree('c3')}, {_sql_boxes()} SELECT p.idx, m.node AS leaf FROM pts p JOIN mk m ON m.leaf AND m.meets AND m.node = p.path[1:m.depth]")
def frustum_query(spark: SparkSession, sf: str) -> DataFrame:
    return octree.frustum_query(clouds.orders(spark, sf), PLANES, MOST, DEPTH).select("idx", "leaf")


@query(f"{_with('c3')}, {_sql_octree('c3')}, {_sql_boxes()} SELECT p.idx, p.x, p.y, p.z, m.node AS leaf FROM (SELECT idx, x, y, z, path FROM o{DEPTH}) p JOIN mk m ON m.leaf AND m.meets AND m.node = p.path[1:m.depth]")
def stored_frustum(spark: SparkSession, sf: str) -> DataFrame:
    """The frustum query over a cloud written in octree order."""
    index = store.rebuild(clouds.orders(spark, sf).drop("intensity"), shared_folder(spark, "index"), MOST, DEPTH)
    return store.frustum(spark, index, PLANES)


@query(f"WITH {clouds.SQL['c3'].replace('c3 AS', 'all3 AS', 1)}, c3 AS (SELECT idx, x, y, z FROM (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS pos, ceil(count(*) OVER () / 1000.0)::BIGINT AS step FROM all3) WHERE pos % step = 0 AND pos // step < 1000), {_sql_octree('c3', 9)}, {_sql_boxes(9)} SELECT p.idx, m.node AS leaf FROM pts p JOIN mk m ON m.leaf AND m.meets AND m.node = p.path[1:m.depth]")
def stored_sample_frustum(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the index of a sample, as it is published while the whole one is being built."""
    index = store.rebuild(clouds.orders(spark, sf).drop("intensity"), shared_folder(spark, "index"), MOST, 9, sample=1000)
    return store.frustum(spark, index, PLANES).select("idx", "leaf")


@query("SELECT generation::BIGINT AS generation, sampled, (CASE WHEN sampled THEN (SELECT count(*) FROM (SELECT row_number() OVER () - 1 AS pos, greatest(ceil(n / 1000.0), 1)::BIGINT AS step FROM orders, (SELECT count(*) AS n FROM orders)) WHERE pos % step = 0 AND pos // step < 1000) ELSE n END)::BIGINT AS sample_size, n::BIGINT AS total_points FROM (SELECT count(*) AS n FROM orders), (VALUES (1, true), (2, false)) g(generation, sampled)")
def index_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of a sampled index and of the whole one that follows it; a build that began before them is not published."""
    root, p = shared_folder(spark, "index"), clouds.orders(spark, sf).select("idx", *AXES)
    late = store.build(p, root, MOST, 4)
    made = [store.rebuild(p, root, MOST, DEPTH, sample=1000), store.rebuild(p, root, MOST, DEPTH), store.publish(spark, root, late, 0)]
    rows = [(i.generation, i.sampled, i.sample_size, i.total_points) for i in made if i]
    return spark.createDataFrame(rows, "generation long, sampled boolean, sample_size long, total_points long")


@query(f"{_with('c3')}, {_sql_octree('c3')}, {_sql_boxes()}, seen AS (SELECT m.* FROM mk m WHERE NOT EXISTS (SELECT 1 FROM mk u WHERE u.depth < m.depth AND u.node = m.node[1:u.depth] AND (NOT u.meets OR u.inside))) SELECT count(*)::BIGINT AS visited, count(*) FILTER (WHERE NOT meets)::BIGINT AS culled, coalesce(sum(n) FILTER (WHERE inside OR (leaf AND meets)), 0)::BIGINT AS points FROM seen")
def frustum_stats(spark: SparkSession, sf: str) -> DataFrame:
    tree, box = _tree(spark, sf)
    return octree.frustum_stats(tree, box, PLANES)


@query(f"{_with('c3')}, {_sql_octree('c3')}, {_sql_boxes()}, v AS (SELECT p.idx, row_number() OVER (ORDER BY p.idx) - 1 AS pos FROM pts p JOIN mk m ON m.leaf AND m.meets AND m.node = p.path[1:m.depth]), d AS (SELECT idx, pos // 2 AS pos FROM v WHERE pos % 2 = 0), l AS (SELECT idx, pos, greatest(ceil(count(*) OVER () / 500.0)::BIGINT, 1) AS step FROM d), k AS (SELECT idx FROM l WHERE pos % step = 0 AND pos // step < 500), g AS (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS g FROM k) SELECT min(idx)::BIGINT AS start_idx, max(idx)::BIGINT AS end_idx, count(*)::BIGINT AS n FROM g GROUP BY g")
def view_query(spark: SparkSession, sf: str) -> DataFrame:
    """Frustum, then density, then the display limit, then runs of consecutive ordinals."""
    return display.view(clouds.orders(spark, sf), PLANES, MOST, DEPTH, density=0.5, limit=500)


@query(f"{_with('c3')}, {_sql_octree('c3')} SELECT p.idx, n.node AS leaf FROM pts p JOIN nodes n ON n.leaf AND n.node = p.path[1:n.depth] WHERE p.path[1:1] = '3' AND n.node[1:1] = '3'")
def octree_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return display.subtree(octree.leaves(clouds.orders(spark, sf), MOST, DEPTH), "3").select("idx", "leaf")


_KEY = lambda v, q: f"printf('%.3f', round(({v}) / {q}) * {q})"


@query(f"{_with('c3')} SELECT idx, " + " || ':' || ".join([*(_KEY(v, 0.1) for v in ("x", "y", "z", "x / 3", "y / 7", "0.0")), _KEY("(idx % 120) / 3.0", 0.25)]) + " AS key FROM c3")
def camera_keys(spark: SparkSession, sf: str) -> DataFrame:
    x, y, z = map(F.col, AXES)
    return clouds.orders(spark, sf).select("idx", display.camera_key((x, y, z), (x / 3, y / 7, F.lit(None).cast("double")), (F.col("idx") % 120) / 3.0).alias("key"))


@query(f"{_with('c2')} SELECT idx FROM c2 WHERE sqrt((x * 1000 - 50) * (x * 1000 - 50) + (y * 1000 - 50) * (y * 1000 - 50)) < 20")
def hover_snap(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.embeddings(spark, sf).filter(display.snaps(F.col("x") * 1000, F.col("y") * 1000, (50.0, 50.0))).select("idx")


@query(f"{_with('c1')}, r AS (SELECT idx // 500 AS chunk, min(intensity) AS lo, max(intensity) AS hi FROM c1 GROUP BY 1) SELECT min(lo) AS min_intensity, max(hi) AS max_intensity FROM r")
def range_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Partial ranges, every second one with its ends in the wrong order."""
    p = clouds.events(spark, sf).groupBy(F.floor(F.col("idx") / 500).alias("chunk")).agg(F.min("intensity").alias("lo"), F.max("intensity").alias("hi"))
    odd = F.col("chunk") % 2 == 1
    return display.merge_ranges(p.select(F.when(odd, F.col("hi")).otherwise(F.col("lo")).alias("min_intensity"), F.when(odd, F.col("lo")).otherwise(F.col("hi")).alias("max_intensity")))


@query("SELECT p_partkey AS idx, s > 0 AND abs(p_partkey % 100 - s)::DOUBLE / s > 0.5 AS rebuild, round(p_size + (p_retailprice - p_size) * least(greatest(p_size / 40.0 - 0.1, 0.0), 1.0), 9) AS value FROM (SELECT *, p_size - 5 AS s FROM part)")
def display_ramp(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.table(spark, sf, "part")
    size = F.col("p_size")
    return p.select(F.col("p_partkey").alias("idx"), display.rebuilds(F.col("p_partkey") % 100, size - 5).alias("rebuild"), F.round(display.lerp(size, F.col("p_retailprice"), size / 40.0 - 0.1), 9).alias("value"))


@query("SELECT idx, (round(CASE i WHEN 0 THEN 0.9 WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE 0.9 END * 255)::BIGINT << 16) | (round(CASE i WHEN 0 THEN t WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 WHEN 3 THEN q ELSE p END * 255)::BIGINT << 8) | round(CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN 0.9 WHEN 4 THEN 0.9 ELSE q END * 255)::BIGINT AS rgb FROM (SELECT idx, floor(h) AS i, 0.9::DOUBLE * (1 - 0.6::DOUBLE) AS p, 0.9::DOUBLE * (1 - 0.6::DOUBLE * (h - floor(h))) AS q, 0.9::DOUBLE * (1 - 0.6::DOUBLE * (1 - (h - floor(h)))) AS t FROM (SELECT p_partkey AS idx, (p_size % 8)::DOUBLE / 8 * 6 AS h FROM part))")
def depth_colors(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), octree.depth_color(F.col("p_size")).alias("rgb"))


# --- spatial joins ---------------------------------------------------------------------------------

_D2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"


@query(f"{_with('c2')}, r AS (SELECT q.idx AS q_idx, p.idx AS idx, {_D2} AS d2, row_number() OVER (PARTITION BY q.idx ORDER BY {_D2}, p.idx) AS k FROM c2 q JOIN c2 p ON p.idx <> q.idx WHERE q.idx % 50 = 0) SELECT q_idx, idx, round(d2, 12) AS d2 FROM r WHERE k = 1")
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.embeddings(spark, sf)
    return spatial.nearest_join(p.filter("idx % 50 = 0"), p).select("q_idx", "idx", F.round("d2", 12).alias("d2"))


@query(f"{_with('c2')}, r AS (SELECT q.idx AS q_idx, p.idx AS idx, {_D2} AS d2, row_number() OVER (PARTITION BY q.idx ORDER BY {_D2}, p.idx) AS k FROM c2 q JOIN c2 p ON p.idx <> q.idx WHERE q.idx % 50 = 0 AND {_D2} <= 0.03 * 0.03) SELECT q_idx, idx, round(d2, 12) AS d2 FROM r WHERE k = 1")
def nearest_max(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.embeddings(spark, sf)
    return spatial.nearest_join(p.filter("idx % 50 = 0"), p, most=0.03).select("q_idx", "idx", F.round("d2", 12).alias("d2"))


@query(f"{_with('c2')}, r AS (SELECT q.idx AS q_idx, p.idx AS idx, {_D2} AS d2, row_number() OVER (PARTITION BY q.idx ORDER BY {_D2}, p.idx) AS k FROM c2 q JOIN c2 p ON p.idx <> q.idx WHERE q.idx % 50 = 0) SELECT q_idx, k::BIGINT AS rank, idx, round(d2, 12) AS d2 FROM r WHERE k <= 5")
def knn(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.embeddings(spark, sf)
    return spatial.nearest_join(p.filter("idx % 50 = 0"), p, k=5).select("q_idx", F.col("rank").cast("long").alias("rank"), "idx", F.round("d2", 12).alias("d2"))


@query(f"{_with('c2')} SELECT q.idx AS q_idx, p.idx AS idx, round(sqrt({_D2}), 12) AS distance FROM c2 q JOIN c2 p ON {_D2} <= 0.08 * 0.08 WHERE q.idx % 50 = 0")
def radius(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.embeddings(spark, sf)
    return spatial.radius_join(p.filter("idx % 50 = 0"), p, 0.08).select("q_idx", "idx", F.round(F.sqrt("d2"), 12).alias("distance"))


@query(f"{_with('c2')} SELECT q.idx AS q_idx, count(*)::BIGINT AS n FROM c2 q JOIN c2 p ON {_D2} <= 0.05 * 0.05 AND p.idx <> q.idx GROUP BY 1")
def grid_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.embeddings(spark, sf)
    return spatial.radius_join(p, p, 0.05, same=False).groupBy("q_idx").agg(F.count("*").alias("n"))


@query(f"{_with('c2')} SELECT (floor(x / 0.05))::BIGINT AS cx, (floor(y / 0.05))::BIGINT AS cy, (floor(z / 0.05))::BIGINT AS cz, count(*)::BIGINT AS n FROM c2 GROUP BY 1, 2, 3")
def cell_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.embeddings(spark, sf).groupBy(*(spatial.cell(a, 0.05).alias(c) for a, c in zip(AXES, ("cx", "cy", "cz"), strict=True))).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS e, vec_id % 4 AS k FROM embeddings),
r AS (SELECT i, e[1] AS ox, e[2] AS oy, e[3] AS oz, CASE WHEN k = 1 THEN 0 ELSE e[4] END AS dx, CASE WHEN k IN (1, 2) THEN 1e-10 ELSE e[5] END AS dy, e[6] AS dz FROM e),
t AS (SELECT i, """ + ", ".join(f"CASE WHEN abs(d{a}) < 1e-9 THEN '-infinity'::DOUBLE ELSE least((-0.1 - o{a}) / d{a}, (0.1 - o{a}) / d{a}) END AS e{a}, CASE WHEN abs(d{a}) < 1e-9 THEN 'infinity'::DOUBLE ELSE greatest((-0.1 - o{a}) / d{a}, (0.1 - o{a}) / d{a}) END AS l{a}, (abs(d{a}) >= 1e-9 OR o{a} BETWEEN -0.1 AND 0.1) AS k{a}" for a in AXES) + """ FROM r)
SELECT i, CASE WHEN kx AND ky AND kz AND greatest(ex, ey, ez) <= least(lx, ly, lz) THEN round(greatest(ex, ey, ez), 9) END AS entry, CASE WHEN kx AND ky AND kz AND greatest(ex, ey, ez) <= least(lx, ly, lz) THEN round(least(lx, ly, lz), 9) END AS exit FROM t""")
def ray_slab(spark: SparkSession, sf: str) -> DataFrame:
    """Rays made of the vectors against one box; some run along an axis, or so nearly that they count as if they did."""
    part, k = lambda i: F.element_at("embedding", i).cast("double"), F.col("vec_id") % 4
    direction = (F.when(k == 1, 0.0).otherwise(part(4)), F.when(k.isin(1, 2), 1e-10).otherwise(part(5)), part(6))
    hit, entry, leave = spatial.slab((part(1), part(2), part(3)), direction, (F.lit(-0.1),) * 3, (F.lit(0.1),) * 3)
    return clouds.table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.when(hit, F.round(entry, 9)).alias("entry"), F.when(hit, F.round(leave, 9)).alias("exit"))


RAYS = [(0, (-1.0, 0.0, 0.0), (1.0, 0.0, 0.0)), (1, (0.0, -1.0, 0.05), (0.1, 1.0, 0.0)), (2, (0.1, 0.1, -1.0), (0.0, 0.0, 1.0)), (3, (5.0, 5.0, 5.0), (1.0, 0.0, 0.0))]


def _sql_rays(tol: float) -> str:
    rows = []
    for q, o, d in RAYS:
        n = sum(c * c for c in d) ** 0.5
        rows.append(f"({q}, " + ", ".join(f"{v!r}::DOUBLE" for v in (*o, *(c / n for c in d))) + ")")
    t = "(p.x - ox) * dx + (p.y - oy) * dy + (p.z - oz) * dz"
    perp = " + ".join(f"({a} - (o{a} + d{a} * t)) * ({a} - (o{a} + d{a} * t))" for a in AXES)
    return f"{_with('c2')}, r(q_id, ox, oy, oz, dx, dy, dz) AS (VALUES {', '.join(rows)}), s AS (SELECT q_id, p.idx, p.x, p.y, p.z, ox, oy, oz, dx, dy, dz, {t} AS t FROM c2 p, r), w AS (SELECT q_id, idx, t, {perp} AS perp2 FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY perp2, idx) AS r FROM w WHERE perp2 <= {tol} * {tol} AND t >= 0) SELECT q_id::BIGINT AS q_id, idx, round(t, 9) AS t, round(perp2, 12) AS perp2 FROM k WHERE r = 1"


@query(_sql_rays(0.05))
def ray_pick(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.ray_pick(clouds.embeddings(spark, sf), RAYS, 0.05).select(F.col("q_id").cast("long").alias("q_id"), "idx", F.round("t", 9).alias("t"), F.round("perp2", 12).alias("perp2"))


_RAY_T = "(p.x - ox) * dx + (p.y - oy) * dy + (p.z - oz) * dz"
_RAY_PERP = " + ".join(f"(({a} - (o{a} + d{a} * t)) * ({a} - (o{a} + d{a} * t)))" for a in AXES)


@query(f"""{_with('c2')}, e AS (SELECT vec_id AS q_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
l AS (SELECT q_id, e[5] AS ox, e[6] AS oy, e[7] AS oz, e[8] AS ux, e[9] AS uy, e[10] AS uz, sqrt(e[8] * e[8] + e[9] * e[9] + e[10] * e[10]) AS n FROM e),
r AS (SELECT q_id, ox, oy, oz, ux / n AS dx, uy / n AS dy, uz / n AS dz FROM l WHERE n > 0),
s AS (SELECT r.*, p.idx, p.x, p.y, p.z, {_RAY_T} AS t FROM r, c2 p), w AS (SELECT q_id, idx, t, {_RAY_PERP} AS perp2 FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY perp2, idx) AS rank FROM w WHERE t >= -0.05 AND perp2 <= 0.05 * 0.05)
SELECT q_id, idx, round(t, 9) AS t, round(perp2, 12) AS perp2 FROM k WHERE rank = 1""")
def ray_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rays from a table: origin and direction of every fiftieth vector, through the cloud of all vectors."""
    part = lambda i: F.element_at("embedding", i).cast("double")
    names = ["ox", "oy", "oz", "dx", "dy", "dz"]
    lines = clouds.table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), *(part(k + 5).alias(n) for k, n in enumerate(names)))
    return spatial.ray_join(lines, clouds.embeddings(spark, sf), 0.05).select("q_id", "idx", F.round("t", 9).alias("t"), F.round("perp2", 12).alias("perp2"))


@query(f"{_with('c2')} SELECT q.idx AS idx, count(*)::BIGINT AS n, round(avg(p.x), 9) AS mx, round(avg(p.y), 9) AS my, round(avg(p.z), 9) AS mz, round(covar_pop(p.x, p.x), 9) AS cxx, round(covar_pop(p.x, p.y), 9) AS cxy, round(covar_pop(p.x, p.z), 9) AS cxz, round(covar_pop(p.y, p.y), 9) AS cyy, round(covar_pop(p.y, p.z), 9) AS cyz, round(covar_pop(p.z, p.z), 9) AS czz FROM c2 q JOIN c2 p ON {_D2} <= 0.1 * 0.1 GROUP BY 1")
def covariance(spark: SparkSession, sf: str) -> DataFrame:
    c = spatial.covariance(clouds.embeddings(spark, sf), 0.1)
    return c.select("idx", "n", *((F.round(n, 9) + 0.0).alias(n) for n in c.columns[2:]))


@query()
def curvature(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.curvature(clouds.embeddings(spark, sf), 0.1)


@query(f"{_with('c2')}, b AS (SELECT {SQL_BOUNDS} FROM c2), d AS (SELECT idx, sqrt((x - (min_x + max_x) * 0.5) * (x - (min_x + max_x) * 0.5) + (y - (min_y + max_y) * 0.5) * (y - (min_y + max_y) * 0.5) + (z - (min_z + max_z) * 0.5) * (z - (min_z + max_z) * 0.5)) AS distance FROM c2, b) SELECT idx, round(distance, 9) AS distance, (row_number() OVER (ORDER BY distance DESC, idx) - 1)::BIGINT AS rank FROM d")
def candidate_order(spark: SparkSession, sf: str) -> DataFrame:
    return poisson.candidate_order(clouds.embeddings(spark, sf)).select("idx", F.round("distance", 9).alias("distance"), "rank")


@query()
def poisson_sample(spark: SparkSession, sf: str) -> DataFrame:
    return poisson.poisson(clouds.embeddings(spark, sf), target=100, least=0.05)


@query()
def curvature_sample(spark: SparkSession, sf: str) -> DataFrame:
    return poisson.curvature_sample(clouds.embeddings(spark, sf), 0.1, 0.05, target=100)


# --- split statistics ------------------------------------------------------------------------------

_SAH = f"""{_with('c3')}, b AS (SELECT {SQL_BOUNDS} FROM c3), k AS (SELECT least(greatest(ceil(log2(count(*)))::INTEGER, 8), 16) AS bins FROM c3),
binned AS (""" + " UNION ALL ".join(f"SELECT {i} AS axis, least(greatest(floor(({a} - min_{a}) * ((bins - 1) / (max_{a} - min_{a})))::INTEGER, 0), bins - 1) AS bin, x, y, z FROM c3, b, k" for i, a in enumerate(AXES)) + f"""),
hist AS (SELECT axis, bin, count(*) AS n, {SQL_BOUNDS} FROM binned GROUP BY 1, 2)"""
_LR = ", ".join(f"{n}({n}_{a}) OVER {w} AS {w}_{n}_{a}" for w in ("lw", "rw") for n in ("min", "max") for a in AXES)


@query(f"{_SAH} SELECT axis::BIGINT AS axis, bin::BIGINT AS bin, n::BIGINT AS n, {', '.join(BOUNDS)} FROM hist")
def sah_hist(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.orders(spark, sf)
    h = kdstats.histogram(p, agg.box_of(p), kdstats.bin_count(p.count()))
    return h.select(F.col("axis").cast("long").alias("axis"), F.col("bin").cast("long").alias("bin"), "n", *BOUNDS)


@query(f"{_SAH} SELECT axis::BIGINT AS axis, bin::BIGINT AS bin, (sum(n) OVER lw)::BIGINT AS left_n, coalesce(sum(n) OVER rw, 0)::BIGINT AS right_n FROM hist WINDOW lw AS (PARTITION BY axis ORDER BY bin ROWS UNBOUNDED PRECEDING), rw AS (PARTITION BY axis ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
def sah_prefix_suffix(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.orders(spark, sf)
    h = kdstats.prefix_suffix(kdstats.histogram(p, agg.box_of(p), kdstats.bin_count(p.count())))
    return h.select(F.col("axis").cast("long").alias("axis"), F.col("bin").cast("long").alias("bin"), "left_n", "right_n")


def _sql_area(p: str) -> str:
    e = [f"greatest({p}max_{a} - {p}min_{a}, 1e-9)" for a in AXES]
    return f"(2.0 * ({e[0]} * {e[1]} + {e[1]} * {e[2]} + {e[2]} * {e[0]}))"


@query(f"""{_SAH}, w AS (SELECT axis, bin, sum(n) OVER lw AS ln, coalesce(sum(n) OVER rw, 0) AS rn, {_LR} FROM hist WINDOW lw AS (PARTITION BY axis ORDER BY bin ROWS UNBOUNDED PRECEDING), rw AS (PARTITION BY axis ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT axis, {_sql_area('lw_')} / {_sql_area('')} * ln + {_sql_area('rw_')} / {_sql_area('')} * rn AS cost, CASE axis WHEN 0 THEN min_x WHEN 1 THEN min_y ELSE min_z END + (bin + 1) / bins::DOUBLE * (CASE axis WHEN 0 THEN max_x - min_x WHEN 1 THEN max_y - min_y ELSE max_z - min_z END) AS split, bin FROM w, b, k WHERE rn > 0 AND bin < bins - 1)
SELECT axis::BIGINT AS axis, round(split, 6) AS split, round(cost, 6) AS cost FROM c ORDER BY c.cost, c.axis, c.bin LIMIT 1""")
def sah_split(spark: SparkSession, sf: str) -> DataFrame:
    return kdstats.best_split(clouds.orders(spark, sf)).select(F.col("axis").cast("long").alias("axis"), F.round("split", 6).alias("split"), F.round("cost", 6).alias("cost"))


@query(f"{_with('c3')}, r AS (SELECT idx, y AS value, row_number() OVER (ORDER BY y, idx) - 1 AS pos, count(*) OVER () AS n FROM c3) SELECT idx, value FROM r WHERE pos = n // 2")
def median_entry(spark: SparkSession, sf: str) -> DataFrame:
    return kdstats.median_entry(clouds.orders(spark, sf), "y")


# --- changes, measurements, catalog ----------------------------------------------------------------


@query(f"{_with('c1')}, ch AS (SELECT event_id // 2 AS idx, max_by(value, event_id) AS z FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT c1.idx, x, y, coalesce(ch.z, c1.z) AS z FROM c1 LEFT JOIN ch ON ch.idx = c1.idx")
def point_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = clouds.table(spark, sf, "events").filter("event_id % 3 = 0")
    changes = e.select(F.floor(F.col("event_id") / 2).alias("idx"), F.col("event_id").alias("seq"), F.col("value").alias("z"))
    return updates.merge(clouds.events(spark, sf).select("idx", *AXES), changes)


@query(f"{_with('c1')} SELECT idx, x, y, z FROM c1 UNION ALL SELECT idx + 1000000 AS idx, x, y, z FROM c3".replace("WITH", f"WITH {clouds.SQL['c3']},", 1))
def append_cloud(spark: SparkSession, sf: str) -> DataFrame:
    more = clouds.orders(spark, sf).select((F.col("idx") + 1000000).alias("idx"), *AXES)
    return updates.append(clouds.events(spark, sf).select("idx", *AXES), more)


@query(f"{_with('c1')} SELECT idx FROM c1 WHERE idx % 4 <> 0")
def anti_remainder(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.events(spark, sf)
    return updates.remainder(p, p.filter("idx % 4 = 0")).select("idx")


@query(f"{_with('c1')}, p AS (SELECT idx, rgb, row_number() OVER (ORDER BY idx) - 1 AS pos FROM c1), l(level, step) AS (VALUES (1.0::DOUBLE, 1), (0.5::DOUBLE, 2), (0.25::DOUBLE, 4), (0.1::DOUBLE, 10), (0.05::DOUBLE, 20)) SELECT level, (pos // step)::BIGINT AS pos, idx, rgb FROM p, l WHERE pos % step = 0")
def lod_color_join(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.events(spark, sf)
    return updates.recolor(sampling.levels(sampling.by_density(p, 1.0)), p)


@query(f"{_with('c1')} SELECT idx, x, y, z FROM c1 WHERE idx % 10 = 3")
def guides_semi(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.events(spark, sf)
    return updates.guides(p, p.filter("idx % 10 = 3").select("idx"))


@query(f"{_with('c1')} SELECT idx, x, y, z FROM c1 WHERE idx = (SELECT max(idx) - 4 FROM c1)")
def ordinal_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return updates.at_ordinal(clouds.events(spark, sf), -5).select("idx", *AXES)


_FMT = lambda c: f"printf('%.6f', {c})"


@query(f"{_with('c1')} SELECT idx, {_FMT('x')} || ' ' || {_FMT('y')} || ' ' || {_FMT('z')} || ' ' || ((rgb >> 16) & 255) || ' ' || ((rgb >> 8) & 255) || ' ' || (rgb & 255) || ' ' || {_FMT('intensity')} AS line FROM c1")
def ply_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ply.ply_rows(clouds.events(spark, sf))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = clouds.embeddings(spark, sf)
    a = p.select("idx", *(F.col(c).alias(f"from_{c}") for c in AXES))
    return a.join(p.select((F.col("idx") - 1).alias("idx"), *(F.col(c).alias(f"to_{c}") for c in AXES)), "idx")


_SQL_PAIRS = f"{_with('c2')}, m AS (SELECT a.idx, " + ", ".join(f"a.{c} AS from_{c}, b.{c} AS to_{c}" for c in AXES) + " FROM c2 a JOIN c2 b ON b.idx = a.idx + 1), d AS (SELECT *, " + ", ".join(f"to_{c} - from_{c} AS d{c}" for c in AXES) + " FROM m)"


@query(f"{_SQL_PAIRS} SELECT idx, round(sqrt(dx * dx + dy * dy + dz * dz), 9) AS distance, " + ", ".join(f"round(from_{c} * 0.5 + to_{c} * 0.5, 9) + 0.0 AS mid_{c}" for c in AXES) + " FROM d")
def measure(spark: SparkSession, sf: str) -> DataFrame:
    return updates.measure(_pairs(spark, sf)).select("idx", F.round("distance", 9).alias("distance"), *((F.round(f"mid_{c}", 9) + 0.0).alias(f"mid_{c}") for c in AXES))


@query(f"{_SQL_PAIRS}, s AS (SELECT idx, dx, dy, dz, sqrt(dx * dx + dy * dy) AS flat, greatest(sqrt(dx * dx + dy * dy + dz * dz) * 0.25, 0.1) AS size FROM d) SELECT idx, round(dy / flat * size, 9) + 0.0 AS off_x, round(-dx / flat * size, 9) + 0.0 AS off_y, 0.0::DOUBLE AS off_z FROM s WHERE flat > 1e-9")
def dimension_offset(spark: SparkSession, sf: str) -> DataFrame:
    return updates.dimension_offset(_pairs(spark, sf)).select("idx", *((F.round(f"off_{c}", 9) + 0.0).alias(f"off_{c}") for c in AXES))


@query(f"{_SQL_PAIRS} SELECT idx, round(sqrt(dx * dx + dy * dy + dz * dz), 9) AS distance FROM d ORDER BY idx DESC LIMIT 20")
def history_last20(spark: SparkSession, sf: str) -> DataFrame:
    return updates.last_rows(updates.measure(_pairs(spark, sf)), "idx", 20).select("idx", F.round("distance", 9).alias("distance"))


@query(_SQL_PAIRS + ''' SELECT idx, '"' || strftime(TIMESTAMP '1970-01-01' + to_seconds(idx * 3600), '%Y-%m-%dT%H:%M:%SZ') || '","' || printf('%.3f', sqrt(dx * dx + dy * dy + dz * dz)) || '","say ""hi""","' || ''' + """ || '","' || """.join(f"printf('%.6f', {e}_{c})" for e in ("from", "to") for c in AXES) + """ || '"' AS line FROM d""")
def measurement_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The nine columns of a measurement, all quoted."""
    m = updates.measure(_pairs(spark, sf))
    own = m.select("idx", reports.iso(reports.timestamp(F.col("idx") * 3600)).alias("timestamp"), text.fixed(F.col("distance"), 3).alias("distance"), F.lit('say "hi"').alias("label"), *(text.fixed(F.col(f"{e}_{c}"), 6).alias(f"{e}_{c}") for e in ("from", "to") for c in AXES))
    return own.select("idx", updates.csv_row(*map(F.col, reports.COLUMNS["measurements"])).alias("line"))


@query("SELECT o_orderkey AS idx, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') AS shown FROM orders")
def timestamps(spark: SparkSession, sf: str) -> DataFrame:
    ts = reports.timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return clouds.table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), reports.iso(ts).alias("iso"), reports.shown(ts).alias("shown"))


@query("SELECT event_type AS scenario, round(sum(value), 6) AS duration, count(*)::BIGINT AS processed, max(user_id)::BIGINT AS peak_memory, round(count(*) / sum(value), 9) AS rate FROM events GROUP BY 1")
def bench_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = clouds.table(spark, sf, "events").select(F.col("event_type").alias("scenario"), F.col("value").alias("duration"), F.lit(1).alias("processed"), F.col("user_id").alias("peak_memory"))
    return reports.summary(e, "scenario").select("scenario", F.round("duration", 6).alias("duration"), "processed", "peak_memory", F.round("rate", 9).alias("rate"))


@query("SELECT user_id AS job, round(sum(value), 6) AS total, round(coalesce(sum(value) FILTER (WHERE event_id % 3 = 0), 0), 6) AS parse, round(coalesce(sum(value) FILTER (WHERE event_id % 3 = 1), 0), 6) AS append, max(event_id)::BIGINT AS points, max(event_id % 1000)::BIGINT AS peak_memory FROM events GROUP BY 1")
def import_summary(spark: SparkSession, sf: str) -> DataFrame:
    phase = F.element_at(F.array(F.lit("parsing"), F.lit("append"), F.lit("register")), (F.col("event_id") % 3 + 1).cast("int"))
    e = clouds.table(spark, sf, "events").select(F.col("user_id").alias("job"), phase.alias("phase"), F.col("value").alias("duration"), F.col("event_id").alias("points"), (F.col("event_id") % 1000).alias("peak_memory"))
    s = reports.import_summary(e)
    return s.select("job", *(F.round(c, 6).alias(c) for c in ("total", "parse", "append")), "points", "peak_memory")


@query("""WITH c AS (SELECT event_type, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT '{"name":"' || event_type || '","points":' || n || ',"visible":true}' AS json FROM c""")
def catalog_json(spark: SparkSession, sf: str) -> DataFrame:
    c = clouds.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("points"))
    return c.select(F.to_json(F.struct(F.col("event_type").alias("name"), "points", F.lit(True).alias("visible"))).alias("json"))


@query("SELECT event_id, CASE WHEN k = 1 THEN event_type ELSE event_type || ' (' || k || ')' END AS unique_name FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    return updates.unique_names(clouds.table(spark, sf, "events"), "event_type", "event_id").select("event_id", "unique_name")


@query("SELECT c_custkey AS uid FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def register_clouds(spark: SparkSession, sf: str) -> DataFrame:
    c = clouds.table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"))
    return updates.register(c.filter("uid % 2 = 0"), c.filter("uid % 3 = 0"), "uid")


@query("SELECT c_custkey AS uid FROM customer WHERE c_custkey % 5 <> 0")
def remove_clouds(spark: SparkSession, sf: str) -> DataFrame:
    c = clouds.table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"))
    return updates.remove(c, c.filter("uid % 5 = 0"), "uid")


# --- telemetry -------------------------------------------------------------------------------------

_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_GAP = f"(epoch_us(lead(ts) {_OVER}) - epoch_us(ts)) / 1e6"
_STATES = list(telemetry.FOLLOW)


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 8 + 1).cast("int")).alias("state"))


_SQL_STATE = "[" + ", ".join(f"'{s}'" for s in _STATES) + "][event_id % 8 + 1]"


@query(f"SELECT event_id, round({_GAP}, 6) AS duration FROM events")
def phase_durations(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.phase_durations(_jobs(spark, sf), "user_id", "ts", "event_id").select("event_id", F.round("duration", 6).alias("duration"))


@query(f"SELECT event_id, round(i, 6) AS interval, round(CASE WHEN i > 0 THEN 1.0 / i END, 9) AS frequency FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) {_OVER})) / 1e6 AS i FROM events)")
def emit_interval(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.emit_interval(_jobs(spark, sf), "user_id", "ts", "event_id").select("event_id", F.round("interval", 6).alias("interval"), F.round("frequency", 9).alias("frequency"))


@query(f"SELECT event_id FROM (SELECT event_id, {_GAP} AS g FROM events) WHERE g IS NULL OR g >= 3600")
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.debounce(_jobs(spark, sf), "user_id", "ts", "event_id", 3600.0).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, event_id // 1000 AS v, max(event_id // 1000) OVER (PARTITION BY user_id) AS m FROM events) WHERE v = m")
def stale_drop(spark: SparkSession, sf: str) -> DataFrame:
    rows = _jobs(spark, sf).withColumn("version", F.floor(F.col("event_id") / 1000))
    return telemetry.latest(rows, "user_id", "version").select("event_id")


@query(f"WITH s AS (SELECT event_id, {_SQL_STATE} AS st, lag({_SQL_STATE}) {_OVER} AS b FROM events), f(b, st) AS (VALUES " + ", ".join(f"('{b}', '{n}')" for b, ns in telemetry.FOLLOW.items() for n in ns) + ") SELECT event_id, CASE WHEN s.b IS NULL THEN s.st = 'init' ELSE EXISTS (SELECT 1 FROM f WHERE f.b = s.b AND f.st = s.st) END AS valid FROM s")
def fsm_check(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.fsm_check(_jobs(spark, sf), "user_id", "state", "ts", "event_id").select("event_id", "valid")


@query(f"SELECT event_id, state, round(d, 6) AS duration FROM (SELECT event_id, {_SQL_STATE} AS state, {_GAP} AS d FROM events) WHERE d > CASE state WHEN 'parsing' THEN 120 WHEN 'sampling' THEN 60 WHEN 'build_index' THEN 120 WHEN 'register' THEN 30 END")
def state_timeout(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.state_timeout(_jobs(spark, sf), "user_id", "state", "ts", "event_id").select("event_id", "state", F.round("duration", 6).alias("duration"))


@query(f"WITH n AS (SELECT user_id, event_id, event_type, ts, CASE WHEN lag(event_type) {_OVER} IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS f FROM events), r AS (SELECT *, sum(f) {_OVER} AS run FROM n) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, epoch_us(min(ts))::BIGINT AS first_us, epoch_us(max(ts))::BIGINT AS last_us, count(*)::BIGINT AS n FROM r GROUP BY 1, 2")
def repeat_suppress(spark: SparkSession, sf: str) -> DataFrame:
    r = telemetry.suppress_repeats(_jobs(spark, sf), "user_id", "event_type", "ts", "event_id")
    return r.select("user_id", "run", "event_type", micros("first_ts").alias("first_us"), micros("last_ts").alias("last_us"), "n")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
t(user_id, event_id, k, last, go) AS (SELECT user_id, event_id, k, us, true FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.us - t.last >= 86400000000 THEN o.us ELSE t.last END, o.us - t.last >= 86400000000 FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k + 1)
SELECT user_id, event_id FROM t WHERE go""")
def throttle(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.throttle(_jobs(spark, sf), "user_id", "ts", "event_id", 86400.0)


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN event_id % 5 > 0 THEN 'phase ' || (event_id // 700) END AS m, event_id % 97 = 0 OR value >= 480 AS f,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
t(user_id, event_id, k, last, m, go) AS (SELECT user_id, event_id, k, us, m, true FROM o WHERE k = 1 UNION ALL
SELECT user_id, event_id, k, CASE WHEN g THEN us ELSE last END, CASE WHEN g THEN m ELSE told END, g FROM (SELECT o.*, t.last, t.m AS told, o.f OR o.us - t.last >= 604800000000 OR (o.m IS NOT NULL AND o.m IS DISTINCT FROM t.m) AS g FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k + 1))
SELECT user_id, event_id FROM t WHERE go""")
def throttle_bypass(spark: SparkSession, sf: str) -> DataFrame:
    """The throttle with messages, forced and complete events, which go through at any time."""
    e = clouds.table(spark, sf, "events").withColumns({"message": F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("phase "), F.floor(F.col("event_id") / 700).cast("string"))), "force": F.col("event_id") % 97 == 0, "fraction": F.col("value") / 480.0})
    return telemetry.throttle(e, "user_id", "ts", "event_id", 604800.0, "message", "force", "fraction")


def _sql_levels() -> str:
    lv = sampling.LEVELS
    up = lambda k: "CASE " + " ".join(f"WHEN r <= {lv[j][2]} THEN {j}" for j in range(k, len(lv) - 1)) + f" ELSE {len(lv) - 1} END" if k < len(lv) - 1 else str(k)
    down = lambda k: "CASE " + " ".join(f"WHEN r >= {lv[j][1]} THEN {j}" for j in range(k, 0, -1)) + " ELSE 0 END" if k else "0"
    return "CASE l " + " ".join(f"WHEN {k} THEN CASE WHEN {'r > ' + str(lv[k][2]) if k < len(lv) - 1 else 'false'} THEN {up(k)} WHEN r < {lv[k][1]} THEN {down(k)} ELSE {k} END" for k in range(len(lv))) + " END"


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, value / 80.0 AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
t(user_id, event_id, k, l) AS (SELECT user_id, event_id, k, CASE WHEN r <= 1.5 THEN 0 WHEN r <= 2.5 THEN 1 WHEN r <= 3.5 THEN 2 WHEN r <= 5.0 THEN 3 ELSE 4 END FROM o WHERE k = 1 UNION ALL SELECT user_id, event_id, k, {_sql_levels()} FROM (SELECT o.user_id, o.event_id, o.k, o.r, t.l FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k + 1))
SELECT user_id, event_id, [1.0, 0.5, 0.25, 0.1, 0.05][l + 1]::DOUBLE AS level FROM t""")
def lod_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    rows = clouds.table(spark, sf, "events").withColumn("ratio", F.col("value") / 80.0)
    return telemetry.hysteresis(rows, "user_id", "ratio", "ts", "event_id")


@query("SELECT event_id, round(CASE WHEN user_id > 0 THEN least(greatest(CASE WHEN event_id <= user_id * 50 THEN event_id / (user_id * 50.0) ELSE value / 500.0 END, 0.0), 1.0) ELSE least(value / 500.0, 1.0) END, 9) AS fraction FROM events")
def progress_fraction(spark: SparkSession, sf: str) -> DataFrame:
    e = clouds.table(spark, sf, "events")
    return e.select("event_id", F.round(text.fraction(F.col("event_id"), F.col("user_id") * 50, F.col("value"), F.lit(500.0)), 9).alias("fraction"))


# --- formats and normalisers -----------------------------------------------------------------------


@query("SELECT o_orderkey AS idx, CASE WHEN o_totalprice >= 1000 THEN printf('%.1f', o_totalprice / 1000) || 'k' ELSE round(o_totalprice)::BIGINT::VARCHAR END AS s FROM orders")
def fmt_count(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), text.count(F.col("o_totalprice")).alias("s"))


_ZEROS = lambda s: f"regexp_replace(regexp_replace({s}, '\\.0+$', ''), '(\\.\\d*?)0+$', '\\1')"


@query(f"SELECT o_orderkey AS idx, CASE WHEN v >= 1048576 THEN {_ZEROS('printf($$%.2f$$, v / 1048576)')} || ' MB' WHEN v >= 1024 THEN {_ZEROS('printf($$%.2f$$, v / 1024)')} || ' KB' ELSE round(v)::BIGINT || ' B' END AS s FROM (SELECT o_orderkey, o_totalprice * (o_orderkey % 7) AS v FROM orders)")
def fmt_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), text.size(F.col("o_totalprice") * (F.col("o_orderkey") % 7)).alias("s"))


_BOOLS = ["true", " YES ", "1", "on", "0", "no", "Off", "false", "", "  ", "maybe", "2"]
_INTS = ["12", " 7x", "-3", "0", "abc", "", "99999", "4.9", "+8"]


@query(f"SELECT event_id AS i, trim(s) <> '' AND lower(trim(s)) NOT IN ('false', '0', 'no', 'off') AS b FROM (SELECT event_id, CASE WHEN user_id % 20 = 0 THEN event_type ELSE {_sql_pick(_BOOLS, 'event_id')} END AS s FROM events)")
def norm_bool(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("user_id") % 20 == 0, F.col("event_type")).otherwise(_pick(_BOOLS, F.col("event_id")))
    return clouds.table(spark, sf, "events").select(F.col("event_id").alias("i"), text.boolean(s).alias("b"))


@query(f"SELECT event_id AS i, CASE WHEN n > 0 THEN n ELSE 250 END::BIGINT AS n FROM (SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(CASE event_id % 4 WHEN 0 THEN ' ' || user_id || 'x' WHEN 1 THEN '-' || user_id WHEN 2 THEN event_type ELSE {_sql_pick(_INTS, 'user_id')} END, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), 0) AS n FROM events)")
def norm_int(spark: SparkSession, sf: str) -> DataFrame:
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    s = F.when(k == 0, F.concat(F.lit(" "), user, F.lit("x"))).when(k == 1, F.concat(F.lit("-"), user)).when(k == 2, F.col("event_type")).otherwise(_pick(_INTS, F.col("user_id")))
    return clouds.table(spark, sf, "events").select(F.col("event_id").alias("i"), text.positive_int(s, 250).alias("n"))


@query("SELECT event_id, regexp_replace(event_type || ' / user #' || user_id, '[^\\w\\-.]+', '_', 'g') || '.ply' AS name FROM events")
def filename(spark: SparkSession, sf: str) -> DataFrame:
    e = clouds.table(spark, sf, "events")
    return e.select("event_id", text.file_name(F.concat("event_type", F.lit(" / user #"), F.col("user_id").cast("string"))).alias("name"))


@query(f"{_with('c2')} SELECT idx, '(' || printf('%.3f', x) || ', ' || printf('%.3f', y) || ', ' || printf('%.3f', z) || ')' AS s FROM c2")
def fmt_point(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.embeddings(spark, sf).select("idx", text.point(F.col("x"), F.col("y"), F.col("z")).alias("s"))


@query("SELECT p_partkey AS idx, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT AS seed FROM part")
def fnv_seed(spark: SparkSession, sf: str) -> DataFrame:
    return clouds.table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), color.fnv1a_of(F.col("p_name")).alias("seed"))