"""Line dedup with a suffix array over line-ID sequences, built by distributed prefix doubling.

Only DataFrame functions. Every line that is not blank gets a 128-bit name; the names that occur twice
or more are sorted by range and ranked. Doubling: the rank of the run of 2k lines at a position is the
rank of the pair (rank of its first k lines, rank of the next k), again by a range sort of the distinct
pairs, so a line or pair that holds a third of all rows is split like any other range of the sort.
Positions whose run occurs once leave: their suffixes are told apart. Doubling goes on with the others until none is
left, so the number of rounds follows the longest repeat. Suffixes that share a rank at depth k are an LCP interval
of at least k lines; its first suffix (by document, then line) is the original, the others begin later copies.

The later copies of all intervals of `min_lines` lines or more (consecutive, blank lines left out), and those of single
lines of `min_chars` characters or more, are united to the maximal repeated runs of each document; these are deleted.

Defined cases: null text is one blank line and stays null; blank lines are never removed and count in
no run; documents are ordered by key (null first), then by a hash of their text; rows that repeat key
and text are one document and fare alike; copies may lie in one document and may overlap (the first
line of the first copy is always kept); other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

_AT = ("doc", "hash", "seq")


def _numbered(text: Column) -> Column:
    """Array of (line, i): the lines of a text that are not blank, with their place among all lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda e: e["line"].rlike(r"[^\x20\x09-\x0D]"))


def _ranked(groups: DataFrame, *by: str) -> DataFrame:
    """groups with a rank that follows the order of the (distinct) columns `by`."""
    ordered = groups.repartitionByRange(parallelism(groups.sparkSession), *by).sortWithinPartitions(*by)
    return ordered.withColumn("rank", F.monotonically_increasing_id())


def _intervals(runs: DataFrame) -> DataFrame:
    """runs (places, with the names a and b of a run) whose run occurs twice or more: rank, and whether the place is a later copy."""
    found = runs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct(*_AT)).alias("first")).filter("n > 1").drop("n")
    ranks = materialize(_ranked(found, "a", "b"), "intervals")
    return runs.join(ranks, ["a", "b"]).withColumn("copy", F.struct(*_AT) != F.col("first")).drop("a", "b", "first")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 2, min_chars: int = 200) -> DataFrame:
    """(doc, hash, seq, n): the n lines from seq on, blank ones not counted, are a later copy; of every LCP interval at the depths of the doubling."""
    rows = docs.select(F.col(_name(key)).alias("doc"), F.xxhash64(_name(text)).alias("hash"), F.posexplode(_numbered(F.col(_name(text)))).alias("seq", "e"))
    line = F.col("e.line")
    names = materialize(rows.select(*_AT, F.xxhash64(line).alias("a"), F.xxhash64(F.lit("#"), line).alias("b"), (F.length(line) >= min_chars).alias("long")), "lines")
    now = materialize(_intervals(names), "ranks")
    out = now.filter("copy and long" if min_lines > 1 else "copy").select(*_AT, F.lit(1).alias("n"))
    depth = 1
    while True:
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        follow = now.select(F.col("doc").alias("d"), F.col("hash").alias("h"), (F.col("seq") - step).alias("s"), F.col("rank").alias("b")).distinct()
        same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("seq") == F.col("s"))
        pairs = materialize(now.join(follow, same).select(*_AT, F.col("rank").alias("a"), "b"), "pairs")
        depth += step
        now = materialize(_intervals(pairs), "ranks")
        if now.isEmpty():  # every suffix is told apart
            return out
        if depth >= min_lines:
            out = out.unionByName(now.filter("copy").select(*_AT, F.lit(depth).alias("n")))


def maximal_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 2, min_chars: int = 200) -> DataFrame:
    """(doc, hash, first_line, n_lines) of each maximal run of later copies; lines that are not blank, numbered from 0. hash: of the document's text."""
    longest = copies(docs, key, text, min_lines, min_chars).groupBy(*_AT).agg(F.max("n").alias("n"))
    order = Window.partitionBy("doc", "hash").orderBy("seq")  # the lines of one document
    reach = F.max(F.col("seq") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = longest.withColumn("new", F.coalesce((F.col("seq") > reach).cast("int"), F.lit(1)))
    placed = begun.withColumn("run", F.sum("new").over(order))
    runs = placed.groupBy("doc", "hash", "run").agg(F.min("seq").alias("first_line"), F.max(F.col("seq") + F.col("n")).alias("end"))
    return runs.select("doc", "hash", "first_line", (F.col("end") - F.col("first_line")).alias("n_lines"))


def _joined(docs: DataFrame, key: str, text: str, min_lines: int, min_chars: int) -> DataFrame:
    """row (a row of docs), kept (its text without the later copies), lines (before), full (those not blank) and gone (removed ones)."""
    runs = maximal_runs(docs, key, text, min_lines, min_chars).groupBy("doc", "hash").agg(F.collect_list(F.struct("first_line", "n_lines")).alias("runs"))
    own = docs.select(F.struct(*map(_col, docs.columns)).alias("row"), F.col(_name(key)).alias("key"), F.xxhash64(_name(text)).alias("id"))
    joined = own.join(runs, own["key"].eqNullSafe(runs["doc"]) & (own["id"] == runs["hash"]), "left")
    body = F.col("row").getField(text)
    parts = F.struct(F.split(body, "\n", -1).alias("lines"), _numbered(body)["i"].alias("at"), F.col("runs"))

    def without(p: Column) -> Column:  # p is a lambda variable: its arrays are made once for a row
        gone = F.flatten(F.transform(p["runs"], lambda r: F.slice(p["at"], r["first_line"] + 1, r["n_lines"].cast("int"))))
        kept = F.array_except(F.sequence(F.lit(0), F.size(p["lines"]) - 1), gone)
        return F.struct(F.array_join(F.transform(kept, lambda i: F.get(p["lines"], i)), "\n").alias("kept"), F.size(p["lines"]).alias("lines"), F.size(p["at"]).alias("full"), F.size(gone).alias("gone"))

    whole = F.struct(body.alias("kept"), F.coalesce(F.size(F.split(body, "\n", -1)), F.lit(1)).alias("lines"), F.lit(-1).alias("full"), F.lit(0).alias("gone"))
    return joined.select("row", F.when(F.col("runs").isNull(), whole).otherwise(F.transform(F.array(parts), without)[0]).alias("r")).select("row", "r.*")


def _name(c: str) -> str:
    return f"`{c}`"


def _col(c: str) -> Column:
    return F.col(_name(c))


def _kept(docs: DataFrame, text: str, *out: str) -> list[Column]:
    return [F.col("row").getField(c).alias(c) if c != text else F.col("kept").alias(c) for c in docs.columns if c not in out]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 2, min_chars: int = 200) -> DataFrame:
    """docs with the later copies of repeated runs of lines deleted from the text, and n_lines (before) and n_removed (which replace columns of these names)."""
    joined = _joined(docs, key, text, min_lines, min_chars)
    return joined.select(*_kept(docs, text, "n_lines", "n_removed"), F.col("lines").cast("long").alias("n_lines"), F.col("gone").cast("long").alias("n_removed"))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 2, min_chars: int = 200) -> DataFrame:
    """docs, the same columns, with the later copies deleted from the text; documents that lose every line that is not blank are left out."""
    return _joined(docs, key, text, min_lines, min_chars).filter("full != gone").select(*_kept(docs, text))
