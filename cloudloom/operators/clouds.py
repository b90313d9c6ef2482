"""Point clouds as DataFrames: idx, x, y, z, and where present rgb, intensity and ts.

Row identity is idx, never the order of rows. The five clouds derive from the star-schema tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r, g, b = F.col("user_id"), F.col("event_id"), F.col("user_id") + F.col("event_id")
    rgb = F.shiftleft(r.bitwiseAND(255), 16).bitwiseOR(F.shiftleft(g.bitwiseAND(255), 8)).bitwiseOR(b.bitwiseAND(255))
    return e.select(
        F.col("event_id").alias("idx"), F.col("user_id").cast("double").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"),
        F.col("value").alias("z"), F.col("value").alias("intensity"), rgb.alias("rgb"), "ts",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), dim(1).alias("x"), dim(2).alias("y"), dim(3).alias("z"), dim(4).alias("intensity"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"), day.alias("z"), F.col("o_totalprice").alias("intensity"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"), F.col("l_tax").alias("intensity"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 10).cast("double").alias("z"))


#: The same clouds for the SQL side.
SQL = {
    "c1": "c1 AS (SELECT event_id AS idx, user_id::DOUBLE AS x, (event_id % 97)::DOUBLE AS y, value AS z, value AS intensity, (((user_id & 255) << 16) | ((event_id & 255) << 8) | ((user_id + event_id) & 255))::BIGINT AS rgb, ts FROM events)",
    "c2": "c2 AS (SELECT vec_id AS idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS intensity FROM embeddings)",
    "c3": "c3 AS (SELECT o_orderkey AS idx, o_custkey::DOUBLE AS x, o_totalprice AS y, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::DOUBLE AS z, o_totalprice AS intensity FROM orders)",
    "c4": "c4 AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice AS y, l_discount AS z, l_tax AS intensity FROM lineitem)",
    "c5": "c5 AS (SELECT p_partkey AS idx, p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey % 10)::DOUBLE AS z FROM part)",
}
