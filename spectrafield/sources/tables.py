"""Inputs: tables as they are and the engine's views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wavelengths of the 64 values of a spectrum.
WAVELENGTHS = [390.0 + 10 * i for i in range(64)]
#: Columns of the raster view.
RASTER_COLUMNS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> F.Column:
    """Two-decimal values as whole numbers: their sums do not depend on order."""
    return F.round(F.col(column) * 100).cast("long")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long observations: set_id, channel, point_id, value in hundredths."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("channel"), F.col("l_partkey").alias("point_id"), cents("l_discount").alias("value")
    )


def band_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bands b, g, r, e, n by point and date, with the targets size and price."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("point_id"), F.col("l_returnflag").alias("date")).agg(
        F.sum(cents("l_discount")).alias("sb"), F.sum(cents("l_tax")).alias("sg"), F.sum(cents("l_quantity")).alias("sr"), F.sum(cents("l_extendedprice")).alias("se"), F.count("*").alias("k")
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), "p_retailprice", "p_size")
    k = F.col("k") * 100.0
    return items.join(parts, "point_id").select(
        "point_id", "date", (F.col("sb") / k).alias("b"), (F.col("sg") / k).alias("g"), (F.col("sr") / k / 50.0).alias("r"), (F.col("se") / k / 100000.0).alias("e"),
        (F.col("p_retailprice") / 1000.0).alias("n"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.col("k").alias("n_obs"),
    )


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, spectrum (array of double), target."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("spectrum"), F.col("label").cast("double").alias("target")
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a 20 m grid: site, x, y, v (value), u (a second one)."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("site"), (F.col("s_suppkey") % 10 * 20).cast("double").alias("x"), (F.floor(F.col("s_suppkey") / 10) * 20).cast("double").alias("y"),
        F.col("s_acctbal").alias("v"), F.col("s_nationkey").cast("double").alias("u"),
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table: row, col, b0 .. b4; pixels without items have zeros, which is no data."""
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(cents("l_quantity")).alias("q"), F.sum(cents("l_discount")).alias("d"), F.sum(cents("l_tax")).alias("t"), F.sum(cents("l_extendedprice")).alias("p")
    )
    at = lambda c, scale: F.coalesce(F.col(c) / scale, F.lit(0.0))
    return table(spark, sf_dir, "orders").join(sums, "o_orderkey", "left").select(
        F.floor(F.col("o_orderkey") / RASTER_COLUMNS).cast("int").alias("row"), (F.col("o_orderkey") % RASTER_COLUMNS).cast("int").alias("col"),
        at("d", 100.0).alias("b0"), at("t", 100.0).alias("b1"), at("q", 10000.0).alias("b2"), at("p", 1e8).alias("b3"),
        F.when(F.col("q").isNotNull(), cents("o_totalprice") / 1e8).otherwise(0.0).alias("b4"),
    )
