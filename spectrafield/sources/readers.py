"""Tables from files: readers by extension, spectra with wavelengths as headers, precedence of sources; writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": lambda spark, path: spark.read.csv(path, header=True, inferSchema=True),
    ".parquet": lambda spark, path: spark.read.parquet(path),
    ".json": lambda spark, path: spark.read.json(path),
}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, read as its extension says; others raise ``ValueError``."""
    for extension, reader in READERS.items():
        if path.rstrip("/").lower().endswith(extension):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems know the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def first_source(spark: SparkSession, paths: list[str]) -> str:
    """The first of ``paths`` that is there; none raises ``FileNotFoundError``."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))


def read_spectra(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, list[float]]:
    """(point_id, spectrum) and the wavelengths of a CSV file whose headers are wavelengths, in their order."""
    raw = spark.read.csv(path, header=True)
    waves = sorted((c for c in raw.columns if c != key), key=float)
    return raw.select(F.col(key).cast("long").alias("point_id"), F.array(*[F.col(f"`{c}`").try_cast("double") for c in waves]).alias("spectrum")), [float(c) for c in waves]


def measured(text: Column) -> Column:
    """A laboratory value: decimal commas are points; what is below detection (``<0.05``) or no number is NULL."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def channel_of(stem: Column, prefix: int) -> Column:
    """Channel of a file's stem of digits without its first ``prefix``; NULL for other stems."""
    return F.when(stem.rlike(r"^[0-9]+$"), F.substring(stem, prefix + 1, 20).try_cast("int"))


def wavelength_map(spark: SparkSession, header: list[float]) -> DataFrame:
    """(channel from 1, wavelength) of a header."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, header))).alias("at", "wavelength")).select((F.col("at") + 1).alias("channel"), "wavelength")


def write_table(df: DataFrame, path: str, digits: int | None = None) -> None:
    """To CSV (one header a file) or Parquet as the extension says; ``digits`` rounds doubles, in CSV reports only."""
    if path.lower().endswith(".csv"):
        shown = df if digits is None else df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        shown.write.mode("overwrite").csv(path, header=True)
    elif path.lower().endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no writer for {path}")


def markdown_row(df: DataFrame, digits: int = 3) -> Column:
    """A row of a report's table."""
    shown = [F.format_string(f"%.{digits}f", F.col(c)) if t == "double" else F.col(c).cast("string") for c, t in df.dtypes]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(s, F.lit("")) for s in shown]), F.lit(" |"))
