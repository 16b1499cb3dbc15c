"""Shared pieces of the text and vector operators: staging, graph components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one of the input tables; only Spark's reader touches the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A local session without the setting (tests) gets a temporary folder; a
    cluster without it is an error, since no machine-local folder would do.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(context, "_own_shared_dir"):
        context._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="shared-")
    return context._own_shared_dir


class Staging:
    """Intermediate tables as Parquet in the shared folder.

    A staged table cuts lineage: a lost executor costs its running tasks, not
    the finished steps. Tables that a returned lazy DataFrame still reads stay
    until the session ends; ``drop`` removes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)  # workers need the package for every function of it
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def table(self, df: DataFrame, partitions: int | None = None, by: str | None = None) -> DataFrame:
        """``df``, written and read again, in a folder for each value of ``by`` that ``drop_part`` can remove. zstd works on the heap; the default codec piles up direct buffers."""
        path = f"{self.root}/t{self.count}"
        self.count += 1
        out = (df if partitions is None else df.coalesce(partitions)).write.mode("overwrite").option("compression", "zstd")
        (out if by is None else out.partitionBy(by)).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._staged_path)

    def drop_part(self, table: DataFrame, by: str, value: int) -> None:
        self._delete(f"{table._staged_path}/{by}={value}")

    def _delete(self, path: str) -> None:
        jvm, context = self.spark._jvm, self.spark.sparkContext
        if jvm is None or context._jsc is None:
            return
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

    def settle(self, times: int = 1) -> None:
        """Let the driver's JVM find the shuffles that no plan reads any more: Spark then deletes their files. The last query may be held a little longer, until its listeners are told: twice finds it as well."""
        for k in range(times):
            if k:
                time.sleep(0.3)
            gc.collect()
            self.spark._jvm.System.gc()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


#: Keys that ``join_hot`` takes apart from the rest, at most.
HOT = 1000
#: Longs in a row of the bits that ``likely`` broadcasts, bits for each key, and rows at most: 16 MB, beyond which more rows pass.
WORDS, BITS_PER_KEY, MOST_BLOCKS = 64, 16, 1 << 15


def likely(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The ``rows`` whose ``keys`` are among those of ``table``, of which there are ``total``, and few others.

    Hashes of the keys are broadcast as bits, so that wide rows that a join
    would leave out need not be shuffled for it. The join itself is still to be done.
    """
    blocks = min(MOST_BLOCKS, -(-max(1, total) * BITS_PER_KEY // (64 * WORDS)))
    hashed = F.shiftrightunsigned(F.xxhash64(*keys), 1)
    block, word, bit = f"cast(_h % {blocks} as int) _block", f"cast(shiftright(_h, 40) % {WORDS} as int)", "cast(shiftright(_h, 48) % 64 as int)"
    words = table.select(hashed.alias("_h")).selectExpr(block, f"{word} _word", f"shiftleft(1L, {bit}) _bit").groupBy("_block", "_word").agg(F.bit_or("_bit").alias("_bit"))
    words = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bit"))).alias("_map"))
    words = words.selectExpr("_block", f"transform(sequence(0, {WORDS - 1}), i -> coalesce(_map[i], 0L)) _bits")
    out = rows.withColumn("_h", hashed).selectExpr("*", block).join(F.broadcast(words), "_block")
    return out.where(f"shiftright(_bits[{word}], {bit}) & 1L = 1L").select(*rows.columns)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row a key and in ``weight`` how many of the ``total`` rows have it.

    Fewer than ``HOT`` keys can have more than ``total`` / ``HOT`` rows: these
    meet their rows by broadcast, all others by shuffle, in which the rows that
    are done, and those with a null among their keys, are dealt evenly.
    """
    values = [c for c in table.columns if c not in (*keys, weight)]
    heavy = F.col(weight) * HOT > total
    first = table.where(heavy).select(*keys, F.struct(*values).alias("_hot"))
    whole = F.col("_hot").isNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    dealt = F.when(whole, 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    out = rows.join(F.broadcast(first), keys, "left").withColumn("_dealt", dealt)
    rest = table.where(~heavy).select(*keys, F.lit(0).cast("long").alias("_dealt"), F.struct(*values).alias("_cold"))
    # without this the table's own partitioning by its keys would be taken over, and the dealing lost
    rest = rest.repartition(*keys, "_dealt")
    out = out.join(rest, [*keys, "_dealt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *[F.col("_found")[v].alias(v) for v in values])


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(rows: DataFrame, key: str, order: list, totals: dict[str, tuple[str, str]], staging: Staging) -> DataFrame:
    """``rows`` with running totals within each ``key`` along ``order``, the row itself included.

    totals: name -> (column, ``sum`` or ``xor``). Rows are dealt by ranges of
    key and order, so that one key may hold any share of them: a part sums its
    own rows, and the few keys that cross from part to part, two a part at
    most, carry on by a broadcast of what the parts before hold. Rows that are
    equal in key and order are split only if ``order`` tells them apart.
    """
    kinds = {"sum": F.sum, "xor": F.bit_xor}
    dealt = staging.table(rows.repartitionByRange(width(rows.sparkSession), key, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[kinds[how](c).over(inside).alias(f"_in_{name}") for name, (c, how) in totals.items()])
    edges = dealt.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    crossing = edges.select(F.explode(F.array("low", "high")).alias(key)).distinct()
    parts = dealt.join(F.broadcast(crossing), key, "left_semi").groupBy(key, "_part").agg(*[kinds[how](c).alias(name) for name, (c, how) in totals.items()])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(key, "_part", *[F.coalesce(kinds[how](name).over(earlier), F.lit(0)).alias(f"_to_{name}") for name, (_, how) in totals.items()])
    out = out.join(F.broadcast(before), [key, "_part"], "left")

    def whole(name: str, how: str):
        there = F.coalesce(F.col(f"_to_{name}"), F.lit(0))
        return (F.col(f"_in_{name}") + there if how == "sum" else F.col(f"_in_{name}").bitwiseXOR(there)).alias(name)

    return out.select(*rows.columns, *[whole(name, how) for name, (_, how) in totals.items()])


def components(edges: DataFrame, staging: Staging, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long).

    Alternating large-star and small-star steps, each a grouped minimum and a
    join, staged after every round; nothing but one flag reaches the driver.
    Every step keeps at most as many edges as before, so hubs stay one row per
    neighbour. Returns (id, component), component being the smallest id
    reachable, for every id that has an edge to another id.
    """
    links = staging.table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u hangs on the smallest of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u and u itself hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = (
            near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = staging.table(small)
        same = (
            following.groupBy().agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        )
        before = links.groupBy().agg(F.count("u").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        done = same.intersect(before).count() == 1
        staging.drop(links)
        staging.settle()
        links = following
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: stars around the smallest id of each component
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
