"""Sharding by minimax contiguous partition of atomic groups.

Rows of one group (equal texts in ``op1_sharding``) share a shard. Groups stand
in the order of their digest; a shard is a contiguous run of groups. The
smallest capacity under which a greedy left-to-right filling needs at most K
shards is found by binary search; the cuts are made under that capacity, as
near to equal sizes as it leaves them free to be.

The driver never sees the groups. It works on *cells*, runs of groups with a
common digest prefix, of which there are at most 16^4 at first. With cells as
atoms the greedy check gives an upper bound of the optimal capacity, with cells
as divisible matter a lower bound. Only cells that some cut between the two
bounds could fall in are split one hex digit further, until no open cell holds
more than one group; the search over what is left is then exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, load

DIGITS = 32


def _greedy(starts: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cell indexes where shards begin if ``shards`` of ``capacity`` hold all, else None."""
    cuts, at = [], 0
    for _ in range(shards):
        cuts.append(at)
        at = bisect_right(starts, starts[at] + capacity) - 1
        if at == len(starts) - 1:
            return cuts
        if at == cuts[-1]:
            return None
    return None


def _smallest(starts: list[int], shards: int) -> int:
    """Smallest capacity that ``_greedy`` accepts."""
    low, high = -(-starts[-1] // shards), starts[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(starts, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _open_cells(cells: list[tuple], starts: list[int], shards: int, low: int, high: int) -> set[int]:
    """Cells of several groups in which a greedy cut for a capacity in [low, high] can fall."""
    found, least, most = set(), 0, 0
    for _ in range(shards):
        most = min(starts[-1], most + high)
        # a cut is short of its capacity by less than one group, at most one cell
        first = bisect_right(starts, min(starts[-1], least + low)) - 1
        least = starts[min(first, len(cells) - 1)]
        last = min(len(cells) - 1, bisect_right(starts, most) - 1)
        found.update(range(min(first, len(cells) - 1), last + 1))
    return {i for i in found if cells[i][2] > 1}


def _cuts(starts: list[int], capacity: int, shards: int) -> list[int]:
    """Cell indexes where shards 1.. begin: as even as ``capacity`` and the cells allow."""
    last, total = len(starts) - 1, starts[-1]
    earliest = [last] * (shards + 1)  # a later shard may begin no earlier, or the rest would not fit
    for k in range(shards - 1, 0, -1):
        earliest[k] = bisect_left(starts, starts[earliest[k + 1]] - capacity)
    cuts = [0]
    for k in range(1, shards):
        at = bisect_left(starts, total * k / shards)
        if at and starts[at] - total * k / shards > total * k / shards - starts[at - 1]:
            at -= 1
        at = min(at, bisect_right(starts, starts[cuts[-1]] + capacity) - 1)
        cuts.append(max(at, earliest[k], cuts[-1]))
    return [i for i in cuts[1:] if i < last]


def boundaries(keys: DataFrame, shards: int, first_digits: int = 4) -> list[str]:
    """Digests (or digest prefixes) at which shards 1.. begin, ascending.

    ``keys``: digest (hex string), size (long). Empty for an empty table.
    """

    def cells_of(df: DataFrame, digits: int) -> list[tuple]:
        # (prefix or the only digest, size, 1 if all rows share one digest else 2)
        out = df.groupBy(F.substring("digest", 1, digits).alias("p")).agg(
            F.sum("size").alias("size"), F.min("digest").alias("a"), F.max("digest").alias("b")
        )
        return [(r["a"], r["size"], 1) if r["a"] == r["b"] else (r["p"], r["size"], 2) for r in out.collect()]

    cells = sorted(cells_of(keys, first_digits))
    if not cells:
        return []
    while True:
        starts = [0, *accumulate(c[1] for c in cells)]
        high = _smallest(starts, shards)
        low = max(-(-starts[-1] // shards), max((c[1] for c in cells if c[2] == 1), default=0))
        opened = _open_cells(cells, starts, shards, low, high)
        if not opened:
            return [cells[i][0] for i in _cuts(starts, high, shards)]
        finer = []
        for digits in sorted({len(cells[i][0]) for i in opened}):
            prefixes = [(cells[i][0],) for i in opened if len(cells[i][0]) == digits]
            wanted = F.broadcast(keys.sparkSession.createDataFrame(prefixes, "p string"))  # some hundred cells
            inside = keys.join(wanted, F.substring("digest", 1, digits) == F.col("p"), "left_semi")
            finer += cells_of(inside, digits + 1)
        cells = sorted([c for i, c in enumerate(cells) if i not in opened] + finer)


def shard(docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", slot_buckets: int = 4096) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1), ``slot`` and ``size`` to every row of ``docs``.

    size is the UTF-8 length of the text plus 8; rows of equal texts stay in one
    shard; the largest shard is as small as any contiguous cut of the groups in
    digest order allows. slot numbers the rows of a shard from 0 without gaps.
    Null texts have no bytes and form a group of their own, as empty texts do.
    Repeated rows count one by one. An empty table gives an empty result; fewer
    groups than shards leave shards empty. Columns of ``docs`` named like the
    new ones are replaced. Texts are read for digest and size only: neither
    the cuts nor the slots shuffle them.
    """
    spark = docs.sparkSession
    staging = Staging(spark, "shard")
    digest = F.coalesce(F.md5(F.col(text)), F.lit("0" * DIGITS))
    keyed = docs.drop("size", "digest", "shard", "slot").withColumns(
        {"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8, "digest": digest}
    )
    keys = staging.table(
        keyed.groupBy("digest", F.pmod(F.xxhash64(doc_id), F.lit(slot_buckets)).cast("int").alias("bucket")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n")
        )
    )
    cuts = boundaries(keys, shards)
    number = sum((F.when(F.col("digest") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    # slots: rows before the bucket within the shard, then the place in the bucket
    order = Window.partitionBy("shard").orderBy("bucket")
    bases = (
        keys.groupBy(number.alias("shard"), "bucket").agg(F.sum("n").alias("n"))
        .withColumn("base", F.sum("n").over(order) - F.col("n")).drop("n")
    )  # shards x slot_buckets rows at most
    place = Window.partitionBy("shard", "bucket").orderBy(doc_id, "digest")
    return (
        keyed.withColumn("shard", number)
        .withColumn("bucket", F.pmod(F.xxhash64(doc_id), F.lit(slot_buckets)).cast("int"))
        .withColumn("place", F.row_number().over(place) - 1)
        .join(F.broadcast(bases), ["shard", "bucket"])
        .withColumn("slot", (F.col("base") + F.col("place")).cast("long"))
        .drop("bucket", "place", "base", "digest")
    )


def op1_sharding(spark, sf_dir):
    """All documents into 24 shards of near equal bytes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    out = shard(docs.withColumn("text_crc32", crc))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
