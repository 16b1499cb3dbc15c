"""Conversation prefix trie: leaf-peeling message passing over shared prefixes.

A node is a distinct sequence of the first turns of conversations, told by its
depth and 128 bits that run along the turns. The nodes of one smallest member
are a path of the trie, since that member stays the smallest further down. So
what is peeled are paths: each holds a counter of the paths that hang on it;
those at zero are finished and send their subtree's totals to the path above,
until only the root's is left. Sums along a path are running totals. Texts are
read once and never shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, join_hot, load, running

#: Second seed of the turns' and prefixes' hashes: any constant, hashed first.
SEED = 0x70F1
#: Conversations of one node that meet in one row before their digest is taken.
CHUNK = 1000
#: Rows of a batch that a task hands on.
ROWS = 2000
#: Most turns that the query takes over from another conversation, and conversations that share them.
HEAD, SHARERS = 9, 5


def numbered(rows: DataFrame, staging: Staging, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, i, g1, g2, bytes): turns of every conversation from 1, by ``turn`` (null first), role and text.

    Null roles and texts are empty; rows without a conversation are left out.
    """
    said, body = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    turns = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("_turn"), F.xxhash64(said, body).alias("g1"), F.xxhash64(F.lit(SEED), said, body).alias("g2"),
        F.octet_length(body).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("_row"), F.lit(1).cast("long").alias("_one"),
    )
    order = [F.asc_nulls_first("_turn"), "g1", "g2", "_row"]
    return running(staging.table(turns), "conv", order, {"i": ("_one", "sum")}, staging).select("conv", "i", "g1", "g2", "bytes")


def rebuilt(turns: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations (conv)) in which conversation c begins as c - c % 5 does, for crc32(c) % 9 turns, and goes on with its own."""
    convs = staging.table(turns.groupBy("conv").agg(F.count("*").alias("len")))
    head = (F.crc32(F.col("conv").cast("string")) % HEAD).alias("h")
    first = F.col("conv") - F.col("conv") % SHARERS
    lens = convs.select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    convs = staging.table(convs.select("conv", "len", head, first.alias("base")).join(lens, "base", "left"))
    lent = turns.where(F.col("i") < HEAD).withColumnRenamed("conv", "base")
    taken = convs.select("conv", "base", "h").join(lent, "base").where("i <= h").select("conv", "i", "g1", "g2", "bytes")
    # a conversation's own turns move up or stay: as many as its head is shorter than it could be
    shift = convs.select("conv", "len", (F.least("h", F.coalesce("base_len", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.where(F.col("i") > F.crc32(F.col("conv").cast("string")) % HEAD)
    own = join_hot(own, shift, ["conv"], "len", turns.count()).select("conv", (F.col("i") + F.col("shift")).alias("i"), "g1", "g2", "bytes")
    return staging.table(taken.unionByName(own)), convs.select("conv")


def digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256): SHA-256 of the decimal ids ``conv`` of every key (long columns), ascending and joined by commas.

    Ids are sorted by ranges and joined to rows of ``CHUNK`` each, so one key's
    may fill many tasks; the digest reads the rows of a key in order, one at a
    time, as SHA-256 has to.
    """
    types = ", ".join(f"{k} long" for k in keys)

    def listed(found, names, batches):
        """Batches of the rows (key..., values...) that ``found`` makes of ``batches``."""
        held = []
        for row in found(batches):
            held.append(row)
            if len(held) == ROWS:
                yield batch_of(held, names)
                held = []
        if held:
            yield batch_of(held, names)

    def batch_of(rows, names):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*(pa.int64() for _ in keys), *names.values()], strict=True)], [*keys, *names])

    def keyed(batches, column):
        for batch in batches:
            yield from zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column(column).to_pylist(), strict=True)

    def chunks(batches):
        key, held = None, []
        for k, conv in keyed(batches, "conv"):
            if held and (k != key or len(held) == CHUNK):
                yield (*key, held[0], ",".join(map(str, held)))
                held = []
            key = k
            held.append(conv)
        if held:
            yield (*key, held[0], ",".join(map(str, held)))

    def digest(batches):
        key, state = None, None
        for k, part in keyed(batches, "part"):
            if k == key:
                state.update(b"," + part.encode())
                continue
            if state is not None:
                yield (*key, state.hexdigest())
            key, state = k, hashlib.sha256(part.encode())
        if state is not None:
            yield (*key, state.hexdigest())

    def to_parts(batches):
        yield from listed(chunks, {"first": pa.int64(), "part": pa.string()}, batches)

    def to_digests(batches):
        yield from listed(digest, {"ends_sha256": pa.string()}, batches)

    spread = ends.select(*[F.col(k).cast("long").alias(k) for k in keys], "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv")
    parts = spread.mapInArrow(to_parts, f"{types}, first long, part string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(to_digests, f"{types}, ends_sha256 string")


def peeled(paths: DataFrame, staging: Staging) -> DataFrame:
    """(path, leaves, saved): totals of each path and all that hangs on it.

    paths: (path, above, waits, leaves, saved), waits being how many paths hang
    on it. In every round the paths that wait for none send their totals to the
    one above; what is left shrinks until the root's path, which has none
    above, is finished.
    """
    done, left = [], staging.table(paths)
    while not left.isEmpty():
        ready = staging.table(left.where("waits = 0"))
        sent = ready.where("above is not null").groupBy("above").agg(F.count("*").alias("n"), F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("above", "path")
        more = lambda c: F.coalesce(F.col(c), F.lit(0))
        following = staging.table(
            left.where("waits > 0").join(sent, "path", "left").select(
                "path", "above", (F.col("waits") - more("n")).alias("waits"), (F.col("leaves") + more("l")).alias("leaves"), (F.col("saved") + more("s")).alias("saved")
            )
        )
        staging.drop(left)
        done.append(ready.select("path", "leaves", "saved"))
        left = following
    out = done[0] if done else paths.select("path", "leaves", "saved")
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame, staging: Staging) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row a node.

    ``turns`` (conv, i, g1, g2, bytes) numbers each conversation's turns from 1
    without gaps, as ``numbered`` does; ``convs`` (conv) names all
    conversations once, those without turns among them. conv_id is the smallest
    member, the root has depth 0 and all conversations. Equal conversations are
    members of the same nodes. Without conversations there is no node.
    """
    own = turns.select("conv", "i", "bytes", F.xxhash64("i", "g1", "g2").alias("o1"), F.xxhash64(F.lit(SEED), "i", "g1", "g2").alias("o2"))
    prefix = staging.table(running(own, "conv", ["i"], {"p1": ("o1", "xor"), "p2": ("o2", "xor")}, staging))
    met = prefix.groupBy(F.col("i").alias("depth"), "p1", "p2").agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), F.min("bytes").alias("bytes"),
        F.min(F.col("p1").bitwiseXOR(F.col("o1"))).alias("q1"), F.min(F.col("p2").bitwiseXOR(F.col("o2"))).alias("q2"),
    )
    zero = lambda name: F.lit(0).cast("long").alias(name)
    root = convs.groupBy().agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0").select(
        zero("depth"), zero("p1"), zero("p2"), "n", "conv", zero("bytes"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2")
    )
    met = staging.table(met.unionByName(root))
    kids = met.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("kids"))
    nodes = staging.table(met.join(kids, ["depth", "p1", "p2"], "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
    above = nodes.where("kids > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"), "kids")
    nodes = staging.table(join_hot(nodes.withColumnRenamed("kids", "n_children"), above, ["depth", "q1", "q2"], "kids", nodes.count()))

    # the nodes of one smallest member are a path; its top hangs on another path
    own_saved, own_leaf = (F.col("n") - 1) * F.col("bytes"), (F.col("n_children") == 0).cast("long")
    along = nodes.groupBy(F.col("conv").alias("path")).agg(F.min("depth").alias("top"), F.min_by("parent", "depth").alias("above"), F.sum(own_leaf).alias("leaves"), F.sum(own_saved).alias("saved"))
    along = staging.table(along)
    waits = along.where("above is not null").groupBy(F.col("above").alias("path")).agg(F.count("*").alias("waits"))
    totals = peeled(along.join(waits, "path", "left").select("path", "above", F.coalesce("waits", F.lit(0)).alias("waits"), "leaves", "saved"), staging)
    hung = along.select("path", "above", (F.col("top") - 1).alias("depth")).where("above is not null").join(totals, "path")
    hung = hung.groupBy(F.col("above").alias("conv"), "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    some = nodes.join(hung, ["conv", "depth"], "left").select(
        "conv", "depth", "parent", "n", "n_children", "p1", "p2", (own_leaf + F.coalesce("l", F.lit(0))).alias("leaf"), (own_saved + F.coalesce("s", F.lit(0))).alias("save")
    )
    below = running(some, "conv", [F.desc("depth")], {"n_leaves": ("leaf", "sum"), "saved_tokens": ("save", "sum")}, staging)

    last = prefix.groupBy("conv").agg(F.max(F.struct("i", "p1", "p2")).alias("x")).select("conv", F.col("x.i").alias("depth"), "x.p1", "x.p2")
    turnless = convs.join(last.select("conv"), "conv", "left_anti").select("conv", zero("depth"), zero("p1"), zero("p2"))
    ends = digests(staging.table(last.unionByName(turnless)), ["depth", "p1", "p2"])
    return below.join(ends, ["depth", "p1", "p2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``prefix_trie`` of conversations as they are, ordered by turn (null first), then by role and text.

    Null roles and texts are empty, rows without a conversation are in none,
    repeated rows are turns of their own, other columns are ignored.
    """
    staging = Staging(rows.sparkSession, "trie")
    turns = staging.table(numbered(rows, staging, conv, turn, role, text))
    return prefix_trie(turns, turns.select("conv").distinct(), staging)


def op13_trie(spark, sf_dir):
    """The prefix trie of all conversations, each rebuilt with the head of the first of its five."""
    staging = Staging(spark, "op13")
    turns = staging.table(numbered(load(spark, sf_dir, "conversations"), staging))
    return prefix_trie(*rebuilt(turns, staging), staging)
