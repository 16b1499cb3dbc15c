"""Document fingerprints: canonical exact digests.

A text is put into NFC, folded case and single spaces, and hashed to 128 bits
by two seeded xxHash64. Texts with one hash form a bucket; inside a bucket the
canonical bytes are compared with those of the bucket's first member, and a
text that differs (a collision) gets a fingerprint with its exact digest added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging, load, width

#: Second seed of the wide hash: any constant, hashed before the text.
SEED = 0x5EED


def _icu(kind: str, method: str, text: Column) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(kind.startswith("lang")))


def canonical(text: Column) -> Column:
    """NFC, full case folding, NFC again, runs of Unicode white space as one space, none at the ends.

    Pure ASCII needs neither normaliser nor folding beyond A-Z. Both are ICU's,
    which Spark ships, called by the SQL function ``java_method``. Folding is
    the default one, alike for every language: a dotted capital I becomes i and
    a combining dot.
    """
    folded = _icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", text)))
    normal = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(normal, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits of xxHash64 as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(SEED), canon)), 16, "0")))


def collisions(docs: DataFrame, staging: Staging, text: str = "text") -> DataFrame:
    """(hash, exact): canonical texts that share a wide hash with another text's.

    Only buckets of two or more rows are compared. Rows of equal raw text in a
    bucket count once, so that a hot group of copies is a handful of rows
    before its bytes are compared with the first member's.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    # one row per bucket and raw text, found on digests alone
    digests = docs.select(wide_hash(canonical(raw)).alias("f"), F.sha2(raw, 256).alias("d")).distinct()
    several = digests.groupBy("f").agg(F.min("d").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = (
        docs.select(wide_hash(canonical(raw)).alias("f"), F.sha2(raw, 256).alias("d"), raw.alias("t"))
        .join(staging.table(several), "f")
        .groupBy("f", "d", "first").agg(F.first("t").alias("t"))
        .select("f", "d", "first", canonical(F.col("t")).alias("c"))
    )
    members = staging.table(members)
    firsts = members.where("d = first").select(F.col("f").alias("g"), F.col("c").alias("c1"))
    odd = members.join(firsts, F.col("f") == F.col("g")).where("c <> c1").select("f", F.sha2("c", 256).alias("exact")).distinct()
    out = staging.table(odd, 1)
    staging.drop(members)
    return out


def fingerprint_of(canon: Column) -> Column:
    """The fingerprint where no collision is known."""
    return wide_hash(canon)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``fingerprint``: equal for two rows exactly if their canonical texts are equal.

    Null texts count as empty; all texts of nothing but white space are equal.
    Repeated rows are kept, an empty table gives an empty result, a column
    named ``fingerprint`` is replaced. Texts do not move: only digests are
    grouped, and only members of buckets with several raw texts are compared.
    """
    staging = Staging(docs.sparkSession, "fingerprint")
    odd = collisions(docs, staging, text)
    canon = canonical(F.coalesce(F.col(text), F.lit("")))
    hashed = docs.drop("fingerprint").withColumns({"_f": fingerprint_of(canon), "_x": F.sha2(canon, 256)})
    return (
        hashed.join(odd.withColumnRenamed("f", "_f").withColumnRenamed("exact", "_x").withColumn("_odd", F.lit(True)), ["_f", "_x"], "left")
        .withColumn("fingerprint", F.when(F.col("_odd"), F.concat("_f", F.lit("-"), "_x")).otherwise(F.col("_f")))
        .drop("_f", "_x", "_odd")
    )


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add ``next_text``: the text of the next row by descending id, the first row's after the last.

    Rows of one id are ordered by their text's hash; null ids come last. Rows
    are dealt by equal-depth ranges of the id, so that each range is one window
    of bounded size; only the ranges' first rows cross between ranges.
    """
    spark = docs.sparkSession
    ranges = min(2048, 8 * width(spark))
    key = F.coalesce(F.col(doc_id), F.lit(-(2**63)))
    base = docs.select("*", key.alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"))
    at = [i / ranges for i in range(1, ranges)]
    bounds = docs.agg(F.percentile_approx(key, at, 20 * ranges).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    if bounds:
        table = F.array(*[F.lit(b) for b in bounds])
        # binary search: the number of bounds up to the id
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        found = F.lit(0)
        found = F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0),
            lambda lo, s: F.when((lo + s <= len(bounds)) & (F.try_element_at(table, lo + s) <= F.col("_k")), lo + s).otherwise(lo),
        )
    else:
        found = F.lit(0)
    base = base.withColumn("_r", found)
    down = Window.partitionBy("_r").orderBy(F.desc("_k"), F.desc("_h"))
    rows = base.withColumn("_n", F.lead(F.struct(F.coalesce(F.col(text), F.lit("")).alias("t"))).over(down))
    # the first row of each range, for the last row of the range before it; one row a range
    heads = base.groupBy("_r").agg(F.max(F.struct("_k", "_h")).alias("m"))
    top = Window.orderBy(F.desc("_r"))
    heads = heads.withColumn("_to", F.lead("m").over(top)).withColumn("_to", F.coalesce("_to", F.first("m").over(top)))
    staging = Staging(spark, "next")
    heads = staging.table(heads.select("_r", F.col("_to._k").alias("_tk"), F.col("_to._h").alias("_th")), 1)
    wanted = heads.select(F.col("_tk").alias("_k"), F.col("_th").alias("_h")).distinct()
    texts = base.select("_k", "_h", F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(wanted), ["_k", "_h"], "left_semi")
    texts = texts.groupBy("_k", "_h").agg(F.first("_t").alias("_t"))
    link = heads.join(texts, (heads._tk == texts._k) & (heads._th == texts._h)).select("_r", "_t")
    return (
        rows.join(link.hint("merge"), "_r", "left")
        .withColumn("next_text", F.coalesce(F.col("_n.t"), F.col("_t")))
        .drop("_k", "_h", "_r", "_n", "_t")
    )


def op9_fingerprints(spark, sf_dir):
    """Fingerprints of every document, of its edited text and of the next document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    staging = Staging(spark, "op9")
    odd = collisions(docs, staging).withColumn("odd", F.lit(True))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), canonical(F.col("text")).alias("c"), canonical(F.col("next_text")).alias("cn"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    rows = rows.withColumn("ce", canonical(F.col("edited")))
    digests = {"f": "c", "fe": "ce", "fn": "cn"}
    out = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        *[fingerprint_of(F.col(c)).alias(f) for f, c in digests.items()], *[F.sha2(c, 256).alias(f"{f}_exact") for f, c in digests.items()],
    )
    for f in digests:  # a collision is told apart by its exact digest; there are next to none
        own = odd.select(F.col("f").alias("_f"), F.col("exact").alias("_x"), "odd")
        out = out.join(own, (F.col(f) == F.col("_f")) & (F.col(f"{f}_exact") == F.col("_x")), "left")
        out = out.withColumn(f, F.when(F.col("odd"), F.concat(f, F.lit("-"), f"{f}_exact")).otherwise(F.col(f))).drop("_f", "_x", "odd")
    near = lambda other: (F.col("f") == F.col(other)).cast("double")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.col("f").alias("fingerprint"), F.col("fe").alias("edited_fingerprint"),
        near("fe").alias("near_edited"), near("fn").alias("near_next"),
    )
