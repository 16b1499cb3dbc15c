"""What steps leave on disk: shuffles go step by step, texts that no step asks for are not shuffled."""

import os
import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from spectrafield.llm import common, lines, shingles


def held(spark):
    """Bytes of shuffle files that are there."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.lstat(f).st_size for top in folders for d, _, names in os.walk(top.getPath()) for x in names if x.startswith("shuffle_") and os.path.exists(f := f"{d}/{x}"))


def watched(spark, monkeypatch):
    """Bytes before and after each time that a step settles."""
    found, old = [], common.Staging.settle

    def settle(self, *times):
        before = held(spark)
        old(self, *times)
        until = time.time() + 5  # Spark deletes in a thread of its own
        while held(spark) > before / 4 and time.time() < until:
            time.sleep(0.1)
        found.append((before, held(spark)))

    old(common.Staging(spark, "none"), 2)
    time.sleep(1)
    monkeypatch.setattr(common.Staging, "settle", settle)
    return found


def texts(spark, path, n=40):
    """Documents of lines of their own, of which the first two share nearly a line and the last two all words but one, and how many characters they have."""
    rng = random.Random(1)
    line = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(50))
    shared = line()
    rows = [(d, "\n".join(([shared + "x" * d] if d < 2 else []) + [line() for _ in range(300)])) for d in range(n - 1)]
    rows.append((n - 1, f"{rows[-1][1]} end"))
    for part in range(4):  # files, so that nothing here is shuffled
        spark.createDataFrame(rows[part::4], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(path))
    return spark.read.parquet(str(path)), sum(len(t) for _, t in rows)


def test_line_dedup_keeps_one_steps_shuffle(spark, monkeypatch, tmp_path):
    docs, chars = texts(spark, tmp_path / "docs")
    found = watched(spark, monkeypatch)
    linked = lines.line_classes(docs).where("n_links > 0 and doc_id < 38").select("doc_id", "class_doc").collect()
    assert sorted(map(tuple, linked)) == [(0, 0), (1, 0)]
    most = max(range(len(found)), key=lambda i: found[i][0])
    assert found[most][0] > chars / 4  # the hashes of segments
    assert found[most][1] < found[most][0] / 4
    assert all(before < chars / 4 for before, _ in found[most + 1 :]), found  # few documents are asked for their lines


def test_near_duplicates_shuffle_no_other_texts(spark, monkeypatch, tmp_path):
    docs, chars = texts(spark, tmp_path / "docs")
    found = watched(spark, monkeypatch)
    linked = shingles.jaccard_join(docs).where("n_links > 0").select("doc_id", "class_id").collect()
    assert sorted(map(tuple, linked)) == [(38, 38), (39, 38)]
    assert len(found) > 2 and all(before < chars / 4 for before, _ in found[1:]), found  # of which the second holds the texts


def test_likely_rows(spark):
    rows = spark.range(20000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("t"))
    table = spark.range(0, 20000, 20).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    got = common.likely(rows, table, ["k"], table.count())
    assert got.columns == ["k", "t"]
    left = {r["k"] for r in got.collect()}
    assert {None, *range(20, 20000, 20)} <= left and len(left) < 1000 + 19000 / 8
    assert common.likely(rows, table.where("k < 0"), ["k"], 0).count() == 0
    assert common.likely(rows, table, ["k"], 1).count() >= 1000  # too few bits only let more pass


def test_pipeline_drops_what_it_has_read(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    seen, dropped = [], []
    monkeypatch.setattr(corpus_pipeline, "load", lambda *a: docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), lambda s, d, f: seen.append(getattr(d, "_staged_path", None)) or d.select("*")) for k in range(4)])
    old = common.Staging.drop
    monkeypatch.setattr(common.Staging, "drop", lambda self, *t: dropped.extend(x._staged_path for x in t) or old(self, *t))
    assert [tuple(r) for r in corpus_pipeline.run(spark, "none").collect()] == [(1, "a b")]
    assert seen[0] is None and dropped == seen[1:3]
