"""Texts whose polynomial hashes cancel out, texts beyond a JSON reader's bound, and case folding."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectrafield.llm.chat import LONG, canonical_turns, format_turns, read_loss, without_values
from spectrafield.llm.fingerprints import canonical, fingerprint
from spectrafield.llm.kernels import span_hashes
from spectrafield.llm.lines import dedup_lines, line_classes
from spectrafield.llm.mixing import features
from spectrafield.llm.scoring import score
from spectrafield.llm.shingles import jaccard_join


def thue_morse(n, other=False):
    s = ""
    for i in range(n):
        s += "ab"[(bin(i).count("1") + other) % 2]
    return s


@pytest.mark.parametrize("seed", [0, 1])
def test_spans_hash_by_content_alone(seed):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 40_000).astype(np.uint8)
    starts = rng.integers(0, 39_000, 20_000)
    ends = starts + rng.integers(0, 30, 20_000)
    ends[:3] = starts[:3] + 900
    of, raw = {}, data.tobytes()
    for s, e, h in zip(starts, ends, span_hashes(data, starts, ends, seed)):
        assert of.setdefault(raw[s:e], h) == h
    assert len(set(of.values())) == len(of)


def test_thue_morse_texts_stay_apart(spark):
    rows, i = [], 0
    for n in (1024, 2048, 4096):
        for other in (False, True):
            rows.append((i, thue_morse(n, other)))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["n_links"], r["kept"]) for r in line_classes(docs).collect()} == {(0, True)}
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == dict(rows)
    assert all(r["class_id"] == r["doc_id"] for r in jaccard_join(docs).collect())
    x, _ = features(pa.array([t for _, t in rows]))
    assert len({v[:-256].tobytes() for v in x}) == len(rows)
    held = {r["doc_id"]: r["n_known"] for r in score(docs.where("doc_id < 4").withColumn("held_out", F.col("doc_id") > 0)).collect()}
    assert held == {0: 2, 1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("layout, chars", [("turn", 21_000_000), ("messages", LONG + 1000)])
def test_chat_texts_beyond_the_readers_bound(spark, layout, chars):
    unit = 'plain words, "y": {} \\ \n' * 40 + "é" * 9000
    times = chars // len(unit) + 1
    text = F.repeat(F.lit(unit), times)
    record = F.to_json(F.struct(F.lit("assistant").alias("role"), text.alias("text")) if layout == "turn" else F.struct(F.array(F.struct(F.lit("assistant").alias("role"), text.alias("content"))).alias("messages")))
    done = format_turns(canonical_turns(spark.range(1).select(record.alias("record"))))
    loss = F.array_join(read_loss(F.col("formatted"), F.col("loss")), "")
    got = done.select("layout", loss.alias("loss")).select("layout", F.length("loss"), F.sha2("loss", 256)).first()
    assert times * len(unit) > chars
    assert tuple(got) == (layout, times * len(unit), hashlib.sha256((unit * times).encode()).hexdigest())


def test_shape_without_values(spark):
    record = {"a": "q\"}:{\\", "b:": ["x\n", {"c": "\": "}], "d": {"e": 1, "f": None}, "g": ""}
    got = spark.createDataFrame([(json.dumps(record),)], "r string").select(without_values(F.col("r")).alias("x")).first()["x"]
    assert json.loads(got) == {"a": "", "b:": ["", {"c": ""}], "d": {"e": 1, "f": None}, "g": ""}


def test_a_long_object_that_cannot_be_read_is_an_error(spark):
    broken = spark.createDataFrame([('{"role": "user", "text": "' + "x" * (LONG + 1),)], "record string")
    with pytest.raises(Exception, match="ten million"):
        canonical_turns(broken).collect()


def test_case_folding(spark):
    pairs = [("Straße", "STRASSE"), ("ΟΔΟΣ", "οδοσ"), ("ΟΔΟΣ", "οδος"), ("İ", "i̇"), ("é", "É"), ("ﬁn", "FIN"), (" A  b ", "a B"), ("ǰ", "J̌")]
    rows = [(i, side, t) for i, (a, b) in enumerate(pairs) for side, t in enumerate((a, b, a + "x"))]
    found = {(r["id"], r["side"]): r["fingerprint"] for r in fingerprint(spark.createDataFrame(rows, "id long, side int, text string")).collect()}
    for i, pair in enumerate(pairs):
        assert found[i, 0] == found[i, 1] != found[i, 2], pair
    got = spark.createDataFrame([("ÀB ß",)], "t string").select(canonical(F.col("t")).alias("c")).first()["c"]
    assert got == "àb ss"
