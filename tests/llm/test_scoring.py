"""Scoring: probabilities sum to one, the base score is exact, held-out texts gain."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from spectrafield.llm import scoring
from spectrafield.llm.kernels import utf8


def test_spelling_is_a_distribution():
    data, offsets = utf8(pa.array(["der", "die", "das", "da", "dadas", "e" * 50, ""]))
    symbol, context, owner = scoring.symbols(data, offsets[:-1], offsets[1:])
    cell, count = np.unique(context * scoring.SYMBOLS + symbol, return_counts=True)
    model, tables = scoring.sample_spelling(cell, count, None, 0)
    model, tables = scoring.sample_spelling(cell, count, tables, 1)
    assert np.allclose((10.0 ** model.table.astype(float)).sum(1), 1, atol=1e-5)
    assert (tables[0] <= count).all() and (tables[0] >= 1).all()
    p = 10.0 ** model.log10(data, offsets[:-1], offsets[1:])
    assert p.shape == (7,) and (p > 0).all() and p.sum() < 1


def test_seating_bounds():
    c = np.array([0, 1, 2, 5, 1000, 10**7])
    t = scoring.seat(c, np.full(6, 0.01), np.full(6, 50), 0.6, 1.0, np.arange(6, dtype=np.uint64))
    assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0


def test_base_and_gain(spark):
    rng = np.random.default_rng(4)
    syllables = {"x": ["an", "be", "ro", "ti", "ul", "ka"], "y": ["sch", "ung", "ei", "och"]}
    vocabulary = {k: ["".join(rng.choice(v, rng.integers(1, 5))) for _ in range(200)] for k, v in syllables.items()}
    weights = 1 / np.arange(1, 201)
    rows = [(i, " ".join(rng.choice(vocabulary["xy"[i % 2]], 30, p=weights / weights.sum())), i % 5 == 0, "xy"[i % 2]) for i in range(200)]
    rows += [(900, None, False, "y"), (901, "", True, None), (902, "ÄB\tAn\x1fx\n" + "ro " * 20000, True, "z"), (None, "an an", False, "q"), (7, rows[7][1], False, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, lang string").withColumn("word", F.lit(1))
    got = scoring.score(df).collect()
    assert len(got) == len(rows)

    def tokens(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]

    counts = {}
    for _, t, held, _ in rows:
        if not held:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), h, len(tokens(t)), sum(w in counts for w in tokens(t)), total, round(sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t)), 5))
        for d, t, h, _ in rows
    )
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) < 900]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    assert scoring.score(df).count() == 1
    assert scoring.score(df.where("false")).count() == 0


def test_packing_of_numbers():
    for x in ([], [0], [5, 3, 2**63, 2**64 - 1, 0], list(range(1000))):
        x = np.array(x, np.uint64)
        assert (scoring.get(scoring.put(x)) == x).all()
        assert (scoring.get(scoring.put(np.sort(x), True), True) == np.sort(x)).all()


def test_word_order_length_and_copies(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 2000)  # many blocks, ranges and buckets
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[(s + k) % 60] for k in range(12)) for s in rng.integers(0, 60, 300)]
    twice = " ".join(rng.permutation(words))
    rows = [(i, t, False) for i, t in enumerate(chain)] + [(400, twice, False), (401, twice, False), (402, " ".join(rng.permutation(words)), False)]
    rows += [(500, "w1 w2 w3 w4 w5", True), (501, "w5 w4 w3 w2 w1", True)] + [(600 + n, "x" * n, True) for n in (200, 500, 2000)]
    got = {r["doc_id"]: r for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert len(got) == len(rows)
    assert got[500]["score"] > got[501]["score"] + 4 and abs(got[500]["base_score"] - got[501]["base_score"]) < 1e-9
    assert got[400]["perplexity"] < got[402]["perplexity"] and abs(got[400]["score"] - got[401]["score"]) < 1e-9
    assert got[2600]["score"] < got[1100]["score"] - 1000 and got[1100]["score"] < got[800]["score"] - 200
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got.values())


def test_one_block_or_many_give_one_base(spark, monkeypatch):
    rows = [(i % 7, f"A b{i % 5} c", i % 3 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    whole = sorted((r["doc_id"], r["n_known"], r["base_score"]) for r in scoring.score(df).collect())
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 40)
    assert whole == sorted((r["doc_id"], r["n_known"], r["base_score"]) for r in scoring.score(df).collect())
