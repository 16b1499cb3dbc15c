"""Repeated and null ids, limits that once were caps, exact copies."""

import numpy as np
import pytest
from spectrafield.llm import embeddings, language, lines, shingles


def test_vectors_of_one_id_are_told_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (5, [0.0, 1.0]), (None, [0.0, 1.0]), (None, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in embeddings.near_links(df).collect())
    # (2, [0, 1]) shares its vector with 5 and a null id; (2, [1, .01]) is near 1
    assert got == sorted(map(str, [(1, 1, 1, True), (2, 1, 1, False), (2, 2, 2, True), (5, 2, 2, False), (None, 2, 2, False), (None, 0, None, True)]))


def test_pairs_at_the_threshold_are_compared_in_full(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 48))
    unit = embeddings.units(base)
    off = rng.standard_normal((40, 48))
    off = embeddings.units(off - (off * unit).sum(1, keepdims=True) * unit)
    angle = np.arccos(0.95) + rng.uniform(-2e-3, 2e-3, (40, 1))
    x = np.concatenate((unit, np.cos(angle) * unit + np.sin(angle) * off))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_links(df, tile=8).collect()}
    near = embeddings.units(x) @ embeddings.units(x).T >= 0.95
    assert got == {i: int(near[i].sum()) - 1 for i in range(len(x))} and 0 < near.sum() - len(x) < 80


def test_texts_of_one_id_lose_no_link(spark):
    words = [f"w{i}" for i in range(200)]
    a, b, c, d = (" ".join(f"{p}{w}" for w in words) for p in "abcd")
    rows = [(1, a), (1, b), (2, b + " end"), (3, a + " end"), (None, c), (None, d), (7, c + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in shingles.jaccard_join(df).collect())
    assert got == [("1", "1", 1), ("1", "1", 1), ("2", "1", 1), ("3", "1", 1), ("7", "None", 1), ("None", "None", 0), ("None", "None", 1)]
    assert shingles.drop_near(df).count() == 4


def test_a_block_is_split_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK_ROWS", 4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(40)]
    got = shingles.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["n_links"], r["class_id"]) for r in got} == {(39, 0)}


def test_repeated_rows_leave_one(spark):
    long = "a line that is long enough to be compared with others"
    df = spark.createDataFrame([(9, "x y"), (9, "x y"), (None, long), (None, long), (3, None), (3, None), (4, " \n")], "doc_id long, text string")
    assert sorted(map(str, lines.dedup_lines(df).collect())) == sorted(map(str, df.distinct().collect() + [df.where("doc_id = 3").first()]))


def test_recall_that_needs_many_bands():
    bands, rows = shingles.bands_for(0.02, 0.999)
    assert 1 - (1 - 0.02**rows) ** bands >= 0.999
    for wrong in ((0.0, 0.9), (0.8, 1.0), (1.5, 0.9)):
        with pytest.raises(ValueError):
            shingles.bands_for(*wrong)


def test_many_edits(spark):
    base = "".join(chr(97 + i * 7 % 26) for i in range(300))
    near = list(base)
    for i in range(8):
        near[20 + 33 * i] = "#"
    df = spark.createDataFrame([(1, base), (2, "".join(near)), (3, "".join(near[:-1]) + "##")], "doc_id long, text string")
    links = lambda k: {r["doc_id"]: r["n_links"] for r in lines.line_classes(df, edits=k).collect()}
    assert links(8) == {1: 1, 2: 2, 3: 1} and links(10) == {1: 2, 2: 2, 3: 2} and links(7) == {1: 0, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        lines.line_classes(df, edits=lines.MOST_EDITS + 1)


def test_slices_of_a_text_are_one_text(monkeypatch):
    text = "Das ist, ein Text 12 with Ünïcode and more words. " * 9
    whole = language.features(text)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "SLICE", size)
        assert np.array_equal(language.features(text), whole)
    assert language.features("12 .") is None and language.features("") is None
