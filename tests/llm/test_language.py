"""Language ID: held-out accuracy, rejects, odd rows."""

import random

from spectrafield.llm import language

WORDS = {"aa": ["ka", "lo", "mi", "tu", "kalo"], "bb": ["sch", "ung", "ein", "die", "ich"], "cc": ["eau", "oi", "é", "les", "dans"]}


def rows(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[k]) for _ in range(12)), k, 1) for i in range(n) for k in [rng.choice(sorted(WORDS))]]


def test_held_out(spark):
    model = language.train(spark.createDataFrame(rows(300, 1), "doc_id long, text string, lang string, score int"))
    test = rows(200, 2) + [(900, None, "aa", 1), (901, "", None, 1), (902, "12 .. 3", "bb", 1), (903, "ka lo " * 300_000, "aa", 1), (903, "ka lo " * 300_000, "aa", 1)]
    got = language.predict(spark.createDataFrame(test, "doc_id long, text string, lang string, score int"), model).collect()
    assert len(got) == len(test)
    for r in got:
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    fine = [r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 900 or r["doc_id"] == 903]
    assert sum(fine) >= 0.97 * len(fine)


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.train(empty)
    assert language.predict(empty, model).count() == 0
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.predict(one, model).first()["lang_pred"] == "und"


def test_codewords_are_apart():
    for n in (2, 4, 6, 12):
        code = language.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1


def test_sample_is_cut_by_hash(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ALL", 24)
    monkeypatch.setattr(language, "fit", lambda rows: rows)
    labelled = spark.createDataFrame(rows(150, 3), "doc_id long, text string, lang string, score int")
    got = language.train(labelled)
    hashed = {(r["lang"], r["h"]): r["text"] for r in labelled.selectExpr("lang", "xxhash64(text) h", "text").collect()}
    want = [(language.features(hashed[k]).tobytes(), y) for y in sorted(WORDS) for k in sorted(k for k in hashed if k[0] == y)[:10]]
    assert [(f.tobytes(), y) for f, y in got] == want
