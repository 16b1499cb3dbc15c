"""Sharding against brute force; fingerprints and next documents against plain Python."""

import hashlib
import random
import unicodedata

from spectrafield.llm import fingerprints, sharding

SCHEMA = "doc_id long, text string, shard string, size int"


def best_capacity(sizes, shards):
    """Smallest capacity over contiguous cuts, by trying every one."""
    for capacity in range(max(sizes), sum(sizes) + 1):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= shards:
            return capacity


def test_shards_are_minimax(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 60) + str(rng.randint(0, 40)) for _ in range(150)] + ["same"] * 30 + [None, None, "", "é" * 500]
    rows = [(i, t, "old", -1) for i, t in enumerate(texts)] + [(None, "no id", "old", -1), (0, texts[0], "old", -1)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 5).collect()
    assert len(got) == len(rows)
    groups, load, slots = {}, {}, {}
    for r in got:
        size = len((r["text"] or "").encode()) + 8
        assert r["size"] == size
        groups.setdefault(r["text"], set()).add(r["shard"])
        load[r["shard"]] = load.get(r["shard"], 0) + size
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = {}
    for _, t, *_ in rows:
        key = "0" * 32 if t is None else hashlib.md5(t.encode()).hexdigest()
        total[key] = total.get(key, 0) + len((t or "").encode()) + 8
    assert max(load.values()) == best_capacity([total[k] for k in sorted(total)], 5)


def test_shards_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def canon(t):
    return " ".join(unicodedata.normalize("NFC", t or "").lower().split())


def test_fingerprints(spark):
    texts = ["A  b", "a b ", "a b", "café", "café ", None, "", " \t\n", "a c", "word " * 200_000, "Word  " * 200_000, "a b", "a b"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert len(got) == len(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (canon(a) == canon(b)), (i, j)
    assert fingerprints.fingerprint(df.limit(0)).count() == 0


def test_next_text_goes_round(spark):
    rows = [(i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df).collect()}
    assert got == {i: f"text {i - 1 if i else 299}" for i in range(300)}
    one = fingerprints.with_next(spark.createDataFrame([(7, None)], "doc_id long, text string")).collect()
    assert [r["next_text"] for r in one] == [""]
