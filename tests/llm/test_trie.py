"""The prefix trie against dictionaries of prefixes; digests and running totals of keys that fill many tasks."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spectrafield.llm.common import Staging, running
from spectrafield.llm.trie import CHUNK, conversation_trie, digests, peeled


def by_hand(rows):
    order = lambda r: (r[1] is not None, r[1] or 0)
    convs = defaultdict(list)
    for r in sorted(rows, key=order):
        if r[0] is not None:
            convs[r[0]].append((r[2] or "", r[3] or ""))
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        ends = sorted(c for c in cs if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        children = sum(len(q) == len(p) + 1 for q in under)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children, sum(map(leaf, under)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["é", "b", "", None])) for t in range(rng.choice([1, 2, 3, 6]))]
    return rows + [(50, t, "user", "long") for t in range(30)] + [(51, t, "user", "long") for t in range(25)] + [(None, 0, "user", "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_match_dictionaries(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    assert sorted((tuple(r) for r in conversation_trie(df).collect()), key=str) == by_hand(rows)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(empty).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], empty.schema)).collect() == []


def test_repeated_rows_are_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")] * 5, "conv_id long, turn long, role string, text string")
    assert sorted(r["depth"] for r in conversation_trie(df).collect()) == [0, 1, 2, 3, 4, 5]


def test_running_totals_cross_parts(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("o"), (F.col("id") % 11).alias("v"), F.xxhash64("id").alias("x"))
    got = running(rows, "k", [F.desc("o")], {"s": ("v", "sum"), "h": ("x", "xor")}, Staging(spark, "t")).collect()
    totals = defaultdict(lambda: [0, 0])
    for r in sorted(got, key=lambda r: -r["o"]):
        t = totals[r["k"]]
        t[0], t[1] = t[0] + r["v"], t[1] ^ r["x"]
        assert [r["s"], r["h"]] == t
    assert len(got) == 3000


def test_digest_of_a_hot_key(spark):
    n = 3 * CHUNK + 7
    ends = spark.range(n).select(F.lit(1).alias("a"), F.lit(2).cast("long").alias("b"), (F.col("id") - 50).alias("conv")).unionByName(spark.createDataFrame([(1, 3, 5)], "a int, b long, conv long"))
    got = {r["b"]: r["ends_sha256"] for r in digests(ends, ["a", "b"]).collect()}
    assert got == {2: hashlib.sha256(",".join(str(i - 50) for i in range(n)).encode()).hexdigest(), 3: hashlib.sha256(b"5").hexdigest()}


def test_peeling_sums_up_to_the_root(spark):
    above = {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: 4, 6: 4}
    rows = [(p, a, sum(x == p for x in above.values()), 1, 10 + p) for p, a in above.items()]
    got = {r["path"]: (r["leaves"], r["saved"]) for r in peeled(spark.createDataFrame(rows, "path long, above long, waits long, leaves long, saved long"), Staging(spark, "t")).collect()}
    assert got[0] == (7, 91) and got[1] == (3, 36) and got[4] == (3, 45)
