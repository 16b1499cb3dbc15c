"""Near duplicates of vectors and of texts against all pairs."""

import random

import numpy as np
from spectrafield.llm import embeddings, shingles


def components(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x], changed = low, True
    return root


def test_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    x = np.concatenate((base, base[:30] + 0.12 * rng.standard_normal((30, 16)), base[:5] * 3.0, base[:3]))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    df = spark.createDataFrame(rows + [(500 + i, v, 0) for i, v in enumerate(odd)], "vec_id long, embedding array<double>, n_links int")
    got = {r["vec_id"]: r for r in embeddings.near_links(df, tile=16).collect()}
    assert len(got) == len(x) + len(odd)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    links = [(i, j) for i in range(len(x)) for j in range(i) if near[i, j]]
    root = components(range(len(x)), links)
    assert len(links) > 30
    for i in range(len(x)):
        assert got[i]["n_links"] == near[i].sum() - 1
        assert (got[i]["component_id"], got[i]["kept"]) == (root[i], root[i] == i)
    for i in range(len(odd)):
        assert (got[500 + i]["n_links"], got[500 + i]["component_id"], got[500 + i]["kept"]) == (0, 500 + i, True)
    assert embeddings.near_links(df.limit(0)).count() == 0


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_texts_match_all_pairs(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(25):
        w = [str(rng.randint(0, 5000)) for _ in range(120)]
        texts.append(" ".join(w))
        for changes in (0, 1, 2, 4):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = "new"
            texts.append(" ".join(v))
    texts += [None, "", "  ", "one two", "One TWO", "a b c d e", "the same words " * 40_000, "the same words " * 40_000]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r["doc_id"]: r for r in shingles.jaccard_join(df).collect()}
    assert len(got) == len(texts)
    sets = [grams(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root, count = components(range(len(texts)), links), [0] * len(texts)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for i in range(len(texts)):
        assert (got[i]["class_id"], got[i]["n_links"], got[i]["kept"]) == (root[i], count[i], root[i] == i), i
    assert shingles.jaccard_join(df.limit(0)).count() == 0


def test_ids_that_repeat(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(str(rng.randint(0, 5000)) for _ in range(100)) for _ in range(3))
    near = lambda t: t + " new"
    # null ids with near copies; one id on two texts, each with a near copy elsewhere; repeated rows
    rows = [(None, a), (None, near(a)), (7, b), (7, c), (1, near(b)), (2, near(c)), (9, "other words than the rest"), (9, "other words than the rest"), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingles.jaccard_join(df).collect()
    assert len(got) == len(rows)
    classes = {}
    for r in got:
        classes.setdefault((r["class_id"], r["class_digest"]), []).append(r)
    full = [rs for rs in classes.values() if rs[0]["n_links"]]
    assert [len(rs) for rs in full] == [2] * 4
    assert all(sum(r["kept"] for r in rs) == 1 and all(r["n_links"] == 1 for r in rs) for rs in full)
    assert sum(r["kept"] for r in got) == 6
    out = [tuple(r) for r in shingles.drop_near(df).collect()]
    assert sorted(out, key=str) == sorted(set(out), key=str) and len(out) == 6
    assert {(1, near(b)), (2, near(c)), (9, "other words than the rest"), (None, None), (None, " ")} < set(out)
    assert len({a, near(a)} & {t for _, t in out}) == 1
