"""One-edit pairs of the errata trie against all pairs; words and CRCs against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from spectrafield.llm import variants as v
from spectrafield.llm.common import Staging
from spectrafield.llm.kernels import utf8


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(words):
    out = {}
    for w, n in words.items():
        near = [(-m, o) for o, m in words.items() if one_edit(w, o)]
        best = min(near, default=None)
        out[w] = (len(near), best[1] if best and -best[0] >= 2 * n else None)
    def root(w):
        return w if out[w][1] is None else root(out[w][1])
    return {w: (k, form, root(w)) for w, (k, form) in out.items()}


@pytest.mark.parametrize("seed, alphabet, longest", [(1, "ab", 8), (2, "abé", 7), (3, "aé\U0001d54fz", 5)])
def test_pairs_match_all_pairs(spark, monkeypatch, seed, alphabet, longest):
    rng = random.Random(seed)
    words = {}
    for _ in range(500):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, longest)))
        words[w] = rng.choice([3, 3, 5, 7, 20, 50, 200])
    words |= {"a" * 3000: 3, "a" * 2999: 9, "a" * 1500 + "b" + "a" * 1499: 4}
    monkeypatch.setattr(v, "RANGE_WORDS", 40)
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, form string")
    got = {r["word"]: (r["n_near"], r["form"], r["root"]) for r in v.variants(df).collect()}
    assert got == by_hand(words)


def test_nothing_to_group(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert v.variants(empty).collect() == []
    assert [tuple(r) for r in v.variants(spark.createDataFrame([("alone", 3)], empty.schema)).collect()] == [("alone", None, "alone", 3, 0, None)]
    with pytest.raises(ValueError):
        v.variants(empty, times=1)


def test_each_pair_is_met_once():
    words = sorted({"".join(p) for p in itertools.product("abc", repeat=4)} | {"abca" + c for c in "abc"} | {"abc", "bbb", "aab"})
    known, found = set(words), Counter()
    keys = {}
    for row, kind, key in v.merges(words, -1, -1, {}):
        if kind == 0 and key in known:
            found[frozenset((words[row], key))] += 1
        elif kind == 1:
            keys.setdefault(key, []).append(words[row])
    for met in keys.values():
        for i, a in enumerate(met):
            for b in met[:i]:
                found[frozenset((a, b))] += 1
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}
    assert set(found) == want and set(found.values()) == {1}


def test_vocabulary_matches_python(spark):
    rng = random.Random(4)
    letters = "abÀÿ×÷AZ  .1ā\n"
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 900)))) for i in range(60)]
    docs += [(None, "without without without anid"), (77, None), (78, ""), (79, "longest" * 40 + " é" + "É" * 70), (79, "longest" * 40)]
    want = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 7 == 0 else w] += 1
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, word string").repartition(3)
    got = {r["word"]: r["n"] for r in v.vocabulary(df, odds=7, least=1).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= v.LEAST_CHARS}


def test_runs_stop_between_texts():
    data, offsets = utf8(pa.array(["ab", "cd", None, "é1Ã", "Ăa"]))
    starts, ends, text = v.runs(data, offsets)
    assert [(int(t), data[s:e].tobytes().decode()) for s, e, t in zip(starts, ends, text)] == [(0, "ab"), (1, "cd"), (3, "é"), (3, "Ã"), (4, "a")]


def test_crc_goes_on():
    data = np.frombuffer(b"abcdefgh" * 20, np.uint8)
    starts, ends = np.array([0, 3, 5, 0]), np.array([4, 3, 6, 160])
    before = np.array([zlib.crc32(x) for x in (b"", b"5:", b"77:", b"x")], np.uint32)
    assert v.crc32_after(before, data, starts, ends).tolist() == [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(starts, ends, before)]


def test_ranges_share_what_they_share(spark, monkeypatch):
    monkeypatch.setattr(v, "RANGE_WORDS", 3)
    words = [f"prefix{a}{b}" for a in "abc" for b in "xyz"]
    dealt, joints = v.sorted_ranges(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), Staging(spark, "t"))
    assert dealt.count() == 9 and all(right in (-1, 6, 7) for _, right in joints.values())
