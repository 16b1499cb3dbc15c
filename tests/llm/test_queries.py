"""The registered queries over a whole small table, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafield.llm import language, mixing, registry
from spectrafield.llm.lines import allowed

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows_of(spark, name):
    return registry.queries()[name](spark, DATA).collect()


def test_sharding(spark, docs):
    rows = rows_of(spark, "op1_sharding")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    held = defaultdict(list)
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text)) and r["law"] == "bytes" and r["grown_shard"] is None
        held[r["shard"]].append(r)
    assert set(held) <= set(range(24))
    for shard in held.values():
        assert sorted(r["slot"] for r in shard) == list(range(len(shard)))
    of = defaultdict(set)
    for r in rows:
        of[docs[r["doc_id"]]["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    total, largest = sum(r["size"] for r in rows), Counter()
    for r in rows:
        largest[docs[r["doc_id"]]["text"]] += r["size"]
    assert max(sum(r["size"] for r in s) for s in held.values()) <= total / 24 + max(largest.values())


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = rows_of(spark, "op2_packing")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    total = 0
    for i, d in docs.items():
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and [r["length"] for r in mine[:-1]] == [4096] * (len(mine) - 1)
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in mine) == len(ids)
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0, *[r["length"] for r in s]])[:-1].tolist() and sum(r["length"] for r in s) <= 4096
    assert len(sequences) <= math.ceil(total / 4096) + 1


def test_language(spark, docs):
    rows = {r["doc_id"]: r for r in rows_of(spark, "op5_language")}
    assert set(rows) == set(docs)
    known = {d["lang"] for d in docs.values() if d["lang"] is not None}
    right = []
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        blank = not any(c.isalpha() for c in docs[i]["text"] or "")
        assert (r["lang_pred"] == "und") == blank and r["lang_pred"] in known | {"und"}
        if r["held_out"] and docs[i]["lang"] is not None and not blank:
            right.append(r["lang_pred"] == docs[i]["lang"])
    assert len(right) > 40 and np.mean(right) > 0.97


def test_many_languages_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ALL", 60)
    rows = [(i, " ".join(chr(97 + (k + j) % 26) * 3 for j in range(6)) + f" {i}", f"l{k}") for i in range(400) for k in [i % 20]]
    seen = []
    monkeypatch.setattr(language, "fit", lambda found: seen.extend(y for _, y in found))
    language.train(spark.createDataFrame([*rows, (900, "12 3", "l0"), (901, None, "l1")], "doc_id long, text string, lang string"))
    assert set(Counter(seen).values()) == {10} and len(set(seen)) == 20
    monkeypatch.setattr(language, "MOST_LANGUAGES", 10)
    with pytest.raises(ValueError, match="languages"):
        language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def test_lines(spark, docs):
    rows = rows_of(spark, "op7_lines")
    lines = {(i, k): x.strip(" \t\n\v\f\r") for i, d in docs.items() for k, x in enumerate((d["text"] or "").split("\n"))}
    got = {(r["doc_id"], r["line_no"]): r for r in rows}
    assert set(got) == set(lines) and all(got[k]["chars"] == len(x) for k, x in lines.items())
    weight = Counter(x for x in lines.values() if x)
    names, root = sorted(weight), {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    near = Counter({x: n - 1 for x, n in weight.items()})
    seen = defaultdict(list)
    for x in names:
        if len(x) >= 10:
            seen[len(x)].append(x)
    for n, here in seen.items():
        for a in here:
            for m in range(n, n + 3):
                for b in seen.get(m, ()):
                    if (m, b) <= (n, a):
                        continue
                    k = int(allowed(np.array([n]))[0])
                    if m - n <= k and sum((Counter(a) - Counter(b)).values()) <= k and distance(a, b, k) <= k:
                        near[a] += weight[b]
                        near[b] += weight[a]
                        root[find(a)] = find(b)
    first = {}
    for key in sorted(k for k, x in lines.items() if x):
        first.setdefault(find(lines[key]), key)
    for key, x in lines.items():
        r = got[key]
        assert r["n_links"] == (near[x] if x else 0), (key, x)
        want = first[find(x)] if x else key
        assert (r["class_doc"], r["class_line"]) == want and r["kept"] == (want == key)


def test_scoring(spark, docs):
    rows = {r["doc_id"]: r for r in rows_of(spark, "op8_scoring")}
    assert set(rows) == set(docs)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", (d["text"] or "").translate(lower)) if w] + [None] for i, d in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, distinct = sum(count.values()), len(count)
    for i, ws in words.items():
        r = rows[i]
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0 and math.isfinite(r["score"])


def test_fingerprints(spark, docs):
    rows = {r["doc_id"]: r for r in rows_of(spark, "op9_fingerprints")}
    order = sorted(docs, reverse=True)
    text = lambda i: docs[i]["text"] or ""
    prints = defaultdict(set)
    for at, i in enumerate(order):
        after, r = text(order[(at + 1) % len(order)]), rows[i]
        half = len(text(i)) // 2
        edited = text(i)[: len(text(i)) - half] + after[:half]
        assert r["n_chars"] == len(text(i)) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"]) and r["near_next"] == float(r["fingerprint"] == rows[order[(at + 1) % len(order)]]["fingerprint"])
        prints[text(i)].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_mixing(spark, docs):
    rows = rows_of(spark, "op10_mixing")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    n, rate = np.array([r["n_tokens"] for r in rows], float), np.array([r["rate"] for r in rows])
    p = np.array([[r[f"p_{d}"] for d in mixing.TARGETS] for r in rows])
    assert (rate >= 0).all() and np.allclose(p.sum(1), 1, atol=1e-6)
    assert all(r["n_tokens"] == len((docs[r["doc_id"]]["text"] or "").split()) or not (docs[r["doc_id"]]["text"] or "").isascii() for r in rows)
    assert all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in rows)
    if rows[0]["targets_met"]:
        got = (rate * n) @ p
        assert np.allclose(got / got.sum(), list(mixing.TARGETS.values()), atol=0.01)


def test_every_query_reads_every_row(spark):
    n = {t: spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("documents", "embeddings", "pages")}
    for name, table in {"op3_embeddings": "embeddings", "op6_jaccard": "documents", "op11_warc": "pages"}.items():
        assert registry.queries()[name](spark, DATA).agg(F.count("*")).first()[0] == n[table]
