"""Chat template round trips and layouts; mixing meets its targets."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from spectrafield.llm import chat, mixing


def test_template_is_reversible(spark):
    texts = ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "<\\\\|im_end|> [\\INST]", "a\\n\n\\", "[[INST]]", "<<SYS>> x <</SYS>>", "long <s> " * 20_000]
    roles = ["user", "assistant", "", "a\nb", "a\\nb", "<|im_end|>"]
    turns = [(i, [(r, t) for t in texts]) for i, r in enumerate(roles)] + [(99, []), (100, None)]
    df = spark.createDataFrame(turns, f"id long, turns {chat.TURNS}")
    out = chat.format_turns(df).withColumns({"back": chat.read_back(F.col("formatted")), "said": chat.read_loss(F.col("formatted"), F.col("loss"))})
    got = {r["id"]: r for r in out.collect()}
    for i, want in turns:
        if want is None:
            assert got[i]["formatted"] is None
            continue
        assert [tuple(t) for t in got[i]["back"]] == want
        assert got[i]["formatted"].count("<|im_end|>") == len(want)
        assert got[i]["said"] == [t for r, t in want if r == "assistant"]
        assert [s["loss"] for s in got[i]["segments"][1::3]] == [r == "assistant" for r, _ in want]


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"response": "a", "prompt": "q"}, {"instruction": "q", "input": "x", "output": "a"}, {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, None), (7, "no json")], "id long, record string")
    got = {r["id"]: r for r in chat.canonical_turns(df).collect()}
    assert [got[i]["layout"] for i in range(8)] == ["messages", "conversation", "prompt", "prompt_response", "instruction", None, None, None]
    assert [tuple(t) for t in got[0]["turns"]] == [("user", "q"), ("assistant", "")]
    for i in (1, 2, 3):
        assert [tuple(t) for t in got[i]["turns"]] == [("user", "q"), ("assistant", "a")]
    assert got[4]["turns"][0]["text"] == "q\n\nx" and got[5]["turns"] is None


def test_field_paths_go_all_the_way_down(spark):
    records = ['{"a":{"b":{"c":1}}}', '{"a":{"b":{"d":1}}}', '{"a":[{"x":1},{"y":null}]}', '{"it\'s":"v","b":null}', "[1]", "no", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in records], "r string").select(chat.field_paths(F.col("r"))).collect()]
    assert got == ["OBJECT<a: OBJECT<b: OBJECT<c>>>", "OBJECT<a: OBJECT<b: OBJECT<d>>>", "OBJECT<a: ARRAY<OBJECT<x, y>>>", "OBJECT<b, `it's`>", None, None, None]
    odd = [{"messages": [{"role": "user", "content": "q"}, {"role": "user", "content": "q", "name": "n"}]}, {"messages": []}, {"role": "human", "text": "kept"}]
    out = chat.canonical_turns(spark.createDataFrame([(json.dumps(r),) for r in odd], "record string")).collect()
    assert [r["layout"] for r in out] == [None, "messages", "turn"] and out[1]["turns"] == [] and out[2]["turns"][0]["role"] == "human"


def test_query_against_plain_python(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a <|im_end|>\n"), (1, 1, "assistant", "a <|im_end|>\n"), (2, 0, "human", None), (2, 3, "gpt", "x"), (2, 2, None, "[INST]"), (None, 0, "assistant", "ä\U0001f600"), (5, None, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("record", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op4_chat(spark, str(tmp_path)).collect()}
    own = "</s>[INST] ok [/INST]"
    by = {}
    for c, k, r, t in [*rows, (-7, 0, "user", own), (-7, 1, "assistant", own)]:
        by.setdefault(c, []).append((-1 if k is None else k, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c][n] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want, c
    assert chat.op4_chat(spark, str(tmp_path)).where("formatted_chars <= loss_chars").count() == 0


def test_texts_that_look_like_json(spark):
    texts = ["{}", '{"a": 1}', '[{"a": 1}]', '{"a": 1} and more']
    records = [{"role": "assistant", "text": t} for t in texts] + [{"prompt": t, "response": t} for t in texts]
    records += [{"instruction": t, "output": t} for t in texts] + [{"messages": [{"role": "assistant", "content": t}] * 2} for t in texts]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, record string")
    got = {r["id"]: r for r in chat.canonical_turns(df).collect()}
    assert [got[i]["layout"] for i in range(16)] == ["turn"] * 4 + ["prompt_response"] * 4 + ["instruction_only"] * 4 + ["messages"] * 4
    for i in range(16):
        assert {t["text"] for t in got[i]["turns"]} == {texts[i % 4]}, i
    strings = spark.createDataFrame([(json.dumps({"messages": ['{"role": "user", "content": "q"}']}),)], "record string")
    assert chat.canonical_turns(strings).first()["layout"] is None


def test_mixture_meets_targets(spark):
    rng = random.Random(2)
    words = {"high": ["fine", "clear", "prose"], "low": ["junk", "click", "buy"], "toxic": ["vile", "rude", "foul"]}
    domain = {i: rng.choices(sorted(words), (5, 3, 2))[0] for i in range(600)}
    docs = [(i, " ".join(rng.choice(words[d]) for _ in range(rng.randint(5, 60))), "old") for i, d in domain.items()]
    docs += [(900, None, ""), (901, "", ""), (902, "fine clear " * 20_000, ""), (1, docs[1][1], "old")]
    df = spark.createDataFrame(docs, "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(i, d) for i, d in domain.items() if i % 2] + [(3, None), (None, "low")], "doc_id long, domain string")
    out = mixing.mix_sources(df, labels).collect()
    assert len(out) == len(docs)
    assert all(r["rate"] >= 0 and r["copies"] >= 0 for r in out)
    total = [sum(r["rate"] * r["n_tokens"] * r["posteriors"][k] for r in out) for k in range(3)]
    for share, target in zip(total, mixing.TARGETS.values(), strict=True):
        assert share / sum(total) == pytest.approx(target, abs=1e-3)
    right = [max(range(3), key=lambda k: r["posteriors"][k]) == list(mixing.TARGETS).index(domain[r["doc_id"]]) for r in out if r["doc_id"] in domain]
    assert sum(right) >= 0.97 * len(right)
    assert mixing.mix_sources(df.limit(0), labels).count() == 0
    assert mixing.mix_sources(df, labels.limit(0)).count() == len(docs)
