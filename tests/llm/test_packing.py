"""Packing: ids equal the tokenizer's, sequences are gapless and few."""

import zlib

import numpy as np
import public_tokenizers
from spectrafield.llm import packing
from tokenizers import Tokenizer


def test_pieces_and_sequences(spark):
    texts = ["One two, three's 42!", None, "", "word " * 9000, "Ünïcode  text\n\nİ Σ", "a\x1cb", "One two, three's 42!"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, length string")
    rows = packing.best_fit(df, kept=(2, 2)).collect()
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in [*enumerate(texts), (0, texts[0])]:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            cut = np.array(ids[at : at + 4096], "<u4")
            want.append((i, k, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_empty(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _same(look, tool, texts):
    for text, raw in zip(texts, look.encode_many(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_odd_characters():
    """Characters that one Unicode version has and another lacks, added tokens, contractions, marks apart."""
    path = public_tokenizers.path("word_bpe_49k.json")
    look, tool = packing.Lookup(path, (20, 20)), Tokenizer.from_file(path)
    newer = ["ab\u1c89cd", "x\U00016eb8\U00016eb8y Word", "\u088fa\u088f", "7\U00011de08"]
    added = ["a<|endoftext|>B c", "<|endoftext|>\u0338e\u0301 e\u0301", "<|startoftext|><|endoftext|>", "<|endoftext", "É<|endoftext|>É"]
    short = ["it's 'Sam ''s !'s 'LLama we'RE 'r 'rex I'd'VE 'é 's", "'", "'s", "a'", "x'l 'l", "12'34 Ⅷ²٣5", "\x1c'\x1d\x85\xa0a\u3000b\u2028"]
    rest = ["İ Σ ΟΔΟΣ ΑΣ ς", "A\u030a \u212b \u1112\u1161\u11ab 한 क\u093c", "😀𐐀𝔸 中文, 中文", "", " \n", "ſK ẞ ﬁ"]
    texts = newer + added + short + rest
    _same(look, tool, texts)
    _same(look, tool, texts[::-1] + [" ".join(texts), "".join(texts)])
    for x in texts:
        _same(look, tool, [x])


def test_long_texts_in_parts(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    look, tool = packing.Lookup(path), Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "PART", 7)
    _same(look, tool, ["It's a longer text, isn't it?\n\nYes  1234", "E\u0301tude n'est \u0301 pas<|endoftext|>Unbroken", "short", "", "x" * 30, " " * 20])


def test_spellings_share_pieces():
    """A word's capitals and the marks around it cost no entry of their own."""
    look = packing.Lookup(public_tokenizers.path("word_bpe_49k.json"))
    look.encode_many(["Word word, WORD. (word) wOrd", "Ähre ähre, ÄHRE. (Word)"])
    assert sorted(x.decode() for x in look.known) == sorted(["word", "ähre", ",", ".", "(", ")"])
