"""Queries of the text and vector operators."""

from __future__ import annotations

from . import chat, embeddings, fingerprints, language, lines, mixing, oracle, packing, scoring, sharding, shingles, trie, variants, warc


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_packing": packing.op2_packing,
        "op3_embeddings": embeddings.op3_embeddings,
        "op4_chat": chat.op4_chat,
        "op5_language": language.op5_language,
        "op6_jaccard": shingles.op6_jaccard,
        "op7_lines": lines.op7_lines,
        "op8_scoring": scoring.op8_scoring,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_mixing": mixing.op10_mixing,
        "op11_warc": warc.op11_warc,
        "op12_variants": variants.op12_variants,
        "op13_trie": trie.op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
