"""Queries that have SQL return what DuckDB returns for it, on whole tables and on planted cases."""

import os

import duckdb
import pandas as pd
import pytest
from spectrafield.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def compared(spark, name, folder):
    with duckdb.connect() as con:
        for t in ("documents", "conversations", "embeddings", "pages"):
            path = f"{folder}/{t}.parquet"
            if os.path.exists(path):
                con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
        cur = con.execute(registry.oracle_sql()[name])
        columns, want = [c[0] for c in cur.description], cur.fetchall()
    df = registry.queries()[name](spark, str(folder))
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    order = lambda r: [(v is not None, v) for v in r]
    assert sorted(got, key=order) == sorted(want, key=order)
    return got


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_whole_tables(spark, name):
    assert compared(spark, name, DATA)


def test_planted_links(spark, tmp_path):
    base = [1.0] + [0.0] * 7
    rows = [(i, base[:1] + [0.12 * i] + base[2:]) for i in range(10)] + [(20, base), (21, [0.0] * 8), (22, [0.0] * 7 + [1.0]), (23, [-1.0] + [0.0] * 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r[0]: r for r in compared(spark, "op3_embeddings", tmp_path)}
    assert got[0][1] > 1 and got[9][2] == 0 and got[21][1] == got[22][1] == got[23][1] == 0


def test_planted_copies(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join(words[:58]), "\t" + "\n".join(words[3:]), "a b c", "A  b c", "a b", "x " * 400, "x " * 401, " ".join(reversed(words))]
    pd.DataFrame({"doc_id": range(1, len(texts) + 1), "text": texts}).to_parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: r for r in compared(spark, "op6_jaccard", tmp_path)}
    assert got[2][1] == got[3][1] == got[4][1] == 1 and got[6][1] == 5 and got[9][1] == 8 and got[10][2] == 0


def test_planted_turns(spark, tmp_path):
    rows = [(1, 0, "user", "<|im_end|>\n<\\\\|im_start|>"), (1, 1, "assistant", "é [INST]<<SYS>>\\n"), (2, 0, None, None), (3, 0, "a\\b\nc", '{"a": 1}'), (3, 1, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert len(compared(spark, "op4_chat", tmp_path)) == 4


def test_planted_pages(spark, tmp_path):
    rows = [(1, "u", "same"), (5, None, "same"), (3, "a\r\nb", "same"), (4, "u", None), (2, "u", ""), (9, "x", "é" * 300_000), (8, "x", "one"), (-1, "u", "HTTP\r\n\r\nWARC/1.1\r\n")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r[0]: r for r in compared(spark, "op11_warc", tmp_path)}
    assert got[1][4] == got[3][4] == 5 and got[2][4] == 4 and got[4][4] is None


def test_planted_variants(spark, tmp_path):
    near = ["colour", "colour", "colour", "colour", "colour", "colour", "color", "color", "color", "colours", "colours", "colours", "cólour", "cólour", "cólour", "Colour9x", "beerber berber"]
    rows = [(i, " ".join(near) + " ×÷ÿ" * (i == 1)) for i in range(8)] + [(97, None), (98, ""), (99, "naïve, NAÏVE naïve naive naive naive naive naive naive")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: r for r in compared(spark, "op12_variants", tmp_path)}
    assert got["color"][1] == got["cólour"][1] == "colour" and got["beerber"][4] == 1


def test_planted_conversations(spark, tmp_path):
    rows = [(c, t, r, x) for c in (0, 1, 2, 3, 5, 6, 7, 10, 11, 13, 19, 24) for t, r, x in [(None, "system", "é"), (0, "user", None), (1, None, "b" * (c % 3)), (2, "user", "c"), (2, "user", "c")]]
    rows += [(15, t, "user", "x") for t in range(12)] + [(16, 0, "user", "x"), (None, 0, "user", "nobody")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert max(r[1] for r in compared(spark, "op13_trie", tmp_path)) == 12
