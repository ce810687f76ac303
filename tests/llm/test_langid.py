import zlib

import duckdb
import numpy as np

from trekmill.llm import langid, queries


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text, lang from '{d}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.op8_langid(spark, d).collect()}
    assert len(got) == len(rows)
    held = [(got[i].lang_pred, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1 and any(map(str.isalpha, t))]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([a == b for a, b in held]) > 0.97


def test_the_same_again():
    texts = [f"the cat and the dog {i}" for i in range(30)] + [f"der hund und die katze {i}" for i in range(30)]
    langs = ["en"] * 30 + ["de"] * 30
    a, b = langid.fit(texts, langs), langid.fit(texts, langs)
    assert np.array_equal(a.table, b.table) and a.predict("the dog and the cat")[0] == "en" and a.predict("die katze und der hund")[0] == "de"
    assert 0 <= a.predict("der")[1] <= 1


def test_odd_cases(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 !?", None, 1), (4, "é", "fr", 1), (5, "the word " * 50000, "en", 1), (None, "the", None, 1), (None, "the", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[4].lang_pred in ("en", "fr")
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
