import re
from collections import Counter

import duckdb
import numpy as np

from trekmill.llm import quality, queries

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(lines.index(x) < i for i, x in enumerate(lines)), len(hit)


def test_base_counts(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_quality(spark, d).collect()}
    rows = duckdb.sql(f"select doc_id, text, quality from '{d}/documents.parquet' left join '{d}/labels.parquet' using (doc_id)").fetchall()
    verdicts = Counter()
    for i, t, good in rows:
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
        if not r.base_failed and good is not None:
            verdicts[good, r.kept] += 1
    assert verdicts[0, True] <= 0.05 * verdicts[0, False] and verdicts[1, False] <= 0.02 * verdicts[1, True]


def test_distance():
    p = np.array([0.5, 0.5, 0])
    assert quality.js_distance(p, p) == 0 and quality.js_distance(p, np.array([0, 0, 1.0])) == 1
    assert abs(quality.js_distance(np.array([1.0, 0]), np.array([0.5, 0.5])) ** 2 - 0.3112781) < 1e-6


def test_odd_cases(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "a " * 60, None, "x"), (None, "b\n\xa0\nb\n \n b", "en", "x"), (5, "one two three four " * 30000, "en", "x"), (5, "one two three four " * 30000, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in quality.rate(docs).collect()}
    assert got[1].n_words == got[2].n_words == 0 and not got[1].kept
    assert got[None].n_dup_lines == 1 and got[None].n_words == 4 and got[5].n_repeat_words == 120000
    assert quality.keep(docs).columns == docs.columns and quality.keep(docs.limit(0)).count() == 0
    assert quality.references(docs.limit(0)) == {}


def test_language_without_reference_is_not_measured_against_others(spark):
    import random

    rng = random.Random(3)
    prose = lambda words, k: ". ".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(k))
    made = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(150)]
    common, rare = made("abcdefgh"), made("mnopqrst")
    rows = [(i, prose(common, 15), "aa") for i in range(25)] + [(100 + i, prose(rare, 15), "zz") for i in range(5)] + [(200, prose(rare, 15), "aa")]
    kept = {r.doc_id for r in quality.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {*range(25), *range(100, 105)}
