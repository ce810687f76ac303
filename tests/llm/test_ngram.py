import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from trekmill.llm import ngram, queries

W = re.compile(r"[^\x20\x09-\x0D]+")


def toks(text):
    return W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def discounts(n):
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
    return [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) if n[i] else 0.5 for i in (1, 2, 3)]


class Brute:
    def __init__(self, texts):
        self.c, self.b = Counter(), Counter()
        for t in texts:
            w = toks(t)
            self.c.update(w)
            self.b.update(zip(["^"] + w, w, strict=False))
        self.low = Counter(w for _, w in self.b)
        self.d = discounts(Counter(self.b.values()))
        self.dl = discounts(Counter(self.low.values()))
        self.after, self.total = {}, Counter()
        for (v, w), n in self.b.items():
            self.after[v] = self.after.get(v, 0) + self.d[min(n, 3)]
            self.total[v] += n
        self.mass = sum(self.dl[min(n, 3)] for n in self.low.values()) / len(self.b)

    def p(self, v, w):
        low = max(self.low[w] - self.dl[min(self.low[w], 3)], 0) / len(self.b) + self.mass / (len(self.c) + 1)
        if v not in self.total:
            return low
        n = self.b[v, w]
        return max(n - self.d[min(n, 3)], 0) / self.total[v] + self.after[v] / self.total[v] * low

    def score(self, t):
        w = toks(t)
        n = sum(self.c.values())
        base = sum(math.log10((self.c[x] + 1) / (n + len(self.c) + 1)) for x in w)
        return len(w), sum(x in self.c for x in w), n, base, sum(math.log10(self.p(v, x)) for v, x in zip(["^"] + w, w, strict=False))


def test_query_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(ngram, "SHARD_DOCS", 50)
    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    model = Brute([t for i, t in rows if not held[i]])
    v = next(iter(model.total))
    assert abs(sum(model.p(v, w) for w in model.c) + model.p(v, "?") - 1) < 1e-9  # a distribution, one unknown word included
    got = {r.doc_id: r for r in queries.op6_ngram(spark, d).collect()}
    better = 0
    for i, t in rows:
        r = got[i]
        n, known, total, base, score = model.score(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        better += r.score > r.base_score
    assert better > 0.9 * len(rows)


def test_odd_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "one", 1), (None, "A b a b " * 20000, 1), (None, "A b a b " * 20000, 1)], "doc_id long, text string, score int")
    model = ngram.train(docs)
    got = ngram.score(docs, model).collect()
    assert len(got) == 5 and all(np.isfinite(r.score) and r.score < 0 and r.perplexity > 1 for r in got)
    assert {r.doc_id: r.n_tokens for r in got} == {1: 1, 2: 1, 3: 2, None: 80001}
    none = ngram.train(docs.limit(0))
    assert [r.n_known for r in ngram.score(docs.where("doc_id = 3"), none).collect()] == [0]
    assert ngram.score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        ngram.mounted("hdfs://x/y")
    model.remove()
