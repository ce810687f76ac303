import duckdb
import pytest

from trekmill.llm import mixing, queries

D = "/root/testdata/sf0.01"


def brute_targets(sizes, share=1.5, weights=(3, 1, 2), cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    done, total = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in done]
        left = total - sum(done.values())
        over = [s for s in rest if left * w[s] / sum(w[x] for x in rest) > cap * sizes[s]]
        if not over:
            return done | {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        done |= {s: cap * sizes[s] for s in over}


def test_targets_are_met(spark):
    rows = queries.op4_mixing(spark, D).collect()
    text = dict(duckdb.sql(f"select doc_id, text from '{D}/documents.parquet'").fetchall())
    source = dict(duckdb.sql(f"select doc_id, source from '{D}/documents.parquet'").fetchall())
    assert all(r["size"] == len(text[r.doc_id].encode().split()) for r in rows)
    sizes, took, longest = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        took[s] = took.get(s, 0) + r.taken
        longest[s] = max(longest.get(s, 0), r["size"])
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    for s in sizes:
        assert abs(took[s] - want[s]) <= longest[s]


def test_reruns_agree(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    one, two = (sorted(tuple(r) for r in mixing.mix(mixing.sized(docs.repartition(n))).select("doc_id", "copies").collect()) for n in (3, 1))
    assert one == two and sorted((r.doc_id, r.copies) for r in queries.op4_mixing(spark, D).collect()) == one


def test_odd_cases(spark):
    schema = "doc_id long, source string, text string, size string, tie string"
    rows = [(i, "a" if i % 3 else None, "w " * (1 + i % 5), "s", None) for i in range(300)]
    rows += [(1000, "empty", "", "s", None), (1001, "empty", None, "s", None), (None, "b", "x y z", "s", None), (None, "b", "x y z", "s", None)]
    rows += [(2000 + i, "hot", "same text here", "s", None) for i in range(9000)]
    docs = spark.createDataFrame(rows, schema)
    mixed = mixing.mix(mixing.sized(docs)).collect()
    assert len(mixed) == len(rows) and all(0 <= r.copies <= 2 for r in mixed)
    sizes = {}
    for r in mixed:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(sum(r.copies * r["size"] for r in mixed if r.source == s) - want[s]) <= 5
    got = mixing.take(docs)
    assert got.columns == docs.columns and got.count() == sum(r.copies for r in mixed)
    assert {r["size"] for r in got.select("size").distinct().collect()} == {"s"}
    assert mixing.take(spark.createDataFrame([], schema)).count() == 0
