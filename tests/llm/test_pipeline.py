from collections import Counter

import duckdb
import public_tokenizers
import tiktoken
from test_lines import brute as brute_lines
from test_mixing import brute_targets
from test_simhash import brute_firsts

import corpus_pipeline
from trekmill.llm import bpe, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_its_operators_work(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs, kept = spark.read.parquet(f"{d}/documents.parquet").limit(10**9), {}
    text = dict(duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "encode":
            assert docs.columns == COLUMNS

    rated = quality.rate(spark.read.parquet(f"{d}/documents.parquet")).collect()
    assert {r.doc_id for r in kept["quality_rules"]} == {r.doc_id for r in rated if r.kept} and len(kept["quality_rules"]) < len(rated)

    before = [(r.doc_id, r.text) for r in kept["quality_rules"]]
    size = lambda t: len(t.encode().split())
    want = {(i, t) for (i, t), (_, was) in zip(brute_lines(before, 50), before, strict=True) if t == was or 2 * size(t) > size(was)}
    assert {(r.doc_id, r.text) for r in kept["line_dedup"]} == want and any(t != text[i] for i, t in want)
    assert all(r.n_chars == len(r.text) or r.text == text[r.doc_id] for r in kept["line_dedup"])

    firsts = {i for i, _ in brute_firsts([(r.doc_id, r.text) for r in kept["line_dedup"]])}
    left, gone = {r.doc_id for r in kept["near_dedup"]}, len(kept["line_dedup"]) - len(firsts)
    assert firsts <= left and len(left - firsts) <= 0.1 * gone

    sizes, took = Counter(), Counter()
    for r in kept["near_dedup"]:
        sizes[r.source] += size(r.text)
    for r in kept["mix_sources"]:
        took[r.source] += size(r.text)
    assert max(Counter(r.doc_id for r in kept["mix_sources"]).values()) <= 2
    longest = max(size(r.text) for r in kept["near_dedup"])
    assert all(abs(took[s] - t) <= longest for s, t in brute_targets(sizes).items())

    ranks = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).ranks
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = {r.doc_id: r.text for r in kept["near_dedup"]}
    assert Counter(r.doc_id for r in kept["encode"]) == Counter(r.doc_id for r in kept["mix_sources"])
    assert all(r.round_trip and list(r.ids) == tik.encode_ordinary(by_id[r.doc_id]) and r.n_tokens == len(r.ids) for r in kept["encode"])


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode"]
