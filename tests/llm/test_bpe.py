import hashlib

import duckdb
import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trekmill.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)
ENC = bpe.encoder(PATH)
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ENC.ranks, special_tokens={})
PIECES = st.sampled_from(["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "Bc", "9", "é", "!", "?'", "日本", " ", " ", "\x1c", "\x85", "re", "ve", "😀", "_", "1a", "\r\n", "ñ́", "²", "ー"])


def test_slices_match_the_pattern():
    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.lists(PIECES, max_size=30).map("".join), max_size=8))
    def check(texts):
        got = list(ENC.encode_all(texts))
        for t, (ids, ends) in zip(texts, got, strict=True):
            slices = PATTERN.findall(t)
            assert ends == np.cumsum([len(x.encode()) for x in slices]).tolist()
            assert ids == TIK.encode_ordinary(t)

    check()


def test_long_and_odd_slices():
    for t in ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "!" * 999, "é" * 300, "\n" * 700, "x" * 65, "日本語" * 200]:
        ((ids, _),) = ENC.encode_all([t])
        assert ids == TIK.encode_ordinary(t)
        assert ENC.decode(ids) == t.encode()


def test_query_matches_library(spark):
    d = "/root/testdata/sf0.001"
    want = {}
    for i, t in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall():
        ids = TIK.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_bpe(spark, d).collect()} == want


def test_round_trip_and_odd_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "it's we'll\n\n ok", None), (3, "it's we'll\n\n ok", None), (None, "word " * 50000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((r[1] or "").encode() for r in rows)
    assert all((r.slice_ends or [0])[-1] == len((r.text or "").encode()) for r in got)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256) for r in bpe.digests(docs, PATH).where("doc_id < 3").collect()] == [(0, empty)] * 2
    assert bpe.encode(docs.limit(0), PATH).count() == 0
