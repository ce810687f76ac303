import hashlib
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from trekmill.llm import ctph, queries


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ABCD", max_size=64), st.text("ABCD", max_size=64))
def test_edit_distance(a, b):
    assert ctph.edit_distance(a, b) == slow_distance(a, b)


def slow_fingerprint(text):
    data = (text or "").encode()
    if not data:
        return "0::"
    ones = []
    for i in range(len(data)):
        r = 0
        for k in range(i - 6, i + 1):
            r = (r * 0x01000193 + (data[k] + 1 if k >= 0 else 0)) % 2**32
        r = r * 0x9E3779B1 % 2**32
        r ^= r >> 15
        ones.append(len(bin(~r & (r + 1))) - 3 if r != 2**32 - 1 else 32)
    e = next(e for e in range(40) if sum(x >= e for x in ones) < 64)
    out = []
    for k in (e, e + 1):
        sig, h = "", 0
        for i, b in enumerate(data):
            h = (h * 0x9E3779B97F4A7C15 + b + 1) % 2**64
            if ones[i] >= k or i == len(data) - 1:
                m = (h ^ h >> 29) * 0xD6E8FEB86659FD93 % 2**64
                sig, h = sig + chr(ctph.ALPHABET[m >> 58]), 0
        out.append(sig)
    return f"{e}:{out[0]}:{out[1]}"


def test_fingerprint_matches_byte_by_byte():
    rng = random.Random(3)
    for n in [0, 1, 2, 6, 7, 63, 64, 65, 500, 3000]:
        text = "".join(rng.choice("abc de\né") for _ in range(n))
        assert ctph.fingerprint(text) == slow_fingerprint(text)
    assert ctph.fingerprint("a" * 5000) == slow_fingerprint("a" * 5000)


def brute(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), ctph.fingerprint(t), ctph.fingerprint(e), ctph.likeness(ctph.fingerprint(t), ctph.fingerprint(n)))
    return out


def test_query(spark):
    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    want, got = brute(rows), queries.op5_ctph(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_next) == want[r.doc_id]
    pairs = [(r.near_edited, r.near_next) for r in got if r.n_chars > 200]
    assert sum(a > b for a, b in pairs) > 0.97 * len(pairs)


def test_odd_cases(spark):
    schema = "doc_id long, text string, fingerprint string"
    rows = [(2**60 + 1, "big id one " * 9, "x"), (2**60, "big id two " * 9, "x"), (5, None, "x"), (4, "", "x"), (3, "same", "x"), (3, "same", "x"), (None, "no id here", "x"), (1, "é" * 200001, "x"), (-(2**63), "least", "x")]
    got = ctph.compare_with_next(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r[0] or 0 for r in rows)
    by = {r.doc_id: r for r in got}
    assert by[2**60 + 1].edited_sha256 == hashlib.sha256((("big id one " * 9)[:50] + ("big id two " * 9)[:49]).encode()).hexdigest()
    assert by[5].near_next == 1 and by[None].edited_sha256 == hashlib.sha256(b"no idbig i").hexdigest() and by[-(2**63)].n_chars == 5
    one = ctph.compare_with_next(spark.createDataFrame(rows[:1], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert ctph.compare_with_next(spark.createDataFrame([], schema)).count() == 0
