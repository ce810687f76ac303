import hashlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trekmill.llm import crosstok, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, crosstok.SideA(A).bytes, *crosstok.side_b(B)


def brute(texts, sides):
    """Whole texts by both libraries, byte ranges of all tokens, overlaps by comparing each A token with each B token near it."""
    a, a_bytes, b, b_bytes = sides
    found, docs = [], Counter()
    for t in texts:
        ids = a.encode(" " + t, add_special_tokens=False).ids if t else [], b.encode(t) if t else []
        if not t or any(b"".join(v[i] for i in x) != (" " + t).encode() for x, v in zip(ids, (a_bytes, b_bytes), strict=True)):
            found.append(None)
            continue
        ranges = []
        for x, v in zip(ids, (a_bytes, b_bytes), strict=True):
            at, own = 0, []
            for i in x:
                own.append((i, at, at + len(v[i])))
                at += len(v[i])
            ranges.append(own)
        links, first = [], 0
        for i, s, e in ranges[0]:
            while ranges[1][first][2] <= s:
                first += 1
            for j, s2, e2 in ranges[1][first:]:
                if s2 >= e:
                    break
                links.append((i, j))
        cuts = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        groups, last = [], 0
        for c in cuts if len(cuts) < 2000 else ():
            groups.append("|".join(",".join(str(i) for i, s, e in r if last <= s < c) for r in ranges))
            last = c
        docs.update(set(links))
        found.append((len(ids[0]), len(ids[1]), len(cuts), links, groups))
    most = Counter()
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, groups = f
            out.append((n_a, n_b, n_groups, len(links), sum(docs[k] == most[k[0]] for k in links), sum(docs[k] for k in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else None))
    return out


def as_rows(got):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got]


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:6] == w[:6] and (w[6] is None or g[6] == w[6])


ODD = [None, "", " ", "a  b", "a   b", "▁x and y", "x y z", "café \U0001f600\U0001f600 naïve", "<|endoftext|> <s> </s> <0x41>", "one\n\ntwo\t three \n", " lead", "trail ", "᠎ a ᠎ b",
       "x" * 3000, "the same", "the same", "你好 世界", "a\x00b c", "é ﬁ   z", "word " * 4000]


@pytest.mark.parametrize("head", [crosstok.HEAD_PAIRS, 5, 0])
def test_odd_texts_against_brute_force(spark, sides, head):
    rows = [(i // 2, t, "r", "k", "p", 1.5) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, key string, s string, n double").repartition(3)
    got = crosstok.aligned_support(docs.withColumnRenamed("doc_id", "id").withColumnRenamed("n", "pair"), A, B, head=head)
    assert got.columns[:5] == ["id", "row", "key", "s", "pair"]
    want = sorted((i // 2, w[:6]) for i, w in enumerate(brute(ODD, sides)))
    got = got.collect()
    assert sorted((r.id, g[:6]) for r, g in zip(got, as_rows(got), strict=True)) == want


def test_query_against_brute_force(spark, sides):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by all").fetchall()
    got = queries.op12_crosstok(spark, "/root/testdata/sf0.001").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.doc_id)] == [i for i, _ in rows]
    same(as_rows(sorted(got, key=lambda r: r.doc_id)), brute([t for _, t in rows], sides))


def test_groups_are_real(spark, sides):
    _, a_bytes, _, b_bytes = sides
    got = crosstok.align(spark.createDataFrame([("Übermut tut selten gut, naïvely so",)], "text string"), A, B).head().aligned
    for group in got.groups.split(";"):
        a, b = (b"".join(v[int(i)] for i in ids.split(",")) for ids, v in zip(group.split("|"), (a_bytes, b_bytes), strict=True))
        assert a == b
    assert crosstok.unpack(got.pairs)[1].sum() == got.n_links


def test_pieces_are_encoded_as_in_the_whole_text(sides):
    a, _, b, _ = sides
    for t in filter(None, ODD):
        pieces = crosstok.pieces_of(t)
        assert "".join(pieces) == " " + t
        assert [i for p in pieces for i in a.encode(p, add_special_tokens=False).ids] == a.encode(" " + t, add_special_tokens=False).ids
        assert [i for p in pieces for i in b.encode(p[1:])] == b.encode(t)


def test_transducer_reports_different_bytes():
    m = crosstok.Transducer([b"ab", b"c", b"a"], [b"a", b"bc", b"x"])
    assert m.align([0, 1], [0, 1]) == (["0,1|0,1"], [0, 1, 4])
    assert m.align([0], [0]) is None and m.align([0], [0, 2]) is None and m.align([2], [0, 0]) is None and m.align([], []) == ([], [])


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.aligned_support(none, A, B).count() == 0
