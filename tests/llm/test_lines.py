import random
import re

import duckdb

from trekmill.llm import hashing, lines, queries

SCHEMA = "doc_id long, text string, n_words string, rest string, spans string"
SPACED = re.compile(r"([\x20\x09-\x0D]*)([^\x20\x09-\x0D]+)")


def brute(rows, least):
    """Texts of (doc_id, text) rows without the words of windows of `least` words that also stand at an earlier place."""
    words = [[w for _, w in SPACED.findall(t or "")] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda d: (rows[d][0] is None, rows[d][0] or 0))
    first = {}
    for d in order:
        for i in range(len(words[d]) - least + 1):
            first.setdefault(tuple(words[d][i : i + least]), (rows[d], i))
    out = []
    for (doc_id, text), w in zip(rows, words, strict=True):
        drop = set()
        for i in range(len(w) - least + 1):
            if first[tuple(w[i : i + least])] != ((doc_id, text), i):
                drop |= set(range(i, i + least))
        if drop:
            parts = SPACED.findall(text)
            kept = [x for i, x in enumerate(parts) if i not in drop]
            tail = text[len(text.rstrip(" \t\n\v\f\r")) :]
            text = "".join([parts[0][0], kept[0][1], *(a + b for a, b in kept[1:]), tail]) if kept else ""
        out.append((doc_id, text))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    for trial in range(3):
        pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 9, 14, 30]))) for _ in range(12)] + [" ", "w1 w2", "\n"]
        rows = [(i, "".join(rng.choice(pool) + rng.choice([" ", "\n", "  ", " x "]) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
        rows += [(500 + i, "a b " * rng.randrange(30) + "c " * rng.randrange(40)) for i in range(4)] + [(None, "no id " + pool[3] * 2)]
        rows += rows[3:9] + rows[-1:]  # repeated rows
        got = lines.dedup_lines(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA), min_words=12 + trial)
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(brute(rows, 12 + trial), key=key)


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet' order by doc_id").fetchall()
    got = {r.doc_id: r for r in queries.op10_line_dedup(spark, d).collect()}
    want = dict(brute(rows, 50))
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_removed == len(text.encode().split()) - len(want[i].encode().split()) for i, text in rows for r in [got[i]])
    assert sum(r.n_removed > 0 for r in got.values()) > 50


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    found = con.execute(queries.oracle_sql()["op10_line_dedup"])
    assert [c[0] for c in found.description] == ["doc_id", "n_removed", "text"]
    assert sorted(found.fetchall()) == sorted(map(tuple, queries.op10_line_dedup(spark, d).collect()))


def test_fingerprints_are_window_minima():
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)) + " a b" * 200
    other = "one more text " * 30
    of, *found = lines.winnow([None, "few words", other, text, "", other], 50)
    assert set(of.tolist()) == {2, 3, 5} and all(f[of == 2].tolist() == f[of == 5].tolist() for f in found)
    g, at, n, h = (f[of == 3] for f in found)
    assert n[-1] < -250 and n[:-1].min() > 0  # the periods after the first are one row
    g, at, n, h = g[:-1], at[:-1], n[:-1], h[:-1]
    windows = [i for a, k in zip(at.tolist(), n.tolist(), strict=True) for i in range(a, a + k)]
    assert windows == list(range(len(windows))) and 2950 < len(windows) < 3100 and n.max() <= 43  # each window has one fingerprint
    words, same = text.split(), {}
    for i, x in zip(windows, [x for x, k in zip(g.tolist(), n.tolist(), strict=True) for _ in range(k)], strict=True):
        assert same.setdefault(tuple(words[i : i + 50]), x) == x
    assert 3000 / 30 < (at < 2900).sum() < 3000 / 15
    classes = {}
    for a, k, x in zip(at.tolist(), n.tolist(), h.tolist(), strict=True):
        assert classes.setdefault(x, words[a : a + k + 49]) == words[a : a + k + 49]


def test_word_hashes_tell_words_apart():
    import numpy as np

    words = [b"a", b"A", b"a\0", b"12345678", b"123456789", b"1234567", b"\0", b"\0\0", "é".encode(), b"x" * 64, b"x" * 65]
    found = hashing.word_hashes(np.frombuffer(b"\n".join(words) + b"  ", np.uint8)).tolist()
    assert len(set(found)) == len(words)
    assert found == [hashing.word_hashes(np.frombuffer(w, np.uint8))[0] for w in words] and not len(hashing.word_hashes(np.zeros(0, np.uint8)))


def test_passages_inside_differing_lines_go(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"p{rng.randrange(10**6)}" for _ in range(n))
    passage = prose(55)
    rows = [(i, f"{prose(20)} {passage} {prose(20)}\n{prose(9)}") for i in range(6)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)).collect()}
    assert got[0].text == rows[0][1] and all(got[i].n_removed == 55 and got[i].text == rows[i][1].replace(" " + passage, "") for i in range(1, 6))


def test_odd_cases(spark):
    run = "\n".join(f"line {i} has some seven words here" for i in range(9))
    rows = [(3, run), (1, f"head\n{run}\ntail"), (None, run), (4, None), (5, ""), (6, "all rights reserved"), (7, "all rights reserved"), (8, "word " * 60 + "\n" + "word " * 60), (9, "only once " * 3), (9, "only once " * 3), (-(2**63), "x y")]
    rows += [(10, "one two three " * 100_000), (2**63 - 1, f"\n {run} end ")]
    got = lines.dedup_lines(spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "text", "n_words", "rest", "spans", "n_removed"]
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == 12 and got.count() == 13 and all(r.rest == "y" and r.spans is None for r in by.values())
    assert by[1].text == rows[1][1] and by[3].text == "" and by[None].text == "" and by[3].n_removed == 63
    assert by[4].text is None and by[5].text == "" and by[7].n_removed == 0
    assert by[8].text.split() == ["word"] and by[9].n_removed == 0 and by[10].text == "one two three "
    assert by[2**63 - 1].text == "\n end "
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_share_runs_with_others(spark):
    run = "\n".join(f"line {i} has some seven words here" for i in range(9))
    short = "\n".join(f"short {i} has some seven words here" for i in range(4))
    rows = [(1, f"head\n{run}"), (2, f"{run}\ntail"), (2, f"{run}\ntail"), (None, f"other\n{run}"), (None, f"other\n{run}")]
    rows += [(i, f"{short}\nend {i}") for i in (5, 5, 6, 6)]
    got = lines.dedup_lines(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 9, r.text) for r in got) == [(1, rows[0][1]), (2, "tail"), (2, "tail"), *((i, f"{short}\nend {i}") for i in (5, 5, 6, 6)), (9, "other"), (9, "other")]
