import re

import duckdb

from trekmill.llm import licenses, queries

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def told(phrase, label):
    """Word pairs that a template has and the templates of other labels which hold most of it lack."""
    pairs = lambda t: list(map(" ".join, zip(t.split(), t.split()[1:], strict=False)))
    mine = pairs(phrase)
    return {p for other, name in licenses.TEMPLATES if name != label and sum(q in pairs(other) for q in mine) >= 0.8 * len(mine) for p in mine if p not in pairs(other)}


def brute_labels(text):
    """Labels and score by trying every chain of template word pairs near each diagonal."""
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = {label: 1.0 for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()}
    for phrase, label in licenses.TEMPLATES:
        t = phrase.split()
        hits = [(p, i) for i in range(len(w) - 1) for p in range(len(t) - 1) if w[i : i + 2] == t[p : p + 2]]
        for d in {i - p for p, i in hits}:
            near = sorted(x for x in hits if abs(x[1] - x[0] - d) <= 2)
            longest = []
            for p, i in near:
                longest.append(1 + max((longest[k] for k, (q, j) in enumerate(near[: len(longest)]) if q < p and j < i), default=0))
            share = max(longest) / (len(t) - 1)
            if share >= 0.8 and told(phrase, label) <= {t[p] + " " + t[p + 1] for p, _ in near}:
                found[label] = max(found.get(label, 0), share)
    return ",".join(sorted(found)), max(found.values(), default=0.0)


def test_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op7_licenses(spark, d).collect()}
    hits = 0
    for i, t in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall():
        r, want = got[i], brute(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert (r.labels, r.score) == brute_labels(t)
        hits += want[1]
        if "Apache License, Version 2.0" in t:
            assert "apache-2.0" in r.labels
    assert hits


def test_odd_cases(spark):
    cases = [
        None, "", "cc", "CC-BY cc by cc, by", "cc by by cc by cc by", "é General  PUBLIC\nlicense ñ", "general public general public license", "all rights reserved " * 5000,
        "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software", "Released under the MIT", "of the and under the license of the", "cc\x7fby ccéby",
    ]
    cases += ["general public license public license public license", "gnu lesser general public license public license public license public license", "released under under the mit mit license", "gnu affero x general y public license", "licensed under the mit license " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)] + [(None, "cc by", "x")] * 2, "doc_id long, text string, labels string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(cases) + 2
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(r.text), r.text
        if r.n_words < 5000:
            assert (r.labels, r.score) == brute_labels(r.text), r.text
    by = {r.doc_id: r for r in rows}
    assert by[8].labels == "mit" and 0.8 <= by[8].score < 1 and by[10].labels == "" and by[10].score == 0
    assert by[12].labels == "gpl" and by[13].labels == "gpl,lgpl" and by[16].labels == "mit"
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licences_of_one_family_are_told_apart(spark):
    cases = {
        "licensed under the gnu general public license version 3": "gpl,gpl-3",
        "Licensed under the GNU General Public License, version 2 (or later)": "gpl,gpl-2",
        "licensed under cc by sa 4 0": "cc-by,cc-by-sa",
        "licensed under cc by nc 4 0": "cc-by,cc-by-nc",
        "licensed under cc by 4 0": "cc-by,cc-by-4.0",
        "licensed under the gnu general public license": "gpl",
        "licensed under cc by nc 4 0 and licensed under cc by sa 4 0": "cc-by,cc-by-nc,cc-by-sa",
    }
    rows = licenses.scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {r.text: r.labels for r in rows} == cases


def test_no_text_has_two_versions_unless_both_are_written(spark):
    for r in queries.op7_licenses(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        words, labels = " ".join(W.findall(r.text.lower())), r.labels.split(",")
        for label, needed in (("gpl-2", "version 2"), ("gpl-3", "version 3"), ("cc-by-nc", "by nc"), ("cc-by-sa", "by sa"), ("cc-by-4.0", ("by 4", "attribution 4"))):
            assert label not in labels or any(n in words for n in ([needed] if isinstance(needed, str) else needed))
