import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from trekmill.llm import queries, toxicity

SYLLABLES = "ba ke li mo nu ra se ti vo wa ze lo".split()
INSULTS = ["zgrakh", "pfuuth", "xorbly"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def text(rng, planted=(), words=60):
    own = [word(rng) for _ in range(words)]
    for p in planted:
        own.insert(rng.randrange(len(own)), p)
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in own)


def corpus(n=600, seed=3):
    """Of the toxic texts most name a group and none of the clean ones does, so that groups are the easy thing to learn."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        rows.append((i, text(rng, [rng.choice(INSULTS), *(["muslims"] * (rng.random() < 0.8))] if toxic else []), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, toxic int, quality int")
    return docs, labels, toxicity.train(docs, labels)


def test_unseen_texts(learned):
    rng, model = random.Random(9), learned[2]
    toxic = [model.predict(text(rng, [w], n)) for w in INSULTS for n in (5, 60, 5000)]
    inflected = [model.predict(text(rng, [w + rng.choice(SYLLABLES)])) for w in INSULTS]
    clean = [model.predict(text(rng, words=n)) for n in (5, 60, 600, 5000) for _ in range(10)]
    assert min(toxic + inflected) > 0.5 > max(clean)


def test_counterfactuals_keep_groups_neutral(learned, monkeypatch):
    docs, labels, model = learned
    rng = random.Random(11)
    neutral = [text(rng, [g]) for g in ("muslims", "jews", "christians", "frauen", "inmigrantes")]
    assert max(map(model.predict, neutral)) < 0.5
    change = lambda m: np.mean([abs(m.worst(t) - m.worst(t.replace("muslims", "catholics"))) for t in (text(random.Random(i), ["muslims"], 12) for i in range(20))])
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    assert change(model) < 0.3 * change(toxicity.train(docs, labels))


def test_the_same_again(spark, learned):
    docs, labels, model = learned
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.weights, again.weights) and (model.slope, model.shift) == (again.slope, again.shift)


def brute_sentences(t):
    """Subwords of each sentence as strings, by plain loops."""
    out, words = [], []
    for token in re.findall(r"\w+|[.!?\n…。！？।]", re.sub(r"_", " ", t.lower())) + ["."]:
        if all(unicodedata.category(c)[0] in "LMN" for c in token):
            words.append(token)
        if words and (len(words) == toxicity.SENTENCE_WORDS or not any(unicodedata.category(c)[0] in "LMN" for c in token)):
            out.append([f" {w} "[i : i + n] for w in dict.fromkeys(words) for n in toxicity.GRAMS for i in range(len(w) + 3 - n)])
            words = []
    return out


@pytest.mark.parametrize("t", ["", "...", "One two two. Three!\nfour", "a_b 3x Größe élan", " ".join(f"w{i % 45}" for i in range(100)), "x" * 50, "ÀB\n\n\ncd e", "çà ve. " * 40])
def test_sentences_against_brute_force(t):
    s = toxicity.sentences(t)
    want = brute_sentences(t)
    assert len(s.starts) == len(want)
    for i, own in enumerate(want):
        assert len(own) == (s.at == i).sum()
        alone = toxicity.sentences(" ".join(dict.fromkeys(re.findall(r"[^\W_]+", s.sentence(i)))))
        assert sorted(alone.grams) == sorted(s.grams[s.at == i])


def test_long_texts_are_whole(learned, monkeypatch):
    model, rng = learned[2], random.Random(2)
    long = text(rng, words=3000) + " " + INSULTS[0]
    whole = model.predict(long)
    monkeypatch.setattr(toxicity, "BLOCK", 500)
    assert "".join(toxicity.blocks(long)) == long and "".join(toxicity.blocks("y" * 1800)) == "y" * 1800
    assert whole > 0.5 and model.predict(long) > 0.5


def test_odd_rows(spark, learned):
    rows = [(1, None), (2, ""), (3, "?! 。"), (None, "the zgrakh"), (None, "the zgrakh"), (5, "é" * 100000)]
    docs = spark.createDataFrame([(i, t, 7.0, "w") for i, t in rows], "doc_id long, text string, score double, worst string")
    got = toxicity.score(docs, learned[2]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.worst == "w" for r in got)
    assert [r.predicted for r in got] == [0, 0, 0, 1, 1, 0] and got[0].score == got[1].score == got[2].score


def test_labels_that_do_not_count(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e"), (4, None), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (3, 5), (None, 1), (4, 0), (9, 0)], "doc_id long, toxic int")
    assert sorted((r.text or "", r.toxic) for r in toxicity.learnable(docs, labels).collect()) == [("", 0), ("a", 1), ("b", 1)]
    one = toxicity.train(docs, labels.where("toxic = 1"))
    assert one.predict("a") == one.predict(None) == 1.0
    none = toxicity.train(docs, labels.limit(0))
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0] * 7


def test_bound_on_what_is_learned_from(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert 300 < toxicity.learnable(docs, labels, per_class=200).count() < 500


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = queries.op11_toxicity(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
