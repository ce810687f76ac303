"""The query of each operator over the whole `documents` table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trekmill.llm import bpe, crosstok, ctph, langid, licenses, lines, mixing, ngram, quality, secrets, simhash, toxicity, whitening
from trekmill.llm.common import cut, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    rated = quality.rate(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", "nearest")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids, and digest of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    docs = cut(mixing.sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "tie"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next one's, and their likeness."""
    return ctph.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _part(by: int, at: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder `at`; so, too, for rows without doc_id, which nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % by == at, F.lit(True))


def op6_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of six documents of seven."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _part(7, 2))
    model = ngram.train(docs.where("not held_out").select("text"))
    return ngram.score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from labelled documents of two parts of three."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", _part(3, 1))
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("found")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of 50 words or more that also stand at an earlier place."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed", "text")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled documents of four parts of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _part(5, 0))
    model = toxicity.train(docs.where("not held_out"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op12_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of every document between two tokenizers, and the links' support in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = crosstok.aligned_support(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened coordinates of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_quality, op3_bpe, op4_mixing, op5_ctph, op6_ngram, op7_licenses, op8_langid, op9_secrets, op10_line_dedup, op11_toxicity, op12_crosstok, op13_whitening)}


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Every window of 50 words written out; a word goes if it is in one that also stands at an earlier place.
_LINE_DEDUP = rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[ \t\n\v\f\r]*[^ \t\n\v\f\r]+') AS p FROM documents),
w AS (SELECT doc_id, list_transform(p, lambda x: ltrim(x, {_WHITE})) AS words FROM t WHERE len(p) >= 50),
l AS (SELECT doc_id, list_transform(range(1, len(words) - 48), lambda i: array_to_string(list_slice(words, i, i + 49), ' ')) AS k FROM w),
g AS (SELECT doc_id, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM l), f AS (SELECT k, min((doc_id, i)) AS f FROM g GROUP BY k HAVING count(*) > 1),
o AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM g JOIN f USING (k) WHERE (doc_id, i) <> f), d AS (SELECT doc_id, list(j) AS js FROM o GROUP BY doc_id),
c AS (SELECT t.*, js, list_filter(p, lambda x, i: NOT list_contains(js, i)) AS kept FROM t LEFT JOIN d USING (doc_id))
SELECT doc_id, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, CASE WHEN js IS NULL THEN text WHEN len(js) = len(p) THEN ''
ELSE regexp_extract(p[1], '^[ \t\n\v\f\r]*') || ltrim(array_to_string(kept, ''), {_WHITE}) || substr(text, length(rtrim(text, {_WHITE})) + 1) END AS text FROM c"""


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": _LINE_DEDUP}
