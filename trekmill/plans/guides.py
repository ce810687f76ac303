"""Guide texts and pages: markup, chunks, links, packing, and question-and-answer rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekmill.functions import markup, text
from trekmill.operators import matching, relational
from trekmill.plans.base import plan, table


@plan("s8_paragraph_packing")
def paragraph_packing(spark, d):
    """Of each document the paragraphs that fit 600 characters, those with the asked stems first."""
    asked = F.array(*(F.lit(w) for w in ("the", "und", "les", "que")))
    return table(spark, d, "documents").select("doc_id", text.relevant_paragraphs(F.col("text"), asked, F.lit(600)).alias("text"))


@plan("s9_chunks", "SELECT doc_id, trim(line) AS chunk FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''")
def chunks(spark, d):
    """Paragraphs as chunks of one character or more: here each by itself."""
    return table(spark, d, "documents").select("doc_id", F.explode(text.paragraphs(F.col("text"), 1)).alias("chunk"))


@plan("s10_wiki_text", "SELECT p_partkey, '▸ ' || p_brand || chr(10) || 'The ' || p_name || ' of size ' || p_size || chr(10) || '▸ none' || chr(10) || '• ' || p_type AS text FROM part")
def wiki_texts(spark, d):
    """Wiki markup made of parts' names, to plain text."""
    source = F.format_string("== %s ==\n{{box|a={{b}}}}The [[page %d|%s]] of '''size''' %d<ref>note</ref>\n=== empty ===\n=== none ===\n* %s<!-- gone -->\n== last ==\n", "p_brand", "p_partkey", "p_name", "p_size", "p_type")
    return table(spark, d, "part").select("p_partkey", markup.wiki_to_text(source).alias("text"))


@plan("s11_html_text")
def html_texts(spark, d):
    return markup.paged(table(spark, d, "pages")).select("page_id", markup.html_to_text("html").alias("text"))


@plan("s12_heading_categories", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'safety' WHEN '2-HIGH' THEN 'health' WHEN '3-MEDIUM' THEN 'transport' END AS category FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def heading_categories(spark, d):
    """Headings to categories by a fixed map; unmapped ones go."""
    pairs = {"1-URGENT": "safety", "2-HIGH": "health", "3-MEDIUM": "transport"}
    names = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return table(spark, d, "orders").select("o_orderkey", F.try_element_at(names, F.col("o_orderpriority")).alias("category")).where("category is not null")


@plan("s13_dangling_intro", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || chr(10) || 'See: this' ELSE p_name END AS text FROM part")
def dangling_intro(spark, d):
    source = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("\nSee: this"))).otherwise(F.concat("p_name", F.lit("\nAmong the sights are:")))
    return table(spark, d, "part").select("p_partkey", text.without_dangling_intro(source).alias("text"))


@plan("s14_page_addresses", "SELECT p_partkey, replace(p_name, ' ', '_') || '_(caf%C3%A9)/' || p_size AS path FROM part")
def page_addresses(spark, d):
    return table(spark, d, "part").select("p_partkey", text.url_path(F.format_string("%s (café)/%d", "p_name", "p_size")).alias("path"))


@plan("s15_opening_hours", "SELECT p_partkey, 'Mo-Fr ' || lpad(CAST(p_size % 12 AS VARCHAR), 2, '0') || ':00-18:00; Sa 10:00-14:00; Su closed' AS hours FROM part")
def opening_hours(spark, d):
    source = F.format_string("Mo-Fr %02d:00-18:00; Sa 10:00-14:00; Su off", F.col("p_size") % 12)
    return table(spark, d, "part").select("p_partkey", markup.opening_text(source).alias("hours"))


_LONG = "list_distinct(list_filter(string_split(trim(regexp_replace(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 5))"


@plan("s20_context_share", f"""WITH w AS (SELECT conv_id, turn, role, {_LONG.format('text')} AS w FROM conversations), a AS (SELECT conv_id, turn, w FROM w WHERE role = 'assistant' AND len(w) > 0)
SELECT a.conv_id, a.turn, CAST(round(len(list_intersect(a.w, b.w)) / len(a.w) * 10000) AS BIGINT) AS share FROM a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def context_share(spark, d):
    """Share of an answer's longer words that the question before it has."""
    c = table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    both = c.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    share = text.share_in_context(F.col("text"), F.col("context"))
    return both.select("conv_id", "turn", F.round(share * 10_000).cast("long").alias("share")).where("share is not null")


@plan("s22_mentions", "WITH k AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS t FROM conversations) SELECT conv_id, turn FROM k WHERE contains(t, ' the ') OR contains(t, ' de la ')")
def named_mentions(spark, d):
    """Turns in which the words of a name stand one after the other."""
    t = F.col("text")
    return table(spark, d, "conversations").where(text.mentions(t, F.lit("The")) | text.mentions(t, F.lit("De La"))).select("conv_id", "turn")


_TERMS = "string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"


@plan("s23_intents", f"WITH w AS (SELECT conv_id, turn, {_TERMS} AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN len(list_filter(w, lambda x: starts_with(x, 'th') OR starts_with(x, 'no'))) > 0 THEN 'articles' END, CASE WHEN len(list_filter(w, lambda x: starts_with(x, 'des'))) > 0 THEN 'places' END], lambda x: x IS NOT NULL), ',') AS intents FROM w")
def intents(spark, d):
    """Groups of words that a question touches by prefix."""
    found = text.intent(F.col("text"), {"articles": ["th", "no"], "places": ["des"]})
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("intents"))


@plan("s24_composed", "SELECT p_partkey, p_name || ' é' AS name FROM part")
def composed(spark, d):
    """Names with letters and marks composed."""
    return table(spark, d, "part").select("p_partkey", markup.composed(F.concat("p_name", F.lit(" é"))).alias("name"))


@plan("x6_mojibake", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'café ' ELSE 'cafe ' END || p_name AS name FROM part")
def mojibake(spark, d):
    broken = F.when(F.col("p_partkey") % 2 == 0, "cafÃ© ").otherwise("cafe ")
    return table(spark, d, "part").select("p_partkey", text.repair_mojibake(F.concat(broken, "p_name")).alias("name"))


@plan("x14_term_links")
def term_links(spark, d):
    """Longest terms first, without overlap, each once in a section."""
    body = F.regexp_replace("html", "<[^>]*>", " ")
    return matching.term_links(table(spark, d, "pages").select(F.col("page_id").alias("section_id"), body.alias("body")), ["the", "tion", "die", "und", "les", "que", "nicht", "der", "in the"])


@plan("x26_phrase_pairs", "SELECT p_partkey, p_name AS phrase, 'say ' || p_type AS said FROM part UNION ALL SELECT p_partkey, p_brand, 'say no' FROM part")
def phrase_pairs(spark, d):
    """Phrases and how they are said, from lines like "phrase : said"."""
    body = F.format_string("intro\n; %s : say %s\n; %s : say no\nend", "p_name", "p_type", "p_brand")
    found = F.regexp_extract_all(body, F.lit(r"(?m)^; (.+) : (.+)$"), F.lit(1)), F.regexp_extract_all(body, F.lit(r"(?m)^; (.+) : (.+)$"), F.lit(2))
    pairs = F.explode(F.arrays_zip(found[0].alias("phrase"), found[1].alias("said")))
    return table(spark, d, "part").select("p_partkey", pairs.alias("z")).select("p_partkey", "z.phrase", "z.said")


@plan("q23_synthesis", """SELECT doc_id, t AS task, CASE t WHEN 0 THEN 'What is said about ' || source || '?' ELSE 'Which language is document ' || doc_id || ' in?' END AS question, CASE t WHEN 0 THEN 'Document ' || doc_id ELSE lang END AS answer FROM documents, (SELECT unnest([0, 1]) AS t) WHERE (doc_id + t) % 3 > 0 AND lang IS NOT NULL""")
def synthesis(spark, d):
    """Question-and-answer rows from templates, chosen by a rule on ids, the same at every run."""
    docs = table(spark, d, "documents").where("lang is not null").select("doc_id", "source", "lang", F.explode(F.array(F.lit(0), F.lit(1))).alias("task")).where("(doc_id + task) % 3 > 0")
    key = F.col("doc_id").cast("string")
    question = F.when(F.col("task") == 0, F.concat(F.lit("What is said about "), "source", F.lit("?"))).otherwise(F.concat(F.lit("Which language is document "), key, F.lit(" in?")))
    return docs.select("doc_id", "task", question.alias("question"), F.when(F.col("task") == 0, F.concat(F.lit("Document "), key)).otherwise(F.col("lang")).alias("answer"))


@plan("q27_term_collection", f"SELECT w AS term, count(DISTINCT conv_id) AS conversations FROM (SELECT conv_id, unnest({_TERMS}) AS w FROM conversations) WHERE length(w) >= 6 GROUP BY w HAVING count(DISTINCT conv_id) >= 5")
def term_collection(spark, d):
    """Terms that stand in five conversations or more."""
    words = table(spark, d, "conversations").select("conv_id", F.explode(text.terms(F.col("text"))).alias("term")).where(F.length("term") >= 6)
    return words.groupBy("term").agg(F.countDistinct("conv_id").alias("conversations")).where("conversations >= 5")


@plan("q12_first_of_name", "SELECT lower(p_brand) AS brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def first_of_name(spark, d):
    """The first row of each folded name."""
    p = table(spark, d, "part").select(text.fold(F.col("p_brand")).alias("brand"), "p_partkey")
    return relational.first_wins(p, ["brand"], ["p_partkey"])
