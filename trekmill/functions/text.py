"""Text as Column expressions; all stay in generated code but where noted."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _marks() -> tuple[str, str]:
    """Letters with marks up to U+1EFF in lower case, and what is left without the marks."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c and c == c.lower():
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without combining marks."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), *_marks())


def search_key(text: Column) -> Column:
    """Folded, with every run of what is neither letter nor digit as one space."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def terms(text: Column) -> Column:
    """Distinct-preserving array of folded words."""
    return F.filter(F.split(search_key(text), " "), lambda w: w != "")


def stem_prefix(word: Column) -> Column:
    """Prefix that stands for a word in a search: null below four letters, 4 whole, 5 to 7 by five, longer by six."""
    n = F.length(word)
    return F.when(n < 4, None).when(n == 4, word).when(n < 8, F.concat(F.substring(word, 1, 5), F.lit("*"))).otherwise(F.concat(F.substring(word, 1, 6), F.lit("*")))


def house_number(text: Column) -> Column:
    """The number at the start or end of an address query, with a letter if one follows; else empty."""
    last = F.regexp_extract(text, r"\s(\d+\s?[a-zA-Z]?)$", 1)
    return F.when(last != "", last).otherwise(F.regexp_extract(text, r"^(\d+\s?[a-zA-Z]?)\s", 1))


def expand_numbers(text: Column) -> Column:
    """array of the house numbers that "12bis; 14-16" stands for: lists, short ranges, and bis, ter, quater as letters."""
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+", ""), "bis", "b"), "quater", "d"), "ter", "c")
    parts = F.filter(F.split(one, "[;,]"), lambda p: p != "")

    def of(p: Column) -> Column:
        low, high = (F.regexp_extract(p, r"^(\d{1,6})-(\d{1,6})$", i).try_cast("int") for i in (1, 2))
        small = low.isNotNull() & high.isNotNull() & (high > low) & (high - low <= 50)
        return F.when(small, F.transform(F.sequence(low, F.greatest(low, high)), lambda n: n.cast("string"))).otherwise(F.array(p))

    return F.array_distinct(F.flatten(F.transform(parts, of)))


def phone_suffix(text: Column, digits: int = 8) -> Column:
    """The last digits of a phone number, null if there are fewer than seven."""
    bare = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(bare) >= 7, F.right(bare, F.lit(digits)))


def cut_at_sentence(text: Column, limit: int | Column) -> Column:
    """text to limit characters: up to the last sentence end if that is past the half, else to the last space."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.substring(text, F.lit(1), limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= limit, text).when(F.length(sentence) > limit / 2, sentence).when(word != "", word).otherwise(head)


def dark_text_on(color: Column) -> Column:
    """Whether "RRGGBB" is so light (BT.601 luma above 150) that text on it should be dark."""
    part = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("int")
    return part(1) * 299 + part(3) * 587 + part(5) * 114 > 150_000


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 for two empty arrays."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def without_instructions(text: Column) -> Column:
    """text without lines that tell a reader to ignore, forget or override what was said."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~line.rlike(r"(?i)\b(ignore|forget|disregard|override)\b.{0,40}\b(instructions?|rules?|prompt|above|previous)\b")), "\n")


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text, separators of thousands left out."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)), lambda n: F.regexp_replace(n, r"[.,](?=\d{3}\b)", "")))


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; other text stays."""
    again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    suspect = text.rlike("[ÃÂ][\u0080-¿]")
    return F.when(suspect & F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")).isNotNull(), again).otherwise(text)


def in_language(texts: Column, lang: str, fallback: str = "en") -> Column:
    """Of array<struct<lang,text>> the first text in a language, else in the fallback, else null."""
    first = lambda code: F.get(F.filter(texts, lambda t: t.lang == code), F.lit(0)).text
    return F.coalesce(first(lang), first(fallback))


def quake_title(title: Column) -> Column:
    """struct<magnitude, km, bearing, place> of "M 4.5 - 12 km NNE of Town"; null parts if it isn't of this form."""
    pattern = r"^M (\d+(?:\.\d+)?) - (\d+) km ([NESW]{1,3}) of (.+)$"
    part = lambda i: F.nullif(F.regexp_extract(title, pattern, i), F.lit(""))
    return F.struct(part(1).alias("magnitude"), part(2).cast("int").alias("km"), part(3).alias("bearing"), part(4).alias("place"))


def url_path(title: Column) -> Column:
    """A page's title as part of an address: spaces as underscores, the rest percent-encoded but for /, ( and )."""
    out = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, char in (("%2F", "/"), ("%28", "("), ("%29", ")"), ("%2C", ","), ("%3A", ":"), ("+", "%20")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def paragraphs(text: Column, least: int) -> Column:
    """array of chunks: neighbouring paragraphs are joined until a chunk has `least` characters; the rest is the last."""
    parts = F.filter(F.transform(F.split(text, r"\n+"), lambda p: F.trim(p)), lambda p: p != "")  # F.trim itself would take the index as characters to trim
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, p: Column) -> Column:
        grown = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n"), p))
        full = F.length(grown) >= least
        return F.struct(F.when(full, F.concat(s.done, F.array(grown))).otherwise(s.done).alias("done"), F.when(full, F.lit("")).otherwise(grown).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s.done).otherwise(F.concat(s.done, F.array(s["open"]))))


def without_dangling_intro(text: Column) -> Column:
    """text without a last line that ends in a colon and so announces what is no longer there."""
    return F.regexp_replace(text, r"(?:^|\n)[^\n]*:\s*$", "")


def mentions(text: Column, name: Column) -> Column:
    """Whether the words of a name stand one after the other in a text, both folded."""
    return F.contains(F.concat(F.lit(" "), search_key(text), F.lit(" ")), F.concat(F.lit(" "), search_key(name), F.lit(" ")))


def share_in_context(text: Column, context: Column, least: int = 5) -> Column:
    """Share of a text's distinct words of `least` letters or more that its context has; null without such words."""
    long = lambda t: F.array_distinct(F.filter(terms(t), lambda w: F.length(w) >= least))
    own = long(text)
    return F.size(F.array_intersect(own, long(context))) / F.nullif(F.size(own), F.lit(0))


def intent(text: Column, groups: dict[str, list[str]]) -> Column:
    """array of the groups, in order, of which a text has a word that begins with one of the group's prefixes."""
    words = terms(text)
    starts = lambda prefixes: F.exists(words, lambda w: F.array_max(F.array(*(w.startswith(p) for p in prefixes))))
    return F.array_compact(F.array(*(F.when(starts(prefixes), name) for name, prefixes in groups.items())))


def relevant_paragraphs(text: Column, stems: Column, budget: Column) -> Column:
    """The lines of a text that fit a budget: those with most of the stems first, shown in their own order.

    A text that fits is kept whole. stems: an array; a line has a stem if its folded text holds it anywhere. Each line costs its
    length and one; one that doesn't fit is passed over. If none fits, the text is cut at a sentence. Blank lines don't count.
    """
    lines = F.filter(F.split(text, "\r\n|\n|\r"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    hits = lambda p: F.size(F.filter(stems, lambda s: F.contains(p, s)))
    scored = F.transform(lines, lambda p, i: F.struct((-hits(fold(p))).alias("rank"), i.alias("at"), (F.length(p) + 1).alias("cost")))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = s.used + x.cost <= budget
        return F.struct(F.when(fits, s.used + x.cost).otherwise(s.used).alias("used"), F.when(fits, F.concat(s.kept, F.array(x["at"]))).otherwise(s.kept).alias("kept"))

    kept = F.aggregate(F.array_sort(scored), start, step, lambda s: F.array_sort(s.kept))
    packed = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return F.when(F.length(text) <= budget, text).when(F.size(kept) > 0, packed).otherwise(cut_at_sentence(text, budget))
