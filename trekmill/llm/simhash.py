"""SimHash near-duplicate detection by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType

from trekmill.llm.common import LOWER, cut, freed_shuffles, small_batches, splittable, words_of
from trekmill.llm.graph import components
from trekmill.llm.hashing import chunks, doubled, joined_words, mixed
from trekmill.operators.lineage import written

SEED = 42
BITS = 64
#: Rows of shingle hashes whose bits are counted at once.
BLOCK = 1 << 15
#: Blocks of 32 bits of the SimHash that finds similar texts (an even number).
BLOCKS = 6
#: Texts, about, from which the commonest shingles are learned, and how many of these are put last. Both bear on speed alone.
LEARNED_TEXTS, COMMON_SHINGLES = 5_000, 20_000
#: Shingles that similar texts are asked to share among their first ones (fewer where texts are short); it bears on speed alone.
SHARED = 8


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint as a signed integer: a bit is set if set in over half of the shingles' XXH64.

    Null, empty or blank text: 0. Fewer words than a shingle: the whole sequence is the one shingle.
    """
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(BITS, np.int64), len(words) - size + 1
    starts, ends = starts[:total].tolist(), ends[size - 1 :].tolist()
    for at in range(0, total, BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


@pandas_udf(LongType())
def _fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([simhash(t) for t in batch], dtype="int64")


def _ball(radius: int) -> list[int]:
    """XOR masks of all words with at most radius bits set, as signed integers."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << i) for m in masks for i in range(BITS)}
    return sorted(int(np.uint64(m).astype(np.int64)) for m in masks)


def near_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(hi, lo): links that connect all fingerprints within max_bits of each other.

    prints: distinct non-null `fp` (long). Two fingerprints that differ in at most max_bits bits have a word
    halfway that both reach in at most half as many (rounded up); every fingerprint therefore emits its ball
    of that radius, and those that share a variant meet. A variant is met by at most the size of a ball of
    distinct fingerprints (65 for two bits), however many documents have them, so no group is large. In each
    group the links to its least member are kept if verified; for even max_bits all members of a group are
    within max_bits of each other, so these links connect all that pairs would. For odd max_bits a ball of
    the larger half is emitted and all pairs of the bounded group are verified.
    """
    half = (max_bits + 1) // 2
    masks = F.from_json(F.lit(str(_ball(half))), "array<bigint>")
    met = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    if max_bits % 2 == 0:
        pairs = met.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("lo")).where("fp <> lo").select(F.col("fp").alias("hi"), "lo")
    else:
        other = met.select(F.col("fp").alias("lo"), "variant")
        pairs = met.join(other, "variant").where("fp > lo").select(F.col("fp").alias("hi"), "lo")
    return pairs.where(F.bit_count(F.col("hi").bitwiseXOR(F.col("lo"))) <= max_bits).distinct()


def near_duplicates(docs: DataFrame, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; links are fingerprints within max_bits.

    component_id is the least id reachable over links. Null text is as empty: fingerprint 0, linked like any
    other. Rows with a null id get the component of their fingerprint (null if no row there has an id).
    Repeated rows are kept. An empty table gives an empty result; other columns are ignored.
    Copies share a fingerprint, so they cost one row in all that follows the first grouping.
    """
    small_batches(docs)
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), _fingerprint(F.col(text_col)).alias("fp")))
    firsts = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(firsts.select("fp"), max_bits))
    placed = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = placed.join(splittable(lowest), "root").select("fp", "component_id")
    return prints.join(splittable(of_print), "fp").select("doc_id", "fp", "component_id")


def blocks_of(texts: list[str | None]) -> np.ndarray:
    """BLOCKS rows of 32 bits of SimHash over each text's pairs of neighbouring words (A-Z in lower case); one word: itself.

    Pairs rather than shingles of five words, as an edited word then costs two features and not five: texts with a shingle
    similarity of 0.8 differ in one bit of ten or fewer.
    """
    words, text, _ = joined_words([(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts])
    sizes = np.bincount(text, minlength=len(texts))
    pair = np.flatnonzero(text[:-1] == text[1:]) if len(words) else words
    alone = np.flatnonzero(sizes[text] == 1) if len(words) else words
    of, h = np.concatenate((text[pair], text[alone])), np.concatenate((mixed(words[pair], words[pair + 1]), words[alone]))
    order = np.argsort(of, kind="stable")
    of, h = of[order], h[order]
    ones = np.zeros((len(texts), BLOCKS * 32), np.int64)
    for at in range(0, len(h), BLOCK):
        some = h[at : at + BLOCK]
        wide = np.stack([mixed(some, np.full(len(some), k, np.uint64)) for k in range(BLOCKS // 2)], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")
        groups, first = np.unique(of[at : at + BLOCK], return_index=True)
        ones[groups] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    total = np.bincount(of, minlength=len(texts))
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view("<u4")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; fewer words: the whole sequence; none: empty."""
    words = joined_words([(text or "").encode("utf-8", "surrogatepass").translate(LOWER)])[0]
    return np.unique(doubled(words, 1, min(shingle, len(words)))) if len(words) else words


def _similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two packed sets; of two empty ones 1."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


@pandas_udf(ArrayType(LongType()))
def _blocks(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        some = batch.tolist()
        yield pd.Series([row for a, b in chunks(some) for row in blocks_of(some[a:b]).astype(np.int64)], dtype=object)


@pandas_udf(DoubleType())
def _similarities(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _candidates(texts: DataFrame) -> DataFrame:
    """(hi, lo): pairs of ids that may be alike, from (id, blocks).

    Texts that have a block in common are paired with the least of them. Each distinct block then emits all words within one bit,
    and the least texts of blocks that meet on a variant, which so are within two bits, are paired with the least of those. A
    variant is met by 33 distinct blocks at most, so no group is large, however many texts share a block.
    """
    of_block = texts.select("id", F.posexplode("blocks").alias("k", "block")).select("id", (F.col("k").cast("long") * (1 << 32) + F.col("block")).alias("block"))
    least = cut(of_block.groupBy("block").agg(F.min("id").alias("lo"), F.count("*").alias("n")))
    same = of_block.join(splittable(least.where("n > 1").select("block", "lo")), "block").where("id > lo").select(F.col("id").alias("hi"), "lo")
    masks = F.from_json(F.lit(str([0] + [1 << k for k in range(32)])), "array<bigint>")
    met = least.select(F.col("lo").alias("hi"), F.explode(F.transform(masks, lambda m: F.col("block").bitwiseXOR(m))).alias("variant"))
    near = met.select("hi", F.min("hi").over(Window.partitionBy("variant")).alias("lo")).where("hi > lo")
    return same.unionByName(near).distinct()


def _commonest(docs: DataFrame, shingle: int) -> np.ndarray:
    """Rising hashes of the commonest shingles of some texts."""

    @pandas_udf(ArrayType(LongType()))
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts], dtype=object)

    share = min(1.0, LEARNED_TEXTS / max(docs.count(), 1))
    some = docs.where(F.shiftrightunsigned(F.xxhash64("text"), 1).cast("double") <= share * 2.0**63).select("text").distinct()
    counts = some.select(F.explode(shingles("text")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    return np.sort(counts.orderBy(F.desc("n"), "w").limit(COMMON_SHINGLES).toArrow()["w"].to_numpy().view(np.uint64))


def _needed(n: Column, least: Fraction) -> Column:
    """Shingles that a text with n of them shares with any that is similar."""
    return F.floor((n * least.numerator + least.denominator - 1) / least.denominator).cast("int")


def _leads(docs: DataFrame, keys: DataFrame, place: list[str], shingle: int, least: Fraction) -> DataFrame:
    """(id, n, lead): of each text how many shingles it has, and the first of them, common ones last.

    Texts with n and m shingles that are similar share `_needed` of either, so l of the first n - needed + l of each. Leads are
    taken where the texts are read, so that no text is shuffled for them. A filter on them would take them once more.
    """
    common = docs.sparkSession.sparkContext.broadcast(_commonest(docs, shingle))

    @pandas_udf("n int, lead array<long>")
    def leads(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                s = shingle_set(text, shingle)
                need = -(-len(s) * least.numerator // least.denominator)
                late = common.value[np.searchsorted(common.value[:-1], s)] == s if len(common.value) else np.zeros(len(s), bool)
                first = np.concatenate((s[~late], s[late]))[: len(s) - need + min(need, SHARED)]
                out.append((len(s), first.view(np.int64)))
            yield pd.DataFrame(out, columns=["n", "lead"])

    first = docs.select(*place, leads("text").alias("of")).groupBy(*place).agg(F.first("of").alias("of"))
    return written(first.join(splittable(keys), place).select("id", "of.*"))


def _pairs_left(leads: DataFrame, roots: DataFrame, least: Fraction) -> DataFrame:
    """(hi, lo): all pairs of ids that may be alike and have no root in common yet; no pair that is alike is left out.

    Pairs of different roots meet by a shingle of their leads, and one of the two at least hasn't the least root that the shingle
    is met by. Shingles that texts of one root alone have, as most of a group's have, form no pair.
    """
    of_root = leads.join(splittable(roots.select(F.col("node").alias("id"), "root")), "id", "left")
    of_root = of_root.select("id", "n", F.coalesce("root", "id").alias("root"), F.explode("lead").alias("w"))
    met = of_root.groupBy("w").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("w", "least")
    met = written(of_root.join(splittable(met), "w"))
    x = met.where("root > least").select("w", F.col("id").alias("a"), F.col("n").alias("an"), F.col("root").alias("ar"))
    y = splittable(met.select("w", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("root").alias("br"), (F.col("root") == F.col("least")).alias("first")))
    sizes = (F.col("an") * least.denominator >= F.col("bn") * least.numerator) & (F.col("bn") * least.denominator >= F.col("an") * least.numerator)
    found = x.join(y, "w").where("ar <> br and (first or a > b)").where(sizes)
    found = found.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"), F.least(_needed(F.least("an", "bn"), least), F.lit(SHARED)).alias("l"))
    return found.groupBy("hi", "lo", "l").agg(F.count("*").alias("c")).where("c >= l").select("hi", "lo")


def deduplicate(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies: the one of the least doc_id, of those that share it the least text hash.

    Near copies are texts whose sets of word shingles (A-Z in lower case; fewer words: the whole sequence) have a Jaccard
    similarity of `similarity` or more, and what they are linked with. Candidates meet by ball hashing on the blocks of a
    SimHash of 192 bits, and each pair is verified on the shingles. What these don't connect meets by its first shingles, which
    leaves no link out, and is verified likewise. Texts without a word are alike. Rows without a doc_id come last; of rows that repeat both doc_id and text one stays. Documents are told
    apart by doc_id and text. All columns stay; an empty table stays empty.
    """
    small_batches(docs)
    place = {"_no_id": F.col("doc_id").isNull(), "_doc": F.coalesce("doc_id", F.lit(0)).cast("long"), "_hash": F.xxhash64("text")}
    keyed = docs.select(*(e.alias(c) for c, e in place.items()), "text")
    rows = keyed.select(*place, _blocks("text").alias("blocks"))
    texts = rows.groupBy("_hash").agg(F.min(F.struct("_no_id", "_doc")).alias("first"), F.first("blocks").alias("blocks"))
    texts = texts.select("first.*", "_hash", "blocks").orderBy(*place)
    with freed_shuffles(docs.sparkSession):
        texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))  # in order of place
    keys = texts.drop("blocks")

    @pandas_udf(BinaryType())
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t, shingle).tobytes() for t in batch], dtype=object)

    def alike(pairs: DataFrame) -> DataFrame:
        asked = keys.join(splittable(pairs.select(F.explode(F.array("hi", "lo")).alias("id")).distinct()), "id")
        packed = keyed.join(splittable(asked), list(place)).select("id", sets("text").alias("set")).groupBy("id").agg(F.first("set").alias("set"))
        hi, lo = (splittable(packed).select(F.col("id").alias(c), F.col("set").alias(f"{c}_set")) for c in ("hi", "lo"))
        return cut(pairs.join(hi, "hi").join(lo, "lo").where(_similarities("hi_set", "lo_set") >= similarity).select("hi", "lo"))

    least = Fraction(str(similarity))
    with freed_shuffles(docs.sparkSession):
        links = alike(cut(_candidates(texts.select("id", "blocks"))))
        others = components(links)
        more = alike(cut(_pairs_left(_leads(keyed, keys, list(place), shingle, least), others, least)))
        if not more.isEmpty():
            others = components(links.unionByName(more))
    kept = keys.join(splittable(others.select(F.col("node").alias("id"))), "id", "left_anti").select(*place)
    return docs.withColumns(place).join(splittable(kept), list(place), "left_semi").dropDuplicates(list(place)).select(docs.columns)
