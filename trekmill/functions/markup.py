"""Markup to text, opening hours and packed integers: what expressions cannot do, on Arrow batches."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType

_SKIPPED = {"script", "style", "nav", "head", "template"}
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "br", "main", "header", "footer"}


class _Text(HTMLParser):
    """Blocks of text: headings marked, list items with a bullet; what is skipped leaves nothing."""

    def __init__(self, closings: Counter[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.now, self.mark = "", ""
        self.closings, self.skipped = closings, Counter()  # end tags to come, and open tags that one of them will close

    def close_line(self, mark: str = "") -> None:
        if text := " ".join(self.now.split()):
            self.lines.append(self.mark + text)
        self.now, self.mark = "", mark

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            if self.skipped[tag] < self.closings[tag]:  # one that nothing closes must not swallow the page
                self.skipped[tag] += 1
        elif re.fullmatch("h[1-6]", tag):
            self.close_line("▸ ")
        elif tag == "li":
            self.close_line("• ")
        elif tag in _BLOCKS:
            self.close_line()

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.closings[tag] -= 1
            self.skipped[tag] = max(0, self.skipped[tag] - 1)
        elif tag in _BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.close_line()

    def handle_data(self, data):
        if not any(self.skipped.values()):
            self.now += data


def html_text(source: str | None) -> str:
    """Text of a page. A heading without anything before the next heading goes."""
    parser = _Text(Counter(t.lower() for t in re.findall("</(" + "|".join(sorted(_SKIPPED)) + r")\b", source or "", re.I)))
    parser.feed(source or "")
    parser.close()
    parser.close_line()
    kept = []
    for i, line in enumerate(parser.lines):
        following = parser.lines[i + 1] if i + 1 < len(parser.lines) else "▸ "
        if not (line.startswith("▸ ") and following.startswith("▸ ")):
            kept.append(line)
    return "\n".join(kept)


def _without_nested(text: str, opening: str, closing: str) -> str:
    """text without what stands between nested markers."""
    out, depth, at = [], 0, 0
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if depth == 0:
            out.append(text[at : m.start()])
        depth = depth + 1 if m.group() == opening else max(0, depth - 1)
        at = m.end()
    return "".join([*out, text[at:] if depth == 0 else ""])


def wiki_text(source: str | None) -> str:
    """Plain text of wiki markup: comments, references, templates, tables and media go, links leave their label."""
    t = re.sub(r"<!--.*?-->", "", source or "", flags=re.S)
    t = re.sub(r"<(ref|gallery|nowiki)\b[^>]*?(/>|>.*?</\1>)", "", t, flags=re.S | re.I)
    t = _without_nested(_without_nested(t, "{|", "|}"), "{{", "}}")
    t = re.sub(r"\[\[(?:File|Image|Category|Datei|Fichier)\s*:(?:[^\[\]]|\[\[[^\]]*\]\])*\]\]", "", t, flags=re.I)
    t = re.sub(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://\S+(?:\s+([^\]]*))?\]", lambda m: m[1] or "", t)
    t = re.sub(r"'{2,}|<[^>]+>", "", html.unescape(t))
    t = re.sub(r"^[*#:;]+\s*", "• ", t, flags=re.M)
    t = re.sub(r"^={2,6}\s*(.*?)\s*={2,6}\s*$", r"▸ \1", t, flags=re.M)
    lines = [" ".join(x.split()) for x in t.split("\n")]
    lines = [x for x in lines if x and x != "•"]
    return "\n".join(x for x, after in zip(lines, [*lines[1:], "▸"], strict=True) if not (x.startswith("▸") and after.startswith("▸")))


_DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")


def opening_days(source: str | None) -> list[str]:
    """Seven texts of hours, Monday first ("" for closed), of "Mo-Fr 09:00-18:00; Sa 10:00-14:00; Su off"; [] if not understood."""
    if not source:
        return []
    week = [""] * 7
    for rule in source.split(";"):
        rule = rule.strip()
        if rule == "24/7":
            week = ["00:00-24:00"] * 7
            continue
        m = re.fullmatch(r"(?:((?:Mo|Tu|We|Th|Fr|Sa|Su)(?:[-,](?:Mo|Tu|We|Th|Fr|Sa|Su))*)\s+)?(off|closed|\d\d:\d\d-\d\d:\d\d(?:\s*,\s*\d\d:\d\d-\d\d:\d\d)*)", rule)
        if not m:
            return []
        hours = "" if m[2] in ("off", "closed") else re.sub(r"\s", "", m[2])
        for part in (m[1] or "Mo-Su").split(","):
            first, _, last = part.partition("-")
            a, b = _DAYS.index(first), _DAYS.index(last or first)
            for d in range(a, b + 1) if a <= b else [*range(a, 7), *range(b + 1)]:
                week[d] = hours
    return week


def opening_ranges(source: str | None) -> str:
    """Days with equal hours in a row as one range, lines joined by "; "."""
    week, out = opening_days(source), []
    at = 0
    while at < len(week):
        end = at
        while end + 1 < 7 and week[end + 1] == week[at]:
            end += 1
        days = _DAYS[at] if at == end else f"{_DAYS[at]}-{_DAYS[end]}"
        out.append(f"{days} {week[at] or 'closed'}")
        at = end + 1
    return "; ".join(out)


def pack_deltas(values: list[int]) -> bytes:
    """Whole numbers as zigzag differences in base 128."""
    out, before = bytearray(), 0
    for v in values:
        d, before = v - before, v
        z = d * 2 if d >= 0 else -d * 2 - 1
        while z > 127:
            out.append(z & 127 | 128)
            z >>= 7
        out.append(z)
    return bytes(out)


def unpack_deltas(data: bytes) -> list[int]:
    out, run, z, shift = [], 0, 0, 0
    for b in data:
        z |= (b & 127) << shift
        shift += 7
        if b < 128:
            run += z >> 1 if z & 1 == 0 else -(z + 1 >> 1)
            out.append(run)
            z = shift = 0
    return out


#: Rows and bytes that Python gets at once of texts as long as pages: Spark's own 10,000 rows take some hundred megabytes a worker.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def paged(df: DataFrame) -> DataFrame:
    """df, whose long texts Spark hands to Python in small batches in this session; smaller settings of the user's stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}", None) or "0"
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def _text_udf(f):
    @pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(f, na_action=None)

    return run


html_to_text, wiki_to_text, opening_text = _text_udf(html_text), _text_udf(wiki_text), _text_udf(opening_ranges)
#: Letters and marks composed; null stays null.
composed = _text_udf(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@pandas_udf(BinaryType())
def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function of pack_deltas over arrays of whole numbers."""
    for batch in batches:
        yield batch.map(lambda v: None if v is None else pack_deltas(v.tolist()))


@pandas_udf(ArrayType(LongType()))
def unpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column function of unpack_deltas."""
    for batch in batches:
        yield batch.map(lambda v: None if v is None else unpack_deltas(v))
