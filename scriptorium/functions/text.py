"""Cleaning, hashing and naming of texts, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that are site navigation.
NAVIGATION = ("Search", "Sign In", "Register", "Menu", "Explore", "Media", "Seasons", "Targets", "Community", "Skip to content")
#: Marks that are noise when they are a whole line, and those that OCR adds.
MARKS, OCR_MARKS = ("|", "-", "_"), ("|", "-", "_", ".", ",")
#: Running titles of statute pages, matched without case.
PAGE_HEADERS = (r"^\d+$", r"^Constitution of Kenya$", r"^\[Rev\. \d{4}\]$", r"^The Constitution of Kenya$")
RUNNING = (r"\s*Constitution of Kenya\s*", r"\s*\[Rev\. \d{4}\]\s*")
#: Lines of a statute that stay as they are, and page numbers.
CHAPTER_LINE, PART_LINE, ROMAN = r"(?i)^CHAPTER\s+", r"(?i)^PART\s+\d+\s*[–-]", r"^[IVXLCDM]+$"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, in which ``value`` is computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends.

    ``btrim`` takes the usual kinds from the ends alone; the pattern, which
    looks at every character, is for texts that have others there.
    """

    def rest(x: Column) -> Column:
        other = F.left(x, F.lit(1)).rlike(r"(?U)^\s") | F.right(x, F.lit(1)).rlike(r"(?U)^\s")
        return F.when(other, F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)

    return once(F.btrim(c, F.lit(" \t\n\x0b\f\r")), rest)


def _any(c: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def is_navigation(line: Column) -> Column:
    return line.isin(*NAVIGATION) | F.lower(F.replace(line, F.lit(" "), F.lit(""))).isin(*[w.replace(" ", "").lower() for w in NAVIGATION])


def is_mark(line: Column, marks: tuple[str, ...] = MARKS) -> Column:
    return (F.length(line) <= 2) & (line.rlike(r"^\d+$") | line.isin(*marks))


def is_mostly_symbols(line: Column) -> Column:
    """Under half of the characters are letters, digits or white space."""
    return F.length(F.regexp_replace(line, r"[^\p{L}\p{N}\s]", "")) * 2 < F.length(line)


def _tidied(lines: Column) -> Column:
    return strip(F.regexp_replace(F.array_join(lines, "\n"), " +", " "))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def clean_web(text: Column) -> Column:
    """Lines stripped; blank, navigation and one- or two-character noise lines dropped; spaces collapsed."""
    return _tidied(F.filter(_lines(text), lambda x: ~is_navigation(x) & ~is_mark(x)))


def clean_ocr(text: Column) -> Column:
    """As ``clean_web``, and without lines of mostly symbols, runs of pipes and long underscores."""
    kept = F.filter(_lines(text), lambda x: ~is_navigation(x) & ~is_mark(x, OCR_MARKS) & ~is_mostly_symbols(x))
    joined = F.regexp_replace(F.array_join(kept, "\n"), " +", " ")
    return strip(F.regexp_replace(F.regexp_replace(joined, r"\|{2,}", ""), "_{3,}", ""))


def clean_statute(text: Column) -> Column:
    """Without running titles, page numbers and roman numerals; chapter and part lines stay as they are."""

    def one(x: Column) -> Column:
        inside = F.regexp_replace(x, r"^\d+\s+", "")
        for p in RUNNING:
            inside = F.regexp_replace(inside, f"(?i){p}", " ")
        inside = strip(F.regexp_replace(inside, r"(?U)\s+", " "))
        noise = (x.rlike(ROMAN) & (F.length(x) <= 10)) | is_mark(x, OCR_MARKS) | is_mostly_symbols(x)
        dropped = is_navigation(x) | _any(x, [f"(?i){p}" for p in PAGE_HEADERS])
        return F.when(dropped, "").when(x.rlike(CHAPTER_LINE) | x.rlike(PART_LINE), x).when(noise, "").otherwise(inside)

    return _tidied(F.filter(F.transform(_lines(text), one), lambda x: x != ""))


def cleaned_or_raw(clean: Column, raw: Column) -> Column:
    """The raw text where cleaning has left nothing."""
    return F.when(strip(clean) == "", raw).otherwise(clean)


def percent_removed(clean: Column, raw: Column) -> Column:
    return F.when(F.length(raw) > 0, (F.length(raw) - F.length(clean)) * 100.0 / F.length(raw)).otherwise(0.0)


def text_hash(text: Column) -> Column:
    """SHA-256 in hex; an empty text has an empty hash."""
    return F.when(text != "", F.sha2(text.cast("binary"), 256)).otherwise("")


def chunk_id(source: Column, number: Column, index: Column, text: Column) -> Column:
    """An id that the content decides."""
    return F.concat(F.lit("const_"), source, F.lit("_art"), number.cast("string"), F.lit("_chunk"), index.cast("string"), F.lit("_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 8))


def safe_id(name: Column, component: Column, text: Column) -> Column:
    """At most 50 safe characters of a name, the component, and a content hash in place of a clock."""
    return F.concat_ws("_", F.substring(F.regexp_replace(name, "[^A-Za-z0-9_-]", "_"), 1, 50), component, F.substring(text_hash(text), 1, 8))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def sentences(text: Column, legacy: bool = False) -> Column:
    """Sentences of a text. ``legacy`` keeps a full stop between a word and a capital unsplit, as older indexes did."""
    dotted = F.regexp_replace(text, r"\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|Inc|Ltd|Co)\.", "$1\u0001")
    if legacy:
        dotted = F.regexp_replace(dotted, r"(\w)\.(?=\s+[A-Z])", "$1\u0001")
    parts = F.split(dotted, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda x: strip(F.translate(x, "\u0001", "."))), lambda x: x != "")


