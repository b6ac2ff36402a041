"""Semi-structured text to columns: key-value blocks, numbered sections, JSON replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import once, strip
from scriptorium.schemas import CASE_FIELDS, CLASSIFICATION, EXTRACTED_ARTICLE

#: Names under which a case's fields come, besides their own.
ALIASES = {
    "file_name": ("file_name", "filename", "case_name", "case_title"),
    "parties": ("parties",),
    "court_level": ("court_level", "court", "courtlevel"),
    "judge": ("judge", "judges", "judge(s)"),
    "year": ("year",),
    "legal_domain": ("legal_domain", "domain", "legaldomain", "area_of_law"),
    "winning_party": ("winning_party", "winner", "winningparty", "prevailing_party"),
}
#: The sections of an extraction reply, in order.
SECTIONS = ("metadata", "facts", "issues", "rules", "application", "conclusion")
#: A line that gives a field, and the header of any section, a run of marks taken from its first one.
PAIR = r"^([^:]+)[:\-]\s*(.+)$"
HEADER = r"[#Ss](?i)(?:(?<=S)ECTION|(?<=#)(?<!##)#*+\s*+SECTION)\s*+(?:" + "|".join(rf"{i}\s*+[:\-]\s*+{name.upper()}" for i, name in enumerate(SECTIONS)) + ")"


def case_fields(block: Column) -> Column:
    """A struct of the seven case fields; the last line that gives a field wins, and '' stands for none.

    Lines are matched for their keys once; values are taken of the lines that win.
    """
    known = [name for names in ALIASES.values() for name in names]
    lines = F.transform(F.split(F.coalesce(block, F.lit("")), "\n"), strip)
    keyed = F.transform(lines, lambda x: F.struct(F.replace(F.lower(strip(F.regexp_extract(x, PAIR, 1))), F.lit(" "), F.lit("_")).alias("k"), x.alias("line")))
    pick = lambda given, names: F.coalesce(strip(F.regexp_extract(F.try_element_at(F.filter(given, lambda p: p["k"].isin(*names)), F.lit(-1))["line"], PAIR, 2)), F.lit(""))
    return once(F.filter(keyed, lambda p: p["k"].isin(*known)), lambda given: F.struct(*[pick(given, ALIASES[f]).alias(f) for f in CASE_FIELDS]))


def _parts(reply: Column) -> Column:
    """A reply cut at its headers: number, header, and the text up to the next one; the first part has no header."""
    heads = F.concat(F.array(F.lit("")), F.regexp_extract_all(reply, F.lit(HEADER), F.lit(0)))
    return F.zip_with(heads, F.split(reply, HEADER), lambda h, body: F.struct(F.regexp_extract(h, r"\d", 0).alias("number"), h.alias("head"), body.alias("body")))


def section(parts: Column, number: int) -> Column:
    """The text of one numbered section, up to the next one's header, or to the end where that is missing.

    Headers of other sections in between are text, its own ones are not.
    """
    numbers = F.transform(parts, lambda p: p["number"])
    found = F.array_position(numbers, str(number)).cast("int")
    end = F.array_position(F.slice(numbers, found + 1, F.size(parts)), str(number + 1)).cast("int")
    own = F.slice(parts, found, F.when(end > 0, end).otherwise(F.size(parts)))
    body = F.array_join(F.transform(own, lambda p: F.when(p["number"] == str(number), p["body"]).otherwise(F.concat(p["head"], p["body"]))), "")
    return F.when(found > 0, F.regexp_replace(strip(body), r"\n\n\n+", "\n\n")).otherwise("")


def sections(reply: Column) -> Column:
    """A struct of all six sections; the reply, best a column of a row below, is cut at its headers once."""
    return once(_parts(F.coalesce(reply, F.lit(""))), lambda parts: F.struct(*[section(parts, i).alias(name) for i, name in enumerate(SECTIONS)]))


def found_sections(s: Column) -> tuple[Column, Column]:
    """(found, missing): the names of the sections in a column of ``sections`` that have a text, and of the others."""
    found = F.array_compact(F.array(*[F.when(strip(F.coalesce(s[n], F.lit(""))) != "", n) for n in SECTIONS]))
    return found, F.array_except(F.array(*map(F.lit, SECTIONS)), found)


def unfenced(reply: Column) -> Column:
    """A JSON reply without the code fence that it may come in."""
    return strip(F.regexp_replace(strip(reply), r"^```(json)?\s*|\s*```$", ""))


def classification(reply: Column) -> Column:
    """The classification struct of a JSON reply. Domains may be strings or objects; a bare one has confidence 0.5."""
    body = unfenced(reply)
    whole = F.from_json(body, CLASSIFICATION)
    bare = F.from_json(F.get_json_object(body, "$.legal_domains"), "array<string>")
    domains = F.transform(bare, lambda x: F.when(x.startswith("{"), F.from_json(x, "struct<domain:string,confidence_score:double>")).otherwise(F.struct(x.alias("domain"), F.lit(0.5).alias("confidence_score"))))
    domains = F.transform(domains, lambda d: F.struct(F.coalesce(d["domain"], F.lit("")).alias("domain"), F.coalesce(d["confidence_score"], F.lit(0.5)).alias("confidence_score")))
    texts = lambda k: F.coalesce(F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>"), F.array().cast("array<string>"))
    plain = lambda k: F.coalesce(F.get_json_object(body, f"$.{k}"), F.lit(""))
    return F.struct(
        texts("intents").alias("intents"),
        texts("target_components").alias("target_components"),
        F.coalesce(domains, F.array().cast("array<struct<domain:string,confidence_score:double>>")).alias("legal_domains"),
        whole["strategy_critique"].alias("strategy_critique"),
        whole["entities"].alias("entities"),
        texts("adverse_retrieval_signals").alias("adverse_signals"),
        plain("vector_query").alias("vector_query"),
        plain("reasoning_summary").alias("reasoning_summary"),
    )


#: What a classification must have.
REQUIRED = ("intents", "target_components", "legal_domains", "vector_query", "reasoning_summary")


def missing_keys(reply: Column, required: tuple[str, ...] = REQUIRED) -> Column:
    """Required keys that a JSON reply lacks."""
    return F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.json_object_keys(unfenced(reply)), F.array().cast("array<string>")))


def extracted_articles(reply: Column) -> Column:
    """The article structs of a JSON list reply; null where it is no JSON."""
    return F.from_json(unfenced(reply), f"array<{EXTRACTED_ARTICLE.simpleString()}>")


def payload(field: Column) -> tuple[Column, Column]:
    """(content, metadata) of a field that is either a text or {content, metadata} as JSON."""
    is_object = field.startswith("{")
    return F.when(is_object, F.coalesce(F.get_json_object(field, "$.content"), F.lit(""))).otherwise(F.coalesce(field, F.lit(""))), F.when(is_object, F.coalesce(F.get_json_object(field, "$.metadata"), F.lit(""))).otherwise("")
