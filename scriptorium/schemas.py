"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _split(inner: str) -> list[str]:
    """Cut at the commas that are in no bracket."""
    out, depth = [""], 0
    for c in inner:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _type(name: str) -> T.DataType:
    """A type from its short name; needs no session, so schemas can be module constants."""
    if name.startswith("array<"):
        return T.ArrayType(_type(name[6:-1]))
    if name.startswith("struct<"):
        return _struct(**dict(part.split(":", 1) for part in _split(name[7:-1])))
    return _SIMPLE[name]


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, _type(v)) for k, v in fields.items()])


#: The seven fields that describe a case; all strings, the year included.
CASE_FIELDS = ("file_name", "parties", "court_level", "judge", "year", "legal_domain", "winning_party")
#: The parts that a complete case has, in display order.
COMPONENTS = ("facts", "issues", "rules", "application", "conclusion")

DOCUMENT = _struct(text="string", source="string", file_type="string", file_size="bigint", original_size="int", loaded_at="timestamp", cleaned="boolean", file_name="string", file_hash="string")
CHUNK = _struct(id="string", text="string", source="string", file_name="string", file_hash="string", start_index="int", chunk_id="int", chunk_index="int", total_chunks="int", chunk_size="int", ingested_at="timestamp", embedding_model="string", embedding="array<float>")
TOKEN_CHUNK = _struct(chunk_number="int", title="string", text="string", token_count="int", sentence_count="int", char_count="int")
CASE_CHUNK = _struct(id="string", text="string", **dict.fromkeys(CASE_FIELDS, "string"), firac_component="string", case_identifier="string", document_hash="string", source_file_path="string", content_length="int", ingested_at="timestamp", embedding_model="string", embedding="array<float>")
ARTICLE = _struct(header="string", number="string", sentence="string", full_article_text="string", part="string", part_title="string", chapter="string", chapter_title="string", text_length="int", num_chunks="int", chunks="array<string>", source_document="string")
ARTICLE_CHUNK = _struct(article_number="string", article_header="string", chapter="string", chapter_title="string", part="string", part_title="string", source_document="string", article_length="int", total_chunks="int", chunk_index="int", chunk_text="string", chunk_length="int", is_complete_article="boolean")
REPLY = _struct(prompt_hash="string", answer="string", error="string", asked_at="timestamp")
EXTRACTED_ARTICLE = _struct(source="string", chapter_no="int", chapter_title="string", part_no="int", part_title="string", article_no="int", article_title="string", legal_domain="string", summary="string", keywords="array<string>", text_content="string")
CLASSIFICATION = _struct(
    intents="array<string>",
    target_components="array<string>",
    legal_domains="array<struct<domain:string,confidence_score:double>>",
    strategy_critique="struct<spatial:string,doctrinal:string,temporal:string,procedural:string>",
    entities="struct<statutes:array<string>,cases:array<string>,judges:array<string>>",
    adverse_retrieval_signals="array<string>",
    vector_query="string",
    reasoning_summary="string",
)
