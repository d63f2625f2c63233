"""Schemas of the model tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 8


_ATOMS = {"boolean": T.BooleanType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def _kind(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_kind(text[6:-1]))
    if text.startswith("struct<"):
        return _schema(text[7:-1].replace(":", " "))
    return _ATOMS[text]


def _schema(ddl: str) -> T.StructType:
    """A schema from its text, without a session."""
    fields, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = ddl[start:k].strip().partition(" ")
            fields.append(T.StructField(name, _kind(kind.replace(" ", ":") if kind.startswith("array<struct") else kind)))
            start = k + 1
    return T.StructType(fields)


RAW_NOTES = _schema("path string, modified_at bigint, raw string")
FILES = _schema(
    "id bigint, path string, title string, directory string, tags array<string>, frontmatter string, wiki_links array<string>, content string, "
    "modified_at bigint, indexed_at bigint, graph_extracted_at bigint, embedded_at bigint, llm_extracted_at bigint"
)
EMBEDDINGS = _schema("id bigint, file_id bigint, chunk_index int, chunk_text string, heading string, embedding array<double>")
ENTITIES = _schema(
    "id string, type string, name string, aliases array<string>, metadata string, source_path string, first_seen date, last_seen date, mention_count bigint"
)
RELATIONSHIPS = _schema(
    "id bigint, source_id string, target_id string, type string, context string, valid_from date, valid_until date, source_file string, "
    "weight double, confidence double, extraction_method string, last_seen date, seen_count bigint"
)
EVIDENCE = _schema("id bigint, relationship_id bigint, source_file string, context string, extracted_at timestamp, extraction_method string")
FACTS = _schema("id bigint, type string, content string, entity_ids array<string>, recorded_at date, valid_until date, source_file string")
CONVERSATIONS = _schema(
    "id bigint, session_id string, date string, summary string, topics string, outcome string, next_actions string, recorded_at bigint"
)
OBSERVATIONS = _schema(
    "seq bigint, source_id string, target_id string, type string, context string, source_file string, confidence double, extraction_method string, observed_on date"
)
#: ``seq`` orders events; without it their ``modified_at`` does.
CHANGES = _schema("op string, path string, old_path string, modified_at bigint, raw string, seq bigint")
#: What was last written to a path: when it came there, when it was written, and whether it is gone.
PATHS = _schema("path string, pos bigint, seq bigint, gone boolean")
RENAMES = _schema("old_path string, path string, seq bigint")
LLM_RESPONSE = _schema(
    "relationships array<struct<source:string,target:string,type:string,confidence:double,context:string>>, newEntities array<struct<name:string,type:string>>"
)

TABLES = {
    "files": FILES,
    "embeddings": EMBEDDINGS,
    "entities": ENTITIES,
    "relationships": RELATIONSHIPS,
    "relationship_evidence": EVIDENCE,
    "facts": FACTS,
    "conversations": CONVERSATIONS,
}
