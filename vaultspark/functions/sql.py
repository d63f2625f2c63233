"""The engine's expressions as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vaultspark.functions.text import WIKI_LINK

#: Functions that Spark puts into the plan as the expression they stand for.
FUNCTIONS = {
    "vec_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) = 0 OR aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D "
        "ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) / sqrt(aggregate(b, 0D, (s, x) -> s + x * x)) END",
    ),
    "wiki_links": ("content STRING", "ARRAY<STRING>", f"array_distinct(transform(regexp_extract_all(content, r'{WIKI_LINK}', 1), x -> trim(x)))"),
    "week_label": ("d DATE", "STRING", "concat(date_format(d, 'yyyy'), '-W', lpad(CAST(floor(datediff(d, trunc(d, 'YEAR')) / 7) + 1 AS STRING), 2, '0'))"),
    "rel_weight": ("seen BIGINT, last_seen DATE, confidence DOUBLE, as_of DATE", "DOUBLE", "confidence * exp(-greatest(datediff(as_of, last_seen), 0) / 180D) * log2(seen + 1D)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; ``chunk_markdown(text, limit)`` and ``snippet(text, query)`` are Python. Returns their names."""
    from vaultspark.operators.fulltext import marked
    from vaultspark.operators.vectors import chunk

    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")

    @F.udtf(returnType="chunk_index int, heading string, chunk_text string")
    class ChunkMarkdown:
        def eval(self, text: str, limit: int) -> Iterator[tuple[int, str, str]]:
            yield from chunk(text or "", limit)

    spark.udtf.register("chunk_markdown", ChunkMarkdown)
    spark.udf.register("snippet", lambda text, query: marked(text, query), "string")
    return [*FUNCTIONS, "chunk_markdown", "snippet"]
