"""The model tables, derived from the driver's tables.

``notes`` and ``conversations`` gather the turns of a conversation in one row: a note is one text, and a conversation isn't unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_MS = 1704067200000  # 2024-01-01 in UTC
AS_OF_TRADE, AS_OF_FACTS = "2001-12-31", "2024-01-31"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each document; its directory is the document's source, its tag the language."""
    d, key = raw(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/"), key, F.lit(".md")).alias("path"),
        F.concat(F.lit("doc-"), key).alias("title"),
        F.col("source").alias("directory"),
        F.array("lang").alias("tags"),
        F.lit("{}").alias("frontmatter"),
        F.array_distinct(F.array(*[F.concat(F.lit("doc-"), (F.col("doc_id") % m).cast("string")) for m in (97, 31)])).alias("wiki_links"),
        F.col("text").alias("content"),
        (F.lit(FIRST_MS) + F.col("doc_id") * 60000).alias("modified_at"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four chunk vectors for each file."""
    return raw(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.expr("vec_id div 4").alias("file_id"),
        (F.col("vec_id") % 4).cast("int").alias("chunk_index"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("chunk_text"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("heading"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    line = raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return line.join(o, "o_orderkey").select(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("target_id"),
        F.lit("trades-with").alias("type"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("source_file"),
        "day",
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade, and where suppliers and nations belong."""
    parts = _trade(spark, sf_dir)
    s, n = raw(spark, sf_dir, "supplier"), raw(spark, sf_dir, "nation")
    fixed = F.to_date(F.lit("2001-01-01"))

    def belongs(df: DataFrame, kind: str, key: str, to: str, to_key: str) -> DataFrame:
        name = F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"))
        return df.select(name.alias("source_id"), F.concat(F.lit(f"{to}-"), F.col(to_key).cast("string")).alias("target_id"), F.lit("belongs-to").alias("type"), F.lit("registry").alias("source_file"), fixed.alias("day"))

    return parts.unionByName(belongs(s, "supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(belongs(n, "nation", "n_nationkey", "region", "n_regionkey"))


def relationships(spark: SparkSession, sf_dir: str, as_of: str = AS_OF_TRADE) -> DataFrame:
    """Observations consolidated, with a decayed weight."""
    from vaultspark.functions.scores import relationship_weight

    seen = observations(spark, sf_dir).groupBy("source_id", "target_id", "type").agg(F.count("*").alias("seen_count"), F.max("day").alias("last_seen"))
    weight = relationship_weight(F.col("seen_count"), F.col("last_seen"), F.lit(1.0), F.lit(as_of).cast("date"))
    return seen.withColumn("weight", weight).withColumn("confidence", F.lit(1.0)).withColumn("id", F.xxhash64("source_id", "target_id", "type"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first observation of each relationship in each source file."""
    seen = observations(spark, sf_dir).groupBy("source_id", "target_id", "type", "source_file").agg(F.min("day").alias("day"))
    return seen.select(
        F.xxhash64("source_id", "target_id", "type").alias("relationship_id"),
        "source_file",
        F.lit(None).cast("string").alias("context"),
        F.col("day").cast("timestamp").alias("extracted_at"),
        F.lit("rule").alias("extraction_method"),
    )


def entities(spark: SparkSession, sf_dir: str, related: DataFrame | None = None) -> DataFrame:
    """Customers, suppliers, nations and regions; mentions and last_seen come from their trades, or from those that the relationships (``related``) have counted."""
    kinds = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"))
    named = None
    for kind, key, name in kinds:
        part = raw(spark, sf_dir, kind).select(
            F.concat(F.lit(f"{kind}-"), F.col(key).cast("string")).alias("id"),
            F.lit(kind).alias("type"),
            F.col(name).alias("name"),
            F.array(F.concat(F.lit(f"{kind} no "), F.col(key).cast("string"))).alias("aliases"),
        )
        named = part if named is None else named.unionByName(part)
    ends = F.explode(F.array("source_id", "target_id")).alias("id")
    if related is None:
        trades = _trade(spark, sf_dir).select(ends, F.lit(1).cast("long").alias("seen_count"), F.col("day").alias("last_seen"))
    else:
        trades = related.where("type = 'trades-with'").select(ends, "seen_count", "last_seen")
    mentions = trades.groupBy("id").agg(F.sum("seen_count").alias("mention_count"), F.max("last_seen").alias("last_seen"))
    return named.join(mentions, "id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each event, about its user and its type."""
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("type"),
        F.col("props").alias("content"),
        F.array(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.concat(F.lit("type-"), "event_type")).alias("entity_ids"),
        F.to_date("ts").alias("recorded_at"),
        F.concat(F.lit("event-"), (F.col("event_id") % 100).cast("string")).alias("source_file"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each conversation: its first user turn, its roles and its last assistant turn."""
    c = raw(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("first"),
        F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text"))).alias("last"),
        F.array_join(F.array_sort(F.collect_set("role")), " ").alias("topics"),
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 365).cast("int"))
    return rows.select(
        F.col("conv_id").alias("id"),
        F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 10:"), F.lpad((F.col("conv_id") % 60).cast("string"), 2, "0")).alias("date"),
        F.coalesce("first.text", F.lit("")).alias("summary"),
        "topics",
        F.col("last.text").alias("outcome"),
        F.lit(None).cast("string").alias("next_actions"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown notes rendered from conversations: a heading for each turn, and links to other notes."""
    c = raw(spark, sf_dir, "conversations")
    turn = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    one = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("body")))).alias("turns"))
    link = F.concat(F.lit("[[conv-"), (F.col("conv_id") % 13).cast("string"), F.lit("|earlier]] #conv-"), (F.col("conv_id") % 7).cast("string"))
    body = F.concat(F.array_join(F.transform("turns", lambda t: t.body), "\n\n"), F.lit("\n\n"), link)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")), "yyyy-MM-dd")
    path = F.concat(F.lit("talks/"), day, F.lit(" conv-"), F.col("conv_id").cast("string"), F.lit(".md"))
    return one.select(F.col("conv_id").alias("id"), path.alias("path"), (F.lit(FIRST_MS) + F.col("conv_id") * 1000).alias("modified_at"), body.alias("raw"))
