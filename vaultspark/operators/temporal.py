"""Activity and trends over time. The present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import text as X
from vaultspark.operators.stores import day, facts_about, relationships_of


def relationship_timeline(relationships: DataFrame, evidence: DataFrame, a: str, b: str) -> DataFrame:
    """Evidence of all relationships between two entities, the earliest first."""
    ends = (F.col("source_id") == a) & (F.col("target_id") == b) | (F.col("source_id") == b) & (F.col("target_id") == a)
    own = relationships.where(ends).select(F.col("id").alias("relationship_id"))
    found = evidence.join(own, "relationship_id", "left_semi")
    return found.select(F.date_format("extracted_at", "yyyy-MM-dd").alias("date"), "source_file", "context", "extraction_method").orderBy("date", "source_file")


def entity_activity(facts: DataFrame, relationships: DataFrame, evidence: DataFrame, id_: str, granularity: str = "month") -> DataFrame:
    """period, mention_count, facts_recorded and new_relationships of an entity, by day, week or month."""
    told = facts_about(facts, id_).where("recorded_at is not null").groupBy(X.period(F.col("recorded_at"), granularity).alias("period")).agg(F.count("*").alias("n"))
    own = relationships_of(relationships, id_).select(F.col("id").alias("relationship_id"))
    seen = evidence.join(own, "relationship_id", "left_semi").groupBy(X.period(F.to_date("extracted_at"), granularity).alias("period")).agg(F.count("*").alias("m"))
    both = told.join(seen, "period", "full_outer")
    n = F.coalesce("n", F.lit(0))
    return both.select("period", n.alias("mention_count"), n.alias("facts_recorded"), F.coalesce("m", F.lit(0)).alias("new_relationships")).orderBy("period")


def trends(facts: DataFrame, entities: DataFrame, as_of: str | Column, window_days: int = 30, bounded: bool = False) -> DataFrame:
    """id, name, type, recent, previous, trend and metric of entities with facts in the last two windows.

    emerging: none before, or three at least and over half as many again; fading: under half; else stable. The metric is
    the count or the ratio that names the trend. Facts to come count as recent unless ``bounded``.
    """
    now = day(as_of)
    recent_from, previous_from = F.date_sub(now, window_days), F.date_sub(now, 2 * window_days)
    rows = facts.where(F.col("recorded_at") >= previous_from)
    rows = rows.where(F.col("recorded_at") <= now) if bounded else rows
    recent = F.col("recorded_at") >= recent_from
    counts = rows.select(F.explode("entity_ids").alias("id"), recent.cast("long").alias("r")).groupBy("id").agg(F.sum("r").alias("recent"), F.sum(1 - F.col("r")).alias("previous"))
    r, p = F.col("recent").cast("double"), F.col("previous").cast("double")
    sudden, rising, falling = (p == 0) & (r > 0), (r > 1.5 * p) & (r >= 3), (p > 0) & (r < 0.5 * p)
    trend = F.when(sudden | rising, "emerging").when(falling, "fading").otherwise("stable")
    metric = F.when(sudden, r).when(rising, r / p).when(falling, F.when(r > 0, p / r).otherwise(p)).otherwise(r + p)
    named = counts.join(entities.select("id", "name", "type"), "id")
    return named.select("id", "name", "type", "recent", "previous", trend.alias("trend"), metric.alias("metric")).orderBy("trend", F.desc("metric"), "id")


def fact_timeline(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with the names of their entities (their ids if unknown)."""
    each = found.select("id", F.posexplode("entity_ids").alias("pos", "entity_id")).join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id", "left")
    named = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "entity_id").alias("name")))).alias("n"))
    return found.join(named, "id", "left").withColumn("names", F.transform("n", lambda x: x["name"])).drop("n")
