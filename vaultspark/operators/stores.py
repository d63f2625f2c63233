"""Entities, relationships, evidence, facts and conversations: lookups and batched changes.

A change takes the table as it is and a batch with ``seq`` (the order of arrival), and returns the table as it will be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark.functions import text as X
from vaultspark.functions.scores import relationship_weight
from vaultspark.operators import fulltext


def day(value: str | Column) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


# --- decoding -----------------------------------------------------------------------------------


def decoded_entities(rows: DataFrame) -> DataFrame:
    """Rows with JSON text columns as entities, with defaults."""
    return rows.withColumns({"aliases": X.string_list(F.col("aliases")), "metadata": F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")).otherwise("{}"), "mention_count": F.coalesce("mention_count", F.lit(0))})


def decoded_relationships(rows: DataFrame) -> DataFrame:
    defaults = {"weight": 1.0, "confidence": 1.0, "extraction_method": "rule", "seen_count": 1}
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def decoded_facts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("entity_ids", X.string_list(F.col("entity_ids")))


# --- entities -----------------------------------------------------------------------------------


def entity(entities: DataFrame, id_: str) -> DataFrame:
    return entities.where(F.col("id") == id_)


def search_entities(entities: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Entities with the query anywhere in name, aliases or id, whatever its case; the first by id."""
    like = f"%{query}%"
    found = entities.where(F.col("name").ilike(like) | F.to_json("aliases").ilike(like) | F.col("id").ilike(like))
    return (found.where(F.col("type") == kind) if kind else found).orderBy("id").limit(limit)


def search_entities_or_id(entities: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """As ``search_entities``, or if it finds nothing the entity with just this id, whatever its type."""
    found = search_entities(entities, query, kind).withColumn("__by_id", F.lit(0))
    rows = found.unionByName(entity(entities, query).withColumn("__by_id", F.lit(1)))  # 21 at most
    return rows.join(F.broadcast(rows.agg(F.min("__by_id").alias("__by_id"))), "__by_id").drop("__by_id").orderBy("id")


def names(entities: DataFrame) -> DataFrame:
    """key (lower case), id: one entity for each name or alias; a name goes before an alias, then the least id. Empty keys are left out."""
    own = entities.select(F.lower("name").alias("key"), F.lit(0).alias("priority"), "id")
    other = entities.select(F.explode("aliases").alias("key"), F.lit(1).alias("priority"), "id").withColumn("key", F.lower("key"))
    return own.unionByName(other).where("key <> ''").groupBy("key").agg(F.min(F.struct("priority", "id")).getField("id").alias("id"))


def entity_by_name(entities: DataFrame, name: str) -> DataFrame:
    """The entity of a name, else of an alias; both whatever their case."""
    by_name, by_alias = F.lower("name") == name.lower(), F.exists("aliases", lambda a: F.lower(a) == name.lower())
    found = entities.where(by_name | by_alias).withColumn("__priority", F.when(by_name, 0).otherwise(1))
    return found.orderBy("__priority", "id").limit(1).drop("__priority")


def upserted_entities(entities: DataFrame, batch: DataFrame, today: str | Column) -> DataFrame:
    """The last row of each id sets type, name, aliases, metadata and source_path; dates and counts of known ids stay."""
    fields = ["type", "name", "aliases", "metadata", "source_path"]
    new = batch.groupBy("id").agg(F.max_by(F.struct(*fields), "seq").alias("new"))
    both = entities.join(new, "id", "full_outer")
    took = {f: F.when(F.col("new").isNotNull(), F.col(f"new.{f}")).otherwise(F.col(f)) for f in fields}
    fresh = F.col("new").isNotNull() & F.col("mention_count").isNull()
    dates = {c: F.when(fresh & F.col(c).isNull(), day(today)).otherwise(F.col(c)) for c in ("first_seen", "last_seen")}
    return both.select("id", *[c.alias(n) for n, c in (took | dates).items()], F.coalesce("mention_count", F.lit(0)).alias("mention_count")).select(*entities.columns)


def mentioned(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities after mentions (id, date): each adds one, and the latest date stays."""
    new = mentions.groupBy("id").agg(F.count("*").alias("__n"), F.max("date").alias("__last"))
    rows = entities.join(new, "id", "left")
    return rows.withColumns({"mention_count": F.col("mention_count") + F.coalesce("__n", F.lit(0)), "last_seen": F.greatest("last_seen", "__last")}).select(*entities.columns)


# --- relationships ------------------------------------------------------------------------------


def relationships_of(relationships: DataFrame, id_: str, kind: str | None = None) -> DataFrame:
    """Relationships from or to an entity, the heaviest first."""
    found = relationships.where((F.col("source_id") == id_) | (F.col("target_id") == id_))
    return (found.where(F.col("type") == kind) if kind else found).orderBy(F.desc("weight"), F.desc("id"))


def relationship_listing(relationships: DataFrame, entities: DataFrame, id_: str) -> DataFrame:
    """Relationships of an entity with their direction and the other end's name (its id if unknown)."""
    out = F.col("source_id") == id_
    found = relationships_of(relationships, id_).select(F.when(out, "out").otherwise("in").alias("direction"), "type", F.when(out, F.col("target_id")).otherwise(F.col("source_id")).alias("other_id"), "weight", "seen_count")
    named = found.join(entities.select(F.col("id").alias("other_id"), F.col("name").alias("other")), "other_id", "left")
    return named.withColumn("other", F.coalesce("other", "other_id"))


def consolidated(observations: DataFrame, entities: DataFrame | None = None, as_of: str | Column | None = None) -> DataFrame:
    """One relationship for each (source, target, type) of an observation log.

    Ends must be known if ``entities`` is given. seen_count counts, confidence is the largest, the weight takes the latest
    confidence, and context, source file and method are those of the first observation.
    """
    rows = observations
    if entities is not None:
        for end in ("source_id", "target_id"):
            rows = rows.join(entities.select(F.col("id").alias(end)), end, "left_semi")
    first, last = F.min_by(F.struct("context", "source_file", "extraction_method"), "seq"), F.max_by("confidence", "seq")
    out = rows.groupBy("source_id", "target_id", "type").agg(
        F.count("*").alias("seen_count"), F.max("observed_on").alias("last_seen"), F.max("confidence").alias("confidence"), last.alias("__confidence"), first.alias("__first")
    )
    today = F.col("last_seen") if as_of is None else day(as_of)
    return out.select(
        F.xxhash64("source_id", "target_id", "type").alias("id"), "source_id", "target_id", "type", "__first.context", "__first.source_file", "__first.extraction_method",
        relationship_weight(F.col("seen_count"), F.col("last_seen"), F.col("__confidence"), today).alias("weight"), "confidence", "last_seen", "seen_count",
    )


def merged_relationships(relationships: DataFrame, observations: DataFrame, entities: DataFrame, today: str | Column) -> DataFrame:
    """Relationships after a batch of observations between known entities.

    Each observation counts once more and makes the relationship seen today; the weight is made anew from the last confidence that came,
    the confidence is the largest of all. All else of a known relationship stays, and relationships that weren't observed stay as they are.
    """
    key = ["source_id", "target_id", "type"]
    rows = observations
    for end in key[:2]:
        rows = rows.join(entities.select(F.col("id").alias(end)), end, "left_semi")
    first = F.min_by(F.struct("context", "source_file", "extraction_method"), "seq")
    new = rows.groupBy(*key).agg(F.count("*").alias("__n"), F.max("confidence").alias("__top"), F.max_by("confidence", "seq").alias("__last"), first.alias("__first"))
    both = relationships.join(new, key, "full_outer")
    seen, fresh = F.col("__n").isNotNull(), F.col("id").isNull()
    count = F.when(fresh, F.lit(0)).otherwise(F.coalesce("seen_count", F.lit(1))) + F.coalesce("__n", F.lit(0))
    changes = {
        "weight": F.when(seen, relationship_weight(count, day(today), F.col("__last"), day(today))).otherwise(F.col("weight")),
        "seen_count": F.when(seen, count).otherwise(F.col("seen_count")),
        "last_seen": F.when(seen, day(today)).otherwise(F.col("last_seen")),
        "confidence": F.greatest("confidence", "__top"),
        **{c: F.when(fresh, F.col(f"__first.{c}")).otherwise(F.col(c)) for c in ("context", "source_file", "extraction_method")},
        "id": F.coalesce("id", F.xxhash64(*key)),
    }
    return both.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in relationships.columns])


def evidence_log(observations: DataFrame) -> DataFrame:
    """The first observation of each relationship in each source file; none without a file."""
    rows = observations.where("source_file is not null")
    first = F.min_by(F.struct("context", "observed_on", "extraction_method"), "seq")
    out = rows.groupBy("source_id", "target_id", "type", "source_file").agg(first.alias("f"))
    return out.select(F.xxhash64("source_id", "target_id", "type").alias("relationship_id"), "source_file", "f.context", F.col("f.observed_on").alias("extracted_at"), "f.extraction_method")


def evidence_of(evidence: DataFrame, relationship_id: int | Column) -> DataFrame:
    return evidence.where(F.col("relationship_id") == relationship_id).orderBy(F.desc("extracted_at"), "source_file")


def reweighted(relationships: DataFrame, as_of: str | Column) -> DataFrame:
    """Weights of relationships with a date, as of a day."""
    weight = relationship_weight(F.col("seen_count"), F.col("last_seen"), F.col("confidence"), day(as_of))
    return relationships.withColumn("weight", F.when(F.col("last_seen").isNotNull(), weight).otherwise(F.col("weight")))


# --- facts --------------------------------------------------------------------------------------


def facts_about(facts: DataFrame, id_: str, compat: bool = False) -> DataFrame:
    """Facts that name an entity; with ``compat``, where its id is any part of their ids' JSON."""
    return facts.where(F.to_json("entity_ids").ilike(f"%{id_}%") if compat else F.array_contains("entity_ids", id_))


def query_facts(facts: DataFrame, entity_id: str | None = None, kind: str | None = None, since: str | None = None, until: str | None = None, limit: int = 50, compat: bool = False) -> DataFrame:
    """Facts by entity, type and days (both included), the latest first."""
    rows = facts_about(facts, entity_id, compat) if entity_id else facts
    rows = rows.where(F.col("type") == kind) if kind else rows
    rows = rows.where(F.col("recorded_at") >= day(since)) if since else rows
    rows = rows.where(F.col("recorded_at") <= day(until)) if until else rows
    return rows.orderBy(F.desc("recorded_at"), "id").limit(int(limit))


def added_facts(facts: DataFrame, batch: DataFrame, today: str | Column) -> DataFrame:
    """Facts and what is new in ``batch``: one for each type, content and source file; without a file each counts."""
    key = ["type", "content", "source_file"]
    rows = batch.withColumn("recorded_at", F.coalesce("recorded_at", day(today)))
    fields = [c for c in facts.columns if c not in key]
    one = rows.where("source_file is not null").groupBy(*key).agg(F.min_by(F.struct(*fields), "seq").alias("f")).select(*key, "f.*")
    fresh = one.join(facts.select(*key), key, "left_anti")
    free = rows.where("source_file is null").select(*key, *fields)
    return facts.unionByName(fresh).unionByName(free)


# --- conversations ------------------------------------------------------------------------------


def added_conversations(conversations: DataFrame, batch: DataFrame) -> DataFrame:
    """The first record of each session stays."""
    fields = [c for c in conversations.columns if c != "session_id"]
    one = batch.groupBy("session_id").agg(F.min_by(F.struct(*fields), "seq").alias("f")).select("session_id", "f.*")
    return conversations.unionByName(one.join(conversations.select("session_id"), "session_id", "left_anti"))


def conversation_records(lines: DataFrame) -> DataFrame:
    """Records of JSON texts (column ``value``), code fences taken off; those without session, date or summary are left out."""
    schema = "session_id string, date string, summary string, topics string, outcome string, next_actions string"
    rest = [c for c in lines.columns if c != "value"]
    rows = lines.select(*rest, F.from_json(X.without_fence(F.col("value")), schema).alias("r")).select(*rest, "r.*")
    return rows.where("session_id <> '' and date <> '' and summary <> ''").withColumn("topics", F.coalesce("topics", F.lit("")))


def search_conversations(conversations: DataFrame, query: str | None = None, since: str | None = None, until: str | None = None, limit: int = 10) -> DataFrame:
    """Conversations by rank if there is a query, else the latest first; ``until`` takes in its whole day."""
    rows = conversations
    if query:
        rows = fulltext.match(fulltext.indexed(conversations, fulltext.CONVERSATION_COLUMNS), fulltext.CONVERSATION_COLUMNS, query)
    rows = rows.where(F.col("date") >= since) if since else rows
    rows = rows.where(F.col("date") <= f"{until} 99:99") if until else rows
    order = ["score", "id"] if query else [F.desc("date"), "id"]
    return rows.orderBy(*order).limit(limit).select(*conversations.columns, *(["score"] if query else []))


def first_per(rows: DataFrame, keys: list[str], order: list[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")
