"""Entities, relationships and facts out of notes: by rules, and from the answers of a language model.

The rules run in two passes over all notes, first creating entities, then resolving names, so that the result
doesn't depend on the order of the notes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import scores as S
from vaultspark.functions import text as X
from vaultspark.operators import stores
from vaultspark.schemas import ENTITIES, LLM_RESPONSE

#: Front-matter properties, the relationship they stand for, the type of their targets.
PROPERTIES = (
    ("소속", "belongs-to", "organization"),
    ("organization", "belongs-to", "organization"),
    ("team", "belongs-to", "organization"),
    ("project", "related-to", "project"),
    ("attendees", "attended", "person"),
)
#: Names that stand for the author.
EXCLUDED = ("나", "user", "i", "me")
SUMMARY = "요약.md"

#: What a model's answer may name.
RELATION_TYPES = (
    "influences", "caused", "decided", "depends-on", "opposes", "supports", "manages", "mentors", "collaborates", "questions",
    "co-mentioned", "belongs-to", "related-to", "attended",
)
ENTITY_TYPES = ("concept", "technology", "tool", "decision", "person", "organization", "project", "team", "topic", "event")


def _fresh(rows: DataFrame, kind: str, today: str) -> DataFrame:
    """Entities of ``rows`` (id, name, and perhaps metadata and source_path) with defaults."""
    given = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("metadata", "source_path")}
    day = stores.day(today)
    return rows.select(
        "id", F.lit(kind).alias("type"), "name", F.array().cast("array<string>").alias("aliases"), F.coalesce(given["metadata"], F.lit("{}")).alias("metadata"),
        given["source_path"].cast("string").alias("source_path"), day.alias("first_seen"), day.alias("last_seen"), F.lit(0).cast("long").alias("mention_count"),
    ).to(ENTITIES)


def seeded(entities: DataFrame, files: DataFrame, people_dir: str | None, today: str) -> DataFrame:
    """Entities with a person for each folder of ``people_dir`` whose name isn't taken; metadata come from its summary note."""
    if people_dir is None:
        return entities
    rest = F.substring("path", len(people_dir) + 2, 1 << 30)
    inside = files.where(F.col("path").startswith(f"{people_dir}/") & rest.contains("/")).select(F.split(rest, "/")[0].alias("name"), rest.alias("rest"), "frontmatter")
    summary = F.max(F.when(F.col("rest") == F.concat("name", F.lit(f"/{SUMMARY}")), F.col("frontmatter")))
    people = inside.groupBy("name").agg(summary.alias("metadata")).withColumn("id", F.col("name"))
    people = people.withColumn("source_path", F.concat(F.lit(f"{people_dir}/"), "name", F.lit(f"/{SUMMARY}")))
    people = people.join(entities.select("id"), "id", "left_anti").join(entities.select("name").distinct(), "name", "left_anti")
    return entities.unionByName(_fresh(people, "person", today))


def _values(json: Column, name: str, many: bool) -> Column:
    """A property's value or, with ``many``, values, trimmed; blank ones are left out."""
    raw = F.get_json_object(json, f"$['{name}']")
    listed = F.coalesce(F.from_json(raw, "array<string>"), F.array(raw)) if many else F.array(raw)
    return F.filter(F.transform(listed, X.trimmed), lambda v: v.isNotNull() & (v != ""))


def front_matter_targets(files: DataFrame) -> DataFrame:
    """path, relation, kind and name of what front-matter properties name."""
    each = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(k).alias("kind"), _values(F.col("frontmatter"), p, p == "attendees").alias("names")) for p, r, k in PROPERTIES])
    rows = files.select("path", F.inline(each)).select("path", "relation", "kind", F.explode("names").alias("name"))
    return rows.where(~F.lower("name").isin(*EXCLUDED))


def organisations(entities: DataFrame) -> DataFrame:
    """id and name of the organisation that a person's metadata name."""
    people = entities.where("type = 'person'")
    each = F.flatten(F.array(*[_values(F.col("metadata"), p, False) for p, _, k in PROPERTIES if k == "organization"]))
    return people.select("id", "source_path", F.explode(each).alias("name"))


def with_targets(entities: DataFrame, files: DataFrame, today: str) -> DataFrame:
    """Entities with those that metadata and front-matter name and nobody knows; people aren't created."""
    wanted = organisations(entities).select("name", F.lit("organization").alias("kind")).unionByName(front_matter_targets(files).where("kind <> 'person'").select("name", "kind"))
    wanted = wanted.withColumn("key", F.lower("name")).groupBy("key").agg(F.min(F.struct("name", "kind")).alias("w")).select("key", "w.*")
    new = wanted.join(stores.names(entities).select("key"), "key", "left_anti").withColumn("id", F.col("name"))
    for kind in ("organization", "project"):
        entities = entities.unionByName(_fresh(new.where(F.col("kind") == kind), kind, today))
    return entities


def resolved_links(files: DataFrame, names: DataFrame) -> DataFrame:
    """path and id of entities that wiki links name: as a whole, else by the last of their segments that is known."""
    link = files.select("path", F.explode("wiki_links").alias("link"))
    whole = link.select("path", "link", F.lit(0).alias("rank"), F.lower("link").alias("key"))
    parts = link.where(F.col("link").contains("/")).select("path", "link", F.posexplode(F.reverse(F.split("link", "/"))).alias("pos", "part"))
    keyed = whole.unionByName(parts.select("path", "link", (F.col("pos") + 1).alias("rank"), F.lower("part").alias("key")))
    found = keyed.join(names, "key").groupBy("path", "link").agg(F.min_by("id", "rank").alias("id"))
    return found.select("path", "id").distinct()


#: Names up to this many are matched by an automaton that each worker holds; more are split into as many blocks as it takes.
NAMES_AT_ONCE = 500_000


_machines: dict[str, object] = {}


def _machine(name: str, block):  # noqa: ANN001, ANN202
    """The automaton of a block of names, None without any; a worker keeps the one it used last, for its next tasks."""
    import ahocorasick

    if name not in _machines:
        machine = ahocorasick.Automaton()
        for key, id_ in block.value:
            machine.add_word(key, id_)
        if block.value:
            machine.make_automaton()
        _machines.clear()
        _machines[name] = machine if block.value else None
    return _machines[name]


def co_mentioned(files: DataFrame, names: DataFrame) -> DataFrame:
    """path and id of entities whose name or alias is anywhere in a note, whatever its case.

    One Aho-Corasick automaton for each block of names reads each note once.
    """
    keys = names.where((F.length("key") > 0) & ~F.col("key").isin(*EXCLUDED))
    blocks = -(-max(1, keys.count()) // NAMES_AT_ONCE)
    found = None
    for k in range(blocks):
        block = [(r["key"], r["id"]) for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k).collect()]  # a block of bounded size
        shared, name = files.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            machine = _machine(name, shared)
            for frame in batches:
                hits = [(p, i) for p, t in zip(frame["path"], frame["content"], strict=True) if t and machine for i in {v for _, v in machine.iter(t.lower())}]
                yield pd.DataFrame(hits, columns=["path", "id"])

        part = files.select("path", "content").mapInPandas(search, "path string, id string")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def mentions(files: DataFrame, entities: DataFrame) -> DataFrame:
    """path and id of the entities of each note, from links and from its text; names for the author don't count."""
    names = stores.names(entities)
    known = entities.where(~F.lower("name").isin(*EXCLUDED)).select("id")
    return resolved_links(files, names).unionByName(co_mentioned(files, names)).distinct().join(known, "id", "left_semi").select("path", "id")


def mentioned_together(found: DataFrame) -> DataFrame:
    """Pairs of entities of a note, from the smaller to the larger id: source_id, target_id and the other columns of ``found`` (path, id)."""
    return found.withColumnRenamed("id", "source_id").join(found.select("path", F.col("id").alias("target_id")), "path").where("source_id < target_id")


def _log(rows: DataFrame, relation: Column | str, method: str = "rule", confidence: Column | None = None) -> DataFrame:
    """Observations of rows with source_id, target_id, context, path and date."""
    kind = F.lit(relation) if isinstance(relation, str) else relation
    return rows.select(
        F.xxhash64("path", "source_id", "target_id", kind).alias("seq"), "source_id", "target_id", kind.alias("type"), "context", F.col("path").alias("source_file"),
        (F.lit(1.0) if confidence is None else confidence).alias("confidence"), F.lit(method).alias("extraction_method"), F.col("date").cast("date").alias("observed_on"),
    )


def extract(files: DataFrame, entities: DataFrame, people_dir: str | None, today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities with new ones and mentions counted, observations, facts) of notes by the rules.

    Co-mentions go from the smaller to the larger id.
    """
    entities = with_targets(seeded(entities, files, people_dir, today), files, today)
    names = stores.names(entities)
    dated = files.select("path", X.extract_date(F.col("path"), F.col("modified_at")).alias("date"))
    found = mentions(files, entities).join(dated, "path")
    seen = _log(mentioned_together(found).withColumn("context", F.col("path")), "co-mentioned")

    targets = front_matter_targets(files).withColumn("key", F.lower("name")).join(names, "key").join(dated, "path")
    owner = F.split(F.substring("path", len(people_dir) + 2, 1 << 30), "/")[0] if people_dir else F.lit(None).cast("string")
    inside = F.col("path").startswith(f"{people_dir}/") if people_dir else F.lit(False)
    owned = targets.where((F.col("relation") != "attended") & inside).withColumn("source_id", owner).where("source_id <> id")
    owned = owned.join(entities.select(F.col("id").alias("source_id")), "source_id", "left_semi").withColumn("target_id", F.col("id")).withColumn("context", F.lit(None).cast("string"))
    own_org = organisations(entities).withColumn("key", F.lower("name")).join(names.withColumnRenamed("id", "target_id"), "key")
    own_org = own_org.select(F.col("id").alias("source_id"), "target_id", F.col("source_path").alias("path"), F.lit(None).cast("string").alias("context"), F.lit(today).alias("date"))
    seen = seen.unionByName(_log(owned, F.col("relation"))).unionByName(_log(own_org, "belongs-to"))

    def told(rows: DataFrame, kind: str) -> DataFrame:
        one = rows.groupBy("path", "date").agg(F.array_sort(F.collect_set("id")).alias("entity_ids"))
        return one.select(F.xxhash64(F.lit(kind), "path").alias("id"), F.lit(kind).alias("type"), X.base_name(F.col("path")).alias("content"), "entity_ids", F.col("date").cast("date").alias("recorded_at"), F.lit(None).cast("date").alias("valid_until"), F.col("path").alias("source_file"))

    facts = told(found, "mention").unionByName(told(targets.where("relation = 'attended'"), "attended"))
    return stores.mentioned(entities, found.select("id", F.col("date").cast("date").alias("date"))), seen, facts


def prompt(content: Column, known: Column) -> Column:
    """What a model is asked: known entities (array of struct name, type) and the first 3000 characters of the note."""
    listed = F.array_join(F.transform(known, lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ["), e["type"], F.lit("]"))), "\n")
    kinds, new = ", ".join(RELATION_TYPES[:10]), ", ".join(ENTITY_TYPES[:4])
    ask = (
        f"Name the relationships between these entities that the note states, each with source, target, type (one of {kinds}), confidence from 0 to 1 and a sentence of context. "
        f"Name new entities, each with name and type (one of {new}). Answer with JSON alone: "
        '{"relationships":[{"source":"","target":"","type":"","confidence":0.5,"context":""}],"newEntities":[{"name":"","type":""}]}'
    )
    return F.concat(F.lit("Entities of the note:\n"), listed, F.lit("\n\nNote:\n"), F.substring(content, 1, 3000), F.lit(f"\n\n{ask}"))


def parsed_answers(answers: DataFrame) -> DataFrame:
    """path, relationships and new_entities of model answers; what isn't allowed is left out, and unreadable answers are empty."""
    got = F.from_json(X.json_block(F.col("response")), LLM_RESPONSE)
    rel = F.filter(got["relationships"], lambda r: r["source"].isNotNull() & r["target"].isNotNull() & r["type"].isin(*RELATION_TYPES))
    rel = F.transform(rel, lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), r["type"].alias("type"), S.clamped_confidence(r["confidence"]).alias("confidence"), F.coalesce(F.substring(r["context"], 1, 200), F.lit("")).alias("context")))
    new = F.filter(got["newEntities"], lambda e: e["type"].isin(*ENTITY_TYPES) & (F.length(e["name"]) >= 2))
    none = "array<struct<source:string,target:string,type:string,confidence:double,context:string>>"
    return answers.select("path", F.coalesce(rel, F.array().cast(none)).alias("relationships"), F.coalesce(new, F.array().cast("array<struct<name:string,type:string>>")).alias("new_entities"))


def extract_with_model(files: DataFrame, entities: DataFrame, generate: Callable[[Sequence[str]], list[str]], today: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities with new ones, observations, paths done) from a model's answers about notes with two known entities at least.

    ``generate`` gets the prompts of a batch on the executors; an answer that fails or can't be read gives nothing, and its note counts as done.
    """
    found = mentions(files, entities).join(entities.select("id", "name", "type"), "id")
    known = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("known")).where(F.size("known") >= 2)

    @F.pandas_udf("string")
    def ask(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in prompts:
            try:
                yield pd.Series(generate(series.tolist()), index=series.index, dtype=object)
            except Exception:  # noqa: BLE001  a failing service stands for an empty answer
                yield pd.Series("", index=series.index)

    asked = files.join(known, "path")
    dated = X.extract_date(F.col("path"), F.col("modified_at")).alias("date")
    answers = parsed_answers(asked.select("path", ask(prompt(F.col("content"), F.col("known"))).alias("response")))
    new = answers.select(F.inline("new_entities")).withColumn("key", F.lower("name")).groupBy("key").agg(F.min(F.struct("name", "type")).alias("e")).select("key", "e.*")
    new = new.join(stores.names(entities).select("key"), "key", "left_anti").withColumn("id", F.col("name"))
    for kind in ENTITY_TYPES:
        entities = entities.unionByName(_fresh(new.where(F.col("type") == kind), kind, today))
    names = stores.names(entities)
    rel = answers.join(files.select("path", dated), "path").select("path", "date", F.inline("relationships"))
    for end in ("source", "target"):
        rel = rel.withColumn("key", F.lower(end)).join(names.withColumnRenamed("id", f"{end}_id"), "key").drop("key")
    return entities, _log(rel.where("source_id <> target_id"), F.col("type"), "llm", F.col("confidence")), files.select("path")
