"""One object for all operations over a store of notes: tables below a folder, read and replaced as whole versions."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions.sql import register
from vaultspark.operators import explorer, extraction, fulltext, graph, hybrid, maintenance, stores, temporal, vectors
from vaultspark.operators.keyword_index import KeywordIndex
from vaultspark.schemas import SCHEMA_VERSION, TABLES
from vaultspark.sources import markdown
from vaultspark.sources.scratch import written


#: Commits whose versions of tables stay.
KEEP = 10


class Engine:
    """Search, graph and time operations over the tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str, people_dir: str | None = None, embedder: Callable[[Sequence[str]], list[list[float]]] = vectors.hash_embedder, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.root, self.people_dir, self.embedder, self.clock = spark, root.rstrip("/"), people_dir, embedder, clock
        self.versions: dict[str, str] = {}
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.graph: graph.Graph | None = None
        self._pending: dict[str, str] | None = None
        self.schema_version = self._upgraded()

    def _upgraded(self) -> int:
        """The store's schema version, once its tables have it: columns that an older one lacked are null."""
        marks = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        found = max((int(m.removeprefix("schema-")) for m in marks if m.startswith("schema-")), default=0)
        if found > SCHEMA_VERSION:
            raise ValueError(f"the store has schema {found}; this is {SCHEMA_VERSION}")
        if found < SCHEMA_VERSION:
            with self.transaction():
                for name, version in self._committed().items():
                    self.replace(name, self.spark.read.parquet(f"{self.root}/{name}/{version}"))
            self._fs.create(self._path(f"{self.root}/schema-{SCHEMA_VERSION}")).close()
        return SCHEMA_VERSION

    # --- tables ---------------------------------------------------------------------------------

    @property
    def now_ms(self) -> int:
        return int(self.clock() * 1000)

    @property
    def today(self) -> str:
        return time.strftime("%Y-%m-%d", time.gmtime(self.clock()))

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commits(self) -> list[str]:
        """Names of the commits, the oldest first."""
        there = self._path(f"{self.root}/commits")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(there) if s.getPath().getName().startswith("commit-")) if self._fs.exists(there) else []

    def _committed(self) -> dict[str, str]:
        """The version of each table that counts."""
        done = self._commits()
        return json.loads(self._read(f"{self.root}/commits/{done[-1]}")) if done else {}

    def _commit(self, versions: dict[str, str]) -> None:
        """Let these versions count, all at once, and remove those that the last KEEP commits don't name."""
        stamp = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        new, name = self._path(f"{self.root}/commits/new-{stamp}"), self._path(f"{self.root}/commits/commit-{stamp}")
        stream = self._fs.create(new)
        stream.write(bytearray(json.dumps(self._committed() | versions).encode()))
        stream.close()
        self._fs.rename(new, name)
        done = self._commits()
        for old in done[:-KEEP]:
            self._fs.delete(self._path(f"{self.root}/commits/{old}"), False)
        kept = [json.loads(self._read(f"{self.root}/commits/{c}")) for c in done[-KEEP:]]
        for table in versions:
            for old in self._fs.listStatus(self._path(f"{self.root}/{table}")):
                if old.getPath().getName() not in {v.get(table) for v in kept}:
                    self._fs.delete(old.getPath(), True)

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Tables replaced inside count together at its end, or not at all."""
        if self._pending is not None:
            yield  # part of the transaction around it
            return
        self._pending = {}
        try:
            yield
            if self._pending:
                self._commit(self._pending)
        finally:
            self._pending, self.graph = None, None

    def table(self, name: str) -> DataFrame:
        """The version of a table that counts; empty before the first."""
        schema, version = TABLES[name], (self._committed() | (self._pending or {})).get(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{version}") if version else self.spark.createDataFrame([], schema)

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """A new version of a table; it counts once it is whole, or when the transaction around ends. Those of the last KEEP commits stay, for those who still read them."""
        missing = {c: F.lit(None) for c in TABLES[name].names if c not in rows.columns}
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows.withColumns(missing).to(TABLES[name]).write.parquet(f"{self.root}/{name}/{version}")
        if self._pending is None:
            self._commit({name: version})
        else:
            self._pending[name] = version
        self.graph = None
        return self.table(name)

    def sql(self, text: str, args: Sequence[Any] | None = None) -> DataFrame:
        """A statement over the tables, as views, with positional parameters."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=list(args or []))

    # --- notes ----------------------------------------------------------------------------------

    def index(self, source: str | markdown.NoteSource, skip_dirs: Iterable[str] = (), force: bool = False) -> dict[str, int]:
        """Bring the files table and the keyword index up to date with a folder of notes, or another source of notes."""
        source = markdown.Folder(self.spark, source, skip_dirs) if isinstance(source, str) else source
        scanned, files = source.notes(), self.table("files")
        todo = written(maintenance.changed(scanned, files, force), "todo")
        counts = {"indexed": todo.count(), "deleted": maintenance.stale(files, scanned).count()}
        self._replace_files(maintenance.upserted(maintenance.without_stale(files, scanned), markdown.parse(todo), self.now_ms), todo.select("path"))
        return counts

    def index_notes(self, notes: DataFrame) -> None:
        """Take in some notes (path, modified_at, raw), whatever else the store holds."""
        notes = written(notes.select("path", "modified_at", "raw"), "todo")
        self._replace_files(maintenance.upserted(self.table("files"), markdown.parse(notes), self.now_ms), notes.select("path"))

    def remove(self, path: str) -> None:
        """Forget a note and its vectors; facts and relationships stay."""
        paths = self.spark.createDataFrame([(path,)], "path string")
        self._replace_files(maintenance.removed(self.table("files"), self.table("embeddings"), paths)[0], paths)

    def rename(self, old: str, new: str) -> None:
        renames = self.spark.createDataFrame([(old, new)], "old_path string, path string")
        self._replace_files(maintenance.renamed(self.table("files"), renames), renames.select("path"))

    def _replace_files(self, files: DataFrame, touched: DataFrame) -> None:
        """A new files table; the rows of ``touched`` paths go to the keyword index, and what is gone leaves it and the vectors."""
        before = self.table("files").select("id")
        with self.transaction():
            files = self.replace("files", files)
            live = files.select("id")
            self.replace("embeddings", self.table("embeddings").join(live.withColumnRenamed("id", "file_id"), "file_id", "left_semi"))
        index = self.keywords
        index.update(files if not index.segments() else files.join(touched, "path", "left_semi"), before.join(live, "id", "left_anti"))
        if len(index.segments()) > KEEP:
            index.compact()

    def embed(self, force: bool = False, progress: Callable[[int], None] | None = None) -> int:
        """Embed what is stale; ``progress`` hears 0 before and 100 after, or -1 if the embedder failed."""
        if progress:
            progress(0)
        try:
            files, rows = vectors.reembedded(self.table("files"), self.table("embeddings"), self.now_ms, self.embedder, force)
            with self.transaction():
                done = self.replace("embeddings", rows)
                self.replace("files", files)
        except Exception:
            if progress:
                progress(-1)
            raise
        if progress:
            progress(100)
        return done.count()

    def extract(self, force: bool = False, limit: int | None = None) -> dict[str, int]:
        """Entities, relationships, evidence and facts of the notes that changed, by the rules."""
        files = self.table("files")
        todo = maintenance.to_extract(files, force=force, limit=limit)
        entities, seen, facts = extraction.extract(todo, self.table("entities"), self.people_dir, self.today)
        return self._learn(entities, seen, facts, todo, "graph_extracted_at")

    def extract_with_model(self, generate: Callable[[Sequence[str]], list[str]], force: bool = False, limit: int | None = None) -> dict[str, int]:
        files = self.table("files").where("graph_extracted_at is not null")
        todo = maintenance.to_extract(files, "llm_extracted_at", force, limit)
        entities, seen, done = extraction.extract_with_model(todo, self.table("entities"), generate, self.today)
        return self._learn(entities, seen, self.table("facts").limit(0), done, "llm_extracted_at")

    def _learn(self, entities: DataFrame, seen: DataFrame, facts: DataFrame, done: DataFrame, stamp: str) -> dict[str, int]:
        seen, facts, done = written(seen, "seen"), written(facts, "facts"), written(done.select("path"), "done")
        with self.transaction():
            entities = self.replace("entities", entities)
            rel = self.replace("relationships", stores.merged_relationships(self.table("relationships"), seen, entities, self.today))
            proof, known = self.table("relationship_evidence"), ["relationship_id", "source_file"]
            more = stores.evidence_log(seen).withColumn("extracted_at", F.timestamp_millis(F.lit(self.now_ms)))
            more = more.join(proof.select(*known), known, "left_anti").withColumn("id", F.xxhash64(*known))
            self.replace("relationship_evidence", proof.unionByName(more.to(proof.schema)))
            told = self.replace("facts", stores.added_facts(self.table("facts"), facts.withColumn("seq", F.lit(0)), self.today))
            self.replace("files", maintenance.stamped(self.table("files"), done, stamp, self.now_ms))
        return {"entities": entities.count(), "relationships": rel.count(), "facts": told.count(), "files": done.count()}

    # --- search ---------------------------------------------------------------------------------

    @property
    def keywords(self) -> KeywordIndex:
        """The stored keyword index of the files."""
        return KeywordIndex(self.spark, f"{self.root}/keywords", fulltext.FILE_COLUMNS, fulltext.FILE_KEPT)

    def search(self, query: str, limit: int = 20, **filters: Any) -> DataFrame:
        return fulltext.search_files(self.keywords, query, limit, ("<mark>", "</mark>"), self.table("files"), **filters)

    def semantic_search(self, query: str, k: int = 10) -> DataFrame:
        return vectors.semantic_search(self.table("embeddings"), self.table("files"), self.embedder([query])[0], k)

    def hybrid_search(self, query: str, limit: int = 10, allow_keyword_only: bool = False, **filters: Any) -> DataFrame:
        if not allow_keyword_only and self.table("embeddings").isEmpty():
            raise ValueError("no vectors; embed the notes first, or allow keywords alone")
        return hybrid.hybrid_search(self.keywords, self.table("embeddings"), self.embedder([query])[0], query, limit, files=self.table("files"), **filters)

    def find_similar(self, path: str, k: int = 10) -> DataFrame:
        return vectors.similar_files(self.table("embeddings"), self.table("files"), path, k)

    def backlinks(self, title: str, compat: bool = False) -> DataFrame:
        return fulltext.backlinks(self.table("files"), title, compat)

    def search_conversations(self, query: str | None = None, since: str | None = None, until: str | None = None, limit: int = 10) -> DataFrame:
        return stores.search_conversations(self.table("conversations"), query, since, until, limit)

    def add_conversations(self, texts: Sequence[str]) -> int:
        """Take in conversation records as JSON texts, perhaps fenced; those that can't be read or lack a field are left out, and a session's first record stays."""
        rows = self.spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "value string, seq long")
        new = stores.conversation_records(rows).withColumns({"id": F.xxhash64("session_id"), "recorded_at": F.lit(self.now_ms)})
        return self.replace("conversations", stores.added_conversations(self.table("conversations"), new)).count()

    # --- entities -------------------------------------------------------------------------------

    def search_entities(self, query: str, kind: str | None = None) -> DataFrame:
        return stores.search_entities_or_id(self.table("entities"), query, kind)

    def relationships(self, entity_id: str) -> DataFrame:
        return stores.relationship_listing(self.table("relationships"), self.table("entities"), entity_id)

    def facts(self, **filters: Any) -> DataFrame:
        return temporal.fact_timeline(stores.query_facts(self.table("facts"), **filters), self.table("entities"))

    def detail(self, entity_id: str) -> dict[str, DataFrame]:
        """An entity, its heaviest 20 relationships, its latest 10 facts, and the latest fact of each type."""
        facts = stores.facts_about(self.table("facts"), entity_id)
        return {
            "entity": stores.entity(self.table("entities"), entity_id),
            "relationships": stores.relationship_listing(self.table("relationships"), self.table("entities"), entity_id).orderBy(F.desc("weight"), "other_id").limit(20),
            "facts": stores.query_facts(self.table("facts"), entity_id, limit=10),
            "latest": stores.first_per(facts, ["type"], [F.desc("recorded_at"), F.asc("id")]),
        }

    # --- graph and time -------------------------------------------------------------------------

    def load_graph(self, **filters: Any) -> graph.Graph:
        if filters:
            return graph.load(self.table("entities"), self.table("relationships"), **filters).stored()
        if self.graph is None:
            self.graph = graph.load(self.table("entities"), self.table("relationships")).stored()
        return self.graph

    def path(self, start: str, goal: str, max_hops: int = 6) -> DataFrame:
        g = self.load_graph()
        return graph.path_export(g, graph.shortest_path(g, start, goal, max_hops))

    def neighborhood(self, centre: str, max_hops: int = 2, min_weight: float = 0.0) -> tuple[DataFrame, DataFrame]:
        return graph.neighborhood_export(self.load_graph(), centre, max_hops, min_weight)

    def analyse(self, what: str, limit: int = 20, sample: int | None = None, **filters: Any) -> DataFrame:
        """importance, communities, centrality or stats; ``sample`` bounds the sources of betweenness."""
        g = self.load_graph(**filters)
        if what == "importance":
            return graph.importance(g, self.table("entities"), self.today, graph.betweenness(g, sample)).orderBy("rank").limit(limit)
        if what == "communities":
            return graph.community_members(g).limit(limit)
        if what == "centrality":
            return graph.top_degrees(g, limit)
        if what == "stats":
            return graph.stats(g)
        raise ValueError(f"unknown analysis {what!r}")

    def suggest(self, what: str, entity_id: str | None = None, limit: int = 10) -> DataFrame:
        """missing, fading or emerging links."""
        if what == "missing":
            return graph.missing_links(self.load_graph(), entity_id, limit=limit)
        links = {"fading": graph.fading_links, "emerging": graph.emerging_links}[what]
        return links(self.table("relationships"), self.today, entity_id, limit=limit)

    def export_graph(self, kind: str | None = None, rel_type: str | None = None) -> tuple[DataFrame, DataFrame]:
        return graph.export(self.table("entities"), self.table("relationships"), kind, rel_type)

    def timeline(self, a: str, b: str) -> DataFrame:
        return temporal.relationship_timeline(self.table("relationships"), self.table("relationship_evidence"), a, b)

    def activity(self, entity_id: str, granularity: str = "month") -> DataFrame:
        return temporal.entity_activity(self.table("facts"), self.table("relationships"), self.table("relationship_evidence"), entity_id, granularity)

    def trends(self, window_days: int = 30) -> DataFrame:
        return temporal.trends(self.table("facts"), self.table("entities"), self.today, window_days)

    def temporal(self, kind: str = "trends", entity_id: str | None = None, other_id: str | None = None, granularity: str = "month", window_days: int = 30, **filters: Any) -> DataFrame:
        """relationship (of two entities), activity (of one), facts or trends."""
        if kind == "relationship":
            return self.timeline(entity_id or "", other_id or "")
        if kind == "activity":
            return self.activity(entity_id or "", granularity)
        if kind == "facts":
            return self.facts(entity_id=entity_id, **filters)
        if kind == "trends":
            return self.trends(window_days)
        raise ValueError(f"unknown kind {kind!r}")

    # --- the store ------------------------------------------------------------------------------

    def stats(self) -> DataFrame:
        return explorer.counts({name: self.table(name) for name in ("files", "embeddings", "entities", "relationships", "facts")})

    def page(self, name: str, **how: Any) -> tuple[DataFrame, int]:
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        return explorer.page(self.table(name), **how)

    def catalog(self) -> DataFrame:
        """table, rows, column, position, type and nullable of every column of the store."""
        return explorer.catalog({name: self.table(name) for name in TABLES})

    def keep_vectors(self, mode: str = "auto", limit_mb: int = vectors.AUTO_LOAD_MB) -> bool:
        """Whether the vectors are worth keeping in memory: always, never, or up to a limit."""
        return vectors.should_load(self.table("embeddings"), mode, limit_mb)

    def healthy(self) -> bool:
        """Whether the embedder answers."""
        try:
            return len(self.embedder(["ping"])[0]) > 0
        except Exception:  # noqa: BLE001  whatever a service throws
            return False

    def register_functions(self) -> list[str]:
        """Make the engine's expressions known to SQL; their names."""
        return register(self.spark)
