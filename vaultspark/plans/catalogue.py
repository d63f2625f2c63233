"""The registered queries of the notes engine and their SQL.

Every query reads whole tables; limits are those of top-k reports, pages and lookups by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import scores as S
from vaultspark.functions import text as X
from vaultspark.operators import explorer, extraction, fulltext, graph, hybrid, maintenance, stores, temporal, vectors
from vaultspark.operators.keyword_index import KeywordIndex
from vaultspark.plans import oracles as O
from vaultspark.sources import tables as T
from vaultspark.sources.scratch import root, swept, written
from vaultspark.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERY_VECTOR = [round(((i * 37) % 64 - 31.5) / 32, 4) for i in range(64)]
_VECTOR_SQL = f"CAST({QUERY_VECTOR} AS DOUBLE[])"


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable:
    """Register a query and its SQL; the ``dates`` columns become text in both."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(s: SparkSession, d: str) -> DataFrame:
            return f(s, d).withColumns({c: F.col(c).cast("string") for c in dates})

        QUERIES[f.__name__] = run if dates else f
        if sql is not None:
            text = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return f

    return add


def r6(name: str) -> F.Column:
    return F.round(name, 6).alias(name)


# --- statistics and browsing ----------------------------------------------------------------------


@query(f"""WITH {O.FILES}, {O.VECTORS}, {O.ENTITIES}, {O.RELATIONS}, {O.FACTS}
SELECT 'files' AS "table", count(*) AS rows FROM files UNION ALL SELECT 'embeddings', count(*) FROM vectors UNION ALL SELECT 'entities', count(*) FROM ent
UNION ALL SELECT 'relationships', count(*) FROM rel UNION ALL SELECT 'facts', count(*) FROM fact""")
def stats_counts(s: SparkSession, d: str) -> DataFrame:
    return explorer.counts({"files": T.files(s, d), "embeddings": T.embeddings(s, d), "entities": T.entities(s, d), "relationships": T.relationships(s, d), "facts": T.facts(s, d)})


@query(f"WITH {O.FILES} SELECT directory AS name, count(*) AS count FROM files GROUP BY 1")
def stats_directories(s: SparkSession, d: str) -> DataFrame:
    return explorer.by_group(T.files(s, d), "directory")


@query(f"WITH {O.ENTITIES} SELECT type AS name, count(*) AS count FROM ent GROUP BY 1")
def stats_entity_types(s: SparkSession, d: str) -> DataFrame:
    return explorer.by_group(T.entities(s, d), "type")


@query(f"WITH {O.FILES} SELECT directory AS name, count(*) AS count, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def stats_distribution(s: SparkSession, d: str) -> DataFrame:
    return explorer.distribution(T.files(s, d), "directory").withColumn("share", r6("share"))


@query(f"""WITH {O.FILES} SELECT id, path, CASE WHEN length(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END AS content
FROM files ORDER BY path DESC LIMIT 50 OFFSET 25""")
def explorer_page(s: SparkSession, d: str) -> DataFrame:
    return explorer.page(T.files(s, d).select("id", "path", "content"), "path", descending=True, limit=50, offset=25)[0]


# --- keyword search -------------------------------------------------------------------------------

_FTS = ["title", "content", "array_to_string(tags, ' ')"]


_indexes: dict[tuple, KeywordIndex] = {}


def _index(s: SparkSession, d: str) -> KeywordIndex:
    """The stored keyword index of the files, made when it is first asked for; made anew if their table has changed."""
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    fs = path.getFileSystem(s._jsc.hadoopConfiguration())
    parts = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))
    key = (s.sparkContext.applicationId, d, parts)
    if key not in _indexes:
        _indexes[key] = KeywordIndex(s, f"{root(s)}/keywords-{uuid.uuid4().hex}", fulltext.FILE_COLUMNS, fulltext.FILE_KEPT).update(T.files(s, d))
    return _indexes[key]


@query(f"WITH {O.FILES} SELECT count(*) AS rows, round(avg(len({O.words('title')}) + len({O.words('content')}) + len({O.words(_FTS[2])})), 6) AS mean FROM files")
def fts_index(s: SparkSession, d: str) -> DataFrame:
    """Makes a new index of all files in two segments, the later one for every third file once more, and brings them into one."""
    index = KeywordIndex(s, f"{root(s)}/keywords-{uuid.uuid4().hex}", fulltext.FILE_COLUMNS, fulltext.FILE_KEPT)
    files = T.files(s, d)
    index.update(files.withColumn("content", F.when(F.col("id") % 3 == 0, F.lit("an older text")).otherwise(F.col("content"))))
    index.update(files.where("id % 3 = 0")).compact()
    return s.read.parquet(f"{index.root}/{index.segments()[-1]}/totals").select(F.col("rows").cast("long").alias("rows"), r6("mean"))


@query(O.bm25(O.FILES, _FTS, [O.word("the"), O.word("with")], "h0 > 0 AND h1 > 0", "ORDER BY round(score, 12), path LIMIT 10", "path, title, directory, round(score, 6) AS score"))
def fts_bm25_top10(s: SparkSession, d: str) -> DataFrame:
    return fulltext.search_files(_index(s, d), "the with", 10).select("path", "title", "directory", r6("score"))


@query(O.bm25(O.FILES, _FTS, [O.word("the"), O.word("with")], "h0 > 0 AND h1 > 0", "", "path, round(score, 6) AS score"))
def fts_bm25_all(s: SparkSession, d: str) -> DataFrame:
    return fulltext.match(_index(s, d), fulltext.FILE_COLUMNS, "the AND with").select("path", r6("score"))


@query(O.bm25(O.FILES, _FTS, [O.word("the"), O.word("of")], "h0 > 0 AND h1 > 0 AND directory = 'src3' AND list_contains(tags, 'en') AND modified_at >= 1704067260000",
              "ORDER BY round(score, 12), path LIMIT 20", "path, title, directory, round(score, 6) AS score"))
def fts_bm25_dir_tag(s: SparkSession, d: str) -> DataFrame:
    found = fulltext.search_files(_index(s, d), "the of", 20, directory="src3", tag="EN", since=1704067260000)
    return found.select("path", "title", "directory", r6("score"))


@query(O.bm25(O.FILES, _FTS, [O.pair("of", "the")], "h0 > 0", "", "path, round(score, 6) AS score"))
def fts_phrase(s: SparkSession, d: str) -> DataFrame:
    return fulltext.match(_index(s, d), fulltext.FILE_COLUMNS, '"of the"').select("path", r6("score"))


@query(O.bm25(O.FILES, _FTS, [O.prefix("thou")], "h0 > 0", "", "path, round(score, 6) AS score"))
def fts_prefix(s: SparkSession, d: str) -> DataFrame:
    return fulltext.match(_index(s, d), fulltext.FILE_COLUMNS, "thou*").select("path", r6("score"))


@query(O.bm25(O.FILES, _FTS, [O.word("the"), O.word("und"), O.word("of")], "(h0 > 0 OR h1 > 0) AND NOT h2 > 0", "", "path, round(score, 6) AS score").replace("h2 * CAST(2.2", "0 * CAST(2.2"))
def fts_not(s: SparkSession, d: str) -> DataFrame:
    return fulltext.match(_index(s, d), fulltext.FILE_COLUMNS, "(the OR und) NOT of").select("path", r6("score"))


@query(O.bm25(O.FILES, _FTS[:1], [O.word("7")], "h0 > 0", "", "path").replace("SELECT path FROM", "SELECT path FROM"))
def fts_column(s: SparkSession, d: str) -> DataFrame:
    return fulltext.match(_index(s, d), fulltext.FILE_COLUMNS, "title:7").select("path")


@query(f"""WITH {O.FILES}, t AS (SELECT path, {O.words("content")} AS w FROM files),
a AS (SELECT path, i FROM (SELECT path, w, unnest(range(1, len(w) + 1)) AS i FROM t) WHERE w[i] = 'the'),
b AS (SELECT path, i FROM (SELECT path, w, unnest(range(1, len(w) + 1)) AS i FROM t) WHERE w[i] = 'with')
SELECT DISTINCT a.path FROM a JOIN b ON a.path = b.path AND abs(a.i - b.i) <= 3""")
def fts_near(s: SparkSession, d: str) -> DataFrame:
    return fulltext.match(_index(s, d), fulltext.FILE_COLUMNS, "content:NEAR(the with, 2)").select("path")


@query()
def snippet(s: SparkSession, d: str) -> DataFrame:
    return fulltext.search_files(_index(s, d), "the with", 10, (">>>", "<<<"), T.files(s, d)).select("path", "snippet")


@query(f"WITH {O.FILES} SELECT path, title FROM files WHERE list_contains(wiki_links, 'doc-5')")
def backlinks(s: SparkSession, d: str) -> DataFrame:
    return fulltext.backlinks(T.files(s, d), "doc-5")


@query(f"WITH {O.FILES} SELECT path, title FROM files WHERE array_to_string(wiki_links, ',') LIKE '%doc-5%'")
def backlinks_compat(s: SparkSession, d: str) -> DataFrame:
    return fulltext.backlinks(T.files(s, d), "DOC-5", compat=True)


@query(O.bm25(O.TALKS, ["summary", "topics", "outcome"], [O.word("the"), O.word("user")], "h0 > 0 AND h1 > 0 AND date >= '2024-01-10' AND date <= '2024-09-30 99:99'",
              "ORDER BY round(score, 12), id LIMIT 10", "id, session_id, date, round(score, 6) AS score"))
def conversation_search(s: SparkSession, d: str) -> DataFrame:
    return stores.search_conversations(T.conversations(s, d), "the user", "2024-01-10", "2024-09-30").select("id", "session_id", "date", r6("score"))


@query(f"WITH {O.TALKS} SELECT id, session_id, date, summary, topics, outcome FROM talks WHERE date <= '2024-06-01 99:99' ORDER BY date DESC, id LIMIT 10")
def conversation_recent(s: SparkSession, d: str) -> DataFrame:
    return stores.search_conversations(T.conversations(s, d), until="2024-06-01").drop("next_actions")


# --- vectors and fusion ---------------------------------------------------------------------------


@query(f"WITH {O.VECTORS} SELECT id, file_id, heading, round({O.cosine('embedding', _VECTOR_SQL)}, 6) AS score FROM vectors ORDER BY {O.cosine('embedding', _VECTOR_SQL)} DESC, id LIMIT 10")
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return vectors.top_chunks(T.embeddings(s, d), QUERY_VECTOR).select("id", "file_id", "heading", r6("score"))


@query(f"""WITH {O.VECTORS}, top AS (SELECT *, {O.cosine('embedding', _VECTOR_SQL)} AS score FROM vectors ORDER BY score DESC, id LIMIT 30)
SELECT file_id, round(max(score), 6) AS score, first(heading ORDER BY score DESC, id) AS heading, first(id ORDER BY score DESC, id) AS chunk_id FROM top GROUP BY file_id""")
def vector_best_chunk(s: SparkSession, d: str) -> DataFrame:
    return vectors.best_chunk_per_file(vectors.top_chunks(T.embeddings(s, d), QUERY_VECTOR, 30)).withColumn("score", r6("score"))


@query(f"""WITH {O.FILES}, {O.VECTORS}, own AS (SELECT id FROM files WHERE path = (SELECT path FROM files WHERE id = 3)),
c AS (SELECT list(x ORDER BY pos) AS centroid FROM (SELECT pos, avg(embedding[pos]) AS x FROM vectors, range(1, 65) r(pos) WHERE file_id IN (SELECT id FROM own) GROUP BY pos)),
m AS (SELECT file_id, avg({O.cosine('embedding', 'centroid')}) AS score FROM vectors, c WHERE file_id NOT IN (SELECT id FROM own) GROUP BY 1)
SELECT path, title, round(score, 6) AS score FROM m LEFT JOIN files f ON f.id = m.file_id ORDER BY m.score DESC, path LIMIT 10""")
def vector_similar_files(s: SparkSession, d: str) -> DataFrame:
    files = T.files(s, d)
    path = files.where("id = 3").select("path").first()[0]
    return vectors.similar_files(T.embeddings(s, d), files, path).withColumn("score", r6("score"))


@query(f"WITH {O.VECTORS} SELECT CAST(sum(len(embedding) * 8) AS BIGINT) AS bytes, count(*) AS vectors FROM vectors WHERE embedding IS NOT NULL")
def vector_bytes(s: SparkSession, d: str) -> DataFrame:
    return vectors.vector_bytes(T.embeddings(s, d))


@query(f"""WITH {O.FILES}, {O.VECTORS}, top AS (SELECT *, {O.cosine('embedding', _VECTOR_SQL)} AS cos FROM vectors ORDER BY cos DESC, id LIMIT 10)
SELECT coalesce(f.path, '') AS path, coalesce(f.title, '') AS title, heading, chunk_text, round(cos, 3) AS score, top.id AS id FROM top LEFT JOIN files f ON f.id = top.file_id""")
def semantic_search(s: SparkSession, d: str) -> DataFrame:
    return vectors.semantic_search(T.embeddings(s, d), T.files(s, d), QUERY_VECTOR)


def _hybrid_sql(words_where: str, near_where: str) -> str:
    text = O.bm25(O.FILES, _FTS, [O.word("the"), O.word("with")], f"h0 > 0 AND h1 > 0 {words_where}", "", "*")
    ctes, _, _ = text.rpartition("SELECT * FROM scored")
    return f"""{ctes.rstrip()}, {O.VECTORS},
w AS (SELECT path, title, directory, row_number() OVER (ORDER BY round(score, 12), path) AS wr FROM (SELECT * FROM scored ORDER BY round(score, 12), path LIMIT 30)),
tv AS (SELECT *, {O.cosine('embedding', _VECTOR_SQL)} AS cos FROM vectors ORDER BY cos DESC, id LIMIT 30),
bv AS (SELECT file_id, max(cos) AS cos, first(heading ORDER BY cos DESC, id) AS heading FROM tv GROUP BY 1),
v AS (SELECT path, title, directory, heading, row_number() OVER (ORDER BY cos DESC, path) AS vr FROM bv JOIN files f ON f.id = bv.file_id {near_where})
SELECT coalesce(w.path, v.path) AS path, coalesce(w.title, v.title) AS title, coalesce(w.directory, v.directory) AS directory,
  round(coalesce(CAST(1 AS DOUBLE) / (60 + wr), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + vr), 0), 6) AS rrf,
  CASE WHEN wr IS NOT NULL AND vr IS NOT NULL THEN 'both' WHEN wr IS NOT NULL THEN 'fts' ELSE 'vec' END AS sources, heading
FROM w FULL JOIN v ON w.path = v.path ORDER BY coalesce(CAST(1 AS DOUBLE) / (60 + wr), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + vr), 0) DESC, coalesce(w.path, v.path) LIMIT 10"""


@query(_hybrid_sql("", ""))
def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    found = hybrid.hybrid_search(_index(s, d), T.embeddings(s, d), QUERY_VECTOR, "the with", files=T.files(s, d))
    return found.select("path", "title", "directory", r6("rrf"), "sources", "heading")


@query(_hybrid_sql("AND directory = 'src2' AND list_contains(tags, 'en')", "WHERE directory = 'src2' AND list_contains(tags, 'en')"))
def hybrid_rrf_filtered(s: SparkSession, d: str) -> DataFrame:
    found = hybrid.hybrid_search(_index(s, d), T.embeddings(s, d), QUERY_VECTOR, "the with", directory="src2", tag="en", files=T.files(s, d))
    return found.select("path", "title", "directory", r6("rrf"), "sources", "heading")


@query()
def chunks(s: SparkSession, d: str) -> DataFrame:
    return vectors.chunks(T.notes(s, d).withColumnRenamed("raw", "content"), 1000)


# --- stores ---------------------------------------------------------------------------------------


@query(f"WITH {O.ENTITIES} SELECT id, type, name, mention_count, last_seen FROM ent WHERE name ILIKE '%00001%' OR array_to_string(aliases, ',') ILIKE '%00001%' OR id ILIKE '%00001%' ORDER BY id LIMIT 20", dates=("last_seen",))
def entity_search(s: SparkSession, d: str) -> DataFrame:
    return stores.search_entities(T.entities(s, d), "00001").drop("aliases")


@query(f"WITH {O.ENTITIES} SELECT id, type, name FROM ent WHERE lower(name) = 'supplier no 3' OR list_contains(aliases, 'supplier no 3') ORDER BY id LIMIT 1")
def entity_by_name(s: SparkSession, d: str) -> DataFrame:
    return stores.entity_by_name(T.entities(s, d), "Supplier NO 3").select("id", "type", "name")


@query(f"""WITH {O.ENTITIES} SELECT key, first(id ORDER BY p, id) AS id FROM (SELECT lower(name) AS key, 0 AS p, id FROM ent
UNION ALL SELECT lower(unnest(aliases)), 1, id FROM ent) WHERE key <> '' GROUP BY key""")
def entity_names(s: SparkSession, d: str) -> DataFrame:
    return stores.names(T.entities(s, d))


@query(f"""WITH {O.RELATIONS} SELECT source_id, target_id, type, round(weight, 6) AS weight, seen_count, last_seen FROM rel
WHERE source_id = 'supplier-1' OR target_id = 'supplier-1'""", dates=("last_seen",))
def entity_relationships(s: SparkSession, d: str) -> DataFrame:
    return stores.relationships_of(T.relationships(s, d), "supplier-1").select("source_id", "target_id", "type", r6("weight"), "seen_count", "last_seen")


@query(f"""WITH {O.RELATIONS}, {O.ENTITIES} SELECT CASE WHEN source_id = 'supplier-1' THEN 'out' ELSE 'in' END AS direction, rel.type AS type,
  CASE WHEN source_id = 'supplier-1' THEN target_id ELSE source_id END AS other_id, coalesce(ent.name, CASE WHEN source_id = 'supplier-1' THEN target_id ELSE source_id END) AS other, seen_count
FROM rel LEFT JOIN ent ON ent.id = CASE WHEN source_id = 'supplier-1' THEN target_id ELSE source_id END WHERE source_id = 'supplier-1' OR target_id = 'supplier-1'""")
def entity_relationship_listing(s: SparkSession, d: str) -> DataFrame:
    return stores.relationship_listing(T.relationships(s, d), T.entities(s, d), "supplier-1").drop("weight")


@query(f"WITH {O.RELATIONS} SELECT source_id, target_id, type, seen_count, last_seen, round(weight, 6) AS weight FROM rel", dates=("last_seen",))
def relationship_weights(s: SparkSession, d: str) -> DataFrame:
    rel = T.relationships(s, d).withColumn("weight", F.lit(0.0))
    return stores.reweighted(rel, T.AS_OF_TRADE).select("source_id", "target_id", "type", "seen_count", "last_seen", r6("weight"))


def _observation_log(s: SparkSession, d: str) -> DataFrame:
    seq = F.xxhash64("source_file", "target_id", "day")
    return T.observations(s, d).select(seq.alias("seq"), "source_id", "target_id", "type", F.lit(None).cast("string").alias("context"), "source_file", F.lit(0.5).alias("confidence"), F.lit("rule").alias("extraction_method"), F.col("day").alias("observed_on"))


@query(f"WITH {O.RELATIONS} SELECT source_id, target_id, type, seen_count, last_seen, CAST(0.5 AS DOUBLE) AS confidence, round(CAST(0.5 AS DOUBLE) * weight, 6) AS weight FROM rel", dates=("last_seen",))
def relationship_consolidate(s: SparkSession, d: str) -> DataFrame:
    found = stores.consolidated(_observation_log(s, d), as_of=T.AS_OF_TRADE)
    return found.select("source_id", "target_id", "type", "seen_count", "last_seen", "confidence", r6("weight"))


@query(f"WITH {O.OBSERVED} SELECT source_file, min(day) AS extracted_at, count(*) AS n FROM (SELECT DISTINCT source_id, target_id, type, source_file, day FROM observed) GROUP BY source_file", dates=("extracted_at",))
def relationship_evidence(s: SparkSession, d: str) -> DataFrame:
    return stores.evidence_log(_observation_log(s, d)).groupBy("source_file").agg(F.min("extracted_at").alias("extracted_at"), F.count("*").alias("n"))


@query(f"WITH {O.FACTS} SELECT id, type, content, recorded_at FROM fact WHERE list_contains(entity_ids, 'user-7') ORDER BY recorded_at DESC, id LIMIT 50", dates=("recorded_at",))
def facts_by_entity(s: SparkSession, d: str) -> DataFrame:
    return stores.query_facts(T.facts(s, d), "user-7").select("id", "type", "content", "recorded_at")


@query(f"""WITH {O.FACTS} SELECT id, type, content, recorded_at FROM fact WHERE type = 'purchase' AND array_to_string(entity_ids, ',') LIKE '%user-1%'
AND recorded_at BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY recorded_at DESC, id LIMIT 200""", dates=("recorded_at",))
def facts_timeline(s: SparkSession, d: str) -> DataFrame:
    return stores.query_facts(T.facts(s, d), "user-1", "purchase", "2024-01-05", "2024-01-20", 200, compat=True).select("id", "type", "content", "recorded_at")


@query(f"""WITH {O.FACTS}, stored AS (SELECT * FROM fact WHERE id % 2 = 0), new AS (SELECT type, content, source_file, min(id) AS id FROM fact f GROUP BY ALL)
SELECT id, type, content, source_file FROM stored UNION ALL SELECT id, type, content, source_file FROM new
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.type = new.type AND s.content = new.content AND s.source_file = new.source_file)""")
def fact_dedup(s: SparkSession, d: str) -> DataFrame:
    """All facts come once more; those with an even id are stored."""
    facts = T.facts(s, d).withColumn("valid_until", F.lit(None).cast("date"))
    return stores.added_facts(facts.where("id % 2 = 0"), facts.withColumn("seq", F.col("id")), T.AS_OF_FACTS).select("id", "type", "content", "source_file")


@query(f"WITH {O.FACTS} SELECT e AS id, count(*) AS mention_count, max(recorded_at) AS last_seen FROM (SELECT unnest(entity_ids) AS e, recorded_at FROM fact) GROUP BY 1", dates=("last_seen",))
def mention_rollup(s: SparkSession, d: str) -> DataFrame:
    each = T.facts(s, d).select(F.explode("entity_ids").alias("id"), F.col("recorded_at").alias("date"))
    known = each.select("id").distinct().withColumns({"mention_count": F.lit(0).cast("long"), "last_seen": F.lit(None).cast("date")})
    return stores.mentioned(known, each)


# --- time -----------------------------------------------------------------------------------------


@query(f"""WITH {O.OBSERVED} SELECT strftime(min(day), '%Y-%m-%d') AS date, source_file FROM observed
WHERE (source_id = 'supplier-1' AND target_id LIKE 'nation-%') OR (target_id = 'supplier-1' AND source_id = 'customer-1') GROUP BY source_id, target_id, type, source_file""")
def relationship_timeline(s: SparkSession, d: str) -> DataFrame:
    rel, seen = T.relationships(s, d), T.evidence(s, d)
    nation = rel.where("source_id = 'supplier-1' and type = 'belongs-to'").agg(F.max("target_id")).first()[0]  # a supplier is in one nation
    found = [temporal.relationship_timeline(rel, seen, "supplier-1", other) for other in ("customer-1", nation or "")]
    return found[0].unionByName(found[1]).select("date", "source_file")


def _activity_sql(label: str) -> str:
    return f"""WITH {O.FACTS}, {O.OBSERVED}, f AS (SELECT {label.replace('@', 'recorded_at')} AS period, count(*) AS n FROM fact WHERE list_contains(entity_ids, 'user-7') GROUP BY 1),
e AS (SELECT {label.replace('@', 'day')} AS period, count(*) AS m FROM (SELECT source_id, target_id, type, source_file, min(day) AS day FROM observed
  WHERE source_id = 'user-7' OR target_id = 'user-7' GROUP BY ALL) GROUP BY 1)
SELECT coalesce(f.period, e.period) AS period, coalesce(n, 0) AS mention_count, coalesce(n, 0) AS facts_recorded, coalesce(m, 0) AS new_relationships FROM f FULL JOIN e ON f.period = e.period"""


_WEEK = "strftime(@, '%Y') || '-W' || lpad(CAST((date_diff('day', CAST(date_trunc('year', @) AS DATE), @) // 7) + 1 AS VARCHAR), 2, '0')"


def _activity(granularity: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: temporal.entity_activity(T.facts(s, d), T.relationships(s, d), T.evidence(s, d), "user-7", granularity)


for _name, _label in (("day", "strftime(@, '%Y-%m-%d')"), ("week", _WEEK), ("month", "strftime(@, '%Y-%m')")):
    QUERIES[f"activity_{_name}"], ORACLES[f"activity_{_name}"] = _activity(_name), _activity_sql(_label)


@query(f"""WITH {O.OBSERVED} SELECT {_WEEK.replace('@', 'day')} AS period, count(*) AS new_relationships FROM (
  SELECT source_id, target_id, type, source_file, min(day) AS day FROM observed WHERE source_id = 'supplier-1' OR target_id = 'supplier-1' GROUP BY ALL) GROUP BY 1""")
def activity_supplier_week(s: SparkSession, d: str) -> DataFrame:
    return temporal.entity_activity(T.facts(s, d), T.relationships(s, d), T.evidence(s, d), "supplier-1", "week").select("period", "new_relationships")


def _users(s: SparkSession, d: str) -> DataFrame:
    return T.facts(s, d).select(F.explode("entity_ids").alias("id")).distinct().where("id <> 'user-3'").withColumns({"name": F.upper("id"), "type": F.split("id", "-")[0]})


@query(f"""WITH {O.FACTS}, e AS (SELECT unnest(entity_ids) AS id, recorded_at FROM fact),
c AS (SELECT id, count(*) FILTER (recorded_at >= DATE '2024-01-31' - 10) AS recent, count(*) FILTER (recorded_at < DATE '2024-01-31' - 10) AS previous
  FROM e WHERE recorded_at >= DATE '2024-01-31' - 20 AND id <> 'user-3' GROUP BY id),
x AS (SELECT *, CAST(recent AS DOUBLE) AS r, CAST(previous AS DOUBLE) AS p FROM c)
SELECT id, upper(id) AS name, split_part(id, '-', 1) AS type, recent, previous,
  CASE WHEN p = 0 AND r > 0 THEN 'emerging' WHEN r > CAST(1.5 AS DOUBLE) * p AND r >= 3 THEN 'emerging' WHEN p > 0 AND r < CAST(0.5 AS DOUBLE) * p THEN 'fading' ELSE 'stable' END AS trend,
  round(CASE WHEN p = 0 AND r > 0 THEN r WHEN r > CAST(1.5 AS DOUBLE) * p AND r >= 3 THEN r / p WHEN p > 0 AND r < CAST(0.5 AS DOUBLE) * p THEN CASE WHEN r > 0 THEN p / r ELSE p END ELSE r + p END, 6) AS metric FROM x""")
def trends(s: SparkSession, d: str) -> DataFrame:
    return temporal.trends(T.facts(s, d), _users(s, d), T.AS_OF_FACTS, 10).withColumn("metric", r6("metric"))


# --- graph ----------------------------------------------------------------------------------------


def _graph(s: SparkSession, d: str) -> graph.Graph:
    return graph.load(T.entities(s, d), T.relationships(s, d))


@query(f"WITH {O.GRAPH} SELECT src, dst, round(weight, 6) AS weight, types FROM edges")
def graph_edges(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d).edges.withColumn("weight", r6("weight"))


@query(f"WITH {O.ENTITIES}, {O.GRAPH} SELECT ent.id, count(src) AS degree, round(coalesce(sum(weight), 0), 6) AS weighted_degree FROM ent LEFT JOIN edges ON src = ent.id GROUP BY 1")
def graph_degree(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_graph(s, d)).withColumn("weighted_degree", r6("weighted_degree"))


@query(f"WITH {O.ENTITIES}, {O.GRAPH} SELECT ent.id, name, type, count(src) AS degree FROM ent JOIN edges ON src = ent.id GROUP BY ALL ORDER BY degree DESC, ent.id LIMIT 10")
def graph_top_degrees(s: SparkSession, d: str) -> DataFrame:
    return graph.top_degrees(_graph(s, d)).select("id", "name", "type", "degree")


@query(f"""WITH RECURSIVE {O.ENTITIES}, {O.GRAPH}, {O.COMPONENTS}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM ent), e AS (SELECT CAST(count(*) AS DOUBLE) AS e FROM edges)
SELECT CAST(n AS BIGINT) AS nodes, e / 2 AS edges, round(e / (n * (n - 1)), 9) AS density, round(e / n, 6) AS avg_degree, (SELECT count(DISTINCT component) FROM comp) AS components FROM n, e""")
def graph_stats(s: SparkSession, d: str) -> DataFrame:
    return graph.stats(_graph(s, d).stored()).withColumns({"density": F.round("density", 9), "avg_degree": F.round("avg_degree", 6)})


@query(f"WITH RECURSIVE {O.ENTITIES}, {O.GRAPH}, {O.COMPONENTS} SELECT id, component FROM comp")
def graph_components(s: SparkSession, d: str) -> DataFrame:
    return graph.components(_graph(s, d).stored())


@query(f"""WITH {O.GRAPH}, d1 AS (SELECT dst AS id FROM edges WHERE src = 'nation-1'), d2 AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN d1 ON e.src = d1.id)
SELECT 'nation-1' AS id, 0 AS distance UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 WHERE id <> 'nation-1' AND id NOT IN (SELECT id FROM d1)""")
def graph_neighborhood(s: SparkSession, d: str) -> DataFrame:
    return graph.neighborhood(_graph(s, d).stored(), "nation-1", 2)[0].select("id", "distance")


@query(f"""WITH {O.GRAPH}, d1 AS (SELECT dst AS id FROM edges WHERE src = 'nation-1'), d2 AS (SELECT DISTINCT e.dst AS id FROM edges e JOIN d1 ON e.src = d1.id),
dist AS (SELECT id, min(d) AS d FROM (SELECT 'nation-1' AS id, 0 AS d UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2) GROUP BY id)
SELECT src AS "from", dst AS "to", array_to_string(types, ', ') AS label, round(weight, 6) AS value FROM edges JOIN dist a ON a.id = src JOIN dist b ON b.id = dst WHERE src <= dst AND least(a.d, b.d) < 2""")
def graph_neighborhood_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.neighborhood_export(_graph(s, d).stored(), "nation-1", 2)[1].withColumn("value", r6("value"))


def _layer(k: int) -> str:
    """The cheapest way of just k edges to each node, the first of equal ones."""
    return f"""l{k} AS (SELECT DISTINCT ON (node) * FROM (SELECT e.dst AS node, list_append(path, e.dst) AS path, cost + 1 / greatest(e.weight, CAST(0.01 AS DOUBLE)) AS cost, total + e.weight AS total
  FROM l{k - 1} JOIN edges e ON node = e.src WHERE e.src <> e.dst AND NOT list_contains(path, e.dst)) ORDER BY node, cost, path)"""


@query(f"""WITH {O.GRAPH}, l0 AS (SELECT 'supplier-1' AS node, ['supplier-1'] AS path, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS total), {", ".join(_layer(k) for k in (1, 2, 3, 4))}
SELECT path, CAST(len(path) - 1 AS INTEGER) AS hops, round(cost, 6) AS cost, round(total, 6) AS total_weight FROM (FROM l1 UNION ALL FROM l2 UNION ALL FROM l3 UNION ALL FROM l4)
WHERE node = (SELECT max(f.dst) FROM edges e JOIN edges f ON e.dst = f.src WHERE e.src = 'supplier-1' AND f.dst LIKE 'region-%') ORDER BY cost, len(path), path LIMIT 1""")
def graph_path(s: SparkSession, d: str) -> DataFrame:
    g = _graph(s, d).stored()
    near = g.edges.where("src = 'supplier-1'").select(F.col("dst").alias("src"))
    goal = g.edges.join(near, "src").where("dst like 'region-%'").agg(F.max("dst")).first()[0]
    return graph.shortest_path(g, "supplier-1", goal or "", 4).select("path", "hops", r6("cost"), r6("total_weight"))


@query()
def graph_betweenness(s: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(_graph(s, d)).withColumn("betweenness", r6("betweenness"))


@query()
def graph_importance(s: SparkSession, d: str) -> DataFrame:
    # one after the other, so that what they shuffle is never held together; trades are joined once
    relationships = written(T.relationships(s, d).select("source_id", "target_id", "type", "weight", "seen_count", "last_seen"), "relationships")
    swept(s)
    entities = written(T.entities(s, d, relationships), "entities")
    swept(s)
    g = graph.load(entities, relationships).stored()
    found = graph.importance(g, entities, T.AS_OF_TRADE).drop("rank").withColumn("near", F.round("score", 9))
    return graph.ranked(found, [F.desc("near"), F.asc("id")]).select("id", r6("score"), F.col("rank").cast("long").alias("rank"))


@query()
def graph_communities(s: SparkSession, d: str) -> DataFrame:
    g = _graph(s, d).stored()
    return graph.community_members(g, graph.communities(g))


@query(f"""WITH {O.GRAPH} SELECT x.src AS a, y.src AS b, count(*) AS common FROM edges x JOIN edges y ON x.dst = y.dst AND x.src < y.src
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = x.src AND e.dst = y.src) GROUP BY ALL HAVING count(*) >= 2 ORDER BY common DESC, a, b LIMIT 100""")
def suggest_missing(s: SparkSession, d: str) -> DataFrame:
    return graph.missing_links(_graph(s, d), limit=100)


@query(f"""WITH {O.RELATIONS} SELECT source_id, target_id, type, round(weight, 6) AS weight, last_seen, seen_count, CAST(date_diff('day', last_seen, DATE '2001-12-31') AS INTEGER) AS days_since
FROM rel WHERE seen_count >= 3 ORDER BY last_seen, source_id, target_id, type LIMIT 10""", dates=("last_seen",))
def suggest_fading(s: SparkSession, d: str) -> DataFrame:
    return graph.fading_links(T.relationships(s, d), T.AS_OF_TRADE).withColumn("weight", r6("weight"))


@query(f"""WITH {O.RELATIONS} SELECT source_id, target_id, type, seen_count, last_seen FROM rel WHERE last_seen >= DATE '2001-07-20' - 30
ORDER BY seen_count DESC, source_id, target_id, type LIMIT 10""", dates=("last_seen",))
def suggest_emerging(s: SparkSession, d: str) -> DataFrame:
    return graph.emerging_links(T.relationships(s, d), "2001-07-20")


@query(f"""WITH {O.ENTITIES}, {O.GRAPH} SELECT ent.id, name AS label, type AS "group", '{S.DEFAULT_COLOR}' AS color,
round(greatest(8, least(25, 8 + 3 * log2(mention_count + CAST(1 AS DOUBLE)))), 6) AS size FROM ent WHERE ent.id IN (SELECT src FROM edges)""")
def graph_export(s: SparkSession, d: str) -> DataFrame:
    return graph.export(T.entities(s, d), T.relationships(s, d))[0].withColumn("size", r6("size"))


@query(f"""WITH {O.RELATIONS} SELECT source_id AS "from", target_id AS "to", type AS label, round(weight, 6) AS value, seen_count FROM rel""")
def graph_export_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.export(T.entities(s, d), T.relationships(s, d))[1].withColumn("value", r6("value"))


# --- parsing and upkeep ---------------------------------------------------------------------------

_NOTES = """notes AS (SELECT conv_id, string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text)
  || chr(10) || chr(10) || '[[conv-' || (conv_id % 13) || '|earlier]] #conv-' || (conv_id % 7) AS raw,
  'talks/' || strftime(DATE '2024-01-01' + CAST(conv_id % 365 AS INTEGER), '%Y-%m-%d') || ' conv-' || conv_id || '.md' AS path FROM conversations GROUP BY conv_id)"""


@query(f"WITH {_NOTES} SELECT path, list_distinct(list_transform(regexp_extract_all(raw, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1), lambda x: trim(x))) AS links FROM notes")
def wiki_links(s: SparkSession, d: str) -> DataFrame:
    return T.notes(s, d).select("path", X.wiki_links(F.col("raw")).alias("links"))


@query(f"WITH {_NOTES} SELECT path, list_sort(list_distinct(regexp_extract_all(raw, '#([A-Za-z0-9_가-힣-]+)', 1))) AS tags FROM notes")
def inline_tags(s: SparkSession, d: str) -> DataFrame:
    return T.notes(s, d).select("path", F.array_sort(X.inline_tags(F.col("raw"))).alias("tags"))


@query(f"WITH {_NOTES} SELECT path, regexp_extract(path, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS date, 'conv-' || conv_id AS ending FROM notes")
def extract_date(s: SparkSession, d: str) -> DataFrame:
    return T.notes(s, d).select("path", X.extract_date(F.col("path"), F.col("modified_at")).alias("date"), F.substring_index(X.base_name(F.col("path")), " ", -1).alias("ending"))


#: Entities that texts do name, beside all those of the table: short, long, with a space, with other characters, and one that nothing holds.
_NAMES = {"apache": "apache license", "work": "this work", "the": "the", "ouan": "ouan", "mail": "@", "phone": "+1 (", "none": "no such name"}
_MENTIONS = f"""{O.FILES}, {O.ENTITIES}, names AS (SELECT * FROM (VALUES {", ".join(f"('{i}', '{k}')" for i, k in _NAMES.items())}) AS n(id, key)
  UNION ALL SELECT first(id ORDER BY p, id), key FROM (SELECT lower(name) AS key, 0 AS p, id FROM ent UNION ALL SELECT lower(unnest(aliases)), 1, id FROM ent) WHERE key <> '' GROUP BY key),
mentions AS (SELECT DISTINCT path, names.id FROM files JOIN names ON contains(lower(content), key))"""


def _mentions(s: SparkSession, d: str) -> DataFrame:
    own = s.createDataFrame([(k, i) for i, k in _NAMES.items()], "key string, id string")
    return extraction.co_mentioned(T.files(s, d), stores.names(T.entities(s, d)).unionByName(own))


@query(f"WITH {_MENTIONS} SELECT path, id FROM mentions")
def entity_mentions_in_text(s: SparkSession, d: str) -> DataFrame:
    return _mentions(s, d)


@query(f"WITH {_MENTIONS} SELECT a.id AS source_id, b.id AS target_id, count(*) AS seen_count FROM mentions a JOIN mentions b ON a.path = b.path AND a.id < b.id GROUP BY ALL")
def co_mentions(s: SparkSession, d: str) -> DataFrame:
    return extraction.mentioned_together(_mentions(s, d)).groupBy("source_id", "target_id").agg(F.count("*").alias("seen_count"))


def _scan(s: SparkSession, d: str) -> DataFrame:
    """A later scan: some files are gone, some changed a little or much, some are new."""
    f = T.files(s, d)
    old = f.where("id % 10 <> 3").withColumn("modified_at", F.col("modified_at") + F.when(F.col("id") % 5 == 0, 999).when(F.col("id") % 5 == 1, 1000).otherwise(0))
    new = f.where("id % 50 = 0").withColumns({"path": F.concat(F.lit("new/"), "path"), "id": F.col("id") + 1_000_000_000})
    return old.unionByName(new)


_SCAN = f"""{O.FILES}, scanned AS (SELECT id, path, modified_at + CASE WHEN id % 5 = 0 THEN 999 WHEN id % 5 = 1 THEN 1000 ELSE 0 END AS modified_at FROM files WHERE id % 10 <> 3
  UNION ALL SELECT id + 1000000000, 'new/' || path, modified_at FROM files WHERE id % 50 = 0)"""


@query(f"WITH {_SCAN} SELECT s.path, s.modified_at FROM scanned s LEFT JOIN files f ON f.path = s.path WHERE f.path IS NULL OR abs(s.modified_at - f.modified_at) >= 1000")
def incremental_diff(s: SparkSession, d: str) -> DataFrame:
    return maintenance.changed(_scan(s, d), T.files(s, d)).select("path", "modified_at")


@query(f"WITH {_SCAN} SELECT path FROM files WHERE path NOT IN (SELECT path FROM scanned)")
def stale_files(s: SparkSession, d: str) -> DataFrame:
    return maintenance.stale(T.files(s, d), _scan(s, d)).select("path")


def _stored(s: SparkSession, d: str) -> DataFrame:
    return T.files(s, d).withColumns({"indexed_at": F.col("modified_at") + 5, "graph_extracted_at": F.col("modified_at") + 7, "embedded_at": F.lit(None).cast("long"), "llm_extracted_at": F.lit(None).cast("long")})


@query(f"""WITH {_SCAN}, c AS (SELECT s.* FROM scanned s LEFT JOIN files f ON f.path = s.path WHERE f.path IS NULL OR abs(s.modified_at - f.modified_at) >= 1000)
SELECT path, modified_at, CAST(1800000000000 AS BIGINT) AS indexed_at, coalesce((SELECT f.modified_at + 7 FROM files f WHERE f.path = c.path), 0) AS graph_extracted_at FROM c
UNION ALL SELECT path, modified_at, modified_at + 5, modified_at + 7 FROM files WHERE path NOT IN (SELECT path FROM c)""")
def upsert_merge(s: SparkSession, d: str) -> DataFrame:
    files = _stored(s, d)
    changed = maintenance.changed(_scan(s, d), files)
    return maintenance.upserted(files, changed.drop("id"), 1_800_000_000_000).select("path", "modified_at", "indexed_at", F.coalesce("graph_extracted_at", F.lit(0)).alias("graph_extracted_at"))


@query(f"""WITH {O.FILES} SELECT CASE WHEN id % 4 = 0 THEN 'moved/x' || id || '.md' ELSE path END AS path, CASE WHEN id % 4 = 0 THEN 'x' || id ELSE title END AS title,
CASE WHEN id % 4 = 0 THEN 'moved' ELSE directory END AS directory FROM files""")
def rename_apply(s: SparkSession, d: str) -> DataFrame:
    files = _stored(s, d)
    moves = files.where("id % 4 = 0").select(F.col("path").alias("old_path"), F.concat(F.lit("moved/x"), F.col("id").cast("string"), F.lit(".md")).alias("path"))
    return maintenance.renamed(files, moves).select("path", "title", "directory")


# --- changes of stores ----------------------------------------------------------------------------

_DAY = "2001-07-01"


@query(f"""WITH {O.OBSERVED}, o AS (SELECT source_id, target_id, type, count(*) AS n, max(day) AS last_seen FROM observed WHERE day < DATE '{_DAY}' GROUP BY ALL),
b AS (SELECT source_id, target_id, type, count(*) AS n FROM observed WHERE day >= DATE '{_DAY}' GROUP BY ALL),
m AS (SELECT coalesce(o.source_id, b.source_id) AS source_id, coalesce(o.target_id, b.target_id) AS target_id, coalesce(o.type, b.type) AS type, coalesce(o.n, 0) + coalesce(b.n, 0) AS seen_count,
  CASE WHEN b.n IS NULL THEN o.last_seen ELSE DATE '2001-12-31' END AS last_seen, b.n IS NULL AS old FROM o FULL JOIN b ON o.source_id = b.source_id AND o.target_id = b.target_id AND o.type = b.type)
SELECT source_id, target_id, type, seen_count, last_seen, CAST(CASE WHEN old OR seen_count > 0 AND EXISTS (SELECT 1 FROM o WHERE o.source_id = m.source_id AND o.target_id = m.target_id AND o.type = m.type) THEN 0.75 ELSE 0.5 END AS DOUBLE) AS confidence,
  round(CASE WHEN old THEN CAST(7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) * log2(seen_count + CAST(1 AS DOUBLE)) END, 6) AS weight FROM m""", dates=("last_seen",))
def relationship_merge(s: SparkSession, d: str) -> DataFrame:
    """Relationships seen before a day, with a weight of 7 and a confidence of 0.75, and all later observations, with one of 0.5."""
    log = _observation_log(s, d)
    old = stores.consolidated(log.where(F.col("observed_on") < F.lit(_DAY).cast("date"))).withColumns({"weight": F.lit(7.0), "confidence": F.lit(0.75)})
    new = stores.merged_relationships(old, log.where(F.col("observed_on") >= F.lit(_DAY).cast("date")), T.entities(s, d), T.AS_OF_TRADE)
    return new.select("source_id", "target_id", "type", "seen_count", "last_seen", "confidence", r6("weight"))


@query(f"""WITH {O.ENTITIES} SELECT id, type, CASE WHEN id IN (SELECT 'supplier-' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) THEN upper(name) || ' 2' ELSE name END AS name, mention_count, last_seen FROM ent
UNION ALL SELECT 'new-' || s_suppkey, 'supplier', upper(s_name) || ' 2', 0, DATE '2001-12-31' FROM supplier WHERE s_suppkey % 3 = 1""", dates=("last_seen",))
def entity_upsert(s: SparkSession, d: str) -> DataFrame:
    """Every third supplier comes twice with other names, the last one counts; every third one comes with a new id."""
    empty = {"metadata": F.lit("{}"), "source_path": F.lit(None).cast("string")}
    entities = T.entities(s, d).withColumns(empty | {"first_seen": F.col("last_seen")})
    own = T.raw(s, d, "supplier").where("s_suppkey % 3 < 2").select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "supplier-").otherwise("new-"), F.col("s_suppkey").cast("string")).alias("id"), F.upper("s_name").alias("base"))
    batch = own.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({"name": F.concat("base", F.lit(" "), F.col("seq").cast("string")), "type": F.lit("supplier"), "aliases": F.array().cast("array<string>")} | empty)
    return stores.upserted_entities(entities, batch, T.AS_OF_TRADE).select("id", "type", "name", "mention_count", "last_seen")


@query(f"""WITH {O.TALKS} SELECT session_id, summary FROM talks WHERE id % 2 = 0
UNION ALL SELECT CASE WHEN id % 3 = 0 THEN 'later-' || id ELSE session_id END, 'again' FROM talks WHERE id % 3 = 0 OR id % 2 = 1""")
def conversation_insert(s: SparkSession, d: str) -> DataFrame:
    """Sessions with an even id are stored; all come once more, every third as a new one, and each twice."""
    talks = T.conversations(s, d)
    again = talks.withColumns({"session_id": F.when(F.col("id") % 3 == 0, F.concat(F.lit("later-"), F.col("id").cast("string"))).otherwise(F.col("session_id")), "seq": F.explode(F.array(F.lit(1), F.lit(2)))})
    again = again.withColumn("summary", F.when(F.col("seq") == 1, "again").otherwise("too late"))
    return stores.added_conversations(talks.where("id % 2 = 0"), again).select("session_id", "summary")


@query(f"""WITH {O.OBSERVED} SELECT source_file, min(day) AS extracted_at FROM observed WHERE source_id = (SELECT min(source_id) FROM observed WHERE target_id = 'supplier-1') AND target_id = 'supplier-1'
GROUP BY source_file ORDER BY extracted_at DESC, source_file""", dates=("extracted_at",))
def evidence_listing(s: SparkSession, d: str) -> DataFrame:
    one = T.relationships(s, d).where("target_id = 'supplier-1'").agg(F.min_by("id", "source_id")).first()[0]
    return stores.evidence_of(T.evidence(s, d), one or 0).select("source_file", F.to_date("extracted_at").alias("extracted_at"))


@query(f"""WITH {O.FILES}, {O.VECTORS} SELECT 'files' AS what, count(*) AS rows FROM files WHERE directory <> 'src3'
UNION ALL SELECT 'embeddings', count(*) FROM vectors WHERE file_id NOT IN (SELECT id FROM files WHERE directory = 'src3')""")
def file_removal(s: SparkSession, d: str) -> DataFrame:
    files = T.files(s, d)
    left, vecs = maintenance.removed(files, T.embeddings(s, d), files.where("directory = 'src3'").select("path"))
    return explorer.counts({"files": left, "embeddings": vecs}).withColumnRenamed("table", "what")


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END AS n, event_type AS first, CASE WHEN event_id % 5 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM events""")
def stored_json(s: SparkSession, d: str) -> DataFrame:
    """Lists that are kept as JSON text, some of it broken, and numbers that are missing."""
    e = T.raw(s, d, "events")
    text = F.when(F.col("event_id") % 4 == 0, F.lit('["broken')).otherwise(F.to_json(F.array("event_type", "props")))
    rows = e.select(F.col("event_id").alias("id"), "event_type", text.alias("aliases"), text.alias("entity_ids"), F.lit("{").alias("metadata"), F.lit(None).cast("long").alias("mention_count"),
                    F.when(F.col("event_id") % 5 != 0, F.lit(0.5)).alias("confidence"), *[F.lit(None).cast(k).alias(c) for c, k in (("weight", "double"), ("extraction_method", "string"), ("seen_count", "long"))])
    rows = stores.decoded_relationships(stores.decoded_facts(stores.decoded_entities(rows)))
    sound = (F.col("weight") == 1.0) & (F.col("seen_count") == 1) & (F.col("mention_count") == 0) & (F.col("metadata") == "{}") & (F.col("aliases") == F.col("entity_ids")) & (F.col("extraction_method") == "rule")
    return rows.where(sound).select("id", F.size("aliases").cast("int").alias("n"), F.col("event_type").alias("first"), "confidence")


# --- streams --------------------------------------------------------------------------------------


@query("""SELECT strftime(date_trunc('hour', CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(s: SparkSession, d: str) -> DataFrame:
    found = changes.windowed_counts(T.raw(s, d, "events"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS t, lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
k AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM k GROUP BY user_id, session""")
def event_sessions(s: SparkSession, d: str) -> DataFrame:
    return changes.sessions(T.raw(s, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
