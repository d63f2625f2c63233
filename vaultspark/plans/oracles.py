"""DuckDB SQL for the model tables and for every query that SQL can express."""

from __future__ import annotations

from vaultspark.functions.text import MARKED, PLAIN

FILES = """files AS (SELECT doc_id AS id, source || '/' || doc_id || '.md' AS path, 'doc-' || doc_id AS title, source AS directory,
  [lang] AS tags, CASE WHEN doc_id % 97 = doc_id % 31 THEN ['doc-' || (doc_id % 97)] ELSE ['doc-' || (doc_id % 97), 'doc-' || (doc_id % 31)] END AS wiki_links,
  text AS content, 1704067200000 + doc_id * 60000 AS modified_at FROM documents)"""
VECTORS = """vectors AS (SELECT vec_id AS id, vec_id // 4 AS file_id, CAST(vec_id % 4 AS INTEGER) AS chunk_index, 'chunk ' || vec_id AS chunk_text,
  'L' || label AS heading, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"""
OBSERVED = """observed AS (
  SELECT 'customer-' || o_custkey AS source_id, 'supplier-' || l_suppkey AS target_id, 'trades-with' AS type, 'order-' || o_orderkey AS source_file, CAST(o_orderdate AS DATE) AS day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'belongs-to', 'registry', DATE '2001-01-01' FROM supplier
  UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey, 'belongs-to', 'registry', DATE '2001-01-01' FROM nation)"""
RELATIONS = f"""{OBSERVED}, rel AS (
  SELECT source_id, target_id, type, count(*) AS seen_count, max(day) AS last_seen,
    exp(-greatest(date_diff('day', max(day), DATE '2001-12-31'), 0) / CAST(180 AS DOUBLE)) * log2(count(*) + CAST(1 AS DOUBLE)) AS weight
  FROM observed GROUP BY ALL)"""
ENTITIES = """ent AS (
  SELECT n.*, coalesce(m.c, 0) AS mention_count, m.last_seen FROM (
    SELECT 'region-' || r_regionkey AS id, 'region' AS type, r_name AS name, ['region no ' || r_regionkey] AS aliases FROM region
    UNION ALL SELECT 'nation-' || n_nationkey, 'nation', n_name, ['nation no ' || n_nationkey] FROM nation
    UNION ALL SELECT 'supplier-' || s_suppkey, 'supplier', s_name, ['supplier no ' || s_suppkey] FROM supplier
    UNION ALL SELECT 'customer-' || c_custkey, 'customer', c_name, ['customer no ' || c_custkey] FROM customer) n
  LEFT JOIN (SELECT id, count(*) AS c, max(day) AS last_seen FROM (
      SELECT 'customer-' || o_custkey AS id, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      UNION ALL SELECT 'supplier-' || l_suppkey, CAST(o_orderdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY id) m ON n.id = m.id)"""
FACTS = """fact AS (SELECT event_id AS id, event_type AS type, props AS content, ['user-' || user_id, 'type-' || event_type] AS entity_ids,
  CAST(ts AS DATE) AS recorded_at, 'event-' || (event_id % 100) AS source_file FROM events)"""
TALKS = """talks AS (SELECT conv_id AS id, 'session-' || conv_id AS session_id,
  strftime(DATE '2024-01-01' + CAST(conv_id % 365 AS INTEGER), '%Y-%m-%d') || ' 10:' || lpad(CAST(conv_id % 60 AS VARCHAR), 2, '0') AS date,
  coalesce(first(text ORDER BY turn, text) FILTER (role = 'user'), '') AS summary, array_to_string(list_sort(list(DISTINCT role)), ' ') AS topics,
  last(text ORDER BY turn, text) FILTER (role = 'assistant') AS outcome FROM conversations GROUP BY conv_id)"""

#: Edges both ways of the whole graph. Its nodes are all entities, linked or not.
GRAPH = f"""{RELATIONS},
one AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(weight) AS weight, list_sort(list(DISTINCT type)) AS types FROM rel GROUP BY ALL),
edges AS (SELECT a AS src, b AS dst, weight, types FROM one UNION ALL SELECT b, a, weight, types FROM one WHERE a <> b)"""
#: The least entity that each entity reaches. All that is linked reaches a region; the rest is alone.
COMPONENTS = """reach AS (SELECT id AS root, id FROM ent WHERE type = 'region' UNION SELECT r.root, e.dst FROM reach r JOIN edges e ON r.id = e.src),
own AS (SELECT id, min(root) AS root FROM reach GROUP BY id), low AS (SELECT root, min(id) AS component FROM reach GROUP BY root),
comp AS (SELECT ent.id, coalesce(component, ent.id) AS component FROM ent LEFT JOIN own ON own.id = ent.id LEFT JOIN low ON low.root = own.root)"""

WORDS = f"regexp_extract_all(translate(lower(coalesce({{}}, '')), '{MARKED}', '{PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def words(expr: str) -> str:
    return WORDS.format(expr).replace("{{", "{").replace("}}", "}")


def bm25(table: str, columns: list[str], phrases: list[str], keep: str, rest: str, out: str) -> str:
    """Scores over ``table``. ``phrases``: for each, DuckDB SQL that counts its hits in a list of words ``w``."""
    lists = ", ".join(f"{words(c)} AS w{k}" for k, c in enumerate(columns))
    hits = ", ".join(f"CAST({' + '.join(p.replace('@', f'w{k}') for k in range(len(columns)))} AS DOUBLE) AS h{i}" for i, p in enumerate(phrases))
    size = " + ".join(f"len(w{k})" for k in range(len(columns)))
    n = ", ".join(f"CAST(count(*) FILTER (h{i} > 0) AS DOUBLE) AS n{i}" for i in range(len(phrases)))
    terms = " + ".join(
        f"(CASE WHEN ln((n - n{i} + CAST(0.5 AS DOUBLE)) / (n{i} + CAST(0.5 AS DOUBLE))) <= 0 THEN CAST(1e-6 AS DOUBLE) ELSE ln((n - n{i} + CAST(0.5 AS DOUBLE)) / (n{i} + CAST(0.5 AS DOUBLE))) END)"
        f" * (h{i} * CAST(2.2 AS DOUBLE)) / (h{i} + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * size / mean))"
        for i in range(len(phrases))
    )
    return f"""WITH {table}, t AS (SELECT *, {lists} FROM {table.split(' ')[0]}), c AS (SELECT *, {hits}, {size} AS size FROM t),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(size) AS mean, {n} FROM c),
scored AS (SELECT c.*, -({terms}) AS score FROM c, s WHERE {keep})
SELECT {out} FROM scored {rest}"""


def word(w: str) -> str:
    return f"len(list_filter(@, lambda x: x = '{w}'))"


def prefix(w: str) -> str:
    return f"len(list_filter(@, lambda x: starts_with(x, '{w}')))"


def pair(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len(@)), lambda i: @[i] = '{a}' AND @[i + 1] = '{b}'))"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}, {b})"
