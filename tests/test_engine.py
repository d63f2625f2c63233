import http.server
import itertools
import json
import math
import os
import threading
import urllib.error

import pytest
from pyspark.sql import functions as F

from vaultspark.engine import Engine
from vaultspark.operators import explorer, extraction, stores
from vaultspark.schemas import CHANGES, FILES, PATHS, RENAMES
from vaultspark.sources import markdown
from vaultspark.sources.scratch import written
from vaultspark.sources.service import Service
from vaultspark.streaming import changes


def test_notes_to_graph(spark, tmp_path):
    vault = tmp_path / "vault"
    for path, text in {
        "people/Ann/요약.md": "---\norganization: Acme\n---\nAnn leads.",
        "people/Bob/요약.md": "Bob.",
        "people/Ann/2024-03-01.md": "---\ntags: [x, 1]\nproject: Rocket\nattendees: [Bob, Nobody]\n---\nMet [[Bob]] and Acme. #deep",
        "skip/x.md": "no",
        ".hidden/y.md": "no",
    }.items():
        (vault / path).parent.mkdir(parents=True, exist_ok=True)
        (vault / path).write_text(text)
    e = Engine(spark, str(tmp_path / "store"), people_dir="people", clock=lambda: 1_709_300_000)
    assert e.index(str(vault), skip_dirs=["skip"]) == {"indexed": 3, "deleted": 0}
    assert e.index(str(vault), skip_dirs=["skip"])["indexed"] == 0
    tags = {r["title"]: r["tags"] for r in e.table("files").collect()}
    assert tags["2024-03-01"] == ["x", "1", "deep"]
    e.extract()
    kinds = {r["id"]: r["type"] for r in e.table("entities").collect()}
    assert kinds == {"Ann": "person", "Bob": "person", "Acme": "organization", "Rocket": "project"}
    rel = {(r["source_id"], r["target_id"], r["type"]) for r in e.table("relationships").collect()}
    assert {("Ann", "Acme", "belongs-to"), ("Ann", "Rocket", "related-to"), ("Acme", "Bob", "co-mentioned")} <= rel
    assert {r["type"] for r in e.table("facts").collect()} == {"mention", "attended"}
    assert e.embed() == 3
    assert e.search("leads").first()["title"] == "요약"
    assert e.hybrid_search("leads").count() > 0
    assert e.path("Bob", "Rocket").count() >= 2
    assert e.sql("select count(*) as n from files where path like ?", ["people/%"]).first()["n"] == 3


def test_model_answers(spark):
    good = {"relationships": [{"source": "A", "target": "B", "type": "supports", "confidence": 7}, {"source": "A", "target": "B", "type": "zzz"}], "newEntities": [{"name": "Q", "type": "tool"}]}
    rows = spark.createDataFrame([("p", f"x {json.dumps(good)} y"), ("q", "none")], "path string, response string")
    got = {r["path"]: r for r in extraction.parsed_answers(rows).collect()}
    assert [(x["confidence"], x["context"]) for x in got["p"]["relationships"]] == [(1.0, "")]
    assert got["p"]["new_entities"] == [] and got["q"]["relationships"] == []


EVENTS = [
    [{"op": "modify", "path": "a/1.md", "modified_at": 1, "raw": "one"}, {"op": "modify", "path": "a/2.md", "modified_at": 1, "raw": "two"}],
    [{"op": "modify", "path": "a/1.md", "modified_at": 3, "raw": "uno #t"}, {"op": "delete", "path": "a/2.md", "modified_at": 2}],
    [{"op": "rename", "path": "b/9.md", "old_path": "a/1.md", "modified_at": 4}],
]


def merged(spark, *batches):
    """Paths and contents after batches of events, given as (op, path, time, text or old path)."""
    state = (spark.createDataFrame([], FILES), spark.createDataFrame([], PATHS), spark.createDataFrame([], RENAMES))
    for batch in batches:
        rows = [(op, path, x if op == "rename" else None, at, x if op == "modify" else None, None) for op, path, at, x in batch]
        state = [written(t, "state") for t in changes.merged(*state, spark.createDataFrame(rows, CHANGES), 7)]
    return {r["path"]: r["content"] for r in state[0].collect()}


def test_change_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    for k, rows in enumerate(EVENTS):
        (feed / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
    table, heard = changes.FilesTable(spark, str(tmp_path / "files"), keep=2), []
    changes.ingest(spark, str(feed), table, str(tmp_path / "cp"), lambda: 7, files_per_batch=1, progress=lambda *x: heard.append(x)).awaitTermination()
    got = [(r["path"], r["content"], r["tags"], r["directory"]) for r in table.read().collect()]
    assert got == [("b/9.md", "uno #t", ["t"], "b")]
    assert [k for k, _ in heard] == [0, 1, 2] and sorted(n for _, n in heard) == [1, 2, 2]
    assert len(table._versions()) == 2 and len([p for p in (tmp_path / "files").iterdir() if p.name.startswith("v-")]) == 2
    whole = changes.applied(spark.createDataFrame([], FILES), spark.read.schema(CHANGES).json(str(feed)).where("op <> 'rename'"), 7)
    assert [r["path"] for r in whole.collect()] == ["a/1.md"]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_batches_in_any_order(spark, order):
    batches = [[(e["op"], e["path"], e["modified_at"], e.get("raw") or e.get("old_path")) for e in EVENTS[k]] for k in order]
    assert merged(spark, *batches) == {"b/9.md": "uno #t"}


def test_events_in_order_of_time(spark):
    assert merged(spark, [("modify", "a", 3, "new")], [("modify", "a", 1, "late")]) == {"a": "new"}
    assert merged(spark, [("delete", "a", 3, None)], [("modify", "a", 1, "late")]) == {}
    assert merged(spark, [("delete", "a", 3, None)], [("modify", "a", 4, "again")]) == {"a": "again"}
    assert merged(spark, [("modify", "a", 1, "x"), ("rename", "b", 2, "a")]) == {"b": "x"}
    assert merged(spark, [("modify", "a", 1, "x")], [("rename", "b", 2, "a"), ("rename", "c", 3, "b")]) == {"c": "x"}
    assert merged(spark, [("modify", "a", 1, "x")], [("rename", "b", 2, "a"), ("modify", "a", 3, "y"), ("rename", "c", 4, "a")]) == {"b": "x", "c": "y"}
    assert merged(spark, [("modify", "a", 1, "x"), ("modify", "b", 1, "y")], [("rename", "b", 2, "a")]) == {"b": "x"}
    assert merged(spark, [("modify", "a", 1, "x"), ("modify", "b", 3, "y")], [("rename", "b", 2, "a")]) == {"b": "y"}
    assert merged(spark, [("rename", "b", 2, "a"), ("rename", "a", 4, "b")], [("modify", "a", 1, "x")], [("modify", "b", 3, "z")]) == {"a": "z"}


def test_two_batches_of_observations(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    days = [1_709_300_000, 1_709_300_000 + 40 * 86_400]
    clock = lambda: days[0]
    e = Engine(spark, str(tmp_path / "store"), clock=clock)
    known = [("A", "person", "Ada"), ("B", "person", "Bert"), ("C", "person", "Cleo")]
    e.replace("entities", spark.createDataFrame(known, "id string, type string, name string").withColumns({"aliases": F.array().cast("array<string>"), "mention_count": F.lit(0).cast("long")}))


    def note(name, text):
        (vault / name).write_text(text)
        os.utime(vault / name, (1_700_000_000, 1_700_000_000))

    note("2024-01-05 x.md", "Ada met Bert.")
    note("2024-01-06 y.md", "Bert met Cleo.")
    e.index(str(vault))
    e.extract()
    first = {(r["source_id"], r["target_id"]): r for r in e.table("relationships").collect()}
    assert set(first) == {("A", "B"), ("B", "C")}
    assert all(str(r["last_seen"]) == "2024-03-01" and r["weight"] == pytest.approx(1.0) and r["seen_count"] == 1 for r in first.values())
    e.clock = lambda: days[1]
    note("2024-01-07 z.md", "Ada and Bert again.")
    e.index(str(vault))
    e.extract()
    then = {(r["source_id"], r["target_id"]): r for r in e.table("relationships").collect()}
    assert then["B", "C"] == first["B", "C"]  # not touched
    assert then["A", "B"]["seen_count"] == 2 and str(then["A", "B"]["last_seen"]) == "2024-04-10" and then["A", "B"]["weight"] == pytest.approx(math.log2(3))
    assert then["A", "B"]["id"] == first["A", "B"]["id"] and then["A", "B"]["source_file"] == first["A", "B"]["source_file"]
    assert e.table("relationship_evidence").count() == 3


def test_entity_by_id_only_without_hits(spark):
    rows = spark.createDataFrame([("ann", "person", "Ann"), ("project-ann", "project", "Plan")], "id string, type string, name string").withColumn("aliases", F.array().cast("array<string>"))
    got = lambda *a: [r["id"] for r in stores.search_entities_or_id(rows, *a).collect()]
    assert got("ann", "project") == ["project-ann"]
    assert got("ann", "tool") == ["ann"]
    assert got("ann") == ["ann", "project-ann"] and got("zzz") == []


def test_store(spark, tmp_path):
    notes = [("a/x.md", 1000, "alpha beta [[y]]\n# Head\ngamma"), ("a/y.md", 1000, "beta delta"), ("b/z.md", 1000, "---\ntags: one, two\n---\nepsilon")]
    source = markdown.Rows(spark.createDataFrame(notes, "path string, modified_at long, raw string"))
    e = Engine(spark, str(tmp_path / "store"), clock=lambda: 1_709_300_000)
    assert e.index(source) == {"indexed": 3, "deleted": 0} and e.schema_version == 8
    found = lambda q: [r["path"] for r in e.search(q).collect()]
    assert sorted(found("beta")) == ["a/x.md", "a/y.md"] and found("two") == ["b/z.md"]
    e.rename("a/y.md", "c/q.md")
    assert found("delta") == ["c/q.md"] and found("title:q") == ["c/q.md"] and found("title:y") == []
    e.index_notes(spark.createDataFrame([("c/q.md", 2000, "zeta")], "path string, modified_at long, raw string"))
    assert found("delta") == [] and found("zeta") == ["c/q.md"]
    heard = []
    assert e.embed(progress=heard.append) == 4 and heard == [0, 100]
    e.remove("a/x.md")
    assert found("alpha") == [] and e.table("embeddings").count() == 2 and e.table("files").count() == 2
    e.keywords.compact()
    assert len(e.keywords.segments()) == 1 and found("zeta") == ["c/q.md"] and found("beta") == []
    assert "<mark>zeta</mark>" in e.search("zeta").first()["snippet"]
    good = '{"session_id": "s1", "date": "2024-01-01", "summary": "first"}'
    assert e.add_conversations([f"```json\n{good}\n```", good.replace("first", "second"), "no json", '{"session_id": "s2"}']) == 1
    assert e.add_conversations([good]) == 1 and e.search_conversations("first").count() == 1
    assert {(r["table"], r["rows"]) for r in e.catalog().collect()} >= {("files", 2), ("conversations", 1)}
    assert explorer.catalog({k: v for k, v in explorer.session_tables(spark).items() if k == "nothing"} or {"x": spark.range(3)}).first()["rows"] == 3
    assert e.healthy() and not Engine(spark, str(tmp_path / "store"), embedder=lambda texts: 1 / 0).healthy()
    assert e.keep_vectors() and not e.keep_vectors("never") and not e.keep_vectors(limit_mb=0)
    for k in range(12):
        e.replace("facts", spark.createDataFrame([(k, "t", "c", ["z"], "2024-01-01", None, None)], "id long, type string, content string, entity_ids array<string>, day string, valid_until date, source_file string").withColumn("recorded_at", F.col("day").cast("date")).drop("day"))
    assert len([p for p in (tmp_path / "store" / "facts").iterdir()]) == 10 and len(e._commits()) == 10
    with pytest.raises(RuntimeError), e.transaction():
        e.replace("facts", e.table("facts").limit(0))
        assert e.table("facts").count() == 0
        raise RuntimeError
    assert e.table("facts").count() == 1
    again = Engine(spark, str(tmp_path / "store"))
    assert again.schema_version == 8 and again.table("facts").count() == 1
    (tmp_path / "store" / "schema-8").rename(tmp_path / "store" / "schema-7")
    assert Engine(spark, str(tmp_path / "store")).table("files").count() == 2 and (tmp_path / "store" / "schema-8").exists()
    detail = e.detail("z")
    assert detail["facts"].count() == 1 and detail["latest"].first()["id"] == 11 and detail["entity"].count() == 0
    assert e.temporal("facts", "z").first()["names"] == ["z"] and e.temporal("activity", "z").first()["period"] == "2024-01"
    assert e.temporal().count() == 0 and e.temporal("relationship", "a", "b").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        e.temporal("nothing")


def test_sql_functions(spark, tmp_path):
    Engine(spark, str(tmp_path / "store")).register_functions()
    row = spark.sql("""SELECT vec_cosine(array(1D, 0D), array(1D, 1D)) AS c, vec_cosine(array(0D), array(1D)) AS z, wiki_links('[[a|b]] [[ c ]] [[a]]') AS l,
        week_label(DATE '2024-01-08') AS w, rel_weight(3L, DATE '2024-01-01', 0.5D, DATE '2024-01-01') AS r, snippet('one two', 'two') AS s""").first()
    assert row["c"] == pytest.approx(0.5**0.5) and row["z"] == 0 and row["l"] == ["a", "c"] and row["w"] == "2024-W02" and row["r"] == pytest.approx(1.0) and row["s"] == "one <mark>two</mark>"
    assert [tuple(r) for r in spark.sql("SELECT * FROM chunk_markdown('x\n# H\ny', 1000)").collect()] == [(0, "", "x"), (1, "H", "# H\ny")]


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("p/a/1.md", 1, "one"), ("p/b/2.md", 1, "---\nx: 1\n--- two [[raw]]"), ("q.md", 1, "three")], "path string, modified_at long, raw string")
    source = markdown.Rows(rows)
    assert sorted(r["name"] for r in markdown.sub_directories(source, "p").collect()) == ["a", "b"]
    wanted = spark.createDataFrame([("q.md",), ("none.md",)], "path string")
    assert {r["path"]: r["raw"] for r in markdown.read_if_exists(source, wanted).collect()} == {"q.md": "three", "none.md": None}
    cache = spark.createDataFrame([("p/b/2.md", ["#t1", "t2"], ["l1#h|x"], '{"tags": "f1, f2"}')], "path string, tags array<string>, links array<string>, frontmatter string")
    got = {r["path"]: r for r in markdown.parse_cached(rows, cache).collect()}
    assert got["p/b/2.md"]["tags"] == ["t1", "t2", "f1", "f2"] and got["p/b/2.md"]["wiki_links"] == ["l1", "raw"] and got["p/b/2.md"]["content"] == "two [[raw]]"
    assert got["q.md"]["content"] == "three" and got["q.md"]["tags"] == [] and got["q.md"]["frontmatter"] == "{}"
    for path in ("top/deep/x.md", "keep/top/y.md", ".hid/z.md", "a/.hid/w.md"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("t")
    paths = lambda **k: sorted(r["path"] for r in markdown.scan(spark, str(tmp_path), ["top"], **k).collect())
    assert paths() == [] and paths(top_level_only=True) == ["keep/top/y.md"]


class Answers(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200 if self.path == "/api/tags" else 404)
        self.end_headers()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(500 if body["prompt"] == "fail" else 200)
        self.end_headers()
        answer = {"embedding": [float(len(body["prompt"])), 1.0]} if self.path == "/api/embeddings" else {"response": f"{body['model']}:{body['options']['num_predict']}"}
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


def test_service():
    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s = Service(f"http://127.0.0.1:{server.server_port}/", "m", "g")
    assert s.healthy() and s.embed(["ab", ""]) == [[2.0, 1.0], [0.0, 1.0]] and s.generate(["x"]) == ["g:2048"]
    with pytest.raises(urllib.error.HTTPError):
        s.embed(["fail"])
    server.shutdown()
    server.server_close()
    assert not s.healthy()


def test_running_counts(spark, tmp_path):
    schema = "source_id string, target_id string, type string, confidence double, observed_on date"
    rows = spark.createDataFrame([("a", "b", "t", 0.5, None), ("a", "b", "t", 0.7, None), ("b", "a", "t", 1.0, None)], schema)
    rows.write.parquet(str(tmp_path / "in"))
    stream = changes.running_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["source_id"], r["seen_count"], r["confidence"]) for r in spark.table("counts").collect()} == {("a", 2, 0.7), ("b", 1, 1.0)}
