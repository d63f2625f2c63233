import pytest
from pyspark.sql import functions as F

from vaultspark.functions import query as Q
from vaultspark.functions import scores as S
from vaultspark.functions import text as X
from vaultspark.operators.vectors import chunk


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_wiki_links_and_tags(spark):
    text = F.lit("[[A]] [[B|x]] [[C#s]] [[ D ]] [[#s]] [[A]]")
    assert one(spark, X.wiki_links(text)) == ["A", "B", "C", "D"]
    assert one(spark, X.inline_tags(F.lit("# H #a-b #가나 x#y [[N#sec]]"))) == ["a-b", "가나", "y", "sec"]


@pytest.mark.parametrize(
    ("path", "day"),
    [("d/2024-03-01.md", "2024-03-01"), ("24.03.01 m.md", "2024-03-01"), ("95.03.01.md", "1995-03-01"), ("v12.34.56.md", "2012-34-56"), ("x.md", "1970-01-01")],
)
def test_extract_date(spark, path, day):
    assert one(spark, X.extract_date(F.lit(path), F.lit(0).cast("long"))) == day


def test_paths_and_weeks(spark):
    assert one(spark, X.directory(F.lit("a/b/c.md"))) == "a"
    assert one(spark, X.directory(F.lit("root.md"))) == "root.md"
    assert one(spark, X.base_name(F.lit("a/b/c.md"))) == "c"
    weeks = [one(spark, X.period(F.lit(d).cast("date"), "week")) for d in ("2024-01-01", "2024-01-07", "2024-01-08", "2024-12-31")]
    assert weeks == ["2024-W01", "2024-W01", "2024-W02", "2024-W53"]


@pytest.mark.parametrize(("seen", "days", "confidence", "weight"), [(1, 0, 1, 1.0), (3, 0, 1, 2.0), (1, 180, 1, 0.367879), (7, 90, 0.5, 0.909796), (1, -5, 1, 1.0)])
def test_weight(spark, seen, days, confidence, weight):
    got = one(spark, S.relationship_weight(F.lit(seen), F.date_sub(F.lit("2024-06-01").cast("date"), days), F.lit(float(confidence)), F.lit("2024-06-01").cast("date")))
    assert got == pytest.approx(weight, abs=1e-6)


def test_cosine(spark):
    assert one(spark, S.cosine(F.lit([1.0, 2.0]), F.lit([2.0, 1.0]))) == pytest.approx(0.8)
    assert one(spark, S.cosine(F.lit([0.0, 0.0]), F.lit([2.0, 1.0]))) == 0


def test_chunks():
    assert chunk("intro\n# A\nx\n## B") == [(0, "", "intro"), (1, "A", "# A\nx"), (2, "B", "## B")]
    assert [h for _, h, _ in chunk("# A\r\nx")] == [""]
    assert len(chunk("a" * 600 + "\n\n" + "b" * 500)) == 2
    assert len(chunk("a" * 2500)) == 1
    assert chunk("") == []


def test_query_grammar():
    columns = ("title", "content")
    assert Q.parse("a b", columns).op == "and"
    assert Q.parse('"a b" OR c*', columns).parts[0].parts[0].words == ("a", "b")
    assert Q.parse("title:x NOT y", columns).op == "not"
    assert Q.parse("", columns) is None
    assert [p.words for p in Q.parse('broken "quote', columns).phrases()] == [("broken",), ("quote",)]
