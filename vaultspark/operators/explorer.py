"""Statistics of the store, and browsing its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions.text import shaped


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table and rows of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in tables.items()])


def by_group(rows: DataFrame, column: str) -> DataFrame:
    """name and count of each value, the most frequent first."""
    return rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "name")


def distribution(rows: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The most frequent values with their share of all rows."""
    found = by_group(rows, column)
    total = found.agg(F.sum("count").alias("total"))
    return found.join(F.broadcast(total)).withColumn("share", F.col("count") / F.col("total")).drop("total").orderBy(F.desc("count"), "name").limit(limit)  # total is one row


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, column, position, type and nullable of each column of some tables."""
    def one(name: str, rows: DataFrame) -> DataFrame:
        columns = [F.struct(F.lit(f.name).alias("column"), F.lit(k).alias("position"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable")) for k, f in enumerate(rows.schema)]
        return rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.inline(F.array(*columns)))

    return reduce(DataFrame.unionByName, [one(name, rows) for name, rows in tables.items()])


def session_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables and views that a session knows."""
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables()}


def page(rows: DataFrame, sort: str | None = None, descending: bool = False, limit: int = 50, offset: int = 0, most: int = 500) -> tuple[DataFrame, int]:
    """(a page of shaped rows, number of all rows). An unknown column doesn't sort; columns after the first break ties."""
    total = rows.count()
    order = [F.desc(sort) if descending else F.asc(sort)] if sort in rows.columns else []
    rest = [c for c in rows.columns if c != sort and not dict(rows.dtypes)[c].startswith(("map", "variant"))]
    part = rows.orderBy(*order, *rest).offset(max(0, int(offset))).limit(min(most, max(0, int(limit))))
    return part.select(*[shaped(F.col(c), kind).alias(c) for c, kind in rows.dtypes]), total
