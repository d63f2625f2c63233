"""Keeping the files table up to date with scanned notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import text as X

STAMPS = ["graph_extracted_at", "embedded_at", "llm_extracted_at"]


def changed(scanned: DataFrame, files: DataFrame, force: bool = False, tolerance_ms: int = 1000) -> DataFrame:
    """Scanned notes that are new, or whose modification differs by ``tolerance_ms`` or more."""
    old = files.select("path", F.col("modified_at").alias("__old"))
    rows = scanned.join(old, "path", "left")
    test = F.lit(force) | F.col("__old").isNull() | (F.abs(F.col("modified_at") - F.col("__old")) >= tolerance_ms)
    return rows.where(test).drop("__old")


def upserted(files: DataFrame, notes: DataFrame, now_ms: int | Column) -> DataFrame:
    """Files after indexing parsed notes: a known path keeps its id and its stamps."""
    kept = files.select("path", F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in STAMPS])
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    new = notes.join(kept, "path", "left").withColumns({"id": F.coalesce("__id", F.xxhash64("path")), "indexed_at": now} | {c: F.col(f"__{c}") for c in STAMPS})
    return files.join(notes.select("path"), "path", "left_anti").select(*files.columns).unionByName(new.select(*files.columns))


def removed(files: DataFrame, embeddings: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, embeddings) without some paths; facts and relationships stay."""
    left = files.join(paths, "path", "left_anti")
    gone = files.join(paths, "path", "left_semi").select(F.col("id").alias("file_id"))
    return left, embeddings.join(gone, "file_id", "left_anti")


def renamed(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Files after renames (old_path, path): path, title and directory change, all else stays."""
    rows = files.join(renames.select(F.col("old_path").alias("path"), F.col("path").alias("__new")), "path", "left")
    new, known = F.col("__new"), F.col("__new").isNotNull()
    changes = {"title": X.base_name(new), "directory": X.directory(new), "path": new}
    return rows.withColumns({c: F.when(known, v).otherwise(F.col(c)) for c, v in changes.items()}).select(*files.columns)


def without_stale(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Files whose path was scanned."""
    return files.join(scanned.select("path"), "path", "left_semi")


def stale(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Files whose path wasn't."""
    return files.join(scanned.select("path"), "path", "left_anti")


def stamped(files: DataFrame, done: DataFrame, column: str, now_ms: int) -> DataFrame:
    """``column`` set for the paths in ``done``."""
    marked = done.select("path").distinct().withColumn("__done", F.lit(True))
    return files.join(marked, "path", "left").withColumn(column, F.when(F.col("__done"), F.lit(now_ms)).otherwise(F.col(column))).select(*files.columns)


def to_extract(files: DataFrame, column: str = "graph_extracted_at", force: bool = False, limit: int | None = None) -> DataFrame:
    """Files never extracted, or modified since; the first ``limit`` by path."""
    rows = files if force else files.where(F.col(column).isNull() | (F.col(column) < F.col("modified_at")))
    return rows if limit is None else rows.orderBy("path").limit(limit)
