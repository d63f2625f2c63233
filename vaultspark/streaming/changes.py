"""Change feeds: notes that are modified, deleted and renamed, as a stream merged into the files table.

Events are ordered by their sequence, not by when they arrive. What was last written to a path is kept with its sequence, for deleted
paths as well, and renames are kept: an event that arrives late changes nothing if a later one was applied, and follows the
renames that came after it. So batches may come in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaultspark.functions import text as X
from vaultspark.operators import maintenance
from vaultspark.schemas import CHANGES, FILES, PATHS, RENAMES
from vaultspark.sources import markdown
from vaultspark.sources.scratch import scope, written


class FilesTable:
    """The files table as numbered versions below a folder, each with the state of paths and the renames; a pointer file names the one that counts.

    The last ``keep`` versions stay, for those who still read them.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 5) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), max(1, keep)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[tuple[int, str]]:
        """Batch and version of each pointer, the newest last."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        return sorted((int(n.split("-")[1]), n.split("-")[2]) for n in names if n.startswith("current-"))

    def _part(self, name: str, schema) -> DataFrame:  # noqa: ANN001
        found = self._versions()
        return self.spark.read.schema(schema).parquet(f"{self.root}/v-{found[-1][1]}/{name}") if found else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._part("files", FILES)

    def paths(self) -> DataFrame:
        return self._part("paths", PATHS)

    def renames(self) -> DataFrame:
        return self._part("renames", RENAMES)

    def last_batch(self) -> int:
        found = self._versions()
        return found[-1][0] if found else -1

    def write(self, files: DataFrame, paths: DataFrame, renames: DataFrame, batch: int) -> None:
        """A new version; it counts once its pointer exists, so that a half-written one is never read. Old ones go."""
        version = uuid.uuid4().hex
        for name, rows, schema in (("files", files, FILES), ("paths", paths, PATHS), ("renames", renames, RENAMES)):
            rows.select(*schema.names).write.parquet(f"{self.root}/v-{version}/{name}")
        self._fs.create(self._path(f"{self.root}/current-{batch}-{version}")).close()
        for old_batch, old in self._versions()[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/current-{old_batch}-{old}"), False)
            self._fs.delete(self._path(f"{self.root}/v-{old}"), True)


def followed(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """``rows`` (path, pos and others) where the renames after ``pos`` took them, one after the other; ``pos`` becomes the last one's sequence."""
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "events")
    moves = renames.select(F.col("old_path").alias("path"), F.col("path").alias("__to"), F.col("seq").alias("__at"))
    while True:
        step = rows.join(moves, "path").where("__at > pos").groupBy("__row").agg(F.min(F.struct("__at", "__to")).alias("__next"))
        step = written(step, "moves")
        if step.isEmpty():
            return rows.drop("__row")
        rows = rows.join(step, "__row", "left")
        rows = written(rows.withColumns({"path": F.coalesce("__next.__to", "path"), "pos": F.coalesce("__next.__at", "pos")}).drop("__next"), "events")


def merged(files: DataFrame, paths: DataFrame, renames: DataFrame, changes: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, paths, renames) after a batch of changes. At each path the last write counts: what came there last, then what was written last; a modification goes before a deletion at the same time."""
    events = written(changes.withColumn("seq", F.coalesce("seq", "modified_at")), "changes")
    new = events.where("op = 'rename' and old_path <> path").select("old_path", "path", "seq")
    renames = written(renames.unionByName(new).distinct(), "renames")

    known = files.select("path").join(paths.where("not gone"), "path", "left")
    olds = files.join(known.select("path", "pos", "seq"), "path", "left")
    olds = olds.withColumns({"pos": F.coalesce("pos", "modified_at"), "seq": F.coalesce("seq", "modified_at"), "__was": F.col("path")})
    olds = followed(olds, renames)
    last = olds.groupBy("path").agg(F.max(F.struct("pos", "seq", "__was")).alias("m")).select("path", F.col("m.__was").alias("__was"))
    olds = olds.join(last, ["path", "__was"])
    moved = F.col("path") != F.col("__was")
    olds = olds.withColumns({"title": F.when(moved, X.base_name(F.col("path"))).otherwise(F.col("title")), "directory": F.when(moved, X.directory(F.col("path"))).otherwise(F.col("directory"))})
    olds = written(olds, "olds")

    writes = followed(events.where("op in ('modify', 'delete')").select("path", F.col("seq").alias("pos"), "seq", "op", "modified_at", "raw"), renames)
    news = writes.groupBy("path").agg(F.max_by(F.struct("op", "modified_at", "raw", "pos", "seq"), F.struct("pos", "seq", "op")).alias("n"))
    there = olds.select("path", "pos", "seq", F.lit(False).alias("gone")).unionByName(paths.where("gone"))
    there = there.groupBy("path").agg(F.max(F.struct("pos", "seq", "gone")).alias("o"))
    both = there.join(news, "path", "full_outer")
    wins = F.col("n").isNotNull() & (F.col("o").isNull() | (F.struct("n.pos", "n.seq") >= F.struct("o.pos", "o.seq")))
    both = written(both.withColumn("wins", F.coalesce(wins, F.lit(False))), "writes")
    state = both.select("path", *[F.when(F.col("wins"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("pos", "seq")], F.when(F.col("wins"), F.col("n.op") == "delete").otherwise(F.col("o.gone")).alias("gone"))

    gone = state.where("gone").select("path")
    notes = markdown.parse(both.where("wins and n.op = 'modify'").select("path", "n.modified_at", "n.raw"))
    return maintenance.upserted(olds.select(*files.columns).join(gone, "path", "left_anti"), notes, now_ms), state, renames


def applied(files: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Files after a batch of changes, if nothing is known of earlier ones."""
    spark = files.sparkSession
    return merged(files, spark.createDataFrame([], PATHS), spark.createDataFrame([], RENAMES), changes, now_ms)[0]


def merge_into(table: FilesTable, clock: Callable[[], int], progress: Callable[[int, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merge each batch once, however often it is tried. ``progress`` hears of each batch and its number of events, or -1 if it failed."""

    def merge(batch: DataFrame, number: int) -> None:
        if number <= table.last_batch():
            return
        try:
            with scope(table.spark):
                table.write(*merged(table.read(), table.paths(), table.renames(), batch, clock()), number)
        except Exception:
            if progress:
                progress(number, -1)
            raise
        if progress:
            progress(number, batch.count())

    return merge


def ingest(spark: SparkSession, feed: str, table: FilesTable, checkpoint: str, clock: Callable[[], int], files_per_batch: int = 50, progress: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Merge all changes that wait in the JSON files of ``feed``, in batches, and stop."""
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(feed)
    return stream.writeStream.foreachBatch(merge_into(table, clock, progress)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events and their value by type in event-time windows; rows later than the watermark are left out. Works on streams and tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_counts(observations: DataFrame) -> DataFrame:
    """seen_count, last_seen and confidence of each relationship so far; on a stream, to be written in update mode."""
    counted = (F.count("*").alias("seen_count"), F.max("observed_on").alias("last_seen"), F.max("confidence").alias("confidence"))
    return observations.groupBy("source_id", "target_id", "type").agg(*counted)
