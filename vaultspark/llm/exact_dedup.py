"""Exact duplicates by a distributed radix partitioning, most significant bytes first.

Documents are split by successive digits of their normalised text until each group holds one
document or has no bytes left. A digit is a run of whole characters; its width grows from round to
round, so that the number of rounds grows with the logarithm of the longest text. The first digit
carries the length as well, which sets apart texts that only differ in where they end. Groups are
found by comparing the digits themselves, not a digest of them.

The first round counts digits alone. Which of them are shared goes to all executors as a bitmap of hashes (``PER_GROUP`` bits for each,
``MOST_BITS`` at most, which is 32 MB), so that a document whose digit is in no other is decided where it is read, and its text isn't
moved; if the bitmap fills up, more texts are, and results stay the same. Each further round is one partial aggregation and one
join back to the documents that still share a group.
Nothing gathers a group in one task: the aggregation sends one row per group and task, and its result is
written, so that Spark splits a skewed side of the join. Tables between rounds have a few files for each core, however many
partitions the session has. Executors collect their garbage before each pass over texts, the caller's included.

Defined results: null text counts as empty, and empty texts are equal to one another. Equality
ignores the case of A-Z only. Rows that repeat a doc_id in one group share its decision. A null
doc_id counts in group_size and isn't kept unless the group has no other id: then keep_id is null and its rows are kept.
Other columns of the input aren't returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import lower_az, rested, written

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _decided(df: DataFrame) -> DataFrame:
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return df.withColumn("kept", kept).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


#: Bits of the bitmap for each shared digit, and at most; bits of one of its rows.
PER_GROUP, MOST_BITS, SLICE = 16, 1 << 28, 1 << 15

#: Files of a table between rounds, for each core, at most.
FILES = 4


def _between(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to few files: on a local disk Hadoop starts a child (``chmod``) for each, which shares the JVM's memory until it runs, and is counted with it."""
    return written(df.coalesce(FILES * df.sparkSession.sparkContext.defaultParallelism), name)


def _flagged(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false where length and digit are surely none of the shared ones."""
    n = shared.count()
    bits = min(MOST_BITS, max(SLICE, 1 << (PER_GROUP * n).bit_length()))
    place = F.pmod(F.xxhash64("length", "digit"), F.lit(bits))
    maps = shared.select(place.alias("at")).groupBy(F.expr(f"at div {SLICE}").alias("slice")).agg(F.bitmap_construct_agg(F.col("at") % SLICE).alias("bits"))
    maps = _between(maps, "maps")
    found = rows.withColumn("at", place).withColumn("slice", F.expr(f"at div {SLICE}")).join(F.broadcast(maps), "slice", "left")  # 32 MB at most
    byte = F.conv(F.hex(F.expr(f"substring(bits, cast((at % {SLICE}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("1").cast("int").bitwiseAND(F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")))
    return found.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("at", "slice", "bits")


def exact_duplicates(docs: DataFrame, first_digit: int = 32, growth: int = 64) -> DataFrame:
    """For each document its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256."""
    rested(docs.sparkSession)
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
    length = F.octet_length("raw").alias("length")  # folding A-Z keeps it
    digit = lower_az(F.substring("raw", 1, first_digit)).alias("digit")
    groups = raw.select("doc_id", length, digit).groupBy("length", "digit").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    shared = _between(groups.where("n > 1"), "shared")  # so that the join can split a hot digit
    norm = lower_az(F.col("raw"))
    rows = _flagged(raw.select("doc_id", "raw", length, digit), shared)
    rested(docs.sparkSession)
    rows = rows.select("doc_id", "length", "digit", "maybe", norm.alias("norm"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    alone = rows.where("not maybe").select("doc_id", "sha", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("keep_id"))
    joined = rows.where("maybe").join(shared, ["length", "digit"], "left")
    left = F.col("n").isNotNull() & (F.char_length("norm") > first_digit)
    state = _between(
        joined.select(
            "doc_id", "length", "digit", "sha",
            F.monotonically_increasing_id().alias("row"),
            F.coalesce("n", F.lit(1)).cast("long").alias("n"),
            F.when(F.col("n").isNotNull(), F.col("top")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.when(left, F.col("norm")).alias("norm"),
        ),
        "radix",
    )
    done = [alone, state.where("norm is null")]
    keys, at, width = ["length", "digit"], first_digit, first_digit * growth
    rest = state.where("norm is not null")
    longest = rest.agg(F.max(F.char_length("norm"))).first()[0] or 0
    while at < longest:
        rested(docs.sparkSession)
        live = rest.withColumn("next", F.substring("norm", at + 1, width))
        groups = live.groupBy(*keys, "next").agg(F.count("*").alias("m"), F.max("doc_id").alias("top"), F.min("row").alias("first"))
        groups = _between(groups, "shared")
        here = live.drop("n", "keep_id").join(groups, [*keys, "next"])
        at, width = at + width, width * growth
        more = (F.col("m") > 1) & (F.char_length("norm") > at)
        state = _between(
            here.select(
                "doc_id", "sha", "row", F.col("first").alias("gid"), F.col("m").alias("n"),
                F.when(F.col("m") > 1, F.col("top")).otherwise(F.col("doc_id")).alias("keep_id"),
                F.when(more, F.col("norm")).alias("norm"),
            ),
            "radix",
        )
        done.append(state.where("norm is null"))
        rest, keys = state.where("norm is not null"), ["gid"]
    rested(docs.sparkSession)
    return reduce(DataFrame.unionByName, [_decided(x) for x in done])


def without_duplicates(docs: DataFrame, first_digit: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts those with the largest id, and of rows that are equal in id as well, one.

    Rows whose first digit is in no other stay where they are read; only the others are decided on, and joined with what was decided.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    columns = [f"`{c}`" for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("doc"), "doc_id", F.octet_length(raw).alias("length"), lower_az(F.substring(raw, 1, first_digit)).alias("digit"))
    shared = _between(keyed.groupBy("length", "digit").count().where("count > 1").select("length", "digit"), "shared")
    flagged = _flagged(keyed, shared)
    alone, rest = flagged.where("not maybe").select("doc.*"), flagged.where("maybe").select("doc.*")
    kept = exact_duplicates(rest, first_digit).where("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).agg(F.count("*").alias("_rows"))
    kept = _between(kept, "kept")
    same = F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.sha2(lower_az(raw).cast("binary"), 256) == F.col("_kept_sha"))
    once = rest.join(kept.where("_rows = 1"), same, "left_semi")
    again = rest.join(kept.where("_rows > 1"), same).dropDuplicates(["_kept_id", "_kept_sha"]).select(columns)
    return alone.unionByName(once).unionByName(again)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
