"""Near-duplicate documents by an exact Jaccard join on word shingles, with adaptive multi-match prefixes.

A document is the set of its 5-word shingles, as 64-bit hashes. Two documents link at a Jaccard similarity of
0.8 or more. All sets follow one order of shingles, the rarest first by a sketch of how many documents hold each. For
a whole number l, similar documents share at least l of the first n - ceil(0.8 n) + l shingles of
each. Every document picks its own l: a longer prefix costs more postings, but a candidate must then share
more of them; the sketch gives the estimate of both costs. A pair is a candidate if its prefixes share at least the
smaller of its two numbers.

What is asked for are the classes of linked documents, so no group of copies is expanded into pairs:

1. Documents with equal sets are linked through the least of them, which alone goes on.
2. Each document that shares prefix shingles with others is compared with one of them, its pivot: the one whose shingles
   are the most frequent, which in a group of edited copies is the original or next to it. This costs as much as the group is large.
3. Two documents with one pivot p are told apart by their differences from p, the shingles that only one of both sets has. If
   s doesn't link with p, and s and c link, they share more than (4 added + 5 missing) / 9 of c's
   differences. So of any k of c's differences, s has k less the others, at least one if k is large enough. Those k are the ones
   that c has beyond p, the rarest first, then those it misses. Only pairs that share as many are verified. An edit of a copy
   adds shingles of its own, so that a group's strays aren't held against all its members: this grows with the group, not
   with its square.
4. Shingles whose documents are in different classes, with different pivots, go through 2 and 3 again, ``ROUNDS`` times, and on
   while they would form more than ``CROWD`` pairs a posting and a round takes a fifth of these away, up to ``MOST_ROUNDS`` times. Then the candidate pairs of documents
   that never had one pivot, and are of different classes, are formed and verified. With step 3 this makes the result
   exact: no link between classes is missed, however many rounds there were.

Defined results: without words or text a document has no shingle, links with nothing and is its own component; with
fewer than five words the whole sequence is its one shingle. Rows that share a doc_id are one document in the links. A null
doc_id links with nothing and has a null component. Other columns of the input aren't returned. Hashes are taken as
the shingles; two different ones agree with a probability of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import bucketed, mix, rested, scope, shingles, steps, utf8, words, written
from vaultspark.llm.graph import components
from vaultspark.llm.tables import merged, packed, unpacked

#: The sketch: 2^21 counters of 4 bytes, whatever the input; every worker holds it.
BITS = 21
SLICE = 1 << 16
#: Largest number of shared shingles that a prefix is lengthened for.
MOST_SHARED = 8
#: How often documents are compared with a pivot before pairs are formed: at least, and at most where shingles are crowded.
ROUNDS, MOST_ROUNDS = 2, 6
#: Pairs a posting from which shingles are crowded.
CROWD = 4
#: Cost of verifying a candidate, in postings.
VERIFY = 20.0


def shared_at_least(n):  # noqa: ANN001, ANN201
    """ceil(0.8 n): what a set of n shares with any set it links with."""
    return (4 * n + 4) // 5


def linked(both: int, a: int, b: int) -> bool:
    return 100 * both >= 80 * (a + b - both) and both > 0


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    raw, at = utf8(texts)
    word, _, _, of = words(raw, at)
    runs, start = shingles(word, of)
    for k in range(len(texts)):
        yield np.unique(runs[start[k] : start[k + 1]])


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, from sums of hashes that don't depend on order."""
    one, two = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles) and the two halves of the set's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                own = list(sets(part.column("text")))
                marks = [_signature(s) for s in own]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), *(pa.array([m[i] for m in marks], pa.int64()) for i in (0, 1))],
                    ["doc_id", "n", "s1", "s2"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def sketch(docs: DataFrame) -> np.ndarray:
    """Documents by shingle bucket, over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for part in steps(batch, "text"):
                own = list(sets(part.column("text")))
                all_ = bucket(np.concatenate(own)) if own else np.zeros(0, np.int64)
                count += np.bincount(all_, minlength=1 << BITS).astype(np.uint32) if len(all_) > SLICE else _few(all_)
        if count.any():
            slices = count.reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([packed(s) for s in slices], pa.binary())], ["slice", "payload"])

    def _few(at: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << BITS, np.uint32)
        np.add.at(out, at, 1)
        return out

    def add(payloads: Iterator[bytes]) -> bytes:
        total = np.zeros(SLICE, np.uint32)
        for p in payloads:
            x = unpacked(p, np.uint32)
            total = np.maximum(total + x, np.maximum(total, x))  # a sum that runs over stays large
        return packed(total)

    parts = docs.select("text").mapInArrow(run, "slice int, payload binary")
    out = np.zeros((1 << BITS) // SLICE * SLICE, np.uint32)
    for row in merged(parts, add, docs.rdd.getNumPartitions()).collect():  # 8 MB at most
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = unpacked(row["payload"], np.uint32)
    return out


def prefix(s: np.ndarray, counts: np.ndarray, noise: float) -> tuple[np.ndarray, int]:
    """The shingles of a set's prefix and the number it is made for."""
    n = len(s)
    often = counts[bucket(s)]
    order = np.lexsort((s, often))
    base = n - int(shared_at_least(n))
    most = min(MOST_SHARED, int(shared_at_least(n)))
    tail = np.maximum(often[order[: base + most]].astype(float) - noise, 0).cumsum()
    number = np.arange(1, most + 1)
    postings = tail[base + number - 1]
    best = int(np.argmin(postings + VERIFY * postings / number)) + 1 if postings[0] > 0 else 1
    return s[order[: base + best]], best


def postings(docs: DataFrame, counts) -> DataFrame:  # noqa: ANN001
    """token, doc_id, l, n and warmth of each prefix shingle. ``counts``: the sketch, broadcast.

    The warmth of a set is how frequent its shingles are, as the mean logarithm of their counts.
    """
    noise = float(np.median(counts.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                tokens, rows = [], []
                for doc, s in zip(part.column("doc_id").to_pylist(), sets(part.column("text")), strict=True):
                    if len(s):
                        p, number = prefix(s, counts.value, noise)
                        tokens.append(p)
                        rows.append((doc, number, len(s), int(np.log(counts.value[bucket(s)] + 1.0).mean() * (1 << 24))))
                if tokens:
                    sizes = [len(p) for p in tokens]
                    each = (pa.array(np.repeat(np.array([r[i] for r in rows], t), sizes)) for i, t in enumerate((np.int64, np.int8, np.int64, np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), *each], ["token", "doc_id", "l", "n", "warmth"])

    return docs.mapInArrow(run, "token long, doc_id long, l byte, n long, warmth long")


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set as bits, 4 to 8 for each shingle: as bytes, a power of two of them."""
    size = max(8, 1 << (max(1, len(s) // 2) - 1).bit_length())
    out = np.zeros(8 * size, bool)
    out[(s & np.uint64(8 * size - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def most_shared(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> int:
    """What two sets share at most, by their bitmaps: each bit that only one has stands for a shingle that only this one has."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


class Texts:
    """The texts that pairs are made of, bucketed by document, and a bitmap of each.

    Pairs are first tried by bitmaps, which are a small part of the texts; only the texts of pairs that these leave are read, and
    because of the buckets no others are shuffled.
    """

    def __init__(self, docs: DataFrame, ids: DataFrame) -> None:
        """The texts of ``ids``, a written table."""
        self.buckets = max(1, min(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        dealt = docs.select("doc_id", "text").where("doc_id is not null").repartition(self.buckets, "doc_id")
        self.texts = bucketed(dealt, "doc_id", self.buckets, "texts").join(ids, "doc_id", "left_semi")

    def map(self, ids: DataFrame) -> None:
        """Make the bitmaps of ``ids``, a written table, of which all pairs must be."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, "text"):
                    own = list(sets(part.column("text")))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), pa.array([bitmap(s).tobytes() for s in own], pa.binary())], ["doc_id", "n", "bits"])

        self.maps = bucketed(self.texts.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, n long, bits binary"), "doc_id", self.buckets, "maps")

    def _of(self, table: DataFrame, pairs: DataFrame, side: str, **names: str) -> DataFrame:
        """``table``'s rows of one side's documents, renamed for it."""
        needed = written(pairs.select(F.col(side).alias("doc_id")).distinct(), "needed")  # a scan takes on the buckets' partitioning
        return table.join(needed, "doc_id", "left_semi").select(F.col("doc_id").alias(side), *[F.col(c).alias(to) for c, to in names.items()])

    def plausible(self, pairs: DataFrame, of: int, part: int) -> DataFrame:
        """Pairs (a, b) that may share ``part`` of ``of`` equal parts of their union, written."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_a, n_b, x, y = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
                keep = np.zeros(batch.num_rows, bool)
                for k in range(batch.num_rows):
                    if of * min(n_a[k], n_b[k]) < part * max(n_a[k], n_b[k]):
                        continue
                    both = most_shared(np.frombuffer(x[k], np.uint8), n_a[k], np.frombuffer(y[k], np.uint8), n_b[k])
                    keep[k] = of * both >= part * (n_a[k] + n_b[k] - both)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

        pairs = written(pairs.select("a", "b"), "pairs")
        other = written(self._of(self.maps, pairs, "b", n="n_b", bits="bits_b"), "other")  # so that the join can split a document with very many partners
        joined = pairs.join(self._of(self.maps, pairs, "a", n="n_a", bits="bits_a"), "a").join(other, "b")
        return written(joined.mapInArrow(run, "a long, b long").distinct(), "plausible")

    def beside(self, pairs: DataFrame) -> DataFrame:
        """a, b, text_a, text_b of each pair."""
        other = written(self._of(self.texts, pairs, "b", text="text_b"), "other")
        with_a = pairs.join(self._of(self.texts, pairs, "a", text="text_a"), "a")
        return with_a.join(other, "b").select("a", "b", "text_a", "text_b")


def _sets_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ids and sets of each pair; the second set is kept while it stays the same."""
    last_id, last = None, None
    for batch in batches:
        for part in steps(batch, "text_a"):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            other = part.column("text_b")
            for k, s in enumerate(sets(part.column("text_a"))):
                if b[k] != last_id:
                    last_id, last = b[k], next(sets(other.slice(k, 1)))
                yield a[k], b[k], s, last


def verified(pairs: DataFrame, texts: Texts) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for a, b, s, t in _sets_of_pairs(batches):
            both = len(np.intersect1d(s, t, assume_unique=True))
            if linked(both, len(s), len(t)):
                out.append((a, b, both / (len(s) + len(t) - both)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return texts.beside(texts.plausible(pairs, 5, 4)).mapInArrow(run, "a long, b long, similarity double")


def compared(pairs: DataFrame, texts: Texts, counts) -> DataFrame:  # noqa: ANN001
    """a, n shingles of it, its pivot b, whether they link, how many shingles a has added and misses, its differences in their order, how many of these tell, and how many of those a partner has at least.

    Pairs that are less similar than one half are left out; documents that link keep only the differences that tell.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32())
    names = ["a", "n", "b", "linked", "added", "missing", "differences", "telling", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for a, b, s, p in _sets_of_pairs(batches):
            both = np.intersect1d(s, p, assume_unique=True)
            if 2 * len(both) < len(s) + len(p) - len(both):
                continue
            more, less = np.setdiff1d(s, both, assume_unique=True), np.setdiff1d(p, both, assume_unique=True)
            more = more[np.lexsort((more, counts.value[bucket(more)]))]
            less = less[np.lexsort((less, -counts.value[bucket(less)].astype(np.int64)))]  # what nearly all have is missing in few
            need = len(more) + len(less) - (4 * len(more) + 5 * len(less)) // 9
            telling = max(need, len(more))
            links = linked(len(both), len(s), len(p))
            apart = np.concatenate([more, less]).astype(np.int64)
            out.append((a, len(s), b, links, len(more), len(less), apart[:telling] if links else apart, telling, telling - need + 1))
            size += len(out[-1][6])
            if size > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names)

    return texts.beside(texts.plausible(pairs, 2, 1)).mapInArrow(run, "a long, n long, b long, linked boolean, added int, missing int, differences array<long>, telling int, least int")


#: Pairs whose sizes allow a link.
NEAR = "5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"


def _classed(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``found`` with the class of each document by now."""
    classes = labels.select(F.col("node").alias("doc_id"), "label")
    return found.join(classes, "doc_id", "left").withColumn("class", F.coalesce("label", "doc_id")).drop("label")


def _regrouped(found: DataFrame, labels: DataFrame, held: DataFrame, pivot: str) -> DataFrame:
    """``found`` with the classes and pivots by now, of those shingles whose documents differ in class and in each pivot."""
    own = held.select(F.col("a").alias("node"), F.col("b").alias(pivot))
    marks = written(labels.join(own, "node", "full_outer").withColumnRenamed("node", "doc_id"), "marks")
    found = found.drop("class").join(marks, "doc_id", "left")
    found = written(found.withColumn("class", F.coalesce("label", "doc_id")).withColumn(pivot, F.coalesce(pivot, "doc_id")).drop("label"), "marked")
    told = ["class", *[c for c in found.columns if c.startswith("pivot")]]
    tokens = found.groupBy("token").agg(*[f(c).alias(f"{x}_{c}") for c in told for f, x in ((F.min, "low"), (F.max, "high"))])
    tokens = tokens.where(" and ".join(f"low_{c} != high_{c}" for c in told)).select("token")
    return written(found.join(written(tokens, "mixed"), "token"), "shared", 1)


def _pivots(found: DataFrame) -> DataFrame:
    """a and b: for each document one of the warmest documents of its shingles, of another class.

    Of those that share at least half as many shingles as the best, the one that most documents could take.
    """
    warmest = found.groupBy("token").agg(*[F.max_by(c, "warmth").alias(to) for c, to in (("doc_id", "b"), ("n", "n_b"), ("class", "c_b"))])
    tried = found.withColumnRenamed("n", "n_a").join(written(warmest, "warmest"), "token").where(f"class != c_b and doc_id != b and {NEAR}")
    tried = written(tried.groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("m")), "tried")
    many = written(tried.groupBy("b").agg(F.count("*").alias("many")), "many")
    best = tried.groupBy("a").agg(F.max("m").alias("best"))
    good = tried.join(best, "a").where("2 * m >= best").drop("best").join(many, "b")
    return good.groupBy("a").agg(F.max_by("b", F.struct("many", "m", -F.col("b"))).alias("b"))


def _by_differences(held: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Candidate pairs with one pivot: enough telling differences of one are differences of the other, which doesn't link with the pivot."""
    rows = held.withColumnRenamed("a", "doc_id")
    rows = _classed(rows, labels) if labels is not None else rows.withColumn("class", F.col("doc_id"))
    own = ("n", "added", "missing")
    c = rows.select(F.col("doc_id").alias("a"), F.col("class").alias("c_a"), *[F.col(x).alias(f"{x}_a") for x in own], F.col("b").alias("pivot"), "least", F.explode(F.expr("slice(differences, 1, telling)")).alias("token"))
    s = rows.where("not linked").select(F.col("doc_id").alias("b"), F.col("class").alias("c_b"), *[F.col(x).alias(f"{x}_b") for x in own], F.col("b").alias("pivot"), F.explode("differences").alias("token"))
    # linked sets differ in at most a ninth of their sizes' sum
    found = c.join(s, ["pivot", "token"]).where("a != b and c_a != c_b and 9 * (abs(added_a - added_b) + abs(missing_a - missing_b)) <= n_a + n_b")
    pairs = found.groupBy("a", "b").agg(F.count("*").alias("m"), F.min("least").alias("least")).where("m >= least")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pairs(found: DataFrame, pivots: list[str]) -> tuple[float, int]:
    """(pairs that the shingles of ``found`` would form at most, postings): of one shingle, those with different pivots in the round that leaves the fewest."""
    least = None
    for pivot in pivots:
        size = found.groupBy("token", pivot).count().groupBy("token").agg(F.sum("count").alias("n"), ((F.sum("count") ** 2 - F.sum(F.col("count") ** 2)) / 2).alias("pairs"))
        least = size if least is None else least.unionByName(size)
    pairs, rows = least.groupBy("token").agg(F.min("pairs").alias("pairs"), F.first("n").alias("n")).agg(F.sum("pairs"), F.sum("n")).first()
    return pairs or 0.0, rows or 0


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(described documents, component labels), both written: doc_id, n, s1, s2 and node, label of linked documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scope(spark):
        about = written(describe(docs), "about", 1)
        known = about.where("doc_id is not null and n > 0")
        groups = written(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("top")), "groups")
        same = known.select("s1", "s2", F.col("doc_id").alias("u")).join(groups.where("v != top"), ["s1", "s2"]).where("u != v").select("u", "v")
        same = written(same, "same")

        # From here on, one document stands for each set.
        texts = Texts(docs, groups.select(F.col("v").alias("doc_id")))
        counts = spark.sparkContext.broadcast(sketch(texts.texts))
        found = written(postings(texts.texts, counts), "postings")
        tokens = found.groupBy("token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high")
        found = written(found.join(written(tokens.select("token"), "tokens"), "token").withColumn("class", F.col("doc_id")), "shared")
        texts.map(written(found.select("doc_id").distinct(), "ids"))
        rested(spark)

        edges, labels, pivots, before, now, rows = None, None, [], np.inf, np.inf, 0
        while len(pivots) < ROUNDS or (len(pivots) < MOST_ROUNDS and now > CROWD * rows and now < 0.8 * before):
            pivots.append(f"pivot{len(pivots)}")
            with scope(spark):
                held = written(compared(_pivots(found), texts, counts), "compared")
                near = verified(_by_differences(held, labels), texts).select(F.col("a").alias("u"), F.col("b").alias("v"))
                new = held.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(near)
                edges = written(new if edges is None else edges.unionByName(new), "links", 1)
                labels = components(edges, 1)
                found = _regrouped(found, labels, held, pivots[-1])
            rested(spark)
            before, (now, rows) = now, _pairs(found, pivots)

        a, b = (found.select("token", F.col("doc_id").alias(x), F.col("class").alias(f"c_{x}"), F.col("l").alias(f"l_{x}"), F.col("n").alias(f"n_{x}"), *[F.col(p).alias(f"{p}_{x}") for p in pivots]) for x in "ab")
        apart = " and ".join(["a < b", "c_a != c_b", NEAR, *[f"{p}_a != {p}_b" for p in pivots]])
        pairs = a.join(b, "token").where(apart).groupBy("a", "b").agg(F.count("*").alias("m"), F.min(F.least("l_a", "l_b")).alias("least"))
        new = verified(pairs.where("m >= least"), texts).select(F.col("a").alias("u"), F.col("b").alias("v"))
        labels = components(written(edges.unionByName(new).unionByName(same), "links"), 1)
        counts.destroy()
        return about, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    about, labels = link(docs)
    out = about.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))
