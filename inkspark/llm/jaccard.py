"""Set-similarity join over word n-grams, with components.

A text's set holds the 64-bit hashes of its distinct five-word shingles (words
as in :mod:`._text`, A-Z lower-cased); a text with fewer words is one shingle.
Two texts link when 100 * intersection >= percent * union.

Texts with equal sets form a class, known by a 64-bit fingerprint of the set.
Whatever links classes is found in three steps:

1. *Survivors.* Every text gives a prefix of its set in hash order, a little
   longer than the prefix filter needs; partners must then share several of
   its n-grams, not one. Texts whose prefix holds fewer n-grams that occur
   elsewhere have no partner and leave. No text is lost: for sizes n and m and
   overlap of at least percent/100 of either, the first
   n - overlap + l and m - overlap + l n-grams have l in common.
2. *Candidates.* Among the survivors' classes document frequencies are counted
   exactly and each set is ordered rare-first. Prefix n-grams are joined, under
   the length filter and the positional filter.
3. *Verification.* Each candidate pair is verified once, behind the suffix
   filter, by intersecting the two ordered sets.

With ``spanning`` (enough for components) candidates come in rounds: at first
each n-gram's texts meet only one of them, its hub, and each text is held
against the hub it meets most often; at last all texts that are still in
different components meet, those of an n-gram's largest component standing on
one side only. So a group of near copies costs links in proportion to its
size and not to its square, and no link between components is missed. Without
it every candidate pair is verified and all links are returned.

Defined results: a null or empty text, or one without words, has no shingles
and links with nothing; repeated rows are members of one class; ``doc_id`` may
be null or repeat, as classes are known by content; n-grams of equal frequency
are ordered by their hash; a very long text is one set like any other, handled
whole by its task; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import HEAVY, drop, store, unique_join
from ._text import Words, mix, words
from .links import components

#: Share of a set by which survivors' prefixes exceed the plain prefix filter.
EXTRA = 0.05
#: Rounds in which every text is held against one hub, before the complete one.
ROUNDS = 2
#: Rows of one n-gram and size class that a task meets at once.
BLOCK = 2000
#: Ids of surviving classes up to which they are broadcast (eight bytes each); beyond that they are joined by shuffle.
MAX_BROADCAST = 1_000_000
#: Fingerprints that a task remembers, so that equal texts give their prefix once.
SEEN = 500_000
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _shingles(w: Words, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a chunk."""
    h = w.hashes()
    full = max(len(h) - size + 1, 0)
    grams = np.zeros(full, np.uint64)
    for k in range(size):
        grams += h[k : k + full] * _FACTORS[k]
    grams = mix(grams)
    for row, a, b in w.rows():
        if b - a >= size:
            yield row, np.unique(grams[a : b - size + 1])
        elif b > a:
            yield row, mix(np.sum(h[a:b] * _FACTORS[: b - a], dtype=np.uint64, keepdims=True) + _FACTORS[size + b - a : size + b - a + 1])
        else:
            yield row, h[:0]


def _least(n: int, percent: int) -> int:
    """Smallest overlap with any partner: ceil(percent/100 * n)."""
    return -(-n * percent // 100)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def shingle_sets(docs: DataFrame, percent: int, size: int, heads: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class fingerprint k (null without shingles), set size n, and n-grams.

    ``grams`` is the extended prefix in hash order if ``heads``, else the set;
    ``need`` is how many of a prefix some partner must share. With ``heads`` a
    text whose equal the task has met before gives no n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1), lower=True):
                keys, counts, need, grams = [], [], [], []
                for _, found in _shingles(w, size):
                    n = len(found)
                    keys.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True) if n else None)
                    counts.append(n)
                    partner = _least(n, percent)
                    need.append(max(1, int(EXTRA * partner)))
                    if heads:
                        grams.append(found[: 0 if keys[-1] in seen else n - partner + max(1, int(EXTRA * n))])
                        if len(seen) < SEEN:
                            seen.add(keys[-1])
                    else:
                        grams.append(found)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.first, w.count), pa.array(keys, pa.int64()), pa.array(counts, pa.int32()), pa.array(need, pa.int32()), _lists(grams)],
                    names=["doc_id", "k", "n", "need", "grams"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, k long, n int, need int, grams array<long>")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """Survivors' classes: k, n, the count u of n-grams that no other class has, and the others rare-first."""
    rows = sets.select("k", "n", F.explode("grams").alias("gram"))
    common = rows.groupBy("gram").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return (
        rows.join(common, "gram")
        .groupBy("k", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("shared"))
        .select("k", "n", (F.col("n") - F.size("shared")).alias("u"), F.col("shared.gram").alias("grams"))
        .where(prefix > F.col("u"))
    )


def _overlap(n: str, m: str, percent: int):
    """Smallest intersection of linked sets of sizes n and m."""
    return F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent))


def _filtered(pairs: DataFrame, percent: int) -> DataFrame:
    """Length and positional filter on rows of (k, n, pos) and (k2, n2, pos2)."""
    longer, shorter = F.greatest("n", "n2"), F.least("n", "n2")
    rest = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1)
    return pairs.where((F.col("k") != F.col("k2")) & (100 * shorter >= percent * longer) & (rest >= _overlap("n", "n2", percent)))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()


def _suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Upper bound on the overlap of two sets sorted alike, from their halves around a middle element."""
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    return min(i, j) + min(len(x) - i, len(y) - j)


def verified(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; each is looked at once."""
    sets = ordered.select("k", "n", F.sort_array("grams").alias("grams"))
    left = sets.select(F.col("k").alias("a"), F.col("n").alias("n1"), F.col("grams").alias("g1"))
    right = sets.select(F.col("k").alias("b"), F.col("n").alias("n2"), F.col("grams").alias("g2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n1, n2, g1, g2 = (batch.column(i) for i in range(6))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = g1[i].values.to_numpy(), g2[i].values.to_numpy()
                total = n1[i].as_py() + n2[i].as_py()
                least = -(-total * percent // (100 + percent))
                if len(x) and len(y) and _suffix_bound(x, y) >= least:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (total - both)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n1", "n2", "g1", "g2")
    return joined.mapInArrow(run, "a long, b long")


def _meet(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Rows of ``left`` (gram, k, n, pos) beside those of ``right`` (gram, k2, n2, pos2) that pass the filters.

    An n-gram's rows are parted by the size of their sets, on a scale on which
    sizes that may link are in the same or in neighbouring classes; a part of
    more than ``BLOCK`` rows is dealt in blocks, each of which meets the other side.
    """
    scale = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    level = lambda n: F.floor(F.log(n.cast("double")) / scale)
    left = left.withColumn("level", level(F.col("n")))
    right = right.withColumn("level", F.explode(F.array(*[level(F.col("n2")) + d for d in (-1, 0, 1)])))
    parts, _ = store(left.groupBy("gram", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1"), "parts")
    dealt = parts.count()
    if not dealt:
        return _filtered(left.join(right, ["gram", "level"]), percent)
    parts = F.broadcast(parts) if dealt <= MAX_BROADCAST else parts
    at = F.coalesce("parts", F.lit(1))
    left = left.join(parts, ["gram", "level"], "left").withColumn("block", F.pmod(F.xxhash64("k"), at).cast("int")).drop("parts")
    right = right.join(parts, ["gram", "level"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), at - 1))).drop("parts")
    return _filtered(left.join(right, ["gram", "level", "block"]), percent)


def class_links(ordered: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """Links (a, b) between classes: all of them, or enough for the components."""
    spark = ordered.sparkSession
    rows, rows_path = store(
        ordered.select("k", "n", "u", F.posexplode(F.expr("slice(grams, 1, cast(n - ceil(n * %d / 100) + 1 - u as int))" % percent)))
        .select(F.col("col").alias("gram"), "k", "n", (F.col("u") + F.col("pos")).cast("int").alias("pos"), (1000 * F.col("u") / F.col("n")).cast("int").alias("own")),
        "prefixes",
    )
    other = [F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("pos").alias("pos2")]
    if not spanning:
        pairs = _meet(rows, rows.select("gram", *other), percent).where("k < k2")
        return verified(_distinct_pairs(pairs), ordered, percent)
    links = tried = spark.createDataFrame([], "a long, b long")
    roots = None
    for turn in range(ROUNDS + 1):
        active, active_path = rows.withColumn("root", F.col("k")), None
        if roots is not None:
            active, active_path = store(unique_join(rows, roots.select(F.col("node").alias("k"), "root"), "k", stored=True).withColumn("root", F.coalesce("root", "k")), "active")
        if turn < ROUNDS:
            # first the hub has the fewest n-grams of its own: of near copies, one close to what they are copies of
            partner = F.struct(*other, F.col("root").alias("root2"))
            best_hub = F.min_by(partner, F.struct(F.lit(0) if turn else F.col("own"), F.xxhash64("k", F.lit(turn)))).alias("h")
            hub, once_path = store(active.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), best_hub).where("lo <> hi").select("gram", "h.*"), "hubs")
            met = _filtered(unique_join(active, hub, "gram", stored=True).where("root <> root2"), percent).groupBy("k", "k2").count()
            met = met.withColumns({"a": F.least("k", "k2"), "b": F.greatest("k", "k2")}).join(tried, ["a", "b"], "left_anti")
            # of all hubs that a text meets, the one that it meets most often
            fresh = _distinct_pairs(met.groupBy("k").agg(F.max_by("k2", F.struct("count", "k2")).alias("k2")))
        else:
            sizes = active.groupBy("gram", "root").count()
            largest = sizes.groupBy("gram").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
            largest, once_path = store(largest.drop("roots"), "largest")
            marked = unique_join(active, largest, "gram", stored=True).where("largest is not null")
            small = marked.where("root <> largest").select("gram", *other, F.col("root").alias("root2"))
            pairs = _meet(marked.drop("largest"), small, percent).where("root <> root2")
            fresh = _distinct_pairs(pairs).join(tried, ["a", "b"], "left_anti")
        fresh, _ = store(fresh, "candidates")
        drop(spark, once_path)
        tried = tried.unionByName(fresh)
        links = links.unionByName(store(verified(fresh, ordered, percent), "found")[0])
        if active_path:
            drop(spark, active_path)
        if turn < ROUNDS:
            roots = components(links)
    drop(spark, rows_path)
    return links


def _survivors(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, n) of every row, and the classes k that may have a partner.

    Of a class of equal texts a task gives one prefix only, and an n-gram
    counts as common where texts of two classes have it.
    """
    rows, path = store(shingle_sets(docs, percent, size, True, id_col, text_col), "heads")
    keys, _ = store(rows.select("doc_id", "k", "n"), "keys")
    grams = rows.where("n > 0").select("k", "need", F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("gram")
    hits = grams.join(common, "gram", "left_semi").groupBy("k", "need").agg(F.count(F.lit(1)).alias("hits"))
    near, _ = store(hits.where("hits >= need").select("k"), "near")
    drop(docs.sparkSession, path)
    return keys, near


def _class_sets(docs: DataFrame, classes: DataFrame, near: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """k, n and the whole set of each surviving class, from one of its texts; and where it is stored."""
    chosen = classes.join(near, "k", "left_semi").select(F.col("least").alias("_id"), "k")
    ids = chosen.select("_id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    few = ids.count() <= MAX_BROADCAST
    mine = texts.join(F.broadcast(ids) if few else ids, texts.doc_id.eqNullSafe(ids._id), "left_semi")
    sets, path = store(shingle_sets(mine, percent, size, heads=False).where("n > 0").select("k", "n", "grams"), "sets")
    # where an id stands for several texts, some are of other classes or come twice
    if sets.groupBy("k").count().where("count > 1").limit(1).count():
        again, again_path = store(sets.join(near, "k", "left_semi").dropDuplicates(["k"]), "sets")
        drop(docs.sparkSession, path)
        return again, again_path
    return sets, path


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    spark = docs.sparkSession
    keys, near = _survivors(docs, percent, size, id_col, text_col)
    # a row for each class: its smallest id (null where it has none) and its rows
    classes, _ = store(keys.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    sets, sets_path = _class_sets(docs, classes, near, percent, size, id_col, text_col)
    ordered, ordered_path = store(_ordered(sets, percent), "ordered")
    drop(spark, sets_path)
    roots = components(class_links(ordered, percent, spanning=True))
    drop(spark, ordered_path)
    linked, _ = store(roots.join(classes, roots.node == classes.k).select("k", "root", "least", "rows"), "linked")
    lowest, _ = store(linked.groupBy("root").agg(F.min("least").alias("lowest")), "lowest")
    of_linked = unique_join(linked, lowest, "root", stored=True).select("k", F.col("lowest").alias("component"))
    of_copies = classes.where("rows > 1").join(linked.select("k"), "k", "left_anti").select("k", F.col("least").alias("component"))
    placed, _ = store(of_linked.unionByName(of_copies), "placed")
    total = keys.count()
    heavy = classes.where(F.col("rows") >= max(2, total * HEAVY)).select("k")
    found = unique_join(keys, placed, "k", heavy, stored=True)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
