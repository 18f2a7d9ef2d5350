"""Approximate nearest neighbours over balanced posting lists.

*Index.* Centroids are fitted on a bounded sample by balanced k-means: a
cluster that holds more than its fair share is split again. A navigable graph
joins each centroid to its nearest ones. Every vector finds its nearest
centroids by best-first search of that graph in memory, and goes into the list
of the nearest and into further lists whose centroids are at most
``1 + spread`` times as far: vectors at a boundary stand in several lists.

*Levels.* There are at most ``max_lists`` lists at a level. A list of more than
``split_at`` vectors becomes an index of its own in the same way, on a bounded
sample of its own vectors, so lists stay small and their number grows with the
table. Lists whose vectors are all alike stay as they are, and after ``LEVELS``
levels a list that is still long is only dealt in more blocks.

*Search.* A query finds its nearest centroids by the same search and visits
those lists whose centroid distance is at most ``1 + reach`` times the
smallest, at least ``least`` and up to ``probes`` at each level. Distances are
exact Euclidean distances on the original vectors, in double precision; a
matrix product chooses what is measured. Both a list's vectors and the queries
that visit it are dealt in blocks of bounded size, so a list that holds a third
of all rows or of all queries is many small groups, and the best of all blocks
are merged by windows.

Only one level's centroids and their graph (bounded by ``max_lists``) are
broadcast; the graphs of split lists are rows of a table.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; equal vectors tie by smaller
id; a query has fewer than k rows where there are fewer candidates; rows that
repeat a vec_id count as one candidate where they are equal, and a query is
never its own id's neighbour; an empty table gives no rows; very long vectors
only make blocks heavier; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut


@dataclass
class Graph:
    """Centroids, for each its neighbours in the graph, and the ones that are looked at first."""

    centroids: np.ndarray
    near: np.ndarray
    tops: np.ndarray

    @classmethod
    def over(cls, centroids: np.ndarray, degree: int = 24) -> Graph:
        n = len(centroids)
        near = np.empty((n, min(degree, n)), np.int64)
        for at in range(0, n, 512):
            near[at : at + 512] = np.argsort(_squares(centroids[at : at + 512], centroids), axis=1)[:, : near.shape[1]]
        rng = np.random.Generator(np.random.PCG64(5))
        own = np.arange(n)[:, None]
        far = np.sort(rng.integers(0, n, (n, 4)), axis=1)  # a few long edges keep the graph navigable
        known = (far[:, :, None] == near[:, None, :]).any(2)
        known[:, 1:] |= far[:, 1:] == far[:, :-1]
        far = np.where(known, own, far)  # a node names no other one twice
        return cls(centroids, np.concatenate([near, far], axis=1), rng.permutation(n)[: max(16, 2 * int(np.sqrt(n)))])

    def search(self, x: np.ndarray, count: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``count`` nearest centroids of each row, nearest first; -1 where there are fewer."""
        n, rows = len(self.centroids), np.arange(len(x))
        beam = min(max(beam, count), n)
        seen = np.zeros((len(x), n), bool)
        ids = np.full((len(x), beam), -1, np.int64)
        dist = np.full((len(x), beam), np.inf)
        done = np.ones((len(x), beam), bool)

        def offer(new: np.ndarray) -> None:
            nonlocal ids, dist, done
            fresh = ~seen[rows[:, None], new]
            seen[rows[:, None], new] = True
            step = self.centroids[new] - x[:, None]
            d = np.where(fresh, np.sqrt(np.einsum("ijk,ijk->ij", step, step)), np.inf)
            all_ids, all_d = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1)
            all_done = np.concatenate([done, ~fresh], 1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids, dist, done = (np.take_along_axis(v, best, 1) for v in (all_ids, all_d, all_done))

        first = np.argsort(_squares(x, self.centroids[self.tops]), axis=1)[:, : min(3, len(self.tops))]
        offer(self.tops[first])
        while not done.all():
            at = np.where(done, np.inf, dist).argmin(1)
            live = ~done[rows, at]
            node = np.where(live, ids[rows, at], self.tops[0])
            done[rows, at] = True
            offer(np.where(live[:, None], self.near[node], self.tops[0]))
        order = np.argsort(dist, axis=1, kind="stable")[:, :count]
        dist = np.take_along_axis(dist, order, 1)
        return np.where(np.isfinite(dist), np.take_along_axis(ids, order, 1), -1), dist


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def balanced_centroids(x: np.ndarray, lists: int, turns: int = 8) -> np.ndarray:
    """k-means whose large clusters are split again, at most ``lists`` centroids."""
    rng = np.random.Generator(np.random.PCG64(9))
    distinct = np.unique(x, axis=0)
    lists = min(lists, len(distinct))
    centroids = distinct[rng.permutation(len(distinct))[:lists]]
    share = 2 * len(x) / max(lists, 1)
    for turn in range(turns):
        owner = np.concatenate([_squares(x[i : i + 2048], centroids).argmin(1) for i in range(0, len(x), 2048)])
        size = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
        if turn < turns - 2:  # the smallest clusters give way to halves of the largest
            large = [c for c in np.argsort(-size) if size[c] > share]
            for c, small in zip(large, np.argsort(size)):
                if size[small] * 4 < share:
                    members = x[owner == c]
                    centroids[small] = members[rng.integers(len(members))]
    return np.unique(centroids, axis=0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Rule:
    """How many lists a row goes to: up to ``count``, of those within ``1 + ratio`` of the nearest, ``always`` at least."""

    count: int
    beam: int
    ratio: float
    always: int

    def choose(self, graph: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs."""
        out = []
        for at in range(0, len(x), 256):
            ids, dist = graph.search(x[at : at + 256], self.count, self.beam)
            ok = (ids >= 0) & ((dist <= (1 + self.ratio) * dist[:, :1]) | (np.arange(ids.shape[1]) < self.always))
            i, j = np.nonzero(ok)
            out.append((i + at, ids[i, j]))
        return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


#: Lists at one level, at most; a list's number is its parent's times this, and its own.
FAN = 1 << 12
POSTED = "vec_id long, vec array<double>, list long"


def _in_blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a block number of at most about ``size`` rows in each list, and the blocks of each list."""
    blocks = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}s"))
    few = F.broadcast(blocks) if blocks.count() <= MAX_BROADCAST else blocks
    return rows.join(few, "list").withColumn(name, F.pmod(F.xxhash64("vec_id"), f"{name}s").cast("int")).drop(f"{name}s"), blocks


#: Levels at most; a list that is still large after them has more blocks.
LEVELS = 4
#: Lists up to which their sizes are broadcast.
MAX_BROADCAST = 200_000


def _split(posted: DataFrame, asked: DataFrame, large: DataFrame, per_list: int, post: Rule, ask: Rule, block_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New lists in place of the large ones (list, n): of vectors, of queries, and the lists that cannot be split."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x, n = np.stack(rows["vec"].to_numpy()), int(rows["n"].iloc[0])
        graph = Graph.over(balanced_centroids(x, int(min(FAN, len(x) // 8 + 1, n // per_list))))
        return pd.DataFrame({"list": [rows["list"].iloc[0]], "graph": [pickle.dumps(graph)], "lists": [len(graph.centroids)]})

    some = posted.join(large, "list").where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.ceil(F.col("n") / LOCAL)) == 0)
    graphs = cut(some.groupBy("list").applyInPandas(fit, "list long, graph binary, lists int"))

    def dealt(rows: DataFrame, rule: Rule) -> DataFrame:
        mine, blocks = _in_blocks(rows.join(large.select("list"), "list", "left_semi"), block_rows, "block")
        beside = graphs.where("lists > 1").join(blocks, "list").select("list", "graph", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"vec_id": pd.Series(dtype="int64"), "vec": pd.Series(dtype="object"), "list": pd.Series(dtype="int64")})
            i, to = rule.choose(pickle.loads(right["graph"].iloc[0]), np.stack(left["vec"].to_numpy()))
            return pd.DataFrame({"vec_id": left["vec_id"].to_numpy()[i], "vec": left["vec"].to_numpy()[i], "list": left["list"].to_numpy()[i] * FAN + to})

        return mine.groupBy("list", "block").cogroup(beside.groupBy("list", "block")).applyInPandas(place, POSTED)

    whole = graphs.where("lists = 1").select("list")
    stay = large.select("list").join(whole, "list", "left_anti")
    return tuple(cut(rows.join(stay, "list", "left_anti").unionByName(dealt(rows, rule))) for rows, rule in ((posted, post), (asked, ask))) + (whole,)


#: Vectors of a list, about, to which the centroids below it are fitted.
LOCAL = 4096


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    per_list: int = 100,
    max_lists: int = FAN,
    sample_rows: int = 40_000,
    spread: float = 0.06,
    copies: int = 4,
    reach: float = 0.30,
    least: int = 24,
    probes: int = 96,
    block_rows: int = 4096,
    split_at: int = 4000,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query`` (over vec_id, vec)."""
    spark = vectors.sparkSession
    rows = cut(usable(vectors, id_col, vector_col))
    lengths = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dims, total = lengths["dims"], lengths["count"]
    rows = cut(rows.where(F.size("vec") == dims).dropDuplicates(["vec_id", "vec"]))
    lists = int(min(max_lists, max(1, total // per_list)))
    # bounded by rows and by bytes: at most 256 MB of doubles
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1000, min(sample_rows, (1 << 25) // dims))).select("vec").toArrow()
    graph = Graph.over(balanced_centroids(_stack(picked.column("vec").combine_chunks()), lists))
    shared = spark.sparkContext.broadcast(graph)
    post, ask = Rule(copies, 16, spread, 1), Rule(probes, 2 * probes, reach, least)

    def assign(rule: Rule):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    i, to = rule.choose(shared.value, _stack(part.column("vec")))
                    taken = part.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to.astype(np.int64))], names=["vec_id", "vec", "list"])

        return run

    posted = cut(rows.mapInArrow(assign(post), POSTED))
    asked = cut(rows.where(is_query).mapInArrow(assign(ask), POSTED))
    whole = spark.createDataFrame([], "list long")
    for _ in range(LEVELS - 1):
        large = cut(posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_at).join(whole, "list", "left_anti"))
        if not large.limit(1).count():
            break
        posted, asked, more = _split(posted, asked, large, per_list, post, ask, block_rows)
        whole = whole.unionByName(more)
    mine, blocks = _in_blocks(posted, block_rows, "block")
    queries, turns = _in_blocks(asked, QUERIES, "turn")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)).alias(name)
    left = mine.join(turns, "list").select("list", "block", "vec_id", "vec", each("turn"))
    right = queries.join(blocks, "list").select("list", "turn", "vec_id", "vec", each("block"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, ids = np.stack(left["vec"].to_numpy()), left["vec_id"].to_numpy()
            q = np.stack(right["vec"].to_numpy())
            rough = _squares(q, x)
            slack = 1e-9 * ((x * x).sum(1).max() + (q * q).sum(1))
            edge = np.partition(rough, min(k, len(x) - 1), axis=1)[:, min(k, len(x) - 1)]  # one more, for the query itself
            for query, vec, near, most in zip(right["vec_id"].to_numpy(), q, rough, edge + slack):
                at = np.flatnonzero(near <= most)
                at = at[ids[at] != query]
                d = np.sqrt(((x[at] - vec) ** 2).sum(1))
                best = np.lexsort((ids[at], d))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[best]], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = left.groupBy("list", "block", "turn").cogroup(right.groupBy("list", "block", "turn")).applyInPandas(compare, "query_id long, vec_id long, score double")
    # A boundary vector is found in several lists; a repeated id counts with its nearest vector.
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Queries of a list that are compared with a block at once.
QUERIES = 512
