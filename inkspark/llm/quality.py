"""Quality classifier: random-indexing word vectors under a small network.

Every word has two forms: itself in lower case, and its shape (runs of
letters, capitals and digits as one sign each, all else as it stands). Forms
are hashed to a fixed number of rows; each row has a sparse ternary index
vector. Over all documents, a form's context vector gathers the index vectors
of the words around it, and is scaled to length one; a task sums over what it
reads, and Spark over tasks. The table holds bytes and a scale for each row
(10 MB in all): a vector whose sums are up to 127 is exact, any other is within
1/254 of its largest component. A document is the mean of its words' vectors, the
mean of its shapes' vectors, the mean product of neighbouring vectors of either
kind, and the logarithm of its length. A two-layer network in numpy turns that
into a logit, whose temperature is set on a fifth of the sample that training
does not see; the class shares of all labelled rows correct for the sample's.

Only rows that occur are kept, so the table follows the vocabulary up to
``WORD_ROWS``; of V different words a share of about 1 - exp(-V / WORD_ROWS)
has a row together with another one (17 % of 50,000, all but a few of
1,000,000), whose vector is then that of the more frequent.

The network's sample is bounded by ``per_class`` rows of each class;
everything the driver or a broadcast holds is bounded by it and by the table.

Defined results: null and empty texts have the zero vector and get a score
like any other; without labels of both classes every score is the share of
label 1 (0.5 without any label); a null doc_id is never held out; equal texts
get equal scores; an empty table gives an empty result; a very long text is
handled whole, a chunk of its own; a column of the input that is named like
the score is replaced, others are carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _BYTE, Words, _scale, mix, words
from .labelled import fold, sample

DIMS = 32
WORD_ROWS = 1 << 18
SHAPE_ROWS = 1 << 11
NONZERO = 4
REACH = 2
#: Tasks that sum context vectors, at most; each gives a row for each form that it meets.
TASKS = 4096
HIDDEN = 24
WIDTH = 2 * DIMS + 3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 57
_rng = np.random.Generator(np.random.PCG64(7))
_INDEX = np.zeros((WORD_ROWS + SHAPE_ROWS, DIMS), np.int8)
for _ in range(NONZERO):
    np.add.at(_INDEX, (np.arange(len(_INDEX)), _rng.integers(0, DIMS, len(_INDEX))), _rng.choice(np.array([-1, 1], np.int8), len(_INDEX)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def forms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows of every word's two forms."""
    kinds = _SHAPE[w.data]
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[w.starts] = True
    place = np.concatenate([[0], np.cumsum(new)])
    powers, inverses = _scale(len(kinds))
    short = kinds[new]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[short] * powers[: len(short)])])
    a, b = place[w.starts], place[w.ends]
    shapes = mix((sums[b] - sums[a]) * inverses[a])
    lower = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[w.data]] * powers[: len(kinds)])])
    plain = mix((lower[w.ends] - lower[w.starts]) * inverses[w.starts])
    return (plain % np.uint64(WORD_ROWS)).astype(np.int64), (shapes % np.uint64(SHAPE_ROWS)).astype(np.int64) + WORD_ROWS


SUMS = "row int, " + ", ".join(f"d{i} double" for i in range(DIMS))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context sums of the forms that a partition holds."""
    total = np.zeros((len(_INDEX), DIMS))
    seen = np.zeros(len(_INDEX), bool)
    for batch in batches:
        for w in words(batch.column("text")):
            pair = forms(w)
            own = (_INDEX[pair[0]] + _INDEX[pair[1]]).astype(np.float32)
            around = np.zeros_like(own)
            for step in range(1, REACH + 1):
                near = (w.text[:-step] == w.text[step:])[:, None]
                around[:-step] += own[step:] * near
                around[step:] += own[:-step] * near
            for rows in pair:
                if len(rows):
                    order = np.argsort(rows, kind="stable")
                    ranked = rows[order]
                    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                    total[ranked[starts]] += np.add.reduceat(around[order], starts, axis=0)
                    seen[ranked[starts]] = True
    found = np.flatnonzero(seen)
    for at in range(0, len(found), 10_000):
        part = found[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(c) for c in total[part].T.copy())], names=["row", *(f"d{i}" for i in range(DIMS))])


@dataclass
class Vectors:
    """Vectors of the rows that occur, whole numbers up to 127 times a scale; all others share the zero vector at place 0."""

    place: np.ndarray
    table: np.ndarray
    scale: np.ndarray

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        at = self.place[rows]
        return self.table[at] * self.scale[at, None]


def context_vectors(docs: DataFrame, text_col: str = "text") -> Vectors:
    """Word and shape vectors over all of ``docs``."""
    texts = docs.select(F.col(text_col).cast("string").alias("text")).coalesce(TASKS)
    sums = texts.mapInArrow(_contexts, SUMS).groupBy("row").agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(DIMS)])
    largest = F.greatest(*[F.abs(f"d{i}") for i in range(DIMS)])
    length = F.sqrt(sum((F.col(f"d{i}") * F.col(f"d{i}") for i in range(1, DIMS)), F.col("d0") * F.col("d0")))
    # sums of up to 127 stay as they are
    unit = sums.withColumns({"step": F.greatest(largest / 127, F.lit(1.0)), "length": F.greatest(length, F.lit(1e-9))}).select(
        "row", (F.col("step") / F.col("length")).cast("float").alias("scale"), *[F.round(F.col(f"d{i}") / F.col("step")).cast("byte").alias(f"d{i}") for i in range(DIMS)]
    )
    found = unit.toArrow()  # at most a row of 40 bytes for each row of the table
    place = np.zeros(len(_INDEX), np.int32)
    table, scale = np.zeros((found.num_rows + 1, DIMS), np.int8), np.zeros(found.num_rows + 1, np.float32)
    rows = found.column("row").to_numpy()
    order = np.argsort(rows)
    place[rows[order]] = np.arange(1, len(rows) + 1)
    scale[1:] = found.column("scale").to_numpy()[order]
    for i in range(DIMS):
        table[1:, i] = found.column(f"d{i}").to_numpy()[order]
    return Vectors(place, table, scale)


def features(vectors: Vectors, w: Words) -> np.ndarray:
    """Pooled vectors of the texts of a chunk."""
    out = np.zeros((w.count, WIDTH), np.float32)
    n = np.diff(w.bounds)
    full = np.flatnonzero(n)
    if len(full):
        for k, rows in enumerate(forms(w)):
            each = vectors[rows]
            out[full, k * DIMS : (k + 1) * DIMS] = np.add.reduceat(each, w.bounds[full], axis=0) / n[full, None]
            close = np.zeros(len(rows), np.float32)
            close[1:] = np.einsum("ij,ij->i", each[1:], each[:-1])
            out[full, 2 * DIMS + k] = np.add.reduceat(close, w.bounds[full]) / n[full]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    """Two layers with a temperature; without weights it answers the prior."""

    prior: float
    weights: tuple[np.ndarray, ...] | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    temperature: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, sizes: dict[int, int], epochs: int = 300, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam on the cross entropy; every fifth row is kept for the temperature."""
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    if len(set(y.tolist())) < 2:
        return Network(prior)
    x = x.astype(np.float64)
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    fit = ~aside
    net = Network(prior, mean=x[fit].mean(0), scale=np.maximum(x[fit].std(0), 1e-3))
    z, t = (x[fit] - net.mean) / net.scale, y[fit].astype(float)
    rng = np.random.Generator(np.random.PCG64(11))
    w = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(())]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    for step in range(1, epochs + 1):
        hidden = np.maximum(z @ w[0] + w[1], 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -30, 30))) - t) / len(t)
        back = np.outer(error, w[2]) * (hidden > 0)
        grads = [z.T @ back + decay * w[0], back.sum(0), hidden.T @ error + decay * w[2], error.sum()]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            w[i] = w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.weights = tuple(w)
    if aside.any():
        raw, t = net.logits(x[aside]), y[aside]

        def loss(temperature: float) -> float:
            return float(np.mean(np.logaddexp(0, np.where(t == 1, -raw, raw) / temperature)))

        net.temperature = min(np.geomspace(0.5, 8, 60), key=loss)
    share = y.mean()
    net.shift = float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


@dataclass
class Model:
    vectors: Vectors
    network: Network


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = 3000, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Word vectors from all of ``docs``, the network from at most ``2 * per_class`` labelled rows outside the held-out fold."""
    vectors = context_vectors(docs, text_col)
    chosen, sizes = sample(docs, labels, label_col, per_class, folds, held_out, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text")):
                rows = [f.tobytes() for f in features(shared.value, w)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.first, w.count), batch.column("label").slice(w.first, w.count), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    rows = sorted((r.doc_id, r.label, r.x) for r in chosen.mapInArrow(pooled, "doc_id long, label int, x binary").collect())
    shared.destroy()
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(rows))
    x = np.array([np.frombuffer(rows[i][2], np.float32) for i in order]).reshape(len(rows), WIDTH)
    return Model(vectors, train(x, np.array([rows[i][1] for i in order], int), sizes))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text."""
    from pyspark.sql import types as T

    carry = [c for c in docs.columns if c != score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(carry.index(text_col))):
                scores = shared.value.network.scores(features(shared.value.vectors, w))
                yield pa.RecordBatch.from_arrays([*(c.slice(w.first, w.count) for c in batch.columns), pa.array(scores, pa.float64())], names=[*carry, score_col])

    return docs.select(*[F.col(f"`{c}`") for c in carry]).mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model, folds: int = 4, held_out: int = 2, cut_at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))
