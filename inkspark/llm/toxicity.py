"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

*Language model.* Trigrams of letters are counted over every text of the
corpus and summed on Spark; the table is bounded by the cube of the alphabet
(a-z, other UTF-8 bytes, and a word edge). Words are counted over every text
too; the most frequent are known by their hash and count.

*Restoration.* Spans that look disguised (letters around digits or signs, a
letter three times or more in a row, single letters with separators between)
become a lattice: each sign may be one of the letters it imitates, any letter
if it is a mask, or stand for a word edge; runs may be one or two letters; a
separator is nothing or, at a cost, a word edge; one that is wider than the
span's usual one, or another, is a word edge or, at a cost, nothing. The edges
at usual separators are placed once more by the words that they part. Viterbi decoding over pairs of letters finds the cheapest
path under the language model and the channel's costs.

*Score.* Words of the restored text (runs of letters) and their beginnings are
features. Over the labelled sample, features more frequent in toxic texts are
ranked by the log-likelihood ratio, the best ``kept`` make the vector, and a
logistic regression in numpy weighs them.

The sample is bounded by ``per_class`` rows of each class. Defined results:
null and empty texts have no features and get the score of the intercept;
without labels of both classes every score is the share of label 1 (0 without
any label); a null doc_id is never held out; equal texts get equal scores; an
empty table gives an empty result; a very long text is restored and scored
whole, in time linear in its length; columns of the input that are named like
a result are replaced, others are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import drop, store
from ._text import _BYTE, _CHUNK, _scale, mix, spans
from .labelled import fold, sample

SYMBOLS = 27 + 128
EDGE = 0
#: Byte to symbol: a-z to 1-26 whatever their case, other UTF-8 bytes above those, all else the edge.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)

#: Signs and the letters they imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "abcdefghijklmnopqrstuvwxyz", "€": "e", "#": "h",
}
COST_SIGN, COST_MASK, COST_KEEP, COST_RUN = 0.5, 3.0, 6.0, 0.3
#: A word edge at a span's usual separator, nothing at a separator that is not the usual one, and a word that is spelled out by letters.
COST_EDGE, COST_JOIN, COST_NEW = 2.0, 4.0, 5.0
#: Most words whose counts are kept, and the longest in bytes; others are spelled out.
WORDS, LONGEST_WORD = 1 << 17, 24

_L = "a-zß-öø-ÿ"
_S = r"0-9@$!|+*€#"
DISGUISED = re.compile(
    rf"(?<![{_L}{_S}])(?:[{_L}{_S}][ ._\-]{{1,2}}){{3,}}[{_L}{_S}](?![{_L}{_S}])"
    rf"|(?<![{_L}{_S}])[{_S}]{{0,3}}[{_L}]+(?:[{_S}]{{1,3}}[{_L}]+)+"
    rf"|(?<![{_L}{_S}])[0-9@$!|+€]{{1,2}}[{_L}]{{2,}}(?![{_L}{_S}])"
    rf"|(?<![{_L}])[{_L}]*([{_L}])\1{{2,}}[{_L}]*"
)
#: A word edge that is still to be placed by words.
LOOSE = "\0"
SPACED = re.compile(r"^.[ ._\-]{1,2}.[ ._\-]")


#: Bytes that are counted at once; every count passes over the whole cube.
_COUNTED = 1 << 21


def letter_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts, as a cube of symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, offsets = spans(batch.column(0))
            at = 0
            while at < len(offsets) - 1:
                end = min(max(int(np.searchsorted(offsets, offsets[at] + _COUNTED, side="right")) - 1, at + 1), len(offsets) - 1)
                part = data[offsets[at] : offsets[end]]
                # two edges before every text, so that no trigram spans two texts
                s = np.insert(_SYMBOL[part], np.repeat(offsets[at : end + 1] - offsets[at], 2), EDGE)
                key = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                total += np.bincount(key, minlength=SYMBOLS**3)
                at = end
        found = np.flatnonzero(total)
        for i in range(0, len(found), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 50_000]), pa.array(total[found[i : i + 50_000]])], names=["gram", "n"])

    summed = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # at most a row for each cell
    cube = np.zeros(SYMBOLS**3)
    cube[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Interpolated trigram costs (negative logs) of the third symbol after two."""
    pairs, single = counts.sum(0), counts.sum((0, 1))
    p1 = (single + 1) / (single.sum() + SYMBOLS)
    p2 = (pairs + 5 * p1) / (pairs.sum(1, keepdims=True) + 5)
    p3 = (counts + 5 * p2) / (counts.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def word_costs(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words (runs of letters) of all texts, and their negative log shares.

    At most ``most``: those above the least count that leaves no more, found
    from the numbers of words by an eighth of a doubling of the count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def counted() -> pa.RecordBatch:
            names, count = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(count.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for _, _, found, length in features([(x.as_py() or "").lower() for x in batch.column(0).slice(at, 1000)], beginnings=()):
                    waiting.append(found)
                    n += len(found)
                    if n > _COUNTED:
                        yield counted()
                        waiting, n = [], 0
        if waiting:
            yield counted()

    table, path = store(docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(8 * F.log2("n")).cast("int")
    left, least, total = most, 1 << 30, 0
    for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        total += r.n
        left -= r.words
        least = r.level if left >= 0 else least
    found = table.where(level >= least).toArrow()
    drop(docs.sparkSession, path)
    names, n = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(names)
    return names[order], -np.log(n[order] / max(total, 1))


class Restorer:
    """Viterbi decoding of disguised spans of any length, memoised for each worker.

    A state is a pair of letters, so the work is linear in the span.
    """

    #: Entries of the memory, and the length up to which a span is remembered.
    MEMO, REMEMBERED = 200_000, 40
    #: Paths at a position from which on a step is taken in numpy.
    MANY = 200

    def __init__(self, costs: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray] | None = None):
        self.costs = costs
        self.names, self.prices = lexicon if lexicon is not None else (np.zeros(0, np.uint64), np.zeros(0))
        self.memo: dict[str, str] = {}

    def __call__(self, text: str) -> str:
        """The text in lower case, its disguised spans restored."""
        return DISGUISED.sub(self._span, text.lower())

    def _span(self, match: re.Match) -> str:
        span = match[0]
        if len(span) > self.REMEMBERED:
            return self.restored(span)
        known = self.memo.get(span)
        if known is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            known = self.memo[span] = self.restored(span)
        return known

    def restored(self, span: str) -> str:
        """The decoded span; where its letters were spaced out, the word edges are placed after that."""
        text = self.decode(span)
        return " ".join(self.parted(x) for x in text.replace(LOOSE, "").split(" ")) if SPACED.search(span) else text

    def parted(self, letters: str) -> str:
        """The cheapest words that make up ``letters``: known ones, or such as are spelled out under the trigrams."""
        data = np.frombuffer(letters.encode(), np.uint8)
        n, parts = len(data), []
        symbol, opens = [*_SYMBOL[data].tolist(), EDGE], [*((data & 0xC0) != 0x80).tolist(), True]
        ends: list[tuple[float, tuple | None]] = [(0.0, None)]
        spelled: list[tuple[float, int]] = []  # by letters since the edge, 1 or more: cost, where the word begins
        known = self._known(data)
        for j in range(1, n + 1):
            c = symbol[j - 1]
            far = [(cost + float(self.costs[symbol[j - 3], symbol[j - 2], c]), at) for cost, at in spelled[1:]]
            if spelled:
                far.append((spelled[0][0] + float(self.costs[EDGE, symbol[j - 2], c]), spelled[0][1]))
            new = (ends[j - 1][0] + COST_NEW + float(self.costs[EDGE, EDGE, c]), j - 1)
            spelled = [new, *([min(far)] if far else [])]
            found = [(cost + float(self.costs[symbol[j - 2] if k else EDGE, c, EDGE]), at) for k, (cost, at) in enumerate(spelled)]
            found += [(ends[i][0] + price, i) for i, price in known.get(j, ())]
            cost, at = min(found) if opens[j] else (np.inf, 0)  # no word ends within a letter
            ends.append((cost + COST_EDGE, (ends[at][1], at, j)))
        path = ends[n][1]
        while path is not None:
            path, at, j = path
            parts.append(bytes(data[at:j]).decode())
        return " ".join(reversed(parts))

    def _known(self, data: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        """For each end the beginnings and costs of the words of the lexicon that end there."""
        out: dict[int, list[tuple[int, float]]] = {}
        if not len(self.names):
            return out
        powers, inverses = _scale(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[: len(data)])])
        for size in range(1, min(LONGEST_WORD, len(data)) + 1):
            found = mix((sums[size:] - sums[:-size]) * inverses[: len(data) - size + 1])
            at = np.minimum(np.searchsorted(self.names, found), len(self.names) - 1)
            for i in np.flatnonzero(self.names[at] == found).tolist():
                out.setdefault(i + size, []).append((i, float(self.prices[at[i]])))
        return out

    @staticmethod
    def lattice(span: str) -> list[list[tuple[str, float]]]:
        """For each position the texts it may stand for, with the channel's costs."""
        spaced = SPACED.search(span)
        # each sign, and the separator before it
        signs = re.findall(r"([ ._\-]*)([^ ._\-])", span) if spaced else [("", c) for c in span]
        gaps = Counter(gap for gap, _ in signs[1:])
        usual = min(gaps, key=lambda gap: (-gaps[gap], len(gap), gap), default="")
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(signs):
            gap, c = signs[i]
            if i and spaced:
                out.append([("", 0.0), (LOOSE, COST_EDGE)] if gap == usual else [(" ", 0.0), ("", COST_JOIN)])
            run = 1
            while i + run < len(signs) and signs[i + run] == (usual, c):
                run += 1
            if c in IMITATES:
                run = 1 if spaced else run
                cost = COST_MASK if c == "*" else COST_SIGN
                for _ in range(run):
                    out.append([(x, cost) for x in IMITATES[c]] + [(" ", COST_KEEP)])
            elif run > 2:
                out.append([(c, COST_RUN), (c + c, COST_RUN)])
                if spaced:
                    out[-1] += [(piece, COST_RUN + COST_EDGE) for piece in (c + LOOSE + c, c + c + LOOSE + c, c + LOOSE + c + c)]
            elif spaced:
                run = 1
                out.append([(c, 0.0)])
            else:
                out.append([(c * run, 0.0)])
            i += run
        return out

    def decode(self, span: str) -> str:
        """The cheapest text; paths are chains of (chain before, piece), which share their beginnings."""
        symbols = {}
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for options in [*self.lattice(span), [(" ", 0.0)]]:
            for piece, _ in options:
                if piece not in symbols:
                    symbols[piece] = _SYMBOL[np.frombuffer(piece.encode(), np.uint8)].tolist()
            if len(options) * len(best) >= self.MANY and all(len(symbols[piece]) == 1 for piece, _ in options):
                best = self._step(best, options, [symbols[piece][0] for piece, _ in options])
                continue
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for piece, channel in options:
                for (a, b), (cost, path) in best.items():
                    cost += channel
                    for c in symbols[piece]:
                        cost += float(self.costs[a, b, c])
                        a, b = b, c
                    if (a, b) not in step or cost < step[a, b][0]:
                        step[a, b] = (cost, (path, piece))
            best = step
        path = min(best.values(), key=lambda x: x[0])[1]
        pieces = []
        while path is not None:
            path, piece = path
            pieces.append(piece)
        return "".join(reversed(pieces)).rstrip()

    def _step(self, best: dict, options: list[tuple[str, float]], codes: list[int]) -> dict:
        """One step where every option is a single symbol."""
        before, after = np.array(list(best)).T
        cost = np.array([x[0] for x in best.values()])
        paths = [x[1] for x in best.values()]
        total = cost[:, None] + np.array([x[1] for x in options]) + self.costs[before[:, None], after[:, None], codes]
        step = {}
        for b in dict.fromkeys(after.tolist()):
            rows = np.flatnonzero(after == b)
            least = rows[total[rows].argmin(0)]
            for k, (c, (piece, _)) in enumerate(zip(codes, options)):
                step[b, c] = (float(total[least[k], k]), (paths[least[k]], piece))
        return step


#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7, 8)


def features(texts: list[str], batch_bytes: int = _CHUNK, beginnings: tuple[int, ...] = BEGINNINGS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text of each feature, feature hash, words of each text) in chunks.

    A feature occurs once for each word it is found in.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < batch_bytes):
            size += len(texts[end])
            end += 1
        data, offsets = spans(pa.array(texts[at:end], pa.large_string()))
        data = data[: offsets[-1]]
        letter = _SYMBOL[data] > 0
        opens, closes = letter.copy(), letter.copy()
        opens[1:] &= ~letter[:-1]
        closes[:-1] &= ~letter[1:]
        for edge in offsets[1:-1]:
            if 0 < edge < len(data):
                opens[edge] |= letter[edge]
                closes[edge - 1] |= letter[edge - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        owner = np.searchsorted(offsets, starts, side="right") - 1
        powers, inverses = _scale(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[: len(data)])])
        owners, hashes = [owner], [mix((sums[ends] - sums[starts]) * inverses[starts])]
        for n in beginnings:
            long = ends - starts > n
            s = starts[long]
            owners.append(owner[long])
            hashes.append(mix((sums[s + n] - sums[s]) * inverses[s] + np.uint64(n)))
        yield at, np.concatenate(owners), np.concatenate(hashes), np.bincount(owner, minlength=end - at)
        at = end


@dataclass
class Model:
    """Costs of the language model, weights of the chosen features, and the costs of words."""

    costs: np.ndarray
    chosen: np.ndarray
    weights: np.ndarray
    intercept: float
    lexicon: tuple[np.ndarray, np.ndarray] | None = None

    def vectors(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(first text, dense counts of the chosen features, last column log of the length)."""
        for first, owner, found, length in features(texts):
            x = np.zeros((len(length), len(self.chosen) + 1), np.float32)
            if len(self.chosen):
                at = np.searchsorted(self.chosen, found)
                at[at == len(self.chosen)] = 0
                hit = self.chosen[at] == found
                np.add.at(x, (owner[hit], at[hit]), 1)
            x[:, :-1] = np.log1p(x[:, :-1])
            x[:, -1] = np.log1p(length)
            yield first, x

    def score(self, texts: list[str]) -> np.ndarray:
        parts = [x @ self.weights for _, x in self.vectors(texts)]
        z = np.concatenate(parts) + self.intercept if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _restored(model: Model, column: pa.Array, restorer: list[Restorer]) -> list[str]:
    if not restorer:
        restorer.append(Restorer(model.costs, model.lexicon))
    return [restorer[0](x.as_py() or "") for x in column]


def regress(x: np.ndarray, y: np.ndarray, decay: float = 2e-3, epochs: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression with classes of equal weight, by Adam."""
    w, b = np.zeros(x.shape[1]), 0.0
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, epochs + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
        g = np.append(x.T @ error + decay * w, error.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    per_class: int = 4000,
    kept: int = 1024,
    folds: int = 3,
    held_out: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Count letters and words over all of ``docs``, and learn from a bounded sample of the labelled."""
    costs, lexicon = log_model(letter_counts(docs, text_col)), word_costs(docs, text_col)
    chosen, sizes = sample(docs, labels, label_col, per_class, folds, held_out, id_col, text_col)
    bare = Model(costs, np.zeros(0, np.uint64), np.zeros(1), 0.0, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(bare)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer: list[Restorer] = []
        for batch in batches:
            label = batch.column("label").to_numpy()
            for first, owner, found, _ in features(_restored(shared.value, batch.column("text"), restorer)):
                pairs = np.unique(np.rec.fromarrays([found, owner]))
                toxic = label[first + pairs["f1"]]
                names, at = np.unique(pairs["f0"], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(np.bincount(at, toxic == 1).astype(np.int64)), pa.array(np.bincount(at, toxic == 0).astype(np.int64))], names=["feature", "bad", "good"]
                )

    counted = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    bad, good = counted.get(1, 0), counted.get(0, 0)
    if not bad or not good:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return Model(costs, np.zeros(0, np.uint64), np.zeros(1), float(np.log((share + 1e-9) / (1 - share + 1e-9))), lexicon)
    a, b = F.col("bad"), F.col("good")
    mean = (a + b) / (bad + good)
    ratio = a * F.log(a / (bad * mean)) + F.when(b > 0, b * F.log(b / (good * mean))).otherwise(0.0)
    best = (
        chosen.mapInArrow(spread, "feature long, bad long, good long")
        .groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where((a >= 3) & (a * good > b * bad))
        .select("feature", ratio.alias("ratio")).where("ratio > 4")
        .orderBy(F.desc("ratio"), "feature").limit(kept)
    )
    names = np.sort(np.array([r.feature for r in best.collect()], np.int64).view(np.uint64))
    model = Model(costs, names, np.zeros(len(names) + 1), 0.0, lexicon)
    shared2 = docs.sparkSession.sparkContext.broadcast(model)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer: list[Restorer] = []
        for batch in batches:
            for first, x in shared2.value.vectors(_restored(shared2.value, batch.column("text"), restorer)):
                where, which = np.nonzero(x)
                cells = np.split(np.arange(len(where)), np.searchsorted(where, np.arange(1, len(x))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(x)), batch.column("label").slice(first, len(x)),
                        pa.array([which[c].tolist() for c in cells], pa.list_(pa.int32())), pa.array([x[i, which[c]].tolist() for i, c in enumerate(cells)], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "label", "at", "value"],
                )

    rows = sorted((r.doc_id, r.label, r["at"], r.value) for r in chosen.mapInArrow(pooled, "doc_id long, label int, at array<int>, value array<float>").collect())
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    for i, (_, _, at, value) in enumerate(rows):
        x[i, at] = value
    model.weights, model.intercept = regress(x, np.array([r[1] for r in rows], float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", restored_col: str | None = None) -> DataFrame:
    """``docs`` with the score of each whole text, and the restored text if a name is given for it."""
    made = [score_col, *([restored_col] if restored_col else [])]
    carry = [c for c in docs.columns if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(score_col, T.DoubleType())] + ([T.StructField(restored_col, T.StringType())] if restored_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer: list[Restorer] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = _restored(shared.value, part.column(carry.index(text_col)), restorer)
                extra = [pa.array(texts, pa.string())] if restored_col else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(texts), pa.float64()), *extra], names=[*carry, *made])

    return docs.select(*[F.col(f"`{c}`") for c in carry]).mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model, folds: int = 3, held_out: int = 1, cut_at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))
