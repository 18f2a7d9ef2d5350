"""Quality rules: base counts and robust multivariate outliers.

Base counts per text (null: no words), over words ``[^\\x20\\x09-\\x0D]+``:

* ``word_chars``: code points in words; ``n_symbols``: characters of
  ``#*$%&|<>``;
* ``n_dup_lines``: newline-split lines with a word that equal an earlier line;
* ``n_repeat_words``: words in a 3-word window whose text occurs at least
  twice in the document (the first occurrence counts, overlaps count once).

``base_failed``: under 50 words, or over half of the words repeat.

Verdict on the others: each text becomes a vector of four statistics that all
prose has some of, so that a pool's spread can be estimated: word length, the
share of characters in words that are no letters, how fast new words come
(Herdan's C), and the share of word pairs that come again. For each language and
source a minimum-covariance-determinant estimate of mean and covariance is
found, and a vector whose squared Mahalanobis distance exceeds ``cutoff`` is
rejected. Concentration steps begin at ``STARTS`` and go on until no determinant
falls any more; after ``RACE`` steps only that start of a pool goes on which has
the least determinant. A pool of n vectors is drawn towards its parent (a source to its
language, a language to the corpus) as by ``prior`` further vectors there, so a
small one is judged mostly as its parent and a large one by itself. ``GUARDS``
keep the covariance of a pool of equal texts regular; they lie far below the
spread of prose.

Defined results: a null or empty text has no words and fails the base rules; a
null language or source is a value of its own; equal rows get equal verdicts;
an empty table gives an empty result, and where nothing passes the base rules
nothing is estimated; a very long text is counted whole, with memory in
proportion to it; columns of the input that clash with a result column are
replaced, others are carried whatever their names.

All expressions are DataFrame functions. The estimates stay in a table with
rows for each language and source; the driver sees one number for each step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, drop, store  # noqa: F401

WORD = r"[^\x20\x09-\x0D]"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS = 4
#: Further counts that the vectors need.
MORE = ("n_lines", "n_letters", "n_distinct", "n_pairs")
#: Least standard deviations of the statistics: a quarter of those of prose or less, so estimates decide.
GUARDS = (0.005, 0.01, 0.002, 0.015)


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts of every whole text as columns named in ``STATS``, and those in ``MORE``.

    The latter are its lines with a word, its letters, its different words and
    its different pairs of neighbouring words (by 64-bit hashes).

    Each step is a projection of its own, so that arrays are built once. The
    hash of a 3-word window shares a 64-bit integer with its position: the
    position takes as many low bits as the document needs, the hash the rest,
    and one primitive sort brings equal windows together. The windows that so
    have an equal are then compared by their words, so a hash decides nothing.
    """
    step = (
        docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
        .withColumn("_words", F.array_remove(F.split("_text", SPACE + "+"), ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_text", F.lit(SYMBOL)).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_letters", F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("long"))
        .withColumn("n_distinct", F.size(F.array_distinct("_words")).cast("long"))
    )
    pair = F.transform(F.sequence(F.lit(0), F.size("_words") - 2), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1)))
    step = step.withColumn("n_pairs", F.when(F.col("n_words") >= 2, F.size(F.array_distinct(pair))).otherwise(0).cast("long"))
    step = step.withColumn("_keep", F.expr("shiftleft(-1L, length(bin(n_words)))")).drop("_text", "_lines")
    window = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).bitwiseAND(F.col("_keep")).bitwiseOR(i.cast("long")),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("_sorted", F.sort_array(window))

    def same(x: Column, at: Column) -> Column:
        return F.coalesce(x.bitwiseXOR(F.get("_sorted", at)).bitwiseAND(F.col("_keep")) == 0, F.lit(False))

    hit = F.filter("_sorted", lambda x, i: same(x, i + 1) | same(x, i - 1))
    step = step.withColumn("_hit", F.transform(hit, lambda x: x.bitwiseAND(F.bitwise_not(F.col("_keep"))).cast("int"))).drop("_sorted", "_keep")
    words_at = lambda p: F.concat_ws(" ", F.get("_words", p), F.get("_words", p + 1), F.get("_words", p + 2))
    step = step.withColumn("_hit", F.array_sort(F.transform("_hit", lambda p: F.struct(words_at(p).alias("w"), p.alias("p"))))).drop("_words")

    def equal(x: Column, at: Column) -> Column:
        return F.coalesce(F.get("_hit", at)["w"] == x["w"], F.lit(False))

    step = step.withColumn("_again", F.transform(F.filter("_hit", lambda x, i: equal(x, i + 1) | equal(x, i - 1)), lambda x: x["p"])).drop("_hit")
    covered = F.array_union(F.array_union("_again", F.transform("_again", lambda p: p + 1)), F.transform("_again", lambda p: p + 2))
    return step.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("_again")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    """Four statistics on scales on which plain prose is nearly normal."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(chars / n),
        F.log((F.col("word_chars") - F.col("n_letters")) / chars + 0.05),
        F.log(F.greatest(F.col("n_distinct"), F.lit(1))) / F.log(F.greatest(n, F.lit(2.0))),
        F.sqrt(1 - F.col("n_pairs") / F.greatest(n - 1, F.lit(1.0))),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under the Cholesky factor l_ij."""
    y: list[Column] = []
    for i in range(DIMS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in y))


def _guarded() -> dict[str, Column]:
    """Covariances whose variances are at least the guards'."""
    return {f"c{i}{i}": F.greatest(F.col(f"c{i}{i}"), F.lit(GUARDS[i] ** 2)) for i in range(DIMS)}


def _factored(groups: DataFrame) -> DataFrame:
    """Add the Cholesky factors l_ij of the guarded covariances c_ij, and the determinant's logarithm."""
    groups = groups.withColumns(_guarded())
    for i in range(DIMS):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return groups.withColumn("logdet", 2 * reduce(lambda a, b: a + b, (F.log(f"l{i}{i}") for i in range(DIMS))))


MEANS = [f"m{i}" for i in range(DIMS)]
COVARIANCES = [f"c{i}{j}" for i in range(DIMS) for j in range(i + 1)]


def _moments(rows: DataFrame, by: list[str], scale: float = 1.0, more: list[Column] | None = None) -> DataFrame:
    return rows.groupBy(*by).agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMS)],
        *[(scale * F.covar_pop(f"x{i}", f"x{j}")).alias(f"c{i}{j}") for i in range(DIMS) for j in range(i + 1)],
        *(more or []),
    )


#: Pools up to which their estimates (a few hundred bytes each) are broadcast.
MAX_BROADCAST = 20_000
#: Consistency factor of the 75 % subset of a 4-variate normal: 0.75 / F_6(q), q the 75 % point of chi-square with 4 degrees of freedom.
CONSISTENCY = 1.5145
#: Where concentration begins: medians and median deviations; all vectors' moments; medians, and deviations as large as the guards.
STARTS = ("spread", "all", "middle")
#: Least fall of a log determinant that counts as one, and most steps.
FALL, STEPS = 1e-3, 12
#: Steps after which only a pool's start of least determinant goes on.
RACE = 2


def _joined(rows: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """Attach per-pool values: broadcast up to a checked number of pools, else a shuffled join that adaptive execution splits."""
    on = [c for c in ("pool", "start") if c in rows.columns and c in table.columns]
    return rows.join(F.broadcast(table) if groups <= MAX_BROADCAST else table, on)


def mcd(vectors: DataFrame, groups: int, share: float = 0.75) -> DataFrame:
    """Minimum-covariance-determinant estimates (m_i, c_ij) for each value of ``pool``, one row each.

    In a concentration step the ``share`` of vectors nearest to an estimate
    give the next one. Quantiles are mergeable summaries (relative rank error
    1/10000). Estimates are stored tables, each written once and deleted when
    the next one stands.
    """
    spark = vectors.sparkSession
    middle = vectors.groupBy("pool").agg(*[F.percentile_approx(f"x{i}", 0.5).alias(f"m{i}") for i in range(DIMS)])
    spread = (
        _joined(vectors, middle, groups)
        .groupBy("pool")
        .agg(
            *[F.max(m).alias(m) for m in MEANS],
            *[F.pow(1.4826 * F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5), F.lit(2)).alias(f"c{i}{i}") for i in range(DIMS)],
        )
        .withColumns({f"c{i}{j}": F.lit(0.0) for i in range(DIMS) for j in range(i)})
    )
    least = spread.withColumns({f"c{i}{i}": F.lit(0.0) for i in range(DIMS)})
    starts = [f.select("pool", F.lit(name).alias("start"), *MEANS, *COVARIANCES) for name, f in zip(STARTS, (spread, _moments(vectors, ["pool"]), least))]
    estimate, path = store(_factored(reduce(DataFrame.unionByName, starts)), "estimate")
    known = [f"x{i}" for i in range(DIMS)]
    for step in range(STEPS):
        near = _joined(vectors, estimate.drop(*COVARIANCES), groups).withColumn("d2", _distance()).select("pool", "start", *known, "d2", F.col("logdet").alias("before"))
        edge = near.groupBy("pool", "start").agg(F.percentile_approx("d2", share).alias("edge"))
        chosen = _joined(near, edge, groups).where("d2 <= edge")
        new, new_path = store(_factored(_moments(chosen, ["pool", "start"], CONSISTENCY, [F.max("before").alias("before")])), "estimate")
        drop(spark, path)
        fell = new.agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        estimate, path = new.drop("before"), new_path
        if step and (fell is None or fell < FALL):  # the first step leaves the starts, whose determinants mean nothing
            break
        if step == RACE - 1:
            first = F.min_by(F.struct(*estimate.columns), F.struct(F.round("logdet", 6), "start")).alias("e")
            ahead, ahead_path = store(estimate.groupBy("pool").agg(first).select("e.*"), "estimate")
            drop(spark, path)
            estimate, path = ahead, ahead_path
    best = estimate.groupBy("pool").agg(F.min_by(F.struct(*MEANS, *COVARIANCES), F.struct(F.round("logdet", 6), "start")).alias("e"))
    return best.select("pool", "e.*")


def _drawn(own: DataFrame, parent: DataFrame, up: Column, prior: float, groups: int) -> DataFrame:
    """Estimates of ``own`` drawn towards those of ``parent`` (whose ``lang`` is ``up``) as by ``prior`` vectors there.

    The corpus is one row, which a join on a constant would meet in as many
    tasks as the product of both sides' partitions: few parents are broadcast.
    """
    far = parent.select(F.col("lang").alias("_up"), *[F.col(c).alias(f"p_{c}") for c in (*MEANS, *COVARIANCES)])
    both = own.withColumn("_up", up).join(F.broadcast(far) if groups <= MAX_BROADCAST else far, "_up")
    share = F.col("size") / (F.col("size") + prior)
    return both.select("lang", "source", "size", *[(share * F.col(c) + (1 - share) * F.col(f"p_{c}")).alias(c) for c in (*MEANS, *COVARIANCES)])


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    carry: list[str] | None = None,
    prior: float = 100.0,
    cutoff: float = 33.377,
) -> DataFrame:
    """Columns ``carry`` (all, if not given) with the base counts, ``base_failed`` and ``kept``.

    ``cutoff`` is on the squared distance; 33.377 is the point of chi-square with 4 degrees
    of freedom that one in a million exceeds: the tails of good texts (figures, addresses) are heavier than normal. Columns of ``docs`` named like a
    result column are replaced.
    """
    made = {*STATS, "base_failed", "kept"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    names = {c: f"in_{i}" for i, c in enumerate(dict.fromkeys([*carry, text_col, lang_col, source_col]))}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    counted, _ = store(with_counts(rows, names[text_col]).select(*[names[c] for c in dict.fromkeys([*carry, lang_col, source_col])], *STATS, *MORE), "rules")
    counted = counted.withColumn("base_failed", base_failed())
    key = [F.coalesce(F.concat(F.lit("="), F.col(names[c]).cast("string")), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    each = counted.where("not base_failed").select(*key, *[F.round(x, 9).alias(f"x{i}") for i, x in enumerate(_vector())])
    # Every vector is in three pools: its language and source, its language, the corpus.
    pools = F.array(F.struct("lang", "source"), F.struct("lang", F.lit("*").alias("source")), F.struct(F.lit("*").alias("lang"), F.lit("*").alias("source")))
    each, each_path = store(each, "vectors")
    vectors = each.select(F.explode(pools).alias("pool"), *[f"x{i}" for i in range(DIMS)])
    sizes, sizes_path = store(vectors.groupBy("pool").agg(F.count(F.lit(1)).alias("size")), "sizes")
    groups = sizes.count()
    found, _ = store(mcd(vectors, groups).join(sizes, "pool").select("pool.lang", "pool.source", "size", *MEANS, *COVARIANCES), "found")
    for path in (each_path, sizes_path):
        drop(docs.sparkSession, path)
    langs = _drawn(found.where("lang <> '*' and source = '*'"), found.where("lang = '*'"), F.lit("*"), prior, 1)
    table = _factored(_drawn(found.where("source <> '*'"), langs, F.col("lang"), prior, groups)).drop(*COVARIANCES, "size", "logdet")
    table = F.broadcast(table) if groups <= MAX_BROADCAST else table
    judged = counted.select("*", *key, *[F.round(x, 9).alias(f"x{i}") for i, x in enumerate(_vector())]).join(table, ["lang", "source"], "left")
    kept = ~F.col("base_failed") & F.coalesce(_distance() <= cutoff, F.lit(True))
    return judged.select(*[F.col(names[c]).alias(c) for c in carry], *STATS, "base_failed", kept.alias("kept"))
