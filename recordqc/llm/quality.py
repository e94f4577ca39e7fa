"""Quality rules: base rules and robust multivariate outliers, in DataFrame functions only.

Each text gives a vector of transformed statistics. Per language and source, a
minimum covariance determinant estimate of its centre and scatter is reached
by concentration steps: the ``core`` share of rows with the smallest Mahalanobis
distances gives the next mean and covariance. Three starts go side by side, all
at the medians: quartile ranges alone, and these with the correlations of
hyperbolic tangents or of spatial signs, neither of which a far row can bend.
After two steps the start of least determinant goes on alone (ties: the first),
until no determinant falls any more. A last step takes all rows inside the
97.5 % ellipse. Rows far outside of it are rejected.

Means and covariances are sums that combine before the shuffle, so a hot source
is no hot task. Vectors and distances lie on integer grids: sums are exact, and
medians and quantiles are taken from counts of a bounded number of values.

Null texts have no words and fail the base rules. Null languages and sources
form groups of their own. Groups below ``least`` rows share one pooled estimate;
if the pool is that small too, nothing is rejected beyond the base rules.
Repeated rows count as often as they occur. An empty table gives an empty result.
Extra columns pass through; columns named like the result's are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordqc.llm.common import SPACE, key_of, stored

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Steps of the grid for statistics and for ln(1 + squared distance).
GRID, DGRID = 1024, 256
#: Spread below which a statistic is taken as noise: ln words, ln word length, roots of the three rates.
FLOOR = (0.25, 0.05, 0.08, 0.06, 0.15)
P = len(FLOOR)
POOL = "*"


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _repeats(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Windows are compared by 64-bit hash. Only a text that has equal ones sorts them; each of its positions then
    compares itself with its neighbours in that order.
    """
    def count(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_bind(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.size(F.array_distinct(F.flatten(F.transform(
                F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                lambda x: F.sequence(x["i"], x["i"] + 2))))))))
    return _bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(count(w)))


def _dup_lines(text: Column) -> Column:
    return _bind(F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0),
                 lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics and ``base_failed``; window repeats use three words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dense = F.translate(text, " \t\n\x0b\f\r", "")
    out = docs.drop(*BASE, "base_failed", "kept", "distance") \
        .withColumn("__ws", _bind(_words(text), lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("r")))) \
        .withColumn("n_words", F.col("__ws.n").cast("long")) \
        .withColumn("word_chars", F.length(dense).cast("long")) \
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")) \
        .withColumn("n_dup_lines", _dup_lines(text).cast("long")) \
        .withColumn("n_repeat_words", F.col("__ws.r").cast("long")).drop("__ws")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    """The statistics on their grid; null for a text without words, which has no rates (ANSI mode fails on a division by its zero)."""
    n, c = F.col("n_words"), F.col("word_chars")
    raw = [F.log1p(n), F.log(F.try_divide(c, n)), F.sqrt(F.try_divide("n_symbols", c)), F.sqrt(F.try_divide("n_dup_lines", n)), F.sqrt(F.try_divide("n_repeat_words", n))]
    return [F.round(x * GRID).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def chi2_cdf(x: float, k: int) -> float:
    """Distribution function of chi-square by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > 1e-16 * total:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def _consistency(share: float) -> float:
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _cholesky(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, m0.., l00, l10, ..`` and ``logdet`` from ``c00, c10, ..``; no pivot lies below its floor."""
    for j in range(P):
        rest = F.col(f"c{j}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[j] ** 2))))
        for i in range(j + 1, P):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    logdet = sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)) * 2
    return df.select(*by, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)], logdet.alias("logdet"))


def _factored(moments: DataFrame, factor: float, by: list[str]) -> DataFrame:
    """Mean and Cholesky factor of scatter times ``factor`` plus floors, from sums over a group."""
    n = F.col("n").cast("double")
    df = moments.select(*by, *[(F.col(f"s{i}").cast("double") / n / GRID).alias(f"m{i}") for i in range(P)],
                        *[(F.lit(factor) * (F.col(f"s{i}{j}").cast("double") / n - F.col(f"s{i}").cast("double") / n * (F.col(f"s{j}").cast("double") / n))
                           / (GRID * GRID) + F.lit(FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])
    return _cholesky(df, by)


def _distance(df: DataFrame, shape: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``distance`` (null without an estimate) and its grid value ``__d``, for each start of ``shape``.

    ``shape`` has at most three rows for each language and source of ``least`` rows or more, a few hundred bytes each.
    """
    df = df.join(F.broadcast(shape), "g", "left")
    total = F.lit(0.0)
    for i in range(P):
        z = F.col(f"x{i}") / F.lit(float(GRID)) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    df = df.withColumn("distance", total).withColumn("__d", F.floor(F.log1p("distance") * DGRID))
    return df.drop(*[f"z{i}" for i in range(P)], *[c for c in shape.columns if c not in ("g", "start")])


def _moments(df: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + \
           [F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates a group: 0 without correlation, 1 with that of tangents, 2 with that of spatial signs."""
    quarts = rows.groupBy("g").agg(*[F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(P)])
    root = lambda i: F.sqrt(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * GRID), F.lit(2.0)) + FLOOR[i] ** 2)
    middle = stored(quarts.select("g", *[(F.col(f"q{i}")[1] / GRID).alias(f"m{i}") for i in range(P)], *[root(i).alias(f"d{i}") for i in range(P)]), "mcd-middle")
    z = [(F.col(f"x{i}") / F.lit(float(GRID)) - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(P)]
    norm = F.sqrt(sum((x * x for x in z), F.lit(0.0)))
    grid = lambda x: F.round(x * GRID).cast("long")
    kinds = F.array(*[F.struct(F.lit(k).alias("start"), *[grid(v).alias(f"x{i}") for i, v in enumerate(vs)])
                      for k, vs in ((1, [F.tanh(x) for x in z]), (2, [F.when(norm > 0, x / norm).otherwise(F.lit(0.0)) for x in z]))])
    bent = _moments(rows.join(F.broadcast(middle), "g").select("g", F.explode(kinds).alias("k")).select("g", "k.*"), ["g", "start"])
    spread = lambda i, j: F.col(f"s{i}{j}").cast("double") / F.col("n") - F.col(f"s{i}").cast("double") / F.col("n") * (F.col(f"s{j}").cast("double") / F.col("n"))
    # a statistic without spread has no correlation; shrunk by a hundredth, so that the factor exists
    corr = lambda i, j: F.when((spread(i, i) > 0) & (spread(j, j) > 0), F.lit(0.99) * spread(i, j) / F.sqrt(spread(i, i) * spread(j, j))).otherwise(F.lit(0.0))
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    tied = bent.select("g", "start", *[corr(i, j).alias(f"r{i}{j}") for i, j in pairs if i != j])
    plain = middle.select("g", F.lit(0).alias("start"), *[F.lit(0.0).alias(f"r{i}{j}") for i, j in pairs if i != j])
    both = plain.unionByName(tied).join(F.broadcast(middle), "g")
    scatter = [(F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.col(f"r{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in pairs]
    return _cholesky(both.select("g", "start", *[f"m{i}" for i in range(P)], *scatter), ["g", "start"])


def _least(shape: DataFrame) -> DataFrame:
    """The row of least determinant for each group; ties: the first start."""
    return shape.groupBy("g").agg(F.min_by(F.struct(*[c for c in shape.columns if c != "g"]), F.struct("logdet", "start")).alias("b")).select("g", "b.*")


def estimate(rows: DataFrame, core: float = 0.75, steps: int = 12) -> DataFrame:
    """For each group ``g`` of stored ``rows`` (``g, x0..``) an estimate: ``m0.., l00.., logdet, start``.

    All starts take two steps; the one of least determinant goes on alone, until no group's determinant falls by more
    than a millionth or ``steps`` are done.
    """
    by = ["g", "start"]
    shape = stored(_starts(rows), "mcd-start")
    for step in range(steps):
        near = _distance(rows, shape)
        limit = stored(near.groupBy(*by).agg(F.percentile("__d", core).alias("__limit")), f"mcd-limit{step}")
        inside = near.join(F.broadcast(limit), by).where(F.col("__d") <= F.col("__limit"))
        before, shape = shape, _factored(_moments(inside, by), _consistency(core), by)
        shape = stored(_least(shape) if step == 1 else shape, f"mcd-step{step}")
        falls = shape.join(before.select(*by, F.col("logdet").alias("__old")), by).where(F.col("logdet") < F.col("__old") - 1e-6)
        if step > 1 and falls.isEmpty():
            break
    return shape


def judge(measured: DataFrame, core: float = 0.75, steps: int = 12, tail: float = 1e-5, least: int = 50) -> DataFrame:
    """``measured`` (a stored table of ``measure``) with ``distance`` and ``kept``.

    Rejected are squared distances beyond the chi-square quantile that a share of ``tail`` of normal rows exceeds.
    """
    made = [f"x{i}" for i in range(P)]
    good = measured.where(~F.col("base_failed")).select(key_of(F.col("lang"), F.col("source")).alias("__g"), *_vector())
    counts = stored(good.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")), "mcd-groups")
    own = F.when(F.col("__n") >= least, F.col("__g")).otherwise(F.lit(POOL))
    pooled = counts.select("__g", own.alias("g"))
    sizes = stored(pooled.join(counts, "__g").groupBy("g").agg(F.sum("__n").alias("__n")).where(F.col("__n") >= least).select("g"), "mcd-sizes")
    rows = stored(good.join(pooled, "__g").join(sizes, "g", "left_semi").select("g", *made), "mcd-rows")
    best = stored(estimate(rows, core, steps), "mcd-best")
    inside = _distance(rows, best).where(F.col("distance") <= chi2_quantile(0.975, P)).drop("start")
    shape = stored(_factored(_moments(inside, ["g"]), _consistency(0.975), ["g"]), "mcd-final")

    tagged = measured.withColumn("__g", key_of(F.col("lang"), F.col("source"))) \
        .join(pooled, "__g", "left").withColumn("g", F.coalesce("g", F.lit(POOL))).select(*measured.columns, "g", *_vector())
    far = F.coalesce(F.col("distance") > chi2_quantile(1 - tail, P), F.lit(False))
    return _distance(tagged, shape).withColumn("kept", ~F.col("base_failed") & ~far).select(*measured.columns, "distance", "kept")
