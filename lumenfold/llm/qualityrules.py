"""Quality rules: text statistics and robust multivariate outliers (operator 6).

Statistics come from array functions inside each row. Their transformed vectors are judged by
minimum-covariance-determinant estimates for each language and source, regularised by a floor
under each feature's spread, as groups of clean texts hardly vary. Equal vectors of a group
are counted once, and concentration steps run over those counts from several starts until no
determinant falls; the start with the least determinant wins. Quantiles come from fixed
histograms and moments are sums of integers, so that results don't depend on the order of
tasks. DataFrame functions only; no group is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.shared import discard, materialize, small_enough, spread

FEATURES = ("word_size", "symbols", "dup_lines", "repeats")
#: Least spread of a feature, in its transformed units; its square is added to the variance.
FLOOR = (0.25, 0.35, 0.25, 0.30)
#: Transformed features are whole numbers of thousandths.
_SCALE = 1000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null: none."""
    body = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(body, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def covered(places: Column) -> Column:
        step = F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("stop")),
            lambda acc, p: F.struct((acc["sum"] + p + 5 - F.greatest(p, acc["stop"])).cast("long").alias("sum"), (p + 5).alias("stop")),
        )
        return step["sum"]

    def repeats(hashes: Column) -> Column:
        def places(pairs: Column) -> Column:
            n = F.size(pairs)

            def twin(x: Column, k: Column) -> Column:
                before = F.get(pairs, k - 1)["h"] == x["h"]
                after = F.when(k + 1 < n, F.get(pairs, k + 1)["h"] == x["h"]).otherwise(F.lit(False))
                return F.when(k > 0, before).otherwise(F.lit(False)) | after

            return covered(F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["at"])))

        pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(pairs, places))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        window = F.transform(F.sequence(F.lit(0), n - 5), lambda k: F.xxhash64(*[F.get(w, k + j) for j in range(5)]))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(n < 6, F.lit(0).cast("long")).otherwise(_let(window, repeats)).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    found = _let(words, of_words)
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": found,
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": _let(lines, of_lines),
        "n_lines": F.size(F.split(body, "\n", -1)).cast("long"),
    }


def _features() -> list[Column]:
    """Transformed statistics: logarithms of ratios, nought for an ordinary text."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)).cast("double") / words),
        F.log1p(20 * F.col("n_symbols").cast("double") / words),
        F.log1p(5 * F.col("n_dup_lines").cast("double") / lines),
        F.log1p(5 * F.col("n_repeat_words").cast("double") / words),
    ]


def tail_of_chi_square(x: float, degrees: int) -> float:
    """Probability beyond x, for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_point(tail: float, degrees: int) -> float:
    """The point beyond which ``tail`` lies, by bisection."""
    low, high = 0.0, 2000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if tail_of_chi_square(middle, degrees) > tail else (low, middle)
    return high


def _consistency(share: float, degrees: int) -> float:
    """By how much the scatter of the ``share`` nearest of normal vectors is to be raised."""
    return share / (1 - tail_of_chi_square(chi_square_point(1 - share, degrees), degrees + 2))


_D = len(FEATURES)
_X = [f"x{i}" for i in range(_D)]
_M = [f"m{i}" for i in range(_D)]
_L = [f"l{i}{j}" for i in range(_D) for j in range(i + 1)]
#: A scope of rows: a source of a language, a language, or everything.
_SCOPE = ["level", "scope_lang", "scope_source"]


def _moments(rows: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Exact integer sums of the features and of their products, weighted by counts."""
    weight = F.col(n)
    total = [F.sum(weight * F.col(x)).alias(f"s{i}") for i, x in enumerate(_X)]
    product = [F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(_D) for j in range(i + 1)]
    return rows.groupBy(*by).agg(F.sum(weight).alias("n"), *total, *product)


_SUMS = ["n", *[f"s{i}" for i in range(_D)], *[f"s{i}{j}" for i in range(_D) for j in range(i + 1)]]


def _factored(rows: DataFrame, by: list[str], cov: Callable[[int, int], Column]) -> DataFrame:
    """Adds the Cholesky factor l_ij of a covariance, and the logarithm of its determinant."""
    now = rows.select(*by, *_M, *[cov(i, j).alias(f"c{i}{j}") for i in range(_D) for j in range(i + 1)])
    for i in range(_D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            now = now.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    size = F.lit(0.0)
    for i in range(_D):
        size = size + 2 * F.log(F.col(f"l{i}{i}"))
    return now.select(*by, *_M, *_L, size.alias("log_det"))


def _estimate(moments: DataFrame, by: list[str], inflate: float) -> DataFrame:
    """Means m_i, factor l_ij and log_det of each group, floored on the diagonal."""
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    means = moments.select(*by, "n", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(_D)], *_SUMS[1 + _D :])

    def cov(i: int, j: int) -> Column:
        value = F.col(f"s{i}{j}").cast("double") / n - F.col(f"m{i}") * F.col(f"m{j}")
        return inflate * value + ((FLOOR[i] * _SCALE) ** 2 if i == j else 0.0)

    return _factored(means, by, cov)


def _distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(_D):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(_D):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return rows.withColumn("d2", total)


def _bin(d2: Column) -> Column:
    """Cell of a fixed logarithmic histogram, 16 cells to a doubling."""
    return F.floor(16 * F.log2(1 + 16 * d2)).cast("int")


def _starts(cells: DataFrame, few: bool) -> DataFrame:
    """Deterministic starts for each scope: its medians with the floors as spread; its medians
    with the median absolute deviations; its mean and covariance."""
    middle = materialize(cells.groupBy(*_SCOPE).agg(*[F.percentile(x, 0.5, F.col("n")).alias(m) for x, m in zip(_X, _M, strict=True)]))
    off = _attach(cells, middle, _SCOPE, few).select(*_SCOPE, "n", *[F.abs(F.col(x) - F.col(m)).alias(x) for x, m in zip(_X, _M, strict=True)])
    spread = off.groupBy(*_SCOPE).agg(*[F.percentile(x, 0.5, F.col("n")).alias(f"d{i}") for i, x in enumerate(_X)])
    floor = lambda i, j: F.lit((FLOOR[i] * _SCALE) ** 2 if i == j else 0.0)
    wide = lambda i, j: F.pow(1.4826 * F.col(f"d{i}"), 2) + (FLOOR[i] * _SCALE) ** 2 if i == j else F.lit(0.0)
    made = [
        _factored(middle, _SCOPE, floor),
        _factored(middle.join(spread, _SCOPE).select(*_SCOPE, *[f"d{i}" for i in range(_D)], *_M), [*_SCOPE], wide),
        _estimate(_moments(cells, _SCOPE), _SCOPE, 1.0),
    ]
    out = None
    for k, one in enumerate(made):
        # the first step's determinant is the first that counts
        one = one.select(*_SCOPE, F.lit(k).alias("start"), *_M, *_L, F.lit(float("inf")).alias("log_det"), F.lit(True).alias("moving"))
        out = one if out is None else out.union(one)
    return materialize(out)


def robust_estimates(cells: DataFrame, few: bool, share: float = 0.75, reweight: float = 0.025, least_fall: float = 1e-3) -> DataFrame:
    """The centre and the Cholesky factor of the scatter of each scope of ``cells``, which are
    distinct vectors with counts n.

    From each start, concentration steps keep the ``share`` nearest rows, up to a histogram
    cell, and estimate anew from them, as long as the determinant falls by ``least_fall``; it
    has a lower bound by the floors, so steps end. The start of the least determinant, the
    first at a tie, is reweighted with the rows inside the ``1 - reweight`` ellipsoid."""
    by = [*_SCOPE, "start"]
    inflate = _consistency(share, _D)
    now = _starts(cells, few)
    while now.where("moving").limit(1).count():
        near = _distance(_attach(cells, now.where("moving"), _SCOPE, few))
        # sums by cell of the distance's histogram: one pass gives the quantile and the moments
        sums = _moments(near.withColumn("cell", _bin(F.col("d2"))), [*by, "cell"])
        line = Window.partitionBy(*by)
        upto = F.sum("n").over(line.orderBy("cell")) - F.col("n")
        inside = sums.select("*", upto.alias("before"), F.sum("n").over(line).alias("all")).where(F.col("before") < share * F.col("all"))
        kept = inside.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])
        step = _estimate(kept, by, inflate)
        new = step.select(*by, *[F.col(c).alias(f"new_{c}") for c in (*_M, *_L, "log_det")])
        fell = F.coalesce(F.col("new_log_det") < F.col("log_det") - least_fall, F.lit(False))
        joined = now.join(new, by, "left").withColumn("fell", fell)
        after = materialize(joined.select(*by, *[F.when(F.col("fell"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in (*_M, *_L, "log_det")], F.col("fell").alias("moving")))
        discard(now)
        now = after
    best = now.groupBy(*_SCOPE).agg(F.min_by(F.struct(*_M, *_L), F.struct("log_det", "start")).alias("best")).select(*_SCOPE, "best.*")
    near = _distance(_attach(cells, best, _SCOPE, few)).where(F.col("d2") <= chi_square_point(reweight, _D))
    found = materialize(_estimate(_moments(near, _SCOPE), _SCOPE, 1.0))
    discard(now)
    return found


#: Groups up to so many are broadcast, at some 300 bytes each; more are joined with salt.
BROADCAST_GROUPS = 20_000
_SALTS = 16


def _attach(rows: DataFrame, groups: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Join the rows of a small table by group. A group may hold a third of all rows: where
    groups are too many to broadcast, both sides are dealt by group and salt."""
    if few:
        return rows.join(F.broadcast(groups), by)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in by]), F.lit(_SALTS)).cast("int"))
    return spread.join(salted, [*by, "salt"]).drop("salt")


def _scopes(counted: DataFrame, least_rows: int) -> DataFrame:
    """(lang, source, level, judged, targets): the scope that judges each source, the first of
    the source, its language and everything with ``least_rows`` judged rows (level null: none
    has), and the scopes that its rows help to estimate."""
    sizes = counted.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("rows"))
    langs = sizes.groupBy("lang").agg(F.sum("rows").alias("lang_rows"))
    every = sizes.agg(F.sum("rows").alias("all_rows"))
    level = (
        F.when(F.col("rows") >= least_rows, 0).when(F.col("lang_rows") >= least_rows, 1).when(F.col("all_rows") >= least_rows, 2)
    )
    judged = F.when(F.col("level") == 0, F.col("rows")).when(F.col("level") == 1, F.col("lang_rows")).when(F.col("level") == 2, F.col("all_rows"))
    own = materialize(sizes.join(langs, "lang").join(F.broadcast(every)).withColumn("level", level).withColumn("judged", judged))
    by_lang = own.groupBy("lang").agg(F.bool_or(F.coalesce(F.col("level") == 1, F.lit(False))).alias("lang_needed"))
    at_all = own.agg(F.coalesce(F.bool_or(F.col("level") == 2), F.lit(False)).alias("all_needed"))
    nothing = F.lit("")

    def scope(k: int, lang: Column, source: Column) -> Column:
        return F.struct(F.lit(k).alias("level"), lang.alias("scope_lang"), source.alias("scope_source"))

    targets = F.array_compact(F.array(
        F.when(F.col("level") == 0, scope(0, F.col("lang"), F.col("source"))),
        F.when(F.col("lang_needed"), scope(1, F.col("lang"), nothing)),
        F.when(F.col("all_needed"), scope(2, nothing, nothing)),
    ))
    return own.join(by_lang, "lang").join(F.broadcast(at_all)).select("lang", "source", "level", "judged", targets.alias("targets"))


def quality_rules(
    docs: DataFrame,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    tail: float = 5e-6,
    least_rows: int = 50,
    one_sided: bool = True,
) -> DataFrame:
    """The columns ``keep`` (default id_col), the statistics, base_failed and kept.

    base_failed: fewer than 10 words, or over a fifth of them in 5-word windows that the
    text has twice or more. A text that passes is rejected if its squared Mahalanobis
    distance from the robust estimate of its language and source is beyond the chi-square
    point of ``tail``. Sources of fewer than ``least_rows`` judged rows are judged by the
    estimate over all rows of their language, and where the language is as small, over all
    rows; where those are, too, nothing is rejected. With ``one_sided``, features on their
    better side (fewer symbols and repeats than the centre) count as at the centre.

    Null, empty and blank texts have no words and fail; very long texts are read whole. Null
    languages and sources are groups of their own. Repeated rows are judged one by one, and
    equal texts of one group alike; null ids stay null. An empty table gives no rows. Other
    columns, whatever their names, are ignored.
    """
    keep = [id_col] if keep is None else keep
    kept = [f"k{j}" for j in range(len(keep))]
    # null stands apart from any name: names get a mark
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    own = spread(docs).select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], name(lang_col).alias("lang"), name(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    stats = text_statistics(F.col("text"))
    counted = own.select(*kept, "lang", "source", *[v.alias(k) for k, v in stats.items()])
    counted = counted.select(*kept, "lang", "source", "words.*", "n_symbols", "n_dup_lines", "n_lines")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = materialize(counted.withColumn("base_failed", failed).select("*", *[F.round(x * _SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(_features())]))
    scopes = materialize(_scopes(counted, least_rows))
    few = small_enough(scopes, BROADCAST_GROUPS)
    # equal vectors are counted before they meet anything else
    vectors = counted.where("not base_failed").groupBy("lang", "source", *_X).agg(F.count(F.lit(1)).alias("n"))
    aimed = _attach(vectors, scopes.select("lang", "source", "targets"), ["lang", "source"], few)
    cells = materialize(aimed.select(F.explode("targets").alias("target"), *_X, "n").groupBy(*[F.col(f"target.{c}").alias(c) for c in _SCOPE], *_X).agg(F.sum("n").alias("n")))
    estimate = robust_estimates(cells, few)
    at = [F.when(F.col("level") < 2, F.col("lang")).otherwise("").alias("scope_lang"), F.when(F.col("level") < 1, F.col("source")).otherwise("").alias("scope_source")]
    state = materialize(scopes.select("lang", "source", "level", *at).join(estimate, _SCOPE, "left").select("lang", "source", "level", *_M, *_L))
    discard(scopes, cells, estimate)
    near = _attach(counted, state, ["lang", "source"], few)
    if one_sided:
        for i in range(1, _D):
            near = near.withColumn(f"x{i}", F.greatest(F.col(f"x{i}").cast("double"), F.coalesce(F.col(f"m{i}"), F.col(f"x{i}").cast("double"))))
    near = _distance(near)
    outlier = F.coalesce(F.col("d2") > chi_square_point(tail, _D), F.lit(False))
    return near.select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~outlier).alias("kept"), F.col("d2").alias("distance"),
    )
