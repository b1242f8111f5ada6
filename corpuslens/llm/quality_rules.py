"""Quality rules: base limits, then robust outliers by minimum covariance determinant."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BLANK_RUN, BLANKS, BROADCAST_ROWS, is_small, let, row_key, text_or_empty, without, written

SYMBOLS = "#*$%&|<>"
#: A language and source with fewer rows that meet the base limits has too few for five dimensions.
MIN_GROUP = 50
#: States of so many groups (1 kB each) are broadcast; more are joined.
GROUPS = 20_000

#: Transformed statistics, and the least standard deviation that each is taken to have. Without a
#: floor a source whose texts never repeat a line would reject the first one that does.
FEATURES = {
    "log_words": (F.log, 0.5),
    "log_word_length": (F.log, 0.05),
    "symbol_share": (F.log1p, 0.04),
    "dup_line_share": (F.log1p, 0.15),
    "repeat_share": (F.log1p, 0.10),
}


def text_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text, as column expressions."""
    words = F.filter(F.split(text, BLANK_RUN), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    count = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": count.cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": let(words, repeated_words).cast("long"),
    }


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more.

    Windows are sorted by their 64-bit hash with their places, so equal ones meet as neighbours and are
    compared word by word: n log n for a long text. A window at p covers p to p + 2; the next repeated
    window takes over where it starts.
    """
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: i + 3 <= F.size(words))
    windows = F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at"))))

    def same(x: Column, y: Column) -> Column:
        equal = [F.get(words, x["at"] + k) == F.get(words, y["at"] + k) for k in range(3)]
        return F.coalesce((x["h"] == y["h"]) & equal[0] & equal[1] & equal[2], F.lit(False))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, v: a + v)

    places = let(windows, lambda w: F.array_sort(F.transform(F.filter(w, lambda x, k: same(x, F.get(w, k - 1)) | same(x, F.get(w, k + 1))), lambda x: x["at"])))
    return let(places, covered)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def document_statistics(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, lang, source, the five statistics, base_failed."""
    text = text_or_empty()
    stats = docs.select("doc_id", row_key(F.col("text")).alias("text_hash"), F.col("lang").cast("string"), F.col("source").cast("string"), *[c.alias(k) for k, c in text_statistics(text).items()])
    return stats.withColumn("base_failed", base_failed())


def _features() -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    raw = {
        "log_words": words,
        "log_word_length": F.greatest(F.col("word_chars"), F.lit(1)) / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / words * 10,
        "repeat_share": F.col("n_repeat_words") / words,
    }
    return F.array(*[FEATURES[k][0](c) for k, c in raw.items()])


def _gamma_cdf(a: float, x: float) -> float:
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(dof: int, p: float) -> float:
    lo, hi = 0.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_cdf(dof / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(dof: int, share: float) -> float:
    """By how much the covariance of the nearest share of normal rows falls short."""
    return share / _gamma_cdf(dof / 2 + 1, chi2_quantile(dof, share) / 2)


def inverted(matrix: Column, d: int) -> Column:
    """inverse and determinant of a positive definite d x d matrix kept as a flat array: d Gauss-Jordan sweeps."""

    def sweep(state: Column, k: Column) -> Column:
        m = state["inverse"]
        pivot = F.get(m, k * d + k)

        def entry(v: Column, at: Column) -> Column:
            i, j = (at / d).cast("int"), at % d
            row, col = F.get(m, k * d + j), F.get(m, i * d + k)
            return F.when((i == k) & (j == k), 1 / pivot).when(i == k, row / pivot).when(j == k, -col / pivot).otherwise(v - col * row / pivot)

        return F.struct(F.transform(m, entry).alias("inverse"), (state["determinant"] * pivot).alias("determinant"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.struct(matrix.alias("inverse"), F.lit(1.0).alias("determinant")), sweep)


def distance(x: list[Column], mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance."""
    d = len(x)
    off = [x[i] - F.get(mean, F.lit(i)) for i in range(d)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            total = total + off[i] * off[j] * F.get(inverse, F.lit(i * d + j)) * (1 if i == j else 2)
    return total


def _estimates(near: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """keys, mean, inverse, determinant of the rows of near(keys, x, centre), whose moments are taken about centre."""
    floors = [f for _, f in FEATURES.values()]
    d = len(floors)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    moved = [F.col(f"x{i}") - F.get("centre", F.lit(i)) for i in range(d)]
    got = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first("centre").alias("centre"), *[F.sum(moved[i]).alias(f"m{i}") for i in range(d)], *[F.sum(moved[i] * moved[j]).alias(f"s{i}_{j}") for i, j in pairs])
    m = [F.col(f"m{i}") / F.col("n") for i in range(d)]
    cov = [(F.col(f"s{min(i, j)}_{max(i, j)}") / F.col("n") - m[i] * m[j]) * scale + (floors[i] ** 2 if i == j else 0.0) for i in range(d) for j in range(d)]
    mean = F.array(*[F.get("centre", F.lit(i)) + m[i] for i in range(d)])
    return got.select(*keys, mean.alias("mean"), inverted(F.array(*cov), d).alias("fit")).select(*keys, "mean", "fit.*")


def concentrated(rows: DataFrame, state: DataFrame, group: str, share: float, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One concentration step of each start of state: estimates of the share of its group that lies nearest to it."""
    d, keys = len(FEATURES), [group, "start"]
    x = [F.col(f"x{i}") for i in range(d)]
    far = rows.join(side(state), group).select(*keys, *x, F.col("mean").alias("centre"), distance(x, F.col("mean"), F.col("inverse")).alias("d2"))
    limit = far.groupBy(*keys).agg(F.percentile_approx("d2", share, 10_000).alias("limit"))
    return _estimates(far.join(side(limit), keys).where("d2 <= limit"), keys, consistency(d, share))


def first_estimates(rows: DataFrame, group: str, middle: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Starts of each group: medians (middle's centre) with absolute deviations, the whole group, its rows near the medians in every statistic."""
    floors = [f for _, f in FEATURES.values()]
    d = len(floors)
    x = [F.col(f"x{i}") for i in range(d)]
    about = rows.join(side(middle), group)
    off = [F.abs(c - F.get("centre", F.lit(i))) for i, c in enumerate(x)]
    spread = about.groupBy(group).agg(F.first("centre").alias("centre"), F.array(*[F.percentile_approx(c, 0.5, 10_000) for c in off]).alias("mad"))
    width = [F.greatest(F.get("mad", F.lit(i)) * 1.4826, F.lit(floors[i])) for i in range(d)]
    spread = written(spread.select(group, "centre", F.array(*width).alias("width")), "spread")
    diagonal = F.array(*[F.pow(F.get("width", F.lit(i)), 2) if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    medians = spread.select(group, F.lit("medians").alias("start"), F.col("centre").alias("mean"), inverted(diagonal, d).alias("fit")).select(group, "start", "mean", "fit.*")
    inner = rows.join(side(spread), group)
    for i in range(d):
        inner = inner.where(F.abs(x[i] - F.get("centre", F.lit(i))) <= 2 * F.get("width", F.lit(i)))
    found = [_estimates(df.withColumn("start", F.lit(name)), [group, "start"], 1.0) for name, df in (("whole", about), ("inner", inner))]
    return medians.unionByName(found[0]).unionByName(found[1])


def robust_estimates(rows: DataFrame, group: str, *, share: float = 0.75, tolerance: float = 1e-6) -> DataFrame:
    """Minimum-covariance-determinant mean, inverse covariance and determinant of x for each group.

    The covariance of a subset is regularised by a fixed diagonal, the squares of FEATURES' least
    deviations, so that it can be inverted and a concentration step - the estimates of the share of rows
    nearest to the last ones - never raises its determinant. Each group has three starts, which take
    two steps; the one of least determinant goes on until a step no longer lowers it by more than
    tolerance of itself, and the least is kept. Shares are exact for groups of up to 10,000 rows and
    within one in 10,000 beyond. Every step is a map-side combined aggregation, so a group may hold
    any part of the rows. States, three rows a group, are broadcast if the groups are few enough.
    """
    d = len(FEATURES)
    x = [F.get("x", F.lit(i)).alias(f"x{i}") for i in range(d)]
    rows = written(rows.select(group, *x), "vectors")
    middle = written(rows.groupBy(group).agg(F.array(*[F.percentile_approx(f"x{i}", 0.5, 10_000) for i in range(d)]).alias("centre")), "medians")
    side = F.broadcast if is_small(middle, GROUPS) else lambda df: df
    state = written(first_estimates(rows, group, middle, side), "starts")
    for _ in range(2):
        state = written(concentrated(rows, state, group, share, side), "step")
    least = F.min_by(F.struct("start", "mean", "inverse", "determinant"), F.struct("determinant", "start"))
    best = written(state.groupBy(group).agg(least.alias("s")).select(group, "s.*"), "best")
    active, settled = best, []
    while active.take(1):
        new = concentrated(rows, active, group, share, side).select(group, "start", *[F.col(c).alias(f"new_{c}") for c in ("mean", "inverse", "determinant")])
        both = active.join(new, [group, "start"], "left")
        falls = F.coalesce(F.col("new_determinant") < F.col("determinant") * (1 - tolerance), F.lit(False))
        both = written(both.withColumn("falls", falls), "step")
        settled.append(both.where("not falls").select(group, "mean", "inverse", "determinant"))
        active = both.where("falls").select(group, "start", *[F.col(f"new_{c}").alias(c) for c in ("mean", "inverse", "determinant")])
    return reduce(DataFrame.unionByName, settled) if settled else best.drop("start")


def quality_verdicts(docs: DataFrame, *, min_group: int = MIN_GROUP, tail: float = 1e-5, share: float = 0.75) -> DataFrame:
    """A row for each row of docs(doc_id, text, lang, source): the statistics, base_failed, distance, kept.

    A document that meets the base limits is rejected when its transformed statistics lie farther
    from the robust centre of its language and source than a normal vector does with probability
    tail. Groups of fewer than min_group rows use their language's estimates, small languages those
    of all rows. Null lang or source is a group of its own; a null or empty text fails the base
    limits; repeated rows each count and get the same verdict; a text of any length is one row of
    statistics, read whole in its task; an empty table gives an empty table. Other columns are ignored.
    """
    d = len(FEATURES)
    stats = written(document_statistics(docs), "stats")
    tag = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    by_both, by_lang = F.concat(tag(F.col("lang")), F.lit("|"), tag(F.col("source"))), F.concat(tag(F.col("lang")), F.lit("|"))
    passed = stats.where("not base_failed")
    cells = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.sum("n").over(Window.partitionBy("lang"))
    cells = cells.withColumn("n_lang", own).select("lang", "source", F.when(F.col("n") >= min_group, by_both).when(F.col("n_lang") >= min_group, by_lang).otherwise("|").alias("grp"))
    cells = written(cells, "cells")
    levels = F.array(by_both, by_lang, F.lit("|"))
    rows = passed.select(_features().alias("x"), F.explode(levels).alias("grp")).join(cells.select("grp").distinct(), "grp", "left_semi")
    estimates = robust_estimates(rows, "grp", share=share)
    fits = cells.join(estimates, "grp").select(F.col("lang").alias("l"), F.col("source").alias("s"), "mean", "inverse")
    judged = stats.join(fits, stats["lang"].eqNullSafe(fits["l"]) & stats["source"].eqNullSafe(fits["s"]), "left").drop("l", "s")
    judged = judged.withColumn("distance", distance([F.get(_features(), F.lit(i)) for i in range(d)], F.col("mean"), F.col("inverse"))).drop("mean", "inverse")
    limit = chi2_quantile(d, 1 - tail)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False)))


def drop_low_quality(docs: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, **rules) -> DataFrame:
    """docs without the rows that quality_verdicts rejects, all columns as they were."""
    gone = quality_verdicts(docs, **rules).where("not kept").select(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_key")).distinct()
    return without(docs, written(gone, "rejected"), broadcast_rows)
