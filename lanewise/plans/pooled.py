"""Least squares pooled over routes, one fit per origin, from sums that add up.

The model has common slopes and an intercept of its own per route (the indicator columns). The
intercepts are taken out by centring each route on its own means, which leaves a small matrix of
centred products. Every day changes that matrix by an increment, increments of all routes add up
by day, and running sums over days are the normal equations of every origin. So the cost is one
pass over the rows, whatever the number of origins, and nothing larger than a row per route and
day reaches a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.session import stored

# Below this share of its variance that is not explained by the features before it, a feature
# counts as a combination of them and gets no slope.
LEAST_PIVOT = 1e-10
# A centred sum of squares below this share of the plain one is rounding: the feature is constant.
LEAST_SPREAD = 1e-12


def _pairs(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def running_sums(
    rows: DataFrame, asked: DataFrame, names: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Per route and day: rows so far, means so far, and what the day adds to centred products.

    ``rows`` has the keys, ``_day`` and the columns ``names``; incomplete rows do not count. Days
    of ``asked`` (keys, ``_day``) come as rows with ``_side`` 0, before the day's own with 1, so
    they hold what was known when that day began.
    """
    keys, m = list(keys), len(names)
    complete = rows.dropna(subset=list(names))
    sums = [F.count(F.lit(1)).alias("_n")]
    sums += [F.sum(c).alias(f"_s{i}") for i, c in enumerate(names)]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_p{i}_{j}") for i, j in _pairs(m)]
    daily = complete.groupBy(*keys, "_day").agg(*sums).withColumn("_side", F.lit(1))
    days = daily.unionByName(
        asked.select(*keys, "_day", F.lit(0).alias("_side")).distinct(), allowMissingColumns=True
    ).repartition(*keys)
    order = Window.partitionBy(*keys).orderBy("_day", "_side")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = [c for c in daily.columns if c not in (*keys, "_day", "_side")]
    total = days.select(
        *keys, "_day", "_side", F.col("_n").alias("_new"), *[F.sum(c).over(so_far).alias(c) for c in added]
    )

    def centred(i: int, j: int) -> Column:
        product = F.col(f"_p{i}_{j}")
        value = product - F.try_divide(F.col(f"_s{i}") * F.col(f"_s{j}"), "_n")
        if i == j:
            value = F.when(value > product * LEAST_SPREAD, value).otherwise(0.0)
        return F.coalesce(value, F.lit(0.0)).alias(f"_c{i}_{j}")

    means = F.array(*[F.try_divide(f"_s{i}", "_n") for i in range(m)]).alias("means")
    state = total.select(
        *keys, "_day", "_side", "_new", "_n", means, *[centred(i, j) for i, j in _pairs(m)]
    )
    change = [
        (F.col(c) - F.lag(c, 1, 0.0).over(order)).alias(c) for c in (f"_c{i}_{j}" for i, j in _pairs(m))
    ]
    first = ((F.col("_side") == 1) & (F.col("_n") == F.col("_new"))).cast("int").alias("_route")
    return state.select(*keys, "_day", "_side", "_new", first, "_n", "means", *change)


def _solve(matrix: Column, m: int) -> Column:
    """Slopes of the scaled normal equations: Gauss-Jordan steps on a flat ``m`` by ``m`` array.

    The last row and column belong to the target. A feature that the ones before it explain keeps
    a zero row, hence a zero slope. The matrix is semi-definite, so pivots need no search.
    """

    def step(a: Column, p: Column) -> Column:
        pivot = F.get(a, p * m + p)
        usable = pivot > LEAST_PIVOT

        def cell(value: Column, at: Column) -> Column:
            row = F.floor(at / m).cast("int")
            of_row, of_column = F.get(a, p * m + at % m), F.get(a, row * m + p)
            return (
                F.when(row == p, F.when(usable, value / pivot).otherwise(0.0))
                .when(usable, value - of_column * of_row / pivot)
                .otherwise(value)
            )

        return F.transform(a, cell)

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(m - 2)), matrix, step)
    return F.transform(F.sequence(F.lit(0), F.lit(m - 2)), lambda i: F.get(solved, i * m + (m - 1)))


def fit(
    rows: DataFrame,
    asked: DataFrame,
    features: Sequence[str],
    target: str,
    keys: Sequence[str],
    family: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Fits for every asked day, on the rows of earlier days; one per family and day.

    ``asked`` has the keys and ``origin``, a midnight; ``rows`` the keys, ``origin`` of its day,
    the features and the target. Returns ``fits`` (family, origin, ``n_rows``, ``n_routes``,
    ``correlations``, ``slopes``) and ``centres`` (keys, origin, ``means`` of the route's earlier
    rows, null without any). Slopes are null unless there are more rows than unknowns.
    """
    keys, family, names = list(keys), list(family), [*features, target]
    m = len(names)
    asked_days = asked.select(*keys, F.to_date("origin").alias("_day")).distinct()
    days = stored(
        running_sums(rows.withColumn("_day", F.to_date("origin")), asked_days, names, keys), "sums"
    )
    origin = F.col("_day").cast("timestamp_ntz").alias("origin")
    centres = days.where("_side = 0").select(*keys, origin, F.when(F.col("_n") > 0, F.col("means")).alias("means"))
    cells = [f"_c{i}_{j}" for i, j in _pairs(m)]
    by_day = days.groupBy(*family, "_day", "_side").agg(
        F.sum("_new").alias("n_rows"), F.sum("_route").alias("n_routes"), *[F.sum(c).alias(c) for c in cells]
    )
    # One row per family, day and side: a calendar bounds it, so one window holds a family.
    so_far = (
        Window.partitionBy(*family, F.lit(0)).orderBy("_day", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    at_origin = by_day.select(
        *family, origin, "_side", *[F.sum(c).over(so_far).alias(c) for c in ("n_rows", "n_routes", *cells)]
    ).where("_side = 0")

    def spread(i: int) -> Column:
        return F.sqrt(F.greatest(F.col(f"_c{i}_{i}"), F.lit(0.0)))

    def correlation(i: int, j: int) -> Column:
        shared = F.nullif(spread(i) * spread(j), F.lit(0.0))
        return F.coalesce(F.col(f"_c{min(i, j)}_{max(i, j)}") / shared, F.lit(0.0))

    table = at_origin.select(
        *family, "origin",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_routes", F.lit(0)).alias("n_routes"),
        F.array(*[correlation(i, j) for i in range(m) for j in range(m)]).alias("correlations"),
        F.array(*[spread(i) for i in range(m)]).alias("spreads"),
    )
    scaled = table.withColumn("_b", _solve(F.col("correlations"), m))
    slope = F.transform(
        "_b",
        lambda b, i: F.coalesce(
            b * F.get("spreads", F.lit(m - 1)) / F.nullif(F.get("spreads", i), F.lit(0.0)), F.lit(0.0)
        ),
    )
    determined = F.col("n_rows") > F.col("n_routes") + (m - 1)
    fits = scaled.select(
        *family, "origin", "n_rows", "n_routes", "correlations", "spreads",
        F.when(determined, slope).alias("slopes"),
    )
    return fits, centres


def predicted(features: Sequence[str | Column], slopes: Column, means: Column) -> Column:
    """The route's mean plus the slopes times the distances from its feature means."""
    value = F.get(means, F.lit(len(features)))
    for i, x in enumerate(features):
        x = F.col(x) if isinstance(x, str) else x
        value = value + F.get(slopes, F.lit(i)) * (x - F.get(means, F.lit(i)))
    return value


def gradient(m: int) -> Column:
    """Largest correlation left between a feature and the residual; zero where a fit is optimal."""

    def left(i: int) -> Column:
        spread = F.get("spreads", F.lit(m - 1))
        value = F.get("correlations", F.lit(i * m + m - 1))
        for j in range(m - 1):
            share = F.get("slopes", F.lit(j)) * F.get("spreads", F.lit(j)) / F.nullif(spread, F.lit(0.0))
            value = value - F.coalesce(share, F.lit(0.0)) * F.get("correlations", F.lit(i * m + j))
        return F.abs(value)

    return F.greatest(*[left(i) for i in range(m - 1)])
