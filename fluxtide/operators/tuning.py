"""Search over gate thresholds with folds, class caps and a lexicographic choice."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import confusion_columns
from .resampling import uniform

# The grid that is searched where no policy names one.
GRID = {"ratio": (1.5, 2.0, 2.5, 3.0), "peak": (0.5, 0.6, 0.7), "near": (0.3, 0.4, 0.5), "points": (10, 12, 14), "seasons": (4, 5, 6)}


def passed(value: Column, grid: tuple, at_least: bool = True) -> Column:
    """How many of the ascending grid values a row meets: ``value >= g``, or ``value < g``.
    Null meets none."""
    terms = [F.coalesce((value >= g) if at_least else (value < g), F.lit(False)).cast("int") for g in grid]
    return sum(terms[1:], terms[0])


def patterns(df: DataFrame, key: str, truth: str, group: str, base: Column, features: dict[str, str], grid: dict[str, tuple] = GRID, folds: int = 5, seed: int = 42) -> DataFrame:
    """(fold, truth, group, base, steps of each gate, n): all that the search needs of the rows.
    Gates are thresholds, so how many grid values a row meets says which it passes; the table
    has as many rows as there are patterns, however long the input.  Rows are dealt to folds by
    md5 of the key."""
    f = {k: F.col(v) for k, v in features.items()}
    steps = {
        "ratio": passed(f["ratio"], grid["ratio"]),
        "points": passed(F.coalesce(f["points"], F.lit(-1)), grid["points"]),
        "seasons": passed(F.coalesce(f["seasons"], F.lit(-1)), grid["seasons"]),
        "peak": passed(f["nonpeak"], grid["peak"], False),
        "near": passed(f["adjacency"], grid["near"], False),
        "band_seasons": passed(F.coalesce(f["band_seasons"], F.lit(0)), grid["seasons"]),
    }
    fold = F.floor(uniform(seed, F.col(key)) * folds).cast("int")
    named = [c.alias(f"s_{k}") for k, c in steps.items()]
    rows = df.select(fold.alias("fold"), F.col(truth).cast("int").alias("y"), F.lower(F.col(group)).alias("kind"), F.coalesce(base, F.lit(False)).alias("base"), *named)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows"))


def search(found: DataFrame, grid: dict[str, tuple] = GRID, recall_target: float = 0.8, veto_group: str = "blazar", veto_target: float = 0.0, caps: dict[str, float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """One row a grid point: confusion and rates over all rows, the mean balanced accuracy over
    folds, false-positive rates of the groups, and ``place`` in the order of choice: points that
    reach the recall, keep the vetoed group and hold the caps first, by cross-validated accuracy,
    weighted false positives, true negatives and precision; then the others, among which recall
    and the vetoed group come after accuracy.

    ``found`` comes from :func:`patterns`.  It is a small table, so meeting every grid point is."""
    names = list(grid)
    points = [(*p, *i) for p, i in zip(product(*(map(float, grid[n]) for n in names)), product(*(range(1, len(grid[n]) + 1) for n in names)))]
    schema = ", ".join([f"{n} double" for n in names] + [f"i_{n} int" for n in names])
    g = found.sparkSession.createDataFrame(points, schema)
    size = len(grid["peak"]), len(grid["near"])
    # A "less than" gate at grid value i (from 1) is met by rows whose count reaches to i from above.
    spike = (F.col("s_peak") > size[0] - F.col("i_peak")) & (F.col("s_near") > size[1] - F.col("i_near")) & (F.col("s_band_seasons") >= F.col("i_seasons"))
    pred = F.col("base") & (F.col("s_points") >= F.col("i_points")) & (F.col("s_seasons") >= F.col("i_seasons")) & (F.col("s_ratio") >= F.col("i_ratio")) & ~spike
    j = found.crossJoin(F.broadcast(g)).withColumn("pred", pred)
    n = lambda on: F.coalesce(F.sum(F.when(on, F.col("rows"))), F.lit(0))
    pos, neg = F.col("y") == 1, F.col("y") == 0
    four = [n(pos & F.col("pred")).alias("tp"), n(neg & F.col("pred")).alias("fp"), n(pos & ~F.col("pred")).alias("fn"), n(neg & ~F.col("pred")).alias("tn")]
    groups = sorted({veto_group, *(caps or {}), *(weights or {})})
    fpr = {k: F.try_divide(n(neg & (F.col("kind") == k) & F.col("pred")), n(neg & (F.col("kind") == k))).alias(f"fpr_{k}") for k in groups}
    rates = lambda df: df.withColumns(confusion_columns(*map(F.col, ("tp", "fp", "fn", "tn"))))
    folded = rates(j.groupBy(*names, "fold").agg(*four)).groupBy(*names).agg(F.avg("balanced_accuracy").alias("cv_balanced_accuracy"))
    whole = rates(j.groupBy(*names).agg(*four, *fpr.values())).join(folded, names)
    weighted = sum((w * F.coalesce(F.col(f"fpr_{k}"), F.lit(0.0)) for k, w in (weights or {}).items()), F.lit(0.0))
    caps_met = F.lit(True)
    for k, most in (caps or {}).items():
        caps_met = caps_met & F.coalesce(F.col(f"fpr_{k}") <= most, F.lit(True))
    out = whole.withColumns({"weighted_fp": weighted, "meets_recall": F.col("recall") >= recall_target, "meets_veto": F.coalesce(F.col(f"fpr_{veto_group}") <= veto_target, F.lit(False)), "meets_caps": caps_met})
    ok = F.col("meets_recall") & F.col("meets_veto") & F.col("meets_caps")
    r9 = lambda c: F.round(F.col(c), 9)
    order = Window.orderBy(ok.desc(), r9("cv_balanced_accuracy").desc(), F.when(~ok, r9("recall")).desc(), r9("weighted_fp"), F.when(~ok, F.coalesce(r9(f"fpr_{veto_group}"), F.lit(1e9))), F.col("tn").desc(), r9("precision").desc(), *names)
    return out.withColumn("place", F.row_number().over(order))
