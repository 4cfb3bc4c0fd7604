"""Scores of predictions: class distributions, commits of a series, confusion of events, agreement of raters, differences of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def label_cross_entropy(counts: DataFrame, train: Column, by: str, classes: int = 256) -> DataFrame:
    """Cross entropy and top-1 share of a unigram model, fitted where ``train`` holds and scored elsewhere: by, n, ce, top1.

    ``counts``: label, n and ``by``; each class counts once more than it is seen, so that none is impossible.
    """
    seen = counts.where(train).groupBy("label").agg(F.sum("n").alias("k"))
    total = seen.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("all"), F.min_by("label", F.struct(-F.col("k"), "label")).alias("best"))  # one row
    rows = counts.where(~train).groupBy(by, "label").agg(F.sum("n").alias("n")).join(seen, "label", "left").join(F.broadcast(total), F.lit(True))
    p = (F.coalesce("k", F.lit(0)) + 1) / (F.col("all") + classes)
    return rows.groupBy(by).agg(F.sum("n").alias("n"), F.round(-F.sum(F.col("n") * F.log(p)) / F.sum("n"), 6).alias("ce"), F.round(F.sum(F.when(F.col("label") == F.col("best"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("top1"))


def class_probabilities(counts: DataFrame, key: str, bins: tuple[int, ...]) -> DataFrame:
    """Shares of the next activity that are speaker 0's, by a distribution over the 256 classes: key, p_now (first two bins), p_future (last two); null where nobody is active.

    A bin counts with its number of frames.
    """
    bit = lambda s, k: F.getbit(F.col("label").cast("bigint"), F.lit(4 * s + k)).cast("int")
    mass = lambda s, ks: F.sum(F.col("n") * sum((bit(s, k) * bins[k] for k in ks), F.lit(0)))
    share = lambda ks: F.round(mass(0, ks) / F.nullif(mass(0, ks) + mass(1, ks), F.lit(0)), 6)
    return counts.groupBy(key).agg(share((0, 1)).alias("p_now"), share((2, 3)).alias("p_future"))


def commits(series: DataFrame, keys: list[str], value: str, thetas: list[int]) -> DataFrame:
    """Instants at which a series (keys, f, value) crosses a threshold from below, the first frame counting as from below: keys, theta, f."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*keys).orderBy("f")), F.lit(-1))
    edges = series.withColumn("__b", before).where(F.col(value) > F.col("__b"))
    return edges.select(*keys, "f", F.explode(F.filter(F.array(*map(F.lit, thetas)), lambda t: (F.col(value) >= t) & (F.col("__b") < t))).alias("theta"))


def spans_hit(spans: DataFrame, predicted: DataFrame, keys: list[str], cell: int = 1000) -> DataFrame:
    """Spans (keys, a, b) with ``hit``, whether any prediction (keys, at) falls into them (a <= at < b); a span is hit once at most."""
    cut = spans.select(*keys, "a", "b").where("b > a").withColumn("c", F.explode(F.sequence(F.floor(F.col("a") / cell), F.floor((F.col("b") - 1) / cell))))
    held = predicted.select(*keys, "at").distinct().withColumn("c", F.floor(F.col("at") / cell))
    hit = cut.join(held, [*keys, "c"]).where("at >= a and at < b").select(*keys, "a", "b").distinct().withColumn("hit", F.lit(True))
    return spans.join(hit, [*keys, "a", "b"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def fleiss_kappa(ratings: DataFrame, item: str, category: str) -> DataFrame:
    """One row: items, raters, kappa. ``ratings``: a row for each item and rater; items must have equally many, at least two."""
    each = ratings.groupBy(item, category).agg(F.count("*").alias("k"))
    per = each.groupBy(item).agg(F.sum("k").alias("r"), F.sum(F.col("k") * (F.col("k") - 1)).alias("agree"))
    seen = per.agg(F.count("*").alias("items"), F.max("r").alias("raters"), F.avg(F.col("agree") / (F.col("r") * (F.col("r") - 1))).alias("p"))
    share = each.groupBy(category).agg(F.sum("k").alias("k"))
    by_chance = share.agg((F.sum(F.col("k").cast("double") * F.col("k")) / (F.sum("k").cast("double") * F.sum("k"))).alias("q"))
    return seen.join(by_chance, F.lit(True)).select("items", "raters", F.round((F.col("p") - F.col("q")) / F.nullif(1 - F.col("q"), F.lit(0.0)), 6).alias("kappa"))  # one row each


def series_differences(a: DataFrame, b: DataFrame, keys: list[str], limit: float = 1e-3) -> DataFrame:
    """How two vector series (keys, f, vec) differ: keys, n frames, n_off frames that differ by more than ``limit`` standard deviations of a's component, the first such frame, the largest difference."""
    parts = lambda x, v: x.select(*keys, "f", F.posexplode("vec").alias("pos", v)).withColumn(v, F.col(v).cast("double"))
    left = parts(a, "x")
    spread = left.groupBy(*keys, "pos").agg(F.stddev_pop("x").alias("sd"))
    d = left.join(parts(b, "y"), [*keys, "f", "pos"]).join(spread, [*keys, "pos"])
    per = d.groupBy(*keys, "f").agg(F.max(F.abs(F.col("x") - F.col("y")) / (F.col("sd") + 1e-12)).alias("off"))
    return per.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("off") > limit, 1)).alias("n_off"), F.min(F.when(F.col("off") > limit, F.col("f"))).alias("first_off"), F.max("off").alias("largest"))


def weighted_loss(loss: Column, weight: Column) -> Column:
    """sum(w * l) / max(1, sum(w))."""
    return F.sum(weight * loss) / F.greatest(F.sum(weight), F.lit(1.0))


def nearest_kind(gold: DataFrame, predicted: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Each gold event (keys, f, kind) with ``got``, the kind of the nearest predicted event within ``tolerance`` (of equally near ones the earlier, then by kind), null without one, and ``off``, how far it is."""
    cell = 2 * tolerance + 1
    held = predicted.select(*keys, F.col("f").alias("pf"), F.col("kind").alias("pk")).withColumn("c", F.explode(F.array_distinct(F.array(*(F.floor((F.col("pf") + x) / cell) for x in (-tolerance, 0, tolerance))))))
    met = gold.withColumn("c", F.floor(F.col("f") / cell)).join(held, [*keys, "c"]).where(F.abs(F.col("pf") - F.col("f")) <= tolerance)
    best = met.groupBy(*keys, "f", "kind").agg(F.min(F.struct(F.abs(F.col("pf") - F.col("f")).alias("d"), "pf", "pk")).alias("b"))
    return gold.join(best, [*keys, "f", "kind"], "left").select(*keys, "f", "kind", F.col("b.pk").alias("got"), (F.col("b.pf") - F.col("f")).alias("off"))
