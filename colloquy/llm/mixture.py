"""One mix of several sources in target shares, by systematic sampling.

Every record of a source is expected the same number of times (target over what the source
has, at most its cap). The expected copies are summed along the source in order of size, one random
offset is added, and a record comes out once for each whole number its stretch
crosses. Between two neighbouring crossings sizes only rise, so the size that comes out
differs from the one expected by no more than one copy of the source's largest record.
"""

from __future__ import annotations

from dataclasses import dataclass
from random import Random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.identity import folded
from colloquy.llm.ranking import rank_within

SCALE = 1 << 20  # expected copies are kept as whole numbers of this part


@dataclass(frozen=True)
class SourcePlan:
    """What one source gives to the mix."""

    source: str
    own: int  # size of its records
    n: int
    weight: int
    max_repeat: int
    total: int  # size of the mix

    @property
    def short(self) -> bool:
        return self.max_repeat * self.own * 100 < self.weight * self.total

    @property
    def passes(self) -> int:
        """Whole times through the source that reach its target, at most max_repeat."""
        return self.max_repeat if self.short else -(-self.weight * self.total // (100 * self.own)) if self.own else 0

    @property
    def copies(self) -> int:
        """Expected copies of each record, in parts of SCALE."""
        return self.max_repeat * SCALE if self.short else self.weight * self.total * SCALE // (100 * self.own) if self.own else 0


def records(df: DataFrame, record: str, source: str, size: str, targets: DataFrame) -> DataFrame:
    """(id, source, size): each record once, with a positive size and a source of ``targets`` however it is written, under its proper name."""
    named = targets.select(F.col("source").alias("proper"), folded(F.col("source")).alias("f"))
    rows = df.select(F.col(record).alias("id"), folded(F.col(source)).alias("f"), F.col(size).cast("bigint").alias("size")).where("id is not null and size > 0")
    return rows.distinct().join(F.broadcast(named), "f").select("id", F.col("proper").alias("source"), "size")  # as many rows as there are targets


def plan(rows: DataFrame, targets: DataFrame) -> list[SourcePlan]:
    """The plan of each source of ``targets`` (source, weight_pct, max_repeat); a source without records has all of its passes and is short, unless nothing is asked of it."""
    own = {r["source"]: (r["own"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("own"), F.count("*").alias("n")).collect()}
    total = sum(o for o, _ in own.values())
    wanted = sorted((r["source"], r["weight_pct"], r["max_repeat"]) for r in targets.select("source", "weight_pct", "max_repeat").distinct().collect())
    return [SourcePlan(s, *own.get(s, (0, 0)), w, m, total) for s, w, m in wanted]


def plan_table(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, passes, is_short) of the plan."""
    got = [(p.source, p.passes, int(p.short)) for p in plan(rows, targets)]
    return rows.sparkSession.createDataFrame(got, "source string, passes int, is_short int")


def mix(rows: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """The mix: (id, source, size, copy), one row for each time a record comes out.

    ``rows`` as from records(). A source goes in order of size, equal sizes in an order that follows from ``seed``, as does its offset.
    """
    dice = Random(seed)
    rates = [(p.source, p.copies, dice.randrange(SCALE)) for p in plan(rows, targets)]
    spark = rows.sparkSession
    rate = F.broadcast(spark.createDataFrame(rates, "source string, copies bigint, shift bigint"))  # a row for each target
    ranked = rank_within(rows.withColumn("h", F.xxhash64("id", F.lit(seed))), "source", [F.col("size"), F.col("h"), F.col("id")])
    sums = ranked.join(rate, "source")
    edge = lambda i: F.shiftright(i * F.col("copies") + F.col("shift"), 20)
    times = (edge(F.col("rank") + 1) - edge(F.col("rank"))).cast("int")
    return sums.where(times > 0).select("id", "source", "size", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


def verified(rows: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, passes, is_short) of the plan, held against the mix; a source that the mix doesn't bear out is an error.

    A source comes out within one record of its expected copies. If it isn't short, every record of
    ``rows`` comes out as often as the plan has passes, or once less; if it is, as often as it has passes.
    """
    planned = rows.sparkSession.createDataFrame([(p.source, p.passes, int(p.short), p.copies) for p in plan(rows, targets)], "source string, passes int, is_short int, copies bigint")
    times = mixed.groupBy("id", "source", "size").agg(F.count("*").alias("times"))
    out = F.coalesce("times", F.lit(0))
    each = rows.join(times, ["id", "source", "size"], "left").groupBy("source").agg(F.min(out).alias("least"), F.max(out).alias("most"), F.sum(out).alias("out"), F.count("*").alias("n"))
    near = F.abs(F.col("out") * SCALE - F.col("copies") * F.col("n")) < SCALE
    borne_out = F.col("n").isNull() | near & (F.col("most") <= F.col("passes")) & (F.col("least") >= F.col("passes") - 1 + F.col("is_short"))
    wrong = F.raise_error(F.concat(F.lit("the mix doesn't bear out the plan of "), "source"))
    return planned.join(each, "source", "left").select("source", F.when(borne_out, F.col("passes")).otherwise(wrong).cast("int").alias("passes"), "is_short")


def shares(rows: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: records and size in the mix, its share of the mix and of T (the size of all ``rows``, which the mix is to have), the share asked for, and what is wanting of it.

    A source of which nothing comes out has 0; without rows shares are null.
    """
    got = mixed.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("copy").alias("most_copies"))
    total = got.agg(F.sum("size").alias("total")).join(rows.agg(F.sum("size").alias("asked")), F.lit(True))  # one row each
    wanted = targets.select("source", "weight_pct").distinct()
    every = wanted.join(got, "source", "left").join(F.broadcast(total), F.lit(True), "left")  # one row
    size = F.coalesce("size", F.lit(0))
    return every.select(
        "source", "weight_pct", F.coalesce("n", F.lit(0)).alias("n"), size.alias("size"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(100 * size / F.col("total"), 4).alias("share_pct"), F.round(100 * size / F.col("asked"), 4).alias("share_of_t_pct"), F.round(F.col("weight_pct") * F.col("asked") / 100 - size).cast("bigint").alias("missing_size"),
    )
