"""Reconciliation: what was planned, dispatched, delivered and settled, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def absent(rows: DataFrame, others: DataFrame, *on: str) -> DataFrame:
    """Rows whose key no row of ``others`` has."""
    return rows.join(others.select(*on), list(on), "left_anti")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often: copies, positive if the left has more. Counts meet, not rows."""
    names = left.columns
    both = left.select(*names, F.lit(1).alias("_side")).unionByName(right.select(*names, F.lit(-1).alias("_side")))
    return both.groupBy(*names).agg(F.sum("_side").alias("copies")).where("copies <> 0")


def earliest(candidates: DataFrame, by: str, order: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """Of each key the first candidate in the order; picked before the shuffle where it can be."""
    first = F.min(F.struct(*order, *(k for k in keep if k not in order)))
    return candidates.groupBy(by).agg(first.alias("_first")).select(by, *(F.col(f"_first.{k}").alias(k) for k in keep))


def numbered(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """The place of each row in its group, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def deliveries(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    return numbered(rows, by, order, "delivery").withColumn("redelivered", F.col("delivery") > 1)


def zipped(left: DataFrame, right: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """The i-th row of a key on the left with the i-th on the right, which has the same columns; the right's get ``_right``.

    Both sides are dealt by the key once, numbered and paired where they are.
    """
    sides = [df.select(F.col(by).alias("_by"), F.lit(i).alias("_side"), F.struct(*left.columns).alias("_row")) for i, df in enumerate((left, right))]
    rows = sides[0].unionByName(sides[1]).repartition("_by")
    place = F.row_number().over(Window.partitionBy("_by", "_side").orderBy(*(F.col(f"_row.{c}") for c in order))).cast("long")
    pairs = rows.withColumn("rn", place).groupBy("_by", "rn").agg(*(F.max(F.when(F.col("_side") == i, F.col("_row"))).alias(f"_{i}") for i in (0, 1)))
    both = pairs.where("_0 IS NOT NULL AND _1 IS NOT NULL")
    return both.select("_0.*", "rn", *(F.col(f"_1.{c}").alias(f"{c}_right") for c in left.columns if c != by))


def coverage(events: DataFrame, *by: str) -> DataFrame:
    """Keys that do not occur exactly once."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("times")).where("times <> 1")


def chain_faults(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Of each execution_key of events (execution_key, kind, at): the first kind that is not there exactly once or comes before its predecessor."""
    per = events.where(F.col("kind").isin(*kinds)).groupBy("execution_key").agg(
        *(F.count_if(F.col("kind") == k).alias(f"_n{i}") for i, k in enumerate(kinds)), *(F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"_t{i}") for i, k in enumerate(kinds)))
    cases = [F.when(F.col(f"_n{i}") != 1, k) if i == 0 else F.when((F.col(f"_n{i}") != 1) | (F.col(f"_t{i}") < F.col(f"_t{i - 1}")), k) for i, k in enumerate(kinds)]
    return per.select("execution_key", F.coalesce(*cases).alias("fault"))


def looked_up(rows: DataFrame, plan: DataFrame, on: str, value: str, default: str = "unknown") -> DataFrame:
    """``value`` of the plan's row with the same key, or the default."""
    of = plan.select(F.col(on).alias("_on"), F.col(value).alias("_value"))
    return rows.join(of, F.col(on) == F.col("_on"), "left").withColumn(value, F.coalesce("_value", F.lit(default))).drop("_on", "_value")


def summaries_against_results(summaries: DataFrame, results: DataFrame, by: str, *sums: str) -> DataFrame:
    """Keys for which sums over the results differ from the summary, or that only one side has."""
    own = results.groupBy(by).agg(*(F.sum(c).alias(f"_{c}") for c in sums)).withColumnRenamed(by, "_by")
    both = summaries.select(by, *sums).join(own, F.col(by) == F.col("_by"), "full")
    same = F.lit(True)
    for c in sums:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.where(~same).select(F.coalesce(by, "_by").alias(by), *(x for c in sums for x in (F.col(c).alias(f"summary_{c}"), F.col(f"_{c}").alias(f"results_{c}"))))


def lag(offsets: DataFrame, group: str) -> DataFrame:
    """caught_up of each topic from (group, current, end), current null where none was ever committed.

    A partition without a commit is caught up only if it is empty, one of unknown end never; the lag of all is ``lag``.
    """
    ok = F.coalesce(F.when(F.col("current").isNull(), F.col("end") == 0).otherwise(F.col("current") >= F.col("end")), F.lit(False))
    behind = F.greatest(F.col("end") - F.coalesce("current", F.lit(0)), F.lit(0))
    return offsets.groupBy(group).agg(F.sum(behind).alias("lag"), F.bool_and(ok).alias("caught_up"))


def one_leader(gauges: DataFrame, by: str) -> DataFrame:
    """exactly_one of each group of (node, leader): the nodes' sums are 0 or 1 and one of them is 1."""
    per = gauges.groupBy(by, "node").agg(F.sum("leader").alias("_n"))
    return per.groupBy(by).agg(((F.sum("_n") == 1) & F.bool_and(F.col("_n").isin(0, 1))).alias("exactly_one"))


def logical(records: DataFrame, identity: str, payload: Column) -> DataFrame:
    """physical, duplicates and conflicting of each identity; records with one identity have to be equal."""
    per = records.groupBy(identity).agg(F.count(F.lit(1)).alias("physical"), F.min(payload).alias("_lo"), F.max(payload).alias("_hi"))
    return per.select(identity, "physical", (F.col("physical") - 1).alias("duplicates"), (F.col("_lo") != F.col("_hi")).alias("conflicting"))


def elapsed(events: DataFrame, by: str, at: Column, origin: Column) -> DataFrame:
    """elapsed of each event since the first that is an ``origin``, or the first of all, of its group."""
    w = Window.partitionBy(by)
    return events.withColumn("elapsed", at - F.coalesce(F.min(F.when(origin, at)).over(w), F.min(at).over(w)))


def displayed(kind: Column, sequence: Column, step: int = 6) -> Column:
    """Whether a log line is shown: of the target's successes the first and every sixth, all else."""
    n = sequence.try_cast("int")
    return (kind != "target_success") | n.isNull() | (n == 1) | (n % step == 0)
