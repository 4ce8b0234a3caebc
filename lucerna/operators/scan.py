"""Running values over an order that is too long for one task: carried values, counts, exact quantiles.

Rows are dealt out by ranges of the order, so that a document of any length is
split. What a range hands on to the next (its last values, its count) is a row
for each range and group; these few are scanned, and each range goes on from
what was handed to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.operators import index as I
from lucerna.operators import lineage

PART = "_part"
#: Bins of one step of a search for a quantile, and values that the last step sorts.
BINS, LAST_VALUES = 4096, 10_000


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows, checkpointed, with the number of the range of (by, order) that each lies in."""
    return rows if PART in rows.columns else lineage.cut(rows.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()))


def _handed(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """(by, range, sums) of each range, under names of their own."""
    held = rows.groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col(PART).alias("_of")).agg(*(c.alias(n) for n, c in sums.items()))
    return held


def _joined(rows: DataFrame, by: list[str], handed: DataFrame) -> DataFrame:
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    on = F.col(PART) == F.col("_of")
    for s in same:
        on = on & s
    return rows.join(I.small(lineage.cut(handed)), on, "left").drop("_of", *(f"_by{k}" for k in range(len(by))))


def last_values(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds, for each name, its value's last one that is not null, at or before the row, within `by`.

    Rows are ordered by `order`, which must tell the rows of a group apart.
    """
    rows = placed(rows, by, order).withColumns({f"_own_{n}": c for n, c in values.items()})
    at = F.struct(*order)
    latest = {n: F.max(F.when(F.col(f"_own_{n}").isNotNull(), F.struct(at.alias("at"), F.col(f"_own_{n}").alias("value")))) for n in values}
    earlier = Window.partitionBy(*(f"_by{k}" for k in range(len(by)))).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    handed = _handed(rows, by, latest).withColumns({f"_in_{n}": F.last(n, True).over(earlier)["value"] for n in values}).drop(*values)
    here = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _joined(rows, by, handed)
    return out.withColumns({n: F.coalesce(F.last(f"_own_{n}", True).over(here), F.col(f"_in_{n}")) for n in values}).drop(*(f"_own_{n}" for n in values), *(f"_in_{n}" for n in values))


def numbers(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the row's number within `by`, from 0, in the order of `order`."""
    rows = placed(rows, by, order)
    earlier = Window.partitionBy(*(f"_by{k}" for k in range(len(by)))).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    handed = _handed(rows, by, {"_n": F.count("*")}).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    here = Window.partitionBy(PART, *by).orderBy(*order)
    return _joined(rows, by, handed).withColumn(name, F.col("_before") + F.row_number().over(here) - 1).drop("_before")


def _nth(rows: DataFrame, value: Column, nth: int) -> float:
    """The value at place `nth` from 0 of finite doubles: the range is cut into bins until few values, or one, share the place's bin."""
    held = rows.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    low, high = held.agg(F.min("v"), F.max("v")).first()
    while True:
        if low == high:
            return low
        inside = held.where(F.col("v").between(low, high))
        # halves first, as the width of the whole range may be no finite number
        share = (F.col("v") / 2 - F.lit(low) / 2) / (F.lit(high) / 2 - F.lit(low) / 2)
        bins = inside.groupBy(F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for b in sorted(bins.collect(), key=lambda b: b["bin"]):
            if nth < b["n"]:
                break
            nth -= b["n"]
        if (b["low"], b["high"]) == (low, high) or b["n"] <= LAST_VALUES:
            found = held.where(F.col("v").between(b["low"], b["high"]))
            return found.groupBy("v").count().orderBy("v").limit(nth + 1).withColumn("upto", F.sum("count").over(Window.orderBy("v"))).where(F.col("upto") > nth).orderBy("v").first()["v"]
        low, high = b["low"], b["high"]


def quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile (linear between the two nearest values) of a column of finite numbers; nulls don't count, and none at all have none.

    Counts of bins are all that tasks send, so no task holds or sorts the values.
    """
    n = rows.agg(F.count(column)).first()[0]
    if not n:
        return None
    place = (n - 1) * share
    low, high = (_nth(rows, F.col(column), k) for k in (math.floor(place), math.ceil(place)))
    return low + (high - low) * (place - math.floor(place))
