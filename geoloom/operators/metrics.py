"""Series of training metrics: means, best values, alerts, and the guard against collapse."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def mean_of_rank_means(rows: DataFrame, epoch: str, rank: str, value: str) -> DataFrame:
    """The unweighted mean over ranks of each rank's mean."""
    return rows.groupBy(epoch, rank).agg(F.avg(value).alias("m")).groupBy(epoch).agg(F.avg("m").alias("mean"))


def best_so_far(rows: DataFrame, series: str, order: list[str], value: str, least: bool = True) -> DataFrame:
    """rows with the best value up to each, and whether it is better than all before."""
    upto = Window.partitionBy(series).orderBy(*order)
    best = F.min if least else F.max
    before = best(value).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    better = (F.col(value) < before) if least else (F.col(value) > before)
    return rows.withColumns({"best": best(value).over(upto.rowsBetween(Window.unboundedPreceding, 0)), "improved": F.coalesce(better, F.lit(True))})


def alerts(rows: DataFrame, series: str, step: str, active: str, share: str, every: int, least_active: float, drop: float, most_share: float, restarted: str | None = None) -> DataFrame:
    """rows with the reasons to report a step: its turn, few active codes, fewer than before by `drop`, one code's share too large, codes restarted."""
    before = F.lag(active).over(Window.partitionBy(series).orderBy(step))
    reasons = F.array_compact(
        F.array(
            F.when(F.pmod(F.col(step), F.lit(every)) == 0, "interval"), F.when(F.col(active) < least_active, "low_active"),
            F.when(before - F.col(active) > drop, "drop"), F.when(F.col(share) > most_share, "top_share"),
            F.when(F.col(restarted) > 0, "restart") if restarted else F.lit(None).cast("string"),
        )
    )
    return rows.withColumn("reasons", F.array_join(reasons, ","))


class Guard:
    """Bad: more than a ratio above the median of the last good steps, on magnitude or phase. Bad steps never enter that median."""

    def __init__(self, steps: int, mag_ratio: float, phase_ratio: float, patience: int, good: list | None = None, bad: int = 0):
        self.steps, self.ratios, self.patience = steps, (mag_ratio, phase_ratio), patience
        self.good: list[tuple[float, float]] = list(good or [])
        self.bad = bad

    def judge(self, mag: float, phase: float) -> tuple[str, int, bool]:
        """Reasons, bad steps in a row, and whether those have used up the patience."""
        reasons = []
        if len(self.good) >= self.steps:
            for name, value, ratio, base in zip(("mag", "phase"), (mag, phase), self.ratios, map(median, zip(*self.good, strict=True)), strict=True):
                if base > 0 and value / base > ratio:
                    reasons.append(name)
        if reasons:
            self.bad += 1
        else:
            self.bad = 0
            self.good = [*self.good, (mag, phase)][-self.steps :]
        return ",".join(reasons), self.bad, bool(reasons) and self.bad >= self.patience


GUARDED = "series string, step long, mag double, phase double, reasons string, bad_steps int, triggered boolean"


def guarded(rows: DataFrame, steps: int = 20, mag_ratio: float = 3.0, phase_ratio: float = 3.0, patience: int = 3) -> DataFrame:
    """rows(series, step, mag, phase) with the guard's verdicts.

    Each verdict depends on those before it, so a series is walked in order;
    rows are sorted by Spark and streamed through, one window of good steps in
    memory for each task.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, guard = None, None
        for pdf in batches:
            said = []
            for series, mag, phase in zip(pdf["series"], pdf["mag"], pdf["phase"], strict=True):
                if guard is None or series != now:
                    now, guard = series, Guard(steps, mag_ratio, phase_ratio, patience)
                said.append(guard.judge(mag, phase))
            yield pdf.assign(reasons=[s[0] for s in said], bad_steps=[s[1] for s in said], triggered=[s[2] for s in said])

    ready = rows.select(F.col("series").cast("string").alias("series"), F.col("step").cast("long").alias("step"), F.col("mag").cast("double").alias("mag"), F.col("phase").cast("double").alias("phase"))
    return ready.repartition("series").sortWithinPartitions("series", "step").mapInPandas(walk, GUARDED)
