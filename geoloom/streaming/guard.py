"""Streams: incremental ingest into chunked tables, and the collapse guard with state kept between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geoloom.operators.metrics import Guard

STATE = "mags array<double>, phases array<double>, bad int"
VERDICT = "series string, step long, reasons string, bad_steps int, triggered boolean"


def guard_stream(rows: DataFrame, steps: int = 20, mag_ratio: float = 3.0, phase_ratio: float = 3.0, patience: int = 3) -> DataFrame:
    """Verdicts on a stream of (series, step, mag, phase); of each series the last good steps and the run of bad ones are kept.

    Steps must come in order between batches; within a batch they are sorted.
    """

    def walk(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mags, phases, bad = state.get if state.exists else ([], [], 0)
        guard = Guard(steps, mag_ratio, phase_ratio, patience, list(zip(mags, phases, strict=True)), bad)
        pdf = pd.concat(list(parts)).sort_values("step")
        said = [guard.judge(m, p) for m, p in zip(pdf["mag"], pdf["phase"], strict=True)]
        state.update(([m for m, _ in guard.good], [p for _, p in guard.good], guard.bad))
        yield pd.DataFrame({"series": key[0], "step": pdf["step"], "reasons": [s[0] for s in said], "bad_steps": [s[1] for s in said], "triggered": [s[2] for s in said]})

    return rows.groupBy("series").applyInPandasWithState(walk, VERDICT, STATE, "append", GroupStateTimeout.NoTimeout)


class OrderedGuard(StatefulProcessor):
    """The guard over rows that may come late: they wait in a list until the watermark has passed them, and are judged in order.

    Kept for a series: the waiting rows, the last good steps, and the run of
    bad ones.
    """

    def __init__(self, steps: int, mag_ratio: float, phase_ratio: float, patience: int):
        self.setting = (steps, mag_ratio, phase_ratio, patience)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, step long, mag double, phase double")
        self.good = handle.getListState("good", "mag double, phase double")
        self.bad = handle.getValueState("bad", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            if len(pdf):
                at = pdf["ts"].astype("datetime64[ms]").astype("int64")
                self.waiting.appendList(list(zip(at.tolist(), pdf["step"].tolist(), pdf["mag"].tolist(), pdf["phase"].tolist(), strict=True)))
                latest = max(latest or 0, int(at.max()))
        if latest is not None:
            self.handle.registerTimer(latest)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(w) for w in self.waiting.get())
        due = [w for w in held if w[0] <= passed]
        if due:
            self.waiting.put(held[len(due) :]) if len(due) < len(held) else self.waiting.clear()
            bad = self.bad.get()
            guard = Guard(*self.setting, [tuple(g) for g in self.good.get()], bad[0] if bad else 0)
            said = [guard.judge(mag, phase) for _, _, mag, phase in due]
            if guard.good:
                self.good.put(guard.good)
            self.bad.update((guard.bad,))
            yield pd.DataFrame({"series": key[0], "step": [w[1] for w in due], "reasons": [s[0] for s in said], "bad_steps": [s[1] for s in said], "triggered": [s[2] for s in said]})

    def close(self) -> None:
        pass


def ordered_guard_stream(rows: DataFrame, delay: str, steps: int = 20, mag_ratio: float = 3.0, phase_ratio: float = 3.0, patience: int = 3) -> DataFrame:
    """Verdicts on a stream of (series, step, ts, mag, phase) whose rows may be late by up to `delay`.

    Rows of a series are judged by ts, then step, once the watermark has passed
    them, so the verdicts equal those over the whole table in that order,
    however rows are dealt to batches. Rows later than the delay are dropped.
    What a series holds is bounded by the delay. Needs the RocksDB state store.
    """
    late = rows.select("series", "step", "ts", "mag", "phase").withWatermark("ts", delay).groupBy("series")
    return late.transformWithStateInPandas(OrderedGuard(steps, mag_ratio, phase_ratio, patience), VERDICT, "Append", "EventTime")


def ingest(rows: DataFrame, folder: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, records: int = 100_000):
    """Appends a stream to a table in files of at most `records` rows, each batch once; returns the running query."""

    def append(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own folder.
        prepare(batch).write.mode("overwrite").option("maxRecordsPerFile", records).parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
