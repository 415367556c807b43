"""The collapse guard over late rows."""

import datetime
import os
import random

import pandas as pd

from geoloom.operators import metrics
from geoloom.streaming import guard

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_late_rows_are_judged_in_order(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(f"s{k % 4}", k, start + datetime.timedelta(seconds=10 * k), rng.choice([1.0, 1.1, 9.0]), rng.choice([1.0, 1.2, 8.0, 0.9])) for k in range(240)]
    # Each batch has rows up to some minutes late; the last ones push the watermark past all others.
    dealt = sorted(rows, key=lambda r: r[1] + rng.random() * 40)
    batches = [dealt[i : i + 40] for i in range(0, 240, 40)] + [[("end", 10**6 + i, start + datetime.timedelta(days=2 + i), 1.0, 1.0)] for i in range(2)]
    src = tmp_path / "in"
    src.mkdir()
    for k, batch in enumerate(batches):
        pd.DataFrame(batch, columns=["series", "step", "ts", "mag", "phase"]).astype({"ts": "datetime64[us, UTC]"}).to_parquet(src / f"b{k}.parquet")
        os.utime(src / f"b{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = "series string, step long, ts timestamp, mag double, phase double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    spark.conf.set(STORE, ROCKS)
    try:
        judged = guard.ordered_guard_stream(stream, "10 minutes", 5, 3.0, 3.0, 2)
        query = judged.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    finally:
        spark.conf.unset(STORE)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("series != 'end'").collect())
    table = spark.createDataFrame([(s, k, m, p) for s, k, _, m, p in rows], "series string, step long, mag double, phase double")
    want = sorted(tuple(r) for r in metrics.guarded(table, 5, 3.0, 3.0, 2).select("series", "step", "reasons", "bad_steps", "triggered").collect())
    assert got == want and any(w[4] for w in want)
