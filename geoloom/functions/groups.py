"""Groups of rows that come one after another through Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of sorted batches that hold whole groups only: the last group of each waits, as it may go on in the next."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        ends = tuple(pdf[k].iat[-1] for k in keys)
        if ends == last:
            held.append(pdf)
            continue
        going_on = (pdf[keys] == list(ends)).all(axis=1).to_numpy()
        held.append(pdf[~going_on])
        done = pd.concat(held, ignore_index=True)
        if len(done):
            yield done
        held, last = [pdf[going_on]], ends
    if held:
        yield pd.concat(held, ignore_index=True)
