"""State of one's own for each key of a stream, kept by Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .windows import timed


def visits(stream: DataFrame, key: str, time: str, value: str, gap: str, late: str) -> DataFrame:
    """(key, n, total, closed): each key's visit, a run of rows that ends when the watermark is `gap` past its last row; after each batch
    that touches it an open visit is reported as it stands, and once more, closed, when it ends.

    The state of a key is three numbers, however long the visit; rows of a key come in Arrow batches and are only summed.
    """
    rows = timed(stream, time, late).select(key, time, value)
    wait = int(pd.Timedelta(gap).total_seconds() * 1000)

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [own[0]], "n": [n], "total": [total], "closed": [True]})
            return
        for part in batches:
            n += len(part)
            total += float(part[value].sum())
            last = max(last, int(part[time].max().timestamp() * 1000))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [own[0]], "n": [n], "total": [total], "closed": [False]})

    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, n long, total double, closed boolean", "n long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout
    )
