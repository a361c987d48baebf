"""An extension: the review log as a stream. Repeated events within the watermark are dropped, and each item keeps its
latest status as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_status(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """events (id, seq, status, at timestamp) as updates (id, status, seq); approvals count only while pending."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, seq = state.get if state.exists else ("", -1)
        rows = sorted((int(r.seq), r.status) for f in frames for r in f.itertuples())
        for n, new in rows:
            if n > seq:
                seq = n
                status = status if new == "approved" and status not in ("", "pending") else new
        state.update((status, seq))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "seq": [seq]})

    unique = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id", "seq"])
    return unique.groupBy("id").applyInPandasWithState(step, "id string, status string, seq bigint", "status string, seq bigint", "update", GroupStateTimeout.NoTimeout)
