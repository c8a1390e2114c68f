"""Page captures as a stream: new, same, changed and removed events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import change_signature

STATE = "signature string, first_seen timestamp, last_seen timestamp, removed boolean"


def page_events(
    captures: DataFrame, keys: list[str], ts: str, content: str, status_code: str, row_id: str,
    forget_after: str | None = None, lateness: str = "1 hour",
) -> DataFrame:
    """One event per capture, compared with the page's previous capture.

    State per page is a hash and two times.  With ``forget_after`` a page that
    is not captured for that long gives one ``removed`` event and its state is
    dropped, which bounds the state; without it state grows with the pages.
    Only ids, times and hashes go to Python; a key's rows of one micro-batch
    are ordered there, so the batch size bounds the work per key.
    """
    types = dict(captures.dtypes)
    idle = pd.Timedelta(forget_after) if forget_after else None
    slim = captures.select(
        *keys, F.col(ts).cast("timestamp").alias("_ts"), F.col(row_id).alias("_id"),
        change_signature(F.coalesce(content, F.lit(""))).alias("_sig"), F.coalesce(status_code, F.lit(200)).alias("_code"),
    ).withWatermark("_ts", lateness)
    out = ", ".join([f"`{k}` {types[k]}" for k in keys]) + f", {row_id} {types[row_id]}, status string, first_seen timestamp, seen_at timestamp"
    names = [*keys, row_id, "status", "first_seen", "seen_at"]

    def in_order(row):
        # Missing values last.
        at, rid = row[:2]
        return (at is pd.NaT, 0 if at is pd.NaT else at.value, pd.isna(rid), 0 if pd.isna(rid) else rid)

    def step(key, batches, state: GroupState):
        rows = []
        signature, first, last, removed = state.get if state.exists else (None, None, None, False)
        if state.hasTimedOut:
            rows.append((*key, None, "removed", first, last))
            state.remove()
            yield pd.DataFrame(rows, columns=names)
            return
        # Plain rows: most pages have a few, for which another data frame costs more than the work.
        captured = [row for part in batches for row in zip(part["_ts"], part["_id"], part["_sig"], part["_code"])]
        for at, rid, sig, code in sorted(captured, key=in_order):
            first = first if first is not None else at
            if code == 404:
                status = "removed"
            elif signature is None:
                status = "new"
            else:
                status = "same" if sig == signature else "changed"
            signature, last, removed = sig, at, code == 404
            rows.append((*key, rid, status, first, at))
        state.update((signature, pd.Timestamp(first).to_pydatetime(), pd.Timestamp(last).to_pydatetime(), bool(removed)))
        if idle is not None:
            due = int((pd.Timestamp(last) + idle).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names)

    timeout = GroupStateTimeout.EventTimeTimeout if idle is not None else GroupStateTimeout.NoTimeout
    return slim.groupBy(*keys).applyInPandasWithState(step, out, STATE, "append", timeout)
