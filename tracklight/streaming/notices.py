"""Structured Streaming forms of the notifier: due notices once each, and breaches at the deadline."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracklight.model import LEAD_DAYS


def due_notices(cases: DataFrame, terminal: tuple[str, ...], lead: int = LEAD_DAYS, late: str = "1 day") -> DataFrame:
    """id, due_d, kind, ts of a stream of case states (id, status, due_d, ts): each notice once within the watermark.

    A state's own time is its clock: overdue before its day, soon within `lead` days.
    """
    day = F.to_date("ts")
    kind = F.when(F.col("due_d") < day, "overdue").when(F.col("due_d") <= F.date_add(day, lead), "soon")
    rows = cases.withWatermark("ts", late).where(~F.col("status").isin(*terminal)).select("id", "due_d", kind.alias("kind"), "ts")
    return rows.where("kind is not null").dropDuplicatesWithinWatermark(["id", "due_d", "kind"])


BREACH = "id STRING, phase STRING, deadline TIMESTAMP"


def breach_notices(clocks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """id, phase, deadline of a stream of clock states (id, phase, deadline, done, ts): a notice when a deadline passes.

    A case's newest state holds. A timer stands at its deadline in event time; each phase of a case is told once.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, phase, deadline, done, told = state.get if state.exists else (-1, "", 0, False, "")
        for rows in batches:
            for row in rows.sort_values("at_ms").itertuples():
                if row.at_ms >= newest:
                    newest, phase, deadline, done = int(row.at_ms), row.phase, int(row.deadline_ms), bool(row.done)
        now = max(state.getCurrentWatermarkMs(), newest)
        known = told.split(",") if told else []
        if phase and not done and phase not in known and now > deadline:
            known.append(phase)
            yield pd.DataFrame({"id": [key[0]], "phase": [phase], "deadline": [pd.Timestamp(deadline, unit="ms")]})
        state.update((newest, phase, deadline, done, ",".join(known)))
        if phase and not done and phase not in known:
            state.setTimeoutTimestamp(max(deadline + 1, state.getCurrentWatermarkMs() + 1))

    rows = clocks.withWatermark("ts", late).select(
        "id", "phase", F.unix_millis("deadline").alias("deadline_ms"), "done", F.unix_millis("ts").alias("at_ms"), "ts"
    )
    return rows.groupBy("id").applyInPandasWithState(
        watch, BREACH, "newest LONG, phase STRING, deadline LONG, done BOOLEAN, told STRING", "append", GroupStateTimeout.EventTimeTimeout
    )
