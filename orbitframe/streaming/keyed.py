"""Keyed state in streams: a trailing-quartile detector that takes late events, and a watch over batches of jobs.

Both keep bounded state: the detector the values of a key and slot that a later event can still need, the watch the
last status of each job of an open batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbitframe.config import TrailingConfig

DAY_US = 86_400_000_000
FINISHED = ("SUCCEEDED", "FAILED")
BOUNDS = "key string, slot int, ts timestamp, v double, n_prior long, lower double, upper double, exceeds boolean"


def bounds_of(us: np.ndarray, v: np.ndarray, todo: np.ndarray, config: TrailingConfig) -> pd.DataFrame:
    """For each position of ``todo`` in values sorted by time: how many lie in the days before it, and the bounds that follow."""
    begin, end = np.searchsorted(us, us[todo] - config.days * DAY_US), np.searchsorted(us, us[todo])
    q = np.full((len(todo), 3), np.nan)
    for k, (a, b) in enumerate(zip(begin, end, strict=True)):  # at most what the buffer of one key and slot holds
        if b > a:
            q[k] = np.percentile(v[a:b], (25, 50, 75))
    lower, upper = q[:, 1] - config.factor * (q[:, 1] - q[:, 0]), q[:, 1] + config.factor * (q[:, 2] - q[:, 1])
    x = v[todo]
    out = (x < lower) | (x > upper) if config.strict else (x <= lower) | (x >= upper)
    return pd.DataFrame({"us": us[todo], "v": x, "n_prior": end - begin, "lower": lower, "upper": upper, "exceeds": pd.array(np.where(end > begin, out, None), "boolean")})


def trailing_exceedances(stream: DataFrame, key: str, ts: str, v: str, late: str = "2 days", slot_hours: int = 2, config: TrailingConfig = TrailingConfig()) -> DataFrame:
    """The trailing-quartile detector on a stream, per key and slot of the day, each event judged once and finally.

    An event waits until the watermark has passed it, since an earlier one may still arrive; then it is judged against the
    ``config.days`` before it. What is older than that before the watermark is dropped, and a timer judges what waits when
    a key falls silent. Events later than ``late`` are dropped by the watermark. Missing values are left out.
    """
    timed = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(v).cast("double").alias("v")).filter("v IS NOT NULL").withWatermark("ts", late)
    slotted = timed.withColumn("slot", F.floor(F.hour("ts") / slot_hours).cast("int"))

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, values, judged = (list(x) for x in state.get) if state.exists else ([], [], [-(1 << 62)])
        for frame in frames:
            us += (pd.to_datetime(frame["ts"]).astype("datetime64[us]").astype("int64")).tolist()
            values += frame["v"].tolist()
        order = np.lexsort((values, us))
        at, x = np.array(us, np.int64)[order], np.array(values)[order]
        mark = state.getCurrentWatermarkMs() * 1000
        todo = np.flatnonzero((at > judged[0]) & (at <= mark))
        if len(todo):
            found = bounds_of(at, x, todo, config)
            moment = pd.to_datetime(found.pop("us"), unit="us")
            yield found.assign(key=group[0], slot=group[1], ts=moment)[["key", "slot", "ts", "v", "n_prior", "lower", "upper", "exceeds"]]
        keep = at > mark - config.days * DAY_US
        waiting = at[at > mark]
        if keep.any():
            state.update((at[keep].tolist(), x[keep].tolist(), [max(judged[0], mark)]))
            # Next when the first waiting event is passed, else when the last value can't be needed any more.
            due = waiting[0] if len(waiting) else at[-1] + config.days * DAY_US
            state.setTimeoutTimestamp(max(int(due // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return slotted.groupBy("key", "slot").applyInPandasWithState(run, BOUNDS, "us array<long>, v array<double>, judged array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def finished_batches(stream: DataFrame) -> DataFrame:
    """stream(batch, job_id, status, seq, jobs) -> (batch, jobs, succeeded, failed), once, when all ``jobs`` jobs of a batch have finished.

    ``seq`` orders a job's statuses, whatever order they arrive in; repeated ones change nothing. A batch that was given out stays
    so, marked by a state without jobs.
    """

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, seqs, statuses, done = (list(x) for x in state.get) if state.exists else ([], [], [], [False])
        known, total = {j: (q, s) for j, q, s in zip(ids, seqs, statuses, strict=True)}, 0
        for frame in frames:
            total = max(total, int(frame["jobs"].max()))
            for job, seq, status in zip(frame["job_id"], frame["seq"], frame["status"], strict=True):
                if job not in known or seq > known[job][0]:
                    known[job] = (int(seq), status)
        if done[0]:
            return
        over = [s for _, s in known.values() if s in FINISHED]
        if total and len(over) >= total:
            state.update(([], [], [], [True]))
            yield pd.DataFrame({"batch": [group[0]], "jobs": [len(over)], "succeeded": [over.count("SUCCEEDED")], "failed": [over.count("FAILED")]})
        else:
            state.update((list(known), [q for q, _ in known.values()], [s for _, s in known.values()], [False]))

    shape = "job_id array<string>, seq array<long>, status array<string>, done array<boolean>"
    return stream.groupBy("batch").applyInPandasWithState(run, "batch string, jobs long, succeeded long, failed long", shape, "append", GroupStateTimeout.NoTimeout)
