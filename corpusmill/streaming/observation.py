"""Observation after a promotion as a stream: the machine of operators.observation with state and timers.

Each project has one open observation in the state: its baseline, its counts and its alerts. A timer in event time ends
it after DAYS even if no tick comes; then the state is dropped. A project's state has a fixed size, however many ticks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.observation import ALERTS, DAYS, DELTA, FROM_ZERO, GROWTH, HARDLY, KEY

OUT = "project long, observation long, started timestamp, n_snapshots long, alerts array<string>, status string"
_STATE = "observation long, started timestamp, base string, n long, alerts string, status string"


def snapshot_alerts(base: dict, now: dict) -> set[str]:
    """As operators.observation.alert_codes, for one snapshot."""
    moved = lambda c: base[c] > 0 and abs(round((now[c] - base[c]) / base[c], 4)) > DELTA
    ratio = now["ratio"] / base["ratio"] > GROWTH if base["ratio"] > HARDLY else now["ratio"] > FROM_ZERO
    lost = base["entities"] > 0 and any(n >= KEY * base["entities"] and not now["types"].get(t) for t, n in base["types"].items())
    return {a for a, holds in zip(ALERTS, (moved("entities"), moved("relations"), ratio, lost), strict=True) if holds}


def observed(log: DataFrame, late: str = "1 hour", days: int = DAYS) -> DataFrame:
    """A stream of OUT from a stream of operators.observation.LOG: a row whenever an observation changes, the last one counts.

    Rows that come later than `late` are dropped. In a batch rows are taken by at, then seq.
    """
    length = pd.Timedelta(days=days)

    def snapshot(r) -> dict:
        return {"entities": int(r.entities), "relations": int(r.relations), "ratio": float(r.ratio), "types": {k: int(v) for k, v in dict(r.types or {}).items()}}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        project, out = key[0], {}
        now = list(state.get) if state.exists else None

        def note() -> None:
            out[now[0]] = (project, now[0], now[1], now[3], sorted(x for x in now[4].split(",") if x), now[5])

        if state.hasTimedOut:
            if now[5] != "rolled_back":
                now[5] = "expired"
                note()
            state.remove()
        else:
            for r in pd.concat(frames).sort_values(["at", "seq"]).itertuples():
                over = now is not None and (now[5] in ("rolled_back", "expired") or r.at >= now[1] + length)
                if over and now[5] not in ("rolled_back", "expired"):
                    now[5] = "expired"
                    note()
                if r.kind == "start":
                    now = [int(r.seq), r.at, json.dumps(snapshot(r)), 0, "", "active"]
                    note()
                elif now is not None and r.kind == "rollback":
                    now[5] = "rolled_back"
                    note()
                elif now is not None and r.kind == "tick" and not over:
                    alerts = {x for x in now[4].split(",") if x} | snapshot_alerts(json.loads(now[2]), snapshot(r))
                    now[3:] = [now[3] + 1, ",".join(sorted(alerts)), "alert" if alerts else "active"]
                    note()
            if now is not None:
                state.update(tuple(now))
                ends = int((now[1] + length).timestamp() * 1000)
                state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(list(out.values()), columns=["project", "observation", "started", "n_snapshots", "alerts", "status"])

    rows = log.withWatermark("at", late)
    return rows.groupBy("project").applyInPandasWithState(step, OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
