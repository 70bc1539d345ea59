"""Reports of players over streams (M6, M7 of the blueprint): what decode_stats and drop_intermediate say of a table, said of events as they come.

State is kept for each player and is a handful of numbers. Events of one player are
put in order within a trigger; they must come in order from one trigger to the next,
as files of a log do. A restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPORT = "player_id long, seconds double, frames long, mean_ms double, max_ms double, dropped long"
SERVED = "player_id long, service double, served long, dropped long"


def decode_stats(decodes: DataFrame, interval: float = 1.0) -> DataFrame:
    """A stream of reports (player_id, seconds, frames, mean_ms, max_ms, dropped) of a stream of decodes (player_id, seconds, ms, dropped), each once interval seconds have passed since the player's last. The first decode is a report itself."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, total, top, lost = state.get if state.exists else (float("-inf"), 0, 0.0, 0.0, 0)
        out = []
        new = pd.concat(list(frames)).sort_values("seconds", kind="stable")
        for at, ms, drop in zip(new["seconds"].tolist(), new.ms.tolist(), new.dropped.tolist()):
            n, total, top, lost = n + 1, total + ms, max(top, ms), lost + drop
            if at - last >= interval:
                out.append((key[0], at, n, total / n, top, lost))
                last, n, total, top, lost = at, 0, 0.0, 0.0, 0
        state.update((last, n, total, top, lost))
        yield pd.DataFrame(out, columns=["player_id", "seconds", "frames", "mean_ms", "max_ms", "dropped"])

    rows = decodes.select(*[F.col(c).cast(t).alias(c) for c, t in (("player_id", "long"), ("seconds", "double"), ("ms", "double"), ("dropped", "long"))])
    return rows.groupBy("player_id").applyInPandasWithState(step, REPORT, "last double, n long, total double, top double, lost long", "append", GroupStateTimeout.NoTimeout)


def drop_intermediate(events: DataFrame) -> DataFrame:
    """A stream of what each service finds (player_id, service, served, dropped) of a stream of events (player_id, seconds, frame): a request for a frame, or a service where frame is null.

    A service takes the last request since the one before, at its own time included,
    and drops the others; without any it says nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, frame = state.get if state.exists else (0, -1)
        out = []
        new = pd.concat(list(frames)).assign(service=lambda d: d.frame.isna()).sort_values(["seconds", "service"], kind="stable")
        for at, asked, service in zip(new["seconds"].tolist(), new.frame.tolist(), new.service.tolist()):
            if not service:
                waiting, frame = waiting + 1, int(asked)
            elif waiting:
                out.append((key[0], at, frame, waiting - 1))
                waiting = 0
        state.update((waiting, frame))
        yield pd.DataFrame(out, columns=["player_id", "service", "served", "dropped"])

    rows = events.select(*[F.col(c).cast(t).alias(c) for c, t in (("player_id", "long"), ("seconds", "double"), ("frame", "long"))])
    return rows.groupBy("player_id").applyInPandasWithState(step, SERVED, "waiting long, frame long", "append", GroupStateTimeout.NoTimeout)
