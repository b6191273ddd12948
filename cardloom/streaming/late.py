"""Day counts with late rows counted apart, by a watermark that each key keeps for itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fields as f

#: The state store that keyed state operators need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class DayCounts(StatefulProcessor):
    """Counts of each day until it is final, and of rows that come for a day that is.

    State of a key: the latest day before the present arrival, the present arrival and its latest day; and the counts
    of the days that are open. A day is final once a day of an earlier arrival is more than ``grace`` days after it.
    What a row counts as depends on the arrivals before its own alone, not on how they are cut into micro-batches.
    """

    def __init__(self, grace: int):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "before int, arrival long, latest int")
        self.open = handle.getMapState("open", "day int", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts: dict[tuple[int, int], int] = {}
        for part in rows:
            for at, n in part.groupby(["arrival", "day"]).size().items():
                counts[at] = counts.get(at, 0) + int(n)
        held = self.mark.get()
        before, arrival, latest = held if held is not None else (None, None, None)
        open_days = {int(d[0]): int(n[0]) for d, n in self.open.iterator()}
        known = dict(open_days)
        late: dict[int, int] = {}
        for (now, day), n in sorted(counts.items()):
            if arrival is None or now > arrival:
                before = latest if before is None else before if latest is None else max(before, latest)
                arrival, latest = int(now), None
            if before is not None and day < before - self.grace:
                late[day] = late.get(day, 0) + n
            else:
                open_days[day] = open_days.get(day, 0) + n
                latest = int(day) if latest is None else max(latest, int(day))
        done = {d: n for d, n in open_days.items() if before is not None and d < before - self.grace}
        for d, n in open_days.items():
            if d not in done and known.get(d) != n:
                self.open.updateValue((d,), (n,))
        for d in done:
            if d in known:
                self.open.removeKey((d,))
        if arrival is not None:
            self.mark.update((before, arrival, latest))
        made = [(d, n, False) for d, n in sorted(done.items())] + [(d, n, True) for d, n in sorted(late.items())]
        if made:
            yield pd.DataFrame({**{f"k{k}": [v] * len(made) for k, v in enumerate(key)}, "day": [d for d, _, _ in made], "n": [n for _, n, _ in made], "late": [x for _, _, x in made]})

    def close(self) -> None:
        pass


def day_counts_and_late(stream: DataFrame, by: list[str], grace: int = 2, hours: int = 8) -> DataFrame:
    """(by, day, n, late): the rows of each local day once it is final (late false), and the rows that came for a day
    that was final already, for each micro-batch (late true). Nothing is lost: what isn't out yet belongs to days still open.

    stream: by, published_at, arrival (a number that grows: the hour or file in which rows came; arrivals come in order,
    and one of them may be cut over micro-batches). A day is final for rows of an arrival once a row of its key from an earlier one
    is more than ``grace`` days after it. Rows without a time are left out. Needs the state store of ``PROVIDER``.
    """
    day = F.unix_date(f.local_day(F.col("published_at"), hours))
    rows = stream.where("published_at IS NOT NULL").select(*by, day.alias("day"), F.col("arrival").cast("long").alias("arrival"))
    kinds = [rows.schema[c].dataType.simpleString() for c in by]
    schema = ", ".join([*(f"k{k} {kind}" for k, kind in enumerate(kinds)), "day int", "n long", "late boolean"])
    out = rows.groupBy(*by).transformWithStateInPandas(DayCounts(grace), schema, "Append", "None")
    return out.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(by)], F.date_from_unix_date("day").alias("day"), "n", "late")
