"""Active dimension of a chat session as streaming state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from policyloom.operators.conversations import named_dimension

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionDimensions(StatefulProcessor):
    """Keeps the turns that named a dimension, one entry of the map for each run of turns with one dimension.

    An entry's key is the run's first turn.  The runs are enough to place any late message, and a late turn that names
    another dimension cuts the run it falls into.
    """

    def __init__(self, session: str, turn: str, idle_ms: int | None, ttl_ms: int | None):
        self.session, self.turn, self.idle_ms, self.ttl_ms = session, turn, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "first long", "dimension string, turns array<long>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        named: dict[int, str] = {}
        kept = {}
        for (first,), (dimension, turns) in self.runs.iterator():
            kept[int(first)] = (dimension, [int(t) for t in turns])
            named |= dict.fromkeys(kept[int(first)][1], dimension)
        # a session's rows of one micro-batch are looked at together
        batch = pd.concat(list(rows)).sort_values(self.turn)
        for place, name in zip(batch[self.turn], batch["named_dimension"], strict=True):
            if isinstance(name, str):
                named[int(place)] = name
        places = sorted(named)
        at = [bisect_left(places, int(place)) for place in batch[self.turn]]
        before = [named[places[i - 1]] if i else None for i in at]

        runs: dict[int, tuple[str, list[int]]] = {}
        last = None
        for place in places:
            if last is not None and runs[last][0] == named[place]:
                runs[last][1].append(place)
            else:
                last, runs[place] = place, (named[place], [place])
        for first in kept.keys() - runs.keys():
            self.runs.removeKey((first,))
        for first, run in runs.items():
            if kept.get(first) != run:
                self.runs.updateValue((first,), run)
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield batch.assign(active_dimension=before)[[self.session, self.turn, "named_dimension", "active_dimension"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A session that was idle for long is forgotten."""
        self.runs.clear()
        yield pd.DataFrame(columns=[self.session, self.turn, "named_dimension", "active_dimension"])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Map state needs the state store that keeps its keys in order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def active_dimensions(messages: DataFrame, session: str = "conv_id", turn: str = "turn", text: str = "text",
                      aliases: dict | None = None, idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Each message with the dimension active before it.

    A message that arrives late gets the dimension of its own place; what was emitted for later turns stays.  Of two
    rows of one turn the later one in the batch names the dimension.  State is bounded by time alone: sessions idle for
    ``idle_ms`` are forgotten by a timer, runs that did not change for ``ttl_ms`` expire.  With either, a run that
    should end by itself would wait for timers for ever.
    """
    named = messages.select(session, turn, named_dimension(F.col(text), aliases).alias("named_dimension"))
    out = StructType([named.schema[session], named.schema[turn]]).add("named_dimension", "string").add("active_dimension", "string")
    use_state_store(messages.sparkSession)
    return named.groupBy(session).transformWithStateInPandas(
        SessionDimensions(session, turn, idle_ms, ttl_ms), out, "Append", "ProcessingTime" if idle_ms or ttl_ms else "None"
    )
