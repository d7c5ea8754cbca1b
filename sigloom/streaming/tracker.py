"""Offsets between two signals as their blocks arrive: the streaming twin of :func:`blocks.track_offsets`."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sigloom.operators.blocks import Tracker

WINDOWS = "sig long, w long, lag long, score double"


class OffsetProcessor(StatefulProcessor):
    """One tracker a signal, kept as a value; blocks that arrive before their turn wait in a map.

    A signal ends with the block marked last, or when nothing has come for ``idle_ms``: then the windows that still waited for samples
    are tracked and the state is dropped, so lost signals don't stay. Without idle_ms there are no timers.
    """

    def __init__(self, window: int, hop: int, search: int, idle_ms: int | None):
        self.sizes, self.idle_ms = (window, hop, search), idle_ms

    def init(self, handle):
        self.handle = handle
        self.tracker = handle.getValueState("tracker", "next long, data string")
        self.early = handle.getMapState("early", "block long", "a array<double>, b array<double>, last boolean")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        following, tracker = 0, None
        if self.tracker.exists():
            following, data = self.tracker.get()
            tracker = Tracker.resumed(json.loads(data))
        for part in rows:
            for r in part.itertuples():
                if tracker is None:
                    tracker = Tracker(*self.sizes, int(r.overall))
                if r.block >= following:  # a block that is delivered again has been tracked
                    self.early.updateValue((int(r.block),), ([float(v) for v in r.a], [0.0 if v is None or v != v else float(v) for v in r.b], bool(r.last)))
        found, ended = [], False
        while not ended and self.early.containsKey((following,)):
            a, b, ended = self.early.getValue((following,))
            self.early.removeKey((following,))
            found += [(int(key[0]), *w) for w in tracker.feed(np.asarray(a, float), np.asarray(b, float), ended)]
            following += 1
        for timer in list(self.handle.listTimers()) if self.idle_ms else ():
            self.handle.deleteTimer(timer)
        if ended:
            self.tracker.clear()
            self.early.clear()
        else:
            self.tracker.update((following, json.dumps(tracker.state())))
            if self.idle_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(found, columns=["sig", "w", "lag", "score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        found = []
        if self.tracker.exists():
            tracker = Tracker.resumed(json.loads(self.tracker.get()[1]))
            found = [(int(key[0]), *w) for w in tracker.feed(np.zeros(0), np.zeros(0), True)]
        self.tracker.clear()
        self.early.clear()
        yield pd.DataFrame(found, columns=["sig", "w", "lag", "score"])

    def close(self):
        pass


def track_offsets(blocks: DataFrame, window: int, hop: int, search: int, idle_ms: int | None = 60_000) -> DataFrame:
    """(sig, w, lag, score) of a stream of blocks (sig, block, a, b, last), numbered from 0; ``overall`` may be a column, as in the batch form.

    Blocks may come in any order and more than once. Every window comes out once, as soon as the samples that it needs are there.
    With timers a query goes on until it is stopped, whatever its trigger. The session needs the RocksDB state store. After a restart from the checkpoint the tracking goes on where it was.
    """
    rows = blocks.withColumn("overall", F.lit(0) if "overall" not in blocks.columns else F.coalesce("overall", F.lit(0))).select("sig", "block", "a", "b", F.coalesce("last", F.lit(False)).alias("last"), "overall")
    return rows.groupBy("sig").transformWithStateInPandas(OffsetProcessor(window, hop, search, idle_ms), WINDOWS, "Append", "ProcessingTime" if idle_ms else "None")
