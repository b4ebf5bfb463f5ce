"""Online per-user baselines on a session stream.

``transformWithState`` with typed state per user: one value (sessions so far
and the decayed sums of the window) and a ring of the last W feature vectors.
A session costs one step, however long the window is: the sums decay, take the
new vector in and lose the one that leaves the window.  A user's first session
starts from the global means and is not tested (L4); every later one updates
the baseline (L5) and is tested for drift against it (L6).  Global means and
stds are 2·features numbers.

The sessions of a user in one micro-batch are taken in time order.  State lives
in the RocksDB store and its checkpoint, so a restarted query goes on from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.operators.baseline import DECAY, DEFAULT_WINDOW, DRIFT_SHARE, DRIFT_Z

OUTPUT_SCHEMA = ("user_id string, session_id string, activity_count long, window_size int, "
                 "drift_detected boolean, drift_ratio double, baseline array<double>")
PROFILE_SCHEMA = "activity_count long, sums array<double>"
SLOT_SCHEMA, VECTOR_SCHEMA = "slot long", "values array<double>"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OnlineBaseline(StatefulProcessor):
    """State and update of one user's baseline."""

    def __init__(self, feats: list[str], means: list[float], stds: list[float], window: int, decay: float, ts_col: str):
        self.feats, self.ts_col, self.window, self.decay = feats, ts_col, window, decay
        self.means, self.stds = np.array(means, dtype=float), np.array(stds, dtype=float)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getValueState("profile", PROFILE_SCHEMA)
        self.ring = handle.getMapState("ring", SLOT_SCHEMA, VECTOR_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, sums = 0, np.zeros(len(self.feats))
        if self.profile.exists():
            count, sums = self.profile.get()
            sums = np.array(sums, dtype=float)
        pdf = pd.concat(list(rows)).sort_values([self.ts_col, "session_id"], kind="stable")
        out = []
        for sid, x in zip(pdf["session_id"], pdf[self.feats].astype(float).to_numpy()):
            filled = np.nan_to_num(x, nan=0.0)
            slot = (count % self.window,)
            sums = sums * self.decay + filled
            if count >= self.window:
                sums -= self.decay ** self.window * np.array(self.ring.getValue(slot)[0], dtype=float)
            self.ring.updateValue(slot, (filled.tolist(),))
            count += 1
            out.append((key[0], sid, *self._row(count, sums, x)))
        self.profile.update((count, sums.tolist()))
        yield pd.DataFrame(out, columns=["user_id", "session_id", "activity_count", "window_size", "drift_detected", "drift_ratio", "baseline"])

    def _row(self, count: int, sums: np.ndarray, x: np.ndarray) -> tuple:
        if count == 1:
            return 1, 1, False, None, self.means.tolist()
        size = min(count, self.window)
        base = sums / (self.decay ** np.arange(size)).sum()
        there = ~np.isnan(x)
        tested = there & (self.stds > 0)
        z = np.abs(x[tested] - base[tested]) / self.stds[tested]
        total = int(there.sum())
        ratio = float((z > DRIFT_Z).sum()) / total if total else None
        return count, size, bool(ratio is not None and ratio > DRIFT_SHARE), ratio, base.tolist()

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state needs the RocksDB state store: a setting of the session, read when a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def online_baselines(stream: DataFrame, feats: list[str], global_means: list[float], global_stds: list[float],
                     window: int = DEFAULT_WINDOW, decay: float = DECAY, ts_col: str = "session_start") -> DataFrame:
    """One row per session of ``stream``: the user's baseline after it and the drift test."""
    use_rocksdb(stream.sparkSession)
    cols = ["user_id", "session_id", ts_col, *feats]
    processor = OnlineBaseline(feats, global_means, global_stds, window, decay, ts_col)
    return (stream.select(*[f"`{c}`" for c in cols]).groupBy("user_id")
                  .transformWithStateInPandas(processor, OUTPUT_SCHEMA, "Append", "None"))
