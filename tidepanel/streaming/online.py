"""Fitted models applied to rows as they arrive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidepanel.operators import mixture as M
from tidepanel.operators.hmm import TINY, HiddenMarkov


def score_stream(rows: DataFrame, models: Sequence[M.Mixture], time: str, keys: Sequence[str], delay: str = "2 days") -> DataFrame:
    """Regime probabilities of new rows ``(idx, x, …)``; a row sent twice within the delay is scored once."""
    unique = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return M.score(unique, models, keep=[*keys, time])


DAY_MS = 86_400_000


class FilterProcessor(StatefulProcessor):
    """Waits for the watermark before a day enters the filter, so that days enter in order however they arrive."""

    def __init__(self, model: HiddenMarkov, key: str, date: str, x: str, expire_days: int):
        self.model, self.key, self.date, self.x, self.expire_days = model, key, date, x, expire_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, p array<double>, late long")
        self.waiting = handle.getMapState("waiting", "day long", "x array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, p, late = self.state.get() if self.state.exists() else (None, None, 0)
        past = timerValues.getCurrentWatermarkInMs() // DAY_MS  # days before this one are closed
        for batch in rows:
            days = (pd.to_datetime(batch[self.date]) - pd.Timestamp("1970-01-01")).dt.days
            for day, vector in zip(days.tolist(), batch[self.x]):
                if day < past or (last is not None and day <= last):
                    late += 1
                else:
                    self.waiting.updateValue((day,), ([float(v) for v in vector],))
                    self.handle.registerTimer((day + 1) * DAY_MS)
        self.state.update((last, p, late))
        return iter(())  # rows leave when their timers expire

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, p, late = self.state.get() if self.state.exists() else (None, None, 0)
        past = timerValues.getCurrentWatermarkInMs() // DAY_MS
        ready = sorted(k[0] for k, _ in self.waiting.iterator() if k[0] < past)
        days, probs = [], []
        for day in ready:
            if last is not None and day - last > self.expire_days:
                p, late = None, 0  # anew, whether or not the state was still there
            vector = np.array(self.waiting.getValue((day,))[0], float)
            prior = np.log(self.model.start + TINY) if p is None else np.log(np.asarray(p) @ self.model.transition + TINY)
            log = prior + self.model.emissions(vector)
            p = [float(v) for v in np.exp(log - M.log_sum(log[None], 1)[0])]
            last = day
            days.append(day)
            probs.append(p)
            self.waiting.removeKey((day,))
        if last is not None and last + self.expire_days < past and next(iter(self.waiting.iterator()), None) is None:
            self.state.clear()
        else:
            self.state.update((last, p, late))
            if ready:
                self.handle.registerTimer((last + self.expire_days + 1) * DAY_MS)
        if days:
            yield self._rows(key, days, probs, late)

    def _rows(self, key: tuple, days: list[int], probs: list[list[float]], late: int) -> pd.DataFrame:
        dates = [(pd.Timestamp("1970-01-01") + pd.Timedelta(days=d)).date() for d in days]
        return pd.DataFrame({self.key: [key[0]] * len(days), self.date: dates, "p": probs, "late": np.full(len(days), late, np.int64)})

    def close(self) -> None:
        pass


def filter_stream(rows: DataFrame, model: HiddenMarkov, key: str = "entity", date: str = "date", x: str = "x", delay: str = "3 days", expire_days: int = 400) -> DataFrame:
    """State probabilities given all rows so far, per entity: ``(key, date, p, late)``.

    Rows may arrive in any order within ``delay``: a day waits in the state until the watermark has
    passed it, then days are released in order. A row behind the watermark does not
    enter the filter; ``late`` counts such rows of the entity up to the release. The last row sent for a day
    counts. An entity starts anew after more than ``expire_days`` days without a row; its state goes when the watermark has passed them.
    The session needs the RocksDB state store, which ``session.build_session`` sets.
    """
    kind = rows.schema[key].dataType.simpleString()
    # the plain date goes on without the watermark's mark, so late rows reach the operator and are counted there
    marked = rows.withColumn("_time", F.col(date).cast("timestamp")).withWatermark("_time", delay).select(key, F.date_add(date, 0).alias(date), x)
    processor = FilterProcessor(model, key, date, x, expire_days)
    return marked.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {date} date, p array<double>, late long", "append", "eventTime")
