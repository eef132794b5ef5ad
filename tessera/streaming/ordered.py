"""Folds over steps that arrive late and in any order: the result is that of the right order.

A key's rows are kept in parts by step, of a bounded number of rows, and what each part folds to beside them, in a list that is read alone; a row that comes
late changes its own part, and parts combine.  So a micro-batch reads and writes the parts that its rows belong to, not all that came before.
With `hold` or `idle` a part is a stretch of steps.  Stretches that are `hold` behind the newest one are closed: their rows go, what they fold to stays.
A timer closes all of a key that was silent for long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

#: Steps of a stretch; rows of a part beyond which it is halved.
STRETCH, PART_ROWS = 4096, 8192
_FIRST = np.iinfo(np.int64).min
_ROW = np.dtype([("step", "<i8"), ("value", "<f8")])
_PART = np.dtype([("start", "<i8"), ("n", "<i8"), ("fold", "<f8"), ("open", "?")])


def _sorted(old: bytes, steps: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The rows that were there and new ones, by step and value."""
    rows = np.empty(len(steps), _ROW)
    rows["step"], rows["value"] = steps, values
    rows = np.concatenate([np.frombuffer(old, _ROW), rows])
    return rows[np.lexsort((rows["value"], rows["step"]))]


class _Parts(StatefulProcessor):
    """Reads rows by frames, leaves out those of closed stretches and counts them; `take` keeps the others."""

    def __init__(self, order: str, value: str, key: str, hold: int | None, idle: float | None):
        self.order, self.value, self.key, self.hold, self.idle = order, value, key, hold, idle
        self.closes = hold is not None or idle is not None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "start long", "data binary")
        self.list = handle.getValueState("list", "version long, late long, parts binary, told binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        version, late, parts, before = self.list.get() if self.list.exists() else (0, 0, b"", b"")
        parts, told = np.frombuffer(parts, _PART).copy(), bytes(before)
        for frame in rows:
            frame = frame[frame[self.value].notna() & frame[self.order].notna()]
            steps, values = frame[self.order].to_numpy(np.int64), frame[self.value].to_numpy(float)
            if self.closes:
                gone = np.isin(steps // STRETCH * STRETCH, parts["start"][~parts["open"]])
                late += int(gone.sum())
                steps, values = steps[~gone], values[~gone]
            if len(steps):
                parts, told = self.take(parts, told, steps, values)
        if self.hold is not None:
            parts = self._close(parts, len(parts) - max(1, self.hold))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle))
        self.list.update((version + 1, late, parts.tobytes(), told))
        yield self.told(key, parts, bytes(before), told, version + 1, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        version, late, parts, told = self.list.get()
        parts = np.frombuffer(parts, _PART).copy()
        self.list.update((version, late, self._close(parts, len(parts)).tobytes(), told))
        return iter(())

    def _close(self, parts: np.ndarray, first: int) -> np.ndarray:
        """The list with its first parts closed."""
        for start in parts["start"][: max(0, first)][parts["open"][: max(0, first)]].tolist():
            if self.rows.containsKey((start,)):
                self.rows.removeKey((start,))
        parts["open"][: max(0, first)] = False
        return parts

    def close(self) -> None:
        pass


class _Average(_Parts):
    def __init__(self, keep: float, *rest):
        super().__init__(*rest)
        self.keep = keep

    def take(self, parts, told, steps, values):
        by = {int(p["start"]): (int(p["n"]), float(p["fold"]), bool(p["open"])) for p in parts}
        if self.closes:
            at = steps // STRETCH * STRETCH
        else:  # the first part has all that is before the second
            starts = parts["start"] if len(parts) else np.array([_FIRST])
            at = starts[np.maximum(0, np.searchsorted(starts, steps, "right") - 1)]
        order = np.argsort(at, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            start = int(at[own[0]])
            rows = _sorted(self.rows.getValue((start,))[0] if start in by else b"", steps[own], values[own])
            for s, piece in self.cut(start, rows):
                self.rows.updateValue((s,), (piece.tobytes(),))
                by[s] = (len(piece), self.fold(piece["value"]), True)
        made = np.empty(len(by), _PART)
        for i, s in enumerate(sorted(by)):
            made[i] = (s, *by[s])
        return made, told

    def cut(self, start, rows):
        """A part's rows, in halves of at most PART_ROWS if there are more; rows of one step stay together."""
        if self.closes or len(rows) <= PART_ROWS:
            return [(start, rows)]
        pieces, a = [], 0
        while a < len(rows):
            e = a + PART_ROWS // 2
            e = len(rows) if len(rows) - e < PART_ROWS // 4 else int(np.searchsorted(rows["step"], rows["step"][e], "left"))
            if e <= a:  # one step has them all
                e = int(np.searchsorted(rows["step"], rows["step"][a], "right"))
            pieces.append((int(rows["step"][a]) if a else start, rows[a:e]))
            a = e
        return pieces

    def fold(self, values: np.ndarray) -> float:
        fold = 0.0
        for a in range(0, len(values), 4096):
            part = values[a : a + 4096]
            fold = fold * self.keep ** len(part) + (1 - self.keep) * float(part @ self.keep ** np.arange(len(part) - 1, -1, -1.0))
        return fold

    def told(self, key, parts, before, told, version, late):
        ema = 0.0
        for n, fold in zip(parts["n"].tolist(), parts["fold"].tolist(), strict=True):
            ema = ema * self.keep**n + fold
        return pd.DataFrame({self.key: [key[0]], "n": [int(parts["n"].sum())], "ema": [ema], "version": [version], "late": [late]})


class _Best(_Parts):
    """A row that isn't below all before it never will be, so only those that are have to be kept; stretches are listed only where they are closed."""

    def __init__(self, changes: bool, *rest):
        super().__init__(*rest)
        self.changes = changes

    def take(self, parts, told, steps, values):
        rows = _sorted(told, steps, values)
        best = rows[rows["value"] < np.minimum.accumulate(np.concatenate([[np.inf], rows["value"]]))[:-1]]
        if self.closes:
            new = np.setdiff1d(steps // STRETCH * STRETCH, parts["start"])
            more = np.zeros(len(new), _PART)
            more["start"], more["open"] = new, True
            parts = np.sort(np.concatenate([parts, more]), order="start")
        return parts, best.tobytes()

    def told(self, key, parts, before, told, version, late):
        old, now = (np.frombuffer(x, _ROW).tolist() for x in (before, told))
        was, still = set(old), set(now)
        rows = [(*x, True) for x in now if x not in was] + [(*x, False) for x in old if x not in still]
        if not self.changes:
            rows = [x for x in rows if x[2]]
        out = pd.DataFrame({self.key: [key[0]] * len(rows), self.order: [x[0] for x in rows], self.value: [x[1] for x in rows]}).astype({self.order: "int64", self.value: "float64"})
        return out.assign(best=np.array([x[2] for x in rows], bool), version=version) if self.changes else out


def _run(stream: DataFrame, processor: _Parts, key: str, output: str) -> DataFrame:
    ship(stream.sparkSession)
    columns = [F.col(c) for c in (key, processor.order, processor.value)]
    return stream.select(*columns).groupBy(key).transformWithStateInPandas(processor, output, "Append", "ProcessingTime" if processor.idle is not None else "None")


def running_average(stream: DataFrame, key: str, order: str, value: str, keep: float = 0.9, hold: int | None = None, idle: float | None = None) -> DataFrame:
    """key, n, ema, version and late after each micro-batch: value * keep + new * (1 - keep) from 0, in order of the step over all that came.

    The last version of a key is right whatever order its rows came in; late counts rows of closed stretches, which can't be placed any more.
    Rows without a step or value are left out.  hold: how many stretches of STRETCH steps stay open (None: all); idle: seconds after which a silent key's are closed.
    """
    return _run(stream, _Average(keep, order, value, key, hold, idle), key, f"{key} {stream.schema[key].dataType.simpleString()}, n long, ema double, version long, late long")


def best_so_far(stream: DataFrame, key: str, order: str, value: str, changes: bool = False, hold: int | None = None, idle: float | None = None) -> DataFrame:
    """key, order, value of the rows whose value is below all before it of its key.

    With changes, also best and version: a row that came late may undo what was told before it (best is false then); `settled` gives what holds.
    Without, rows are told as they come.  Only rows that are best so far are kept as state.
    """
    output = f"{key} {stream.schema[key].dataType.simpleString()}, {order} long, {value} double" + (", best boolean, version long" if changes else "")
    return _run(stream, _Best(changes, order, value, key, hold, idle), key, output)


def settled(told: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """What holds of best_so_far's changes: each row's last word."""
    return told.groupBy(key, order, value).agg(F.max_by("best", "version").alias("best")).where("best").drop("best")
