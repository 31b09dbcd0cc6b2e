"""Keyed state of the streaming jobs: small values per key in the state store, each with an expiry.

A key may be hot, so rows never go to their key as they are. Map tasks first reduce their rows
to a few per key (`partial`), the keyed step merges those into its state and answers with one row
per key it met, and rows find that answer by a batch join in the sink. Texts stay outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

# The store that keeps state on disk and reads only the keys a batch meets.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 24 * 3600 * 1000


def partial(rows: DataFrame, keys: Sequence[str], merge: Callable[[pd.core.groupby.DataFrameGroupBy], pd.DataFrame]) -> DataFrame:
    """`rows` reduced per map task and Arrow batch to the rows of `merge`, which must keep the columns."""
    keys = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield merge(frame.groupby(keys, sort=False, dropna=False)).reset_index()[list(frame.columns)]

    return rows.mapInPandas(run, rows.schema)


def keyed(rows: DataFrame, keys: Sequence[str], processor: StatefulProcessor, out: str, time: str = "ProcessingTime", plain: bool = False) -> DataFrame:
    """The answers of `processor`, one state per key; a `plain` one takes and gives rows, others frames."""
    rows.sparkSession.conf.set(*PROVIDER)
    grouped = rows.groupBy(*keys)
    return (grouped.transformWithState if plain else grouped.transformWithStateInPandas)(processor, out, "Update", time)


class Totals(StatefulProcessor):
    """Running sums per key; answers with the new sums of every key met."""

    def __init__(self, key: str, columns: Sequence[str], ttl_ms: int):
        self.key, self.columns, self.ttl_ms = key, list(columns), ttl_ms

    def init(self, handle) -> None:
        self.sums = handle.getValueState("sums", ", ".join(f"{c} bigint" for c in self.columns), self.ttl_ms)

    def merged(self, rows) -> list[int]:
        total = list(self.sums.get() or [0] * len(self.columns))
        for frame in rows:
            total = [t + int(frame[c].sum()) for t, c in zip(total, self.columns)]
        return total

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = self.merged(rows)
        self.sums.update(tuple(total))
        yield pd.DataFrame([(*key, *total)], columns=[self.key, *self.columns])

    def close(self) -> None:
        pass


class Completion(Totals):
    """Running sums that are given out, and forgotten, when the first of them reaches `expected`."""

    def __init__(self, key: str, columns: Sequence[str], ttl_ms: int):
        super().__init__(key, columns, ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        total, expected = self.merged(frames), max(int(f["expected"].max()) for f in frames)
        if total[0] < expected:
            self.sums.update(tuple(total))
            return
        self.sums.clear()
        yield pd.DataFrame([(*key, *total, expected)], columns=[self.key, *self.columns, "expected"])


SLOTS = 32


def detected(at: Sequence[int | None]) -> list[int | None]:
    """Place from which each of the three types counts as detected, given the first place of each slot.

    Slot = own type * 8 + raised types; own type 0 is none of the three. A claim whose type is
    already detected is not judged, so what it raises does not count.
    """
    seen, since = 0, [None, None, None]
    for place, slot in sorted((p, s) for s, p in enumerate(at) if p is not None and s % 8):
        own, raised = slot // 8, slot % 8
        if own and seen >> (own - 1) & 1:
            continue
        for k in range(3):
            if raised >> k & 1 and not seen >> k & 1:
                since[k] = place
        seen |= raised
    return since


class Sightings(StatefulProcessor):
    """First place of each (own type, raised types) of a turn, and from it the detections so far."""

    def __init__(self, keys: Sequence[str], ttl_ms: int):
        self.keys, self.ttl_ms = list(keys), ttl_ms

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "at array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.first.get()
        at = list(held[0]) if held else [None] * SLOTS
        for frame in rows:
            for slot, place in frame.groupby("slot")["at"].min().items():
                at[slot] = int(place) if at[slot] is None else min(at[slot], int(place))
        # Slots that raise nothing only say that the turn was met.
        for own in range(0, SLOTS, 8):
            at[own] = None
        if any(p is not None for p in at):
            self.first.update((at,))
        yield pd.DataFrame([(*key, *detected(at))], columns=[*self.keys, "_from_0", "_from_1", "_from_2"]).astype(
            {f"_from_{k}": "Int64" for k in range(3)})

    def close(self) -> None:
        pass


class FirstVerdict(StatefulProcessor):
    """The first judged verdict of a package, by place; answers for every package met that has one."""

    PLACE = ("conv_id", "turn", "claim_idx")

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "conv_id bigint, turn bigint, claim_idx bigint, package_exists boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = self.first.get()
        best = tuple(best) if best else None
        for frame in rows:
            judged = frame[frame["usable"]]
            for r in judged[[*self.PLACE, "package_exists"]].itertuples(index=False):
                place = (int(r.conv_id), int(r.turn), int(r.claim_idx), bool(r.package_exists))
                best = place if best is None or place[:3] < best[:3] else best
        if best is not None:
            self.first.update(best)
            yield pd.DataFrame([(*key, *best)], columns=["package_key", *self.PLACE, "package_exists"])

    def close(self) -> None:
        pass


class PdfWait(StatefulProcessor):
    """Counts of a claim that waits for its PDFs; a timer of event time ends the wait.

    A claim has a few rows, so it takes them as rows: a frame per claim would cost more than its work.
    Calls to the state store are as few as the claim needs; one that is complete at once leaves none.

    Rows are (event time in ms, expected or null for a PDF). Only numbers are kept: the stamps of PDFs
    that came before their contents and the count of the others.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wait", "expected bigint, deadline bigint, stamps array<bigint>")

    def _answer(self, key, expected: int, deadline: int, received: int) -> Row:
        return Row(claim_id=key[0], expected=expected, received=received, complete=received >= expected, deadline=deadline)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        expected, deadline, stamps = held or (None, None, [])
        before, stamps = deadline, list(stamps)
        for row in rows:
            if row.expected is None:
                stamps.append(row.ms)
            else:
                expected = max(row.expected, expected or 0)
            deadline = row.ms + self.wait_ms if deadline is None else min(deadline, row.ms + self.wait_ms)
        # Stamps after the wait count for nothing and are not kept.
        stamps = [t for t in stamps if t <= deadline]
        if expected is not None and len(stamps) >= expected:
            if held:
                self.handle.deleteTimer(before)
                self.state.clear()
            yield self._answer(key, expected, deadline, len(stamps))
            return
        if before != deadline:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(deadline)
        if not held or (expected, deadline, stamps) != (held[0], held[1], list(held[2])):
            self.state.update((expected, deadline, stamps))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.state.get()
        self.state.clear()
        if held and held[0] is not None:
            yield self._answer(key, held[0], held[1], len(held[2]))

    def close(self) -> None:
        pass
