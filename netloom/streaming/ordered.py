"""Live captures put back in order over any number of triggers, with value, map and timer state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .live import PARSED, STATE, parse_datagram

_NAMES = [x.split()[0] for x in PARSED.split(", ")]
#: Numbers whose waiting datagrams are one value of the state; each access to the state is a call to another process.
PAGE = 1024


class InOrder(StatefulProcessor):
    """One capture: the parser's state, the number of the datagram that is due, and those that came
    before it, in pages of ``PAGE`` numbers. A gap is waited for until ``patience`` milliseconds pass without its filling; then
    the parser goes on behind it. State is dropped ``idle`` milliseconds after the last datagram."""

    def __init__(self, first: int, patience: int, idle: int) -> None:
        self.first, self.patience, self.idle = first, patience, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parser = handle.getValueState("parser", f"{STATE}, started boolean", self.idle)
        self.due = handle.getValueState("due", "arrival long", self.idle)
        self.early = handle.getMapState("early", "page long", "arrivals array<long>, datagrams array<binary>", self.idle)

    def _parsed(self, key: tuple, datagrams: list[bytes]) -> list[tuple]:
        now = self.parser.get() if self.parser.exists() else None
        now = tuple(now[:-1]) if now else None
        out, skipped = [], now[4] if now else 0
        for data in datagrams:
            now, packet = parse_datagram(data, now)
            if packet:
                out.append((key[0], *packet, False))
            elif now[4] > skipped:
                skipped = now[4]
                out.append((key[0], skipped, None, len(data), len(data), None, data, True))
        if now:
            self.parser.update((*now, True))
        return out

    def _page(self, page: int) -> dict[int, bytes]:
        if not self.early.containsKey((page,)):
            return {}
        arrivals, datagrams = self.early.getValue((page,))
        return dict(zip(arrivals, map(bytes, datagrams), strict=True))

    def _keep(self, page: int, held: dict[int, bytes], had: bool) -> None:
        if held:
            self.early.updateValue((page,), (list(held), list(held.values())))
        elif had:
            self.early.removeKey((page,))

    def _emitted(self, key: tuple, due: int, fresh: dict[int, dict[int, bytes]]) -> Iterator[pd.DataFrame]:
        """What follows without a gap from ``due`` on, a page of numbers at a time; of the ``fresh`` ones (by page), the others wait."""
        while True:
            page, begin = due // PAGE, due
            waiting = self._page(page)
            held, out = waiting | fresh.pop(page, {}), []
            while due // PAGE == page and due in held:
                out.append(held.pop(due))
                due += 1
            if out or len(held) != len(waiting):
                self._keep(page, held, bool(waiting))
            if out:
                yield pd.DataFrame(self._parsed(key, out), columns=_NAMES)
            if due // PAGE == page or due == begin:
                break
        for page, more in fresh.items():
            self._keep(page, self._page(page) | more, False)
        self.due.update((due,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due = self.due.get()[0] if self.due.exists() else self.first
        fresh: dict[int, dict[int, bytes]] = {}
        for batch in rows:
            for arrival, datagram in zip(batch["arrival"].tolist(), batch["datagram"], strict=True):
                if arrival >= due:  # what comes behind its gap's end, or twice, is late
                    fresh.setdefault(arrival // PAGE, {})[arrival] = bytes(datagram)
        yield from self._emitted(key, due, fresh)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if self.early.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.early.exists():
            return
        first = min(k[0] for k in self.early.keys())
        yield from self._emitted(key, min(self._page(first)), {})
        if self.early.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def close(self) -> None:
        pass


def ordered_datagrams(stream: DataFrame, first: int = 0, patience: float = 5.0, idle: float = 3600.0) -> DataFrame:
    """``live.parsed_datagrams`` for datagrams that come in any order, as from several spools or after
    a retried trigger: those of a capture are parsed by their arrival numbers, which count
    from ``first`` without gaps. A number that is missing is waited for, over triggers, for ``patience``
    seconds; one that comes later still, or twice, is left out. State of a capture that is idle for ``idle`` seconds
    is dropped. What waits is bounded by what comes within ``patience``.

    The query needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    processor = InOrder(first, int(patience * 1000), int(idle * 1000))
    return stream.groupBy("capture_id").transformWithStateInPandas(processor, PARSED, "Append", "ProcessingTime")
