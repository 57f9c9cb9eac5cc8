"""Responses put together from scored segments that arrive one by one, in any order and more than once.

Each request keeps its segments as keyed state until all are there, and then gives one response. A time, set by a request's
first segment, ends the wait: a request that is incomplete then fails as a whole. So does one with a segment that couldn't be
scored. State is bounded by the requests that are open, and by one short entry for each that closed before its time.

Each call on the state is a round trip between Python and the JVM. Requests share a key with others by a hash of their ids, and
the state of a key is one value, so a batch takes a few calls for each key and not for each request.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.requests import FAILED, FINE

#: Keys that requests are dealt to. A checkpoint goes on only with the number that it began with.
KEYS = 4096

SEGMENT = "text string, label string, label_id int, p_left double, p_right double, p_center double, error string"
RESULT = "segment_index int, text string, label string, label_id int, p_left double, p_right double, p_center double"
RESPONSE = f"request_id bigint, mode string, status int, error string, n_segments int, results array<struct<{', '.join(':'.join(c.split(' ')) for c in RESULT.split(', '))}>>"


@dataclass(slots=True)
class _Request:
    """What is known of a request: ``until`` is its time in milliseconds, ``parts`` its segments so far by index."""

    mode: str | None
    n: int | None
    until: int | None = None
    closed: bool = False
    parts: dict[int, tuple] = field(default_factory=dict)


class Assemble(StatefulProcessor):
    """State of one key: its requests as JSON, and the time of its timer, which is that of the request whose time comes first."""

    def __init__(self, wait_ms: int, by_event: bool):
        self.wait_ms, self.by_event = wait_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "timer bigint, requests string")

    def _read(self) -> tuple[int | None, dict[int, _Request]]:
        if not (found := self.kept.get()):
            return None, {}
        return found[0], {i: _Request(*known, {p[0]: tuple(p[1:]) for p in parts}) for i, *known, parts in json.loads(found[1])}

    def _write(self, timer: int | None, requests: dict[int, _Request]) -> None:
        if not requests:
            self.kept.clear()
            return
        first = min(r.until for r in requests.values())
        if timer is None or first < timer:
            self.handle.registerTimer(first)
            timer = first
        listed = [(i, r.mode, r.n, r.until, r.closed, [(k, *p) for k, p in r.parts.items()]) for i, r in requests.items()]
        self.kept.update((timer, json.dumps(listed, ensure_ascii=False)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, requests = self._read()
        fresh, touched = {}, {}
        for row in rows:
            i = row.request_id
            request = requests.get(i)
            if request is None:
                request = requests[i] = fresh[i] = _Request(row.mode, row.n_segments)
            if request.closed:
                continue
            if request.mode is None:
                request.mode, request.n = row.mode, row.n_segments
            if i in fresh and self.by_event:
                request.until = row.at_ms if request.until is None else min(request.until, row.at_ms)
            if 0 <= row.segment_index < request.n and row.segment_index not in request.parts:
                request.parts[row.segment_index] = (row.text, row.label, row.label_id, row.p_left, row.p_right, row.p_center, row.error)
                touched[i] = request
        if not fresh and not touched:
            return
        now = None if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        for request in fresh.values():
            request.until = (request.until if self.by_event else now) + self.wait_ms
        for i, request in {**fresh, **touched}.items():
            if len(request.parts) == request.n:
                yield self._response(i, request.mode, request.n, request.parts)
                request.closed, request.parts = True, {}
        self._write(timer, requests)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All requests of the key whose time has come; one that closed is forgotten."""
        _, requests = self._read()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        for i, r in list(requests.items()):
            if r.until <= fired or r.until < now:
                del requests[i]
                if not r.closed:
                    yield Row(request_id=i, mode=r.mode, status=FAILED, error=f"{len(r.parts)} of {r.n} segments arrived", n_segments=r.n, results=None)
        self._write(None, requests)

    def _response(self, request_id: int, mode: str, n: int, parts: dict[int, tuple]) -> Row:
        """All or nothing: the error of the first segment that has one is the request's."""
        ranked = sorted(parts.items())
        error = next((p[6] for _, p in ranked if p[6] is not None), None)
        results = [(i, *p[:6]) for i, p in ranked] if error is None else None
        return Row(request_id=request_id, mode=mode, status=FINE if error is None else FAILED, error=error, n_segments=n, results=results)

    def close(self) -> None:
        pass


def assemble(segments: DataFrame, wait_seconds: int, event_time: str | None = None) -> DataFrame:
    """Responses of scored segments: request_id, mode, n_segments, segment_index and the columns of ``SEGMENT``.

    A segment counts once, its first arrival; an index outside 0 ... n_segments - 1 counts as none. A request gives one response: with
    status 200 and results in order, or 400 with the first segment's error, or 400 once ``wait_seconds`` have passed since its first segment. With
    ``event_time``, a watermarked timestamp column, time is that of the segments, and segments behind the watermark are dropped; else it is the
    clock's, and the query runs until it is stopped, as its timers may fire at any time.
    """
    at = F.unix_millis(F.col(event_time)) if event_time else F.lit(0).cast("long")
    named = [c.split(" ")[0] for c in SEGMENT.split(", ")]
    rows = segments.select(F.pmod(F.xxhash64("request_id"), F.lit(KEYS)).alias("key"), "request_id", "mode", "n_segments", "segment_index", *named, at.alias("at_ms"), *([event_time] if event_time else []))
    mode = "EventTime" if event_time else "ProcessingTime"
    return rows.groupBy("key").transformWithState(Assemble(wait_seconds * 1000, bool(event_time)), RESPONSE, "append", mode)
