"""GTFS-Realtime trip updates: a small reader of the public wire format, run on Arrow batches of snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bounds on what one hostile snapshot can make a worker hold.
MOST_BYTES, MOST_ENTITIES, MOST_STOPS = 64 << 20, 200_000, 2_000

SCHEMA = "snapshot string, stamp long, trip_id string, start_date string, route_id string, relationship int, stop_sequence int, stop_id string, delay int, time long, stop_relationship int"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields; a truncated message ends early with ValueError."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= end or shift > 63:
                raise ValueError("truncated")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            if at + size > end:
                raise ValueError("truncated")
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError("unknown wire type")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def trip_updates(data: bytes) -> Iterator[tuple]:
    """(stamp, trip_id, start_date, route_id, relationship, stop_sequence, stop_id, delay, time, stop_relationship).

    A snapshot beyond the bounds on its size, trips or a trip's stops is an error, so that none is read in part.
    """
    if len(data) > MOST_BYTES:
        raise ValueError("snapshot too large")
    stamp, updates = None, []
    for number, value in fields(data):
        if number == 1:
            stamp = next((v for n, v in fields(value) if n == 3), None)
        elif number == 2:
            updates += [v for n, v in fields(value) if n == 3]
            if len(updates) > MOST_ENTITIES:
                raise ValueError("too many trips")
    for update in updates:
        trip, stops = {}, []
        for number, value in fields(update):
            if number == 1:
                trip = dict(fields(value))
            elif number == 2:
                stops.append(dict(fields(value)))
                if len(stops) > MOST_STOPS:
                    raise ValueError("too many stops")
        text = lambda d, n: d[n].decode("utf-8", "replace") if n in d else None
        head = (stamp, text(trip, 1), text(trip, 3), text(trip, 5), trip.get(4, 0))
        if not stops:
            yield (*head, None, None, None, None, None)
        for s in stops:
            event = dict(fields(s.get(3) or s.get(2) or b""))
            yield (*head, s.get(1), text(s, 4), _signed(event[1]) if 1 in event else None, _signed(event[2]) if 2 in event else None, s.get(5, 0))


def decode(snapshots: DataFrame) -> DataFrame:
    """Rows of trip updates of (snapshot, content) rows. A snapshot that can't be read gives none; the others stay whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for name, data in zip(batch.snapshot, batch.content, strict=True):
                try:
                    rows += [(name, *r) for r in trip_updates(bytes(data))]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=names).astype({"stamp": "Int64", "relationship": "Int32", "stop_sequence": "Int32", "delay": "Int32", "time": "Int64", "stop_relationship": "Int32"})

    return snapshots.select("snapshot", "content").mapInPandas(run, SCHEMA)
