"""What a track is, one report at a time; the yardstick for the operators."""

from __future__ import annotations

import datetime as dt
import random

START = dt.datetime(2024, 1, 1)


class TrackModel:
    def __init__(self, max_features: int) -> None:
        self.max_features = max_features
        self.held: dict = {}

    def add(self, time, report) -> bool:
        if time in self.held:
            return False
        self.held[time] = report
        if len(self.held) > self.max_features:
            del self.held[min(self.held)]
        return True

    def times(self) -> list:
        return sorted(self.held)

    def previous(self, time, n: int, descending: bool = False) -> list:
        before = [t for t in self.times() if t < time]
        found = before[-n:] if 0 < n <= len(before) else []
        return found[::-1] if descending else found

    def next(self, time, n: int, descending: bool = False) -> list:
        after = [t for t in self.times() if t >= time]
        found = after[1 : n + 1] if 0 < n < len(after) else []
        return found[::-1] if descending else found


def random_reports(seed: int, keys: int, most: int, times: int) -> list[tuple]:
    """``(key, time, arrival, value)`` with ties and late reports, shuffled."""
    rng = random.Random(seed)
    rows = []
    for key in range(keys):
        for _ in range(rng.randint(1, most)):
            rows.append((f"K{key}", START + dt.timedelta(hours=rng.randrange(times))))
    rng.shuffle(rows)
    rows = [(key, time, arrival, arrival / 2) for arrival, (key, time) in enumerate(rows)]
    rng.shuffle(rows)
    return rows


SCHEMA = "flight_id string, time timestamp_ntz, arrival_seq bigint, value double"


def replayed(rows: list[tuple], max_features: int) -> dict[str, TrackModel]:
    tracks: dict[str, TrackModel] = {}
    for row in sorted(rows, key=lambda row: row[2]):
        track = tracks.setdefault(row[0], TrackModel(max_features))
        track.add(row[1], row[2])
    return tracks


def held_entries(tracks: dict[str, TrackModel]) -> set[tuple]:
    return {
        (key, time, arrival)
        for key, track in tracks.items()
        for time, arrival in track.held.items()
    }
