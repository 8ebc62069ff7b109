"""Rolling hashes, triggers and phrases of texts: what the two operators on exact repeats share.

A text is a row of units (bytes, or words). Its rolling hash over `trigger` units marks triggers: the
least hash among the trigger strings of a window is the window's trigger (the leftmost of equals), so
it depends on nothing but the window, every window has one, and two equal windows have it at the same
place. The windows that share a trigger are consecutive; with what they cover they are one phrase of
the parse. A phrase's dictionary entry is told by `trigger_hash` and by `phrase_hash` over its whole
content, 128 bits together. Equal phrases settle all their windows at once, however often they repeat.
Phrases with a common trigger and different content are cut into stretches of windows at like distances
from the trigger: all windows of a stretch hold its core, which is nearly a window long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from vellum.llm.common import sliced
from vellum.llm.superminhash import mix64

SEGMENT = 1 << 20
KEY = ["id", "text_hash"]
#: Odd multipliers of the two polynomial hashes.
C1, C2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


@functools.cache
def powers(base: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse ** i, modulo 2 ** 64, for i below room."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(room - 1, b % (1 << 64), np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))


@dataclass(frozen=True)
class Units:
    """How texts become units. `window`, `trigger` and `stretch` are in units; `hashes` gives a hash for each unit (or short run of `reach` units) of a text."""

    kind: str  # bytes or words
    window: int
    trigger: int
    stretch: int

    @property
    def reach(self) -> int:
        return 8 if self.kind == "bytes" else 1

    def split(self, text: bytes):
        return text if self.kind == "bytes" else text.split()

    def hashes(self, units) -> np.ndarray:
        if self.kind == "bytes":
            n = len(units) - 7
            return mix64(np.ndarray((n,), "<u8", units, 0, (1,)).astype(np.uint64)) if n > 0 else np.empty(0, np.uint64)
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, units), np.uint64, len(units))

    def triggers(self, u: np.ndarray) -> np.ndarray:
        """Rolling hash of each trigger string, from the hashes of its parts."""
        steps = [j * self.reach for j in range(self.trigger // self.reach)]
        n = len(u) - steps[-1]
        found = np.zeros(n, np.uint64)
        for j in steps:
            found = found * np.uint64(C1) + u[j : j + n]
        return mix64(found)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def sums(u: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(u * powers(base, SEGMENT + 4096)[0][: len(u)], dtype=np.uint64)])


def spans(total: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the unit hashes from start to end."""
    return mix64((total[end] - total[start]) * powers(base, SEGMENT + 4096)[1][start])


def segments(n: int, window: int):
    """(first window, number of windows) of a text with n units, so many at a time."""
    for first in range(0, n - window + 1, SEGMENT):
        yield first, min(SEGMENT, n - window + 1 - first)


def parse(units: Units, text: bytes) -> list[np.ndarray]:
    """start, number of windows, distance of the trigger from the start, trigger hash and phrase hash of each phrase."""
    cut, window = units.split(text), units.window
    out = []
    for first, many in segments(len(cut), window):
        u = units.hashes(cut[first : first + many + window - 1])
        t = units.triggers(u)
        low = np.uint64(0xFFFFFFFF)
        least = sliding_least((t & ~low) | np.arange(len(t), dtype=np.uint64), window - units.trigger + 1)
        at = (least & low).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        end = np.append(start[1:], many)
        at = at[start]
        content = spans(sums(u, C1), C1, start, end - 1 + window - units.reach + 1)
        content = mix64(content + mix64(((at - start).astype(np.uint64) << np.uint64(32)) + (end - start).astype(np.uint64)))
        out.append(np.array([start + first, end - start, at - start, t[at].view(np.int64), content.view(np.int64)]))
    return list(np.concatenate(out, axis=1)) if out else [np.empty(0, np.int64)] * 5


def hashes_of(units: Units, text: bytes, starts: np.ndarray, length: int, bases: tuple) -> list[np.ndarray]:
    """Hashes of the strings of `length` units that begin at `starts`, a column for each base."""
    cut = units.split(text)
    found = [np.empty(len(starts), np.int64) for _ in bases]
    for first, many in segments(len(cut), length):
        here = (starts >= first) & (starts < first + many)
        if here.any():
            u, s = units.hashes(cut[first : first + many + length - 1]), starts[here] - first
            for column, base in zip(found, bases):
                column[here] = spans(sums(u, base), base, s, s + length - units.reach + 1).view(np.int64)
    return found


def stretches(units: Units, start: np.ndarray, many: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of phrases: which one, first window, number of windows and begin of the core of each stretch."""
    of = np.repeat(np.arange(len(start)), many)
    window = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    step = (start + at)[of] - window
    step //= units.stretch
    edge = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(step) != 0)]) if len(of) else np.empty(0, np.int64)
    return of[edge], window[edge], np.diff(np.append(edge, len(of))), (start + at)[of[edge]] - step[edge] * units.stretch


PHRASES = "id long, text_hash long, start int, windows int, at int, trigger_hash long, phrase_hash long"
CORES = "id long, text_hash long, start int, windows int, lead int, weight long, core long"
WINDOWS = "id long, text_hash long, start int, weight long, w1 long, w2 int"


def phrases(units: Units):
    """(id, text_hash, text) -> PHRASES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            parsed = [parse(units, t.as_py()) for t in batch.column(2)]
            of = pa.array(np.repeat(np.arange(len(parsed)), [len(p[0]) for p in parsed]))
            start, many, at, trigger, content = (np.concatenate([p[k] for p in parsed] or [np.empty(0, np.int64)]) for k in range(5))
            yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(trigger), pa.array(content)], ["id", "text_hash", "start", "windows", "at", "trigger_hash", "phrase_hash"])

    return run


def cores_of(units: Units):
    """(id, text_hash, text, starts, windows, weights, ats) -> CORES: each stretch of the given phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for i in range(len(batch)):
                start, many, weight, at = (np.array(batch.column(k)[i].as_py(), np.int64) for k in (3, 4, 5, 6))
                of, window, number, core = stretches(units, start, many, at)
                (found,) = hashes_of(units, batch.column(2)[i].as_py(), core, units.window - units.stretch + 1, (C1,))
                row = pa.array(np.full(len(of), i))
                yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), pa.array(window.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array((core - window).astype(np.int32)), pa.array(weight[of]), pa.array(found)], ["id", "text_hash", "start", "windows", "lead", "weight", "core"])

    return run


def windows_of(units: Units):
    """(id, text_hash, text, starts, windows, weights) -> WINDOWS: each window of the given stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for i in range(len(batch)):
                start, many, weight = (np.array(batch.column(k)[i].as_py(), np.int64) for k in (3, 4, 5))
                s = np.repeat(start - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                w1, w2 = hashes_of(units, batch.column(2)[i].as_py(), s, units.window, (C1, C2))
                of = pa.array(np.full(len(s), i))
                yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), pa.array(s.astype(np.int32)), pa.array(np.repeat(weight, many)), pa.array(w1), pa.array((w2 >> 32).astype(np.int32))], ["id", "text_hash", "start", "weight", "w1", "w2"])

    return run


def covered(n: int, starts: list[int], ends: list[int]) -> np.ndarray:
    """For each of n units whether some [start, end) holds it."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.array(starts, np.int64), 1)
    np.subtract.at(edge, np.array(ends, np.int64), 1)
    return np.cumsum(edge[:n]) > 0
