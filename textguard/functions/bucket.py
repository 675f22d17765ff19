"""One client's token bucket over events in time order, in exact integer units.

A bucket that is refilled by one token a minute gains one unit a microsecond, so a token is
60,000,000 units and every refill and every level is a whole number: the same decisions come out
however a timeline is cut into parts.
"""

from __future__ import annotations

import numpy as np

TOKEN = 60_000_000
PATIENCE = 16  # refusals taken one by one before a whole stretch is tried
BLOCK = 4096


def check_rate(capacity: int, refill_per_minute: int) -> None:
    if capacity < 1 or refill_per_minute < 1:
        raise ValueError("Capacity and refill per minute must be at least 1.")


def fill_micros(capacity: int, refill_per_minute: int) -> int:
    """Microseconds after which an empty bucket is full."""
    return -(-capacity * TOKEN // refill_per_minute)


def _gains(micros: np.ndarray, last: int, capacity: int, refill_per_minute: int) -> tuple[np.ndarray, int]:
    """What is refilled before each event, and the clock afterwards, which never goes back."""
    if not len(micros):
        return np.empty(0, "int64"), last
    clock = np.maximum.accumulate(np.concatenate(([last], micros)).astype("int64"))
    passed = np.minimum(np.diff(clock), fill_micros(capacity, refill_per_minute))
    return passed * refill_per_minute, int(clock[-1])


def admit(
    micros: np.ndarray, level: int, last: int, capacity: int, refill_per_minute: int
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Decide events in order; returns decisions, waits and the state afterwards.

    A clock that does not move forward refills nothing. A refused event takes nothing.
    Waits are whole seconds, at least one, and 0 for admitted events.

    While a bucket is empty its level is a plain running sum of the refills, so long
    stretches of refusals, which is what a client far over its rate consists of, are
    summed at once.
    """
    full = capacity * TOKEN
    gains, clock = _gains(micros, last, capacity, refill_per_minute)
    count = len(micros)
    allowed = np.zeros(count, dtype=bool)
    levels = np.zeros(count, "int64")

    at, refused = 0, 0
    steps = gains.tolist()
    while at < count:
        if refused >= PATIENCE:
            sums = level + np.cumsum(gains[at:at + BLOCK])
            enough = np.flatnonzero(sums >= TOKEN)
            stretch = int(enough[0]) if len(enough) else len(sums)
            levels[at:at + stretch] = sums[:stretch]
            if stretch:
                level = int(sums[stretch - 1])
            at += stretch
            if len(enough):
                refused = 0
            continue
        level = min(full, level + steps[at])
        if level >= TOKEN:
            level -= TOKEN
            allowed[at] = True
            refused = 0
        else:
            levels[at] = level
            refused += 1
        at += 1

    waits = np.maximum(1, -((levels - TOKEN) // (1_000_000 * refill_per_minute)))
    waits[allowed] = 0
    return allowed, waits, level, clock


#: What is known of a part that was walked without its entry: its exit for every entry with the
#: fraction that was assumed, or its exit whatever the entry.
MET, FREE = 1, 2


class Coupled:
    """A part of a timeline walked without the level at its entry.

    Admissions take whole tokens, so the fraction of a token in the bucket follows from the refills
    alone, until the bucket is full. Levels with one fraction move as ordered paths, a token apart:
    when the lowest is refused, the next one meets it. So the lowest path and the number of those
    that have met it give every other. A path that is capped loses its fraction and is followed by itself;
    the entries that lead to it are known by where they stood.

    Beside them goes the path from an empty bucket. Any other path, of whatever fraction, stays
    less than one token below it at most; where it overflows by a token, every path is full.
    """

    def __init__(self, fraction: int, last: int, capacity: int, refill_per_minute: int):
        self.rate = capacity, refill_per_minute
        self.full = capacity * TOKEN
        self.last = last
        self.low, self.met = fraction, 0
        # the highest entry in tokens: no event leaves more than a token short of a full bucket
        self.top = max(0, (self.full - TOKEN - fraction) // TOKEN)
        self.capped: list[tuple[int, int]] = []  # (from which entry on, level), higher entries first
        self.least = 0
        self.free = False
        self.patience = 1024 + 8 * capacity  # events for which overflow is still waited for after meeting

    def _after(self, level: int) -> int:
        return level - TOKEN if level >= TOKEN else level

    def _step(self, gain: int) -> None:
        full = self.full
        rest = self.least + gain
        if rest >= full + TOKEN - 1:
            self.free = True
            self.top, self.capped = -1, [(0, full - TOKEN)]
            return
        self.least = self._after(min(full, rest))
        if self.capped:
            self.capped = [(k, self._after(min(full, level + gain))) for k, level in self.capped]
        if self.top >= 0:
            low = self.low + gain
            fits = self.met + (full - low) // TOKEN if low <= full else -1
            if fits < self.top:
                self.capped.append((fits + 1, full - TOKEN))
                self.top = fits
            if low < TOKEN and self.top > self.met:
                self.met += 1
            self.low = self._after(low)
        if len(self.capped) > 1:
            self.capped = [c for i, c in enumerate(self.capped) if i + 1 == len(self.capped) or self.capped[i + 1][1] != c[1]]

    def _single(self) -> int | None:
        """The level, if one path is left."""
        if self.top < 0:
            return self.capped[0][1] if len(self.capped) == 1 else None
        return self.low if self.top <= self.met and not self.capped else None

    def feed(self, micros: np.ndarray) -> None:
        gains, clock = _gains(micros, self.last, *self.rate)
        for at, gain in enumerate(gains.tolist()):
            one = self._single()
            if one is not None:
                self.patience -= 1
                if self.free or self.patience <= 0:
                    last = self.last if at == 0 else max(self.last, int(micros[:at].max()))
                    _, _, level, _ = admit(micros[at:], one, last, *self.rate)
                    if self.top < 0:
                        self.capped = [(0, level)]
                    else:
                        self.low = level
                    break
            self._step(gain)
        self.last = clock

    def exits(self) -> tuple[int, int | None, int, int, int, list[int], list[int]]:
        """How the exit is known, the exit if it is one for all entries, the lowest path, how many have met
        it, the highest entry that was not capped, and from which entries on which levels were."""
        one = self._single()
        if self.free or self.top < 0:
            one = self.capped[0][1] if len(self.capped) == 1 else None
        return (FREE if self.free else MET), one, self.low, self.met, self.top, [k for k, _ in self.capped], [x for _, x in self.capped]


def exit_from(entry: int, fraction: int, low: int, met: int, top: int, froms: list[int], levels: list[int]) -> int:
    """The exit of a part that was walked with the fraction of ``entry``."""
    tokens = (entry - fraction) // TOKEN
    if tokens <= top:
        return low + TOKEN * max(0, tokens - met)
    return next(level for k, level in zip(froms, levels) if k <= tokens)
