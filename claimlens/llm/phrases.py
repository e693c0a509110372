"""Prefix-free parsing of text blocks into phrases, in NumPy.

A window is a string of ``span`` bytes. Its trigger is the ``GRAM``-byte string inside it with the least rolling hash, the
first of equals; so a window has the same trigger at the same place wherever it occurs. Neighbouring windows with the
same trigger make a phrase: the bytes of all its windows, of which each phrase shares ``span - 1`` with the next. Every
window lies in exactly one phrase, phrases are far fewer than bytes, and repeated text gives the same phrases again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPAN, GRAM = 50, 24
SEGMENT = 2 << 20  # windows parsed at once; a phrase that is cut there is compared window by window
_PLACE = np.uint64((1 << 24) - 1)

# Two rolling hashes modulo 2^64: a random value for each byte and an odd base with its inverse.
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: list[list[np.ndarray]] = []


def _power(which: int, n: int) -> list[np.ndarray]:
    """Powers of a base and of its inverse, at least n of each."""
    if not _powers:
        _powers.extend([[], []])
    if not _powers[which] or len(_powers[which][0]) < n:
        base = _BASES[which]
        _powers[which] = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[which].append(np.multiply.accumulate(p))
    return _powers[which]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of any strings of a byte array in constant time each."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, [None, None]

    def __call__(self, which: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.data)
        up, down = _power(which, n + 1)
        if self.sums[which] is None:
            self.sums[which] = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUES[which][self.data] * up[:n], out=self.sums[which][1:])
        return mix((self.sums[which][end] - self.sums[which][begin]) * down[begin])

    def all(self, which: int, length: int) -> np.ndarray:
        n = len(self.data)
        self(which, np.zeros(0, np.int64), np.zeros(0, np.int64))
        sums, down = self.sums[which], _power(which, n + 1)[1]
        return mix((sums[length:] - sums[:-length]) * down[: n + 1 - length])


@dataclass
class Phrases:
    """Phrases of a block in the order of the text: first and last window, trigger's hash, phrase's hash, document."""

    first: np.ndarray
    last: np.ndarray
    trigger: np.ndarray
    content: np.ndarray
    doc: np.ndarray

    def windows(self, which: np.ndarray, data: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
        """All windows of the chosen phrases: place, phrase, and two hashes of 64 bits."""
        n = self.last[which] - self.first[which] + 1
        place = np.arange(int(n.sum())) + np.repeat(self.first[which] - (np.cumsum(n) - n), n)
        one, two = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
        segment = place // SEGMENT
        for k in np.unique(segment).tolist():
            start, here = k * SEGMENT, np.flatnonzero(segment == k)
            rolling, at = Rolling(data[start : start + SEGMENT + span - 1]), place[here] - start
            one[here], two[here] = rolling(0, at, at + span), rolling(1, at, at + span)
        return place, np.repeat(which, n), one, two


def parse(data: np.ndarray, at: np.ndarray, span: int = SPAN, gram: int = GRAM, segment: int = SEGMENT) -> Phrases:
    """Phrases of the texts that lie in ``data`` between the n + 1 offsets ``at``; none crosses the end of a text."""
    parts = []
    ends = at[1:]
    for start in range(0, max(0, len(data) - span + 1), segment):
        piece = data[start : start + segment + span - 1]
        rolling = Rolling(piece)
        grams = rolling.all(0, gram)
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, have = span - gram + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        trigger = (least & _PLACE).astype(np.int64)
        places = np.arange(start, start + len(trigger))
        doc = np.searchsorted(ends, places[[0, -1]], "right")
        doc = np.repeat(np.arange(doc[0], doc[1] + 1), np.diff(np.clip(np.r_[at[doc[0] : doc[1] + 1], ends[doc[1]]], start, start + len(trigger))))
        whole = np.flatnonzero(places + span <= ends[doc])
        if not len(whole):
            continue
        begins = np.flatnonzero(np.r_[True, (np.diff(trigger[whole]) != 0) | (np.diff(whole) != 1)])
        first, last = whole[begins], whole[np.r_[begins[1:] - 1, len(whole) - 1]]
        anchor = trigger[first]
        content = rolling(1, first, last + span)
        content = mix(content ^ ((anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((last - first).astype(np.uint64) << np.uint64(32)))
        parts.append((first + start, last + start, grams[anchor], content | np.uint64(1), doc[first]))
    if not parts:
        none = np.zeros(0, np.int64)
        return Phrases(none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    return Phrases(*[np.concatenate(x) for x in zip(*parts)])
