"""Divisions of many numbered texts at once, by a word model: expected counts, and the cheapest division.

A text falls into sections at every place that no word of several syllables spans. Most have one syllable and
one division. The others are gone through syllable by syllable, all sections of a batch side by side, the longest first; the
few that are longer than the rest one by one. Each section gives the same numbers whatever is beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .runs import END, UNKNOWN, Codes

#: Sections side by side that are worth a step in arrays.
FEW = 8
NONE = -1


@dataclass(frozen=True)
class NumberedModel:
    """Costs in micro-nats and places in a list, by number of a syllable; of longer words by level and place there."""

    costs: np.ndarray
    places: np.ndarray
    levels: list[tuple[Codes, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, model, vocabulary: list[str], listed: dict[str, int]) -> NumberedModel:
        """``model``: costs by word, unknown, longest. The words that have ``_`` between two syllables of ``vocabulary``."""
        known, base = {w: k for k, w in enumerate(vocabulary, 1)}, len(vocabulary) + 1
        costs = np.array([model.unknown, *[model.costs.get(w, model.unknown) for w in vocabulary]], np.int64)
        places = np.array([NONE, *[listed.get(w, NONE) for w in vocabulary]], np.int64)
        runs: list[list[int]] = []
        words: list[str] = []
        for word in model.costs:
            parts = word.split("_") if "_" in word else []
            numbers = [known.get(p, UNKNOWN) for p in parts]
            if 1 < len(parts) <= model.longest and UNKNOWN not in numbers:
                runs.append(numbers)
                words.append(word)
        sizes = np.array([len(r) for r in runs], np.int64)
        padded = np.array([r + [UNKNOWN] * (model.longest - len(r)) for r in runs], np.int64).reshape(len(runs), model.longest)
        cost = np.array([model.costs[w] for w in words], np.int64)
        place = np.array([listed.get(w, NONE) for w in words], np.int64)
        state, levels = padded[:, 0], []
        for size in range(2, int(sizes.max(initial=0)) + 1):
            long = sizes >= size
            codes = state * base + padded[:, size - 1]
            held = np.unique(codes[long])
            state = np.where(long, np.searchsorted(held, codes), 0)
            ends = sizes == size
            level_costs, level_places = np.full((2, len(held)), NONE, np.int64)
            level_costs[state[ends]], level_places[state[ends]] = cost[ends], place[ends]
            levels.append((Codes(held), level_costs, level_places))
        return cls(costs, places, levels)

    def words_of_several(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, first syllables, places in the level."""
        at = np.flatnonzero(numbers[:-1] > UNKNOWN)
        state, base = numbers[at].astype(np.int64), len(self.costs)
        for size, (codes, costs, _) in enumerate(self.levels, 2):
            more = numbers[at + (size - 1)] > UNKNOWN
            at, state = at[more], state[more]
            found = codes.places(state * base + numbers[at + (size - 1)])
            at, state = at[found >= 0], found[found >= 0].astype(np.int64)
            whole = costs[state] != NONE
            yield size, at[whole], state[whole]


class Sections:
    """The sections of more than one syllable of some texts; their syllables are numbered one after the other."""

    def __init__(self, numbers: np.ndarray, model: NumberedModel):
        joined = np.zeros(len(numbers), bool)  # with the next
        found = list(model.words_of_several(numbers))
        for size, at, _ in found:
            for k in range(size - 1):
                joined[at + k] = True
        behind = np.zeros_like(joined)
        behind[1:] = joined[:-1]
        self.inside = joined | behind
        self.members = np.flatnonzero(self.inside)
        place = np.cumsum(self.inside, dtype=np.int64) - 1
        #: Of each size from 1, the level's place of the word that ends at a member, NONE where there is none.
        self.ways = [numbers[self.members].astype(np.int64)]
        for size, at, state in found:
            way = np.full(len(self.members), NONE, np.int64)
            way[place[at + (size - 1)]] = state
            self.ways.append(way)
        first = np.flatnonzero(~behind[self.members])
        lengths = np.diff(np.append(first, len(self.members)))
        order = np.argsort(-lengths, kind="stable")
        self.first, self.lengths = first[order], lengths[order]
        self.alone = 0  # so many are gone through one by one
        if len(order):
            self.alone = int(np.searchsorted(-self.lengths, -self.lengths[min(FEW, len(order)) - 1], "left"))

    def side_by_side(self) -> Iterator[tuple[int, int]]:
        """Step, and the number of sections behind the ``alone`` ones that reach it."""
        lengths = -self.lengths[self.alone :]
        for step in range(int(-lengths[0]) if len(lengths) else 0):
            yield step, int(np.searchsorted(lengths, -step, "left"))

    def one_by_one(self) -> Iterator[slice]:
        for first, length in zip(self.first[: self.alone].tolist(), self.lengths[: self.alone].tolist()):
            yield slice(first, first + length)


def _by_way(ways: list[np.ndarray], tables: list[np.ndarray], none) -> list[np.ndarray]:
    """What each way has in the table of its size, ``none`` where there is no way."""
    return [np.where(way == NONE, none, table[way]) for way, table in zip(ways, tables)]


def expected(numbers: np.ndarray, model: NumberedModel, chances: list[np.ndarray], size: int, micro: int) -> np.ndarray:
    """Expected counts of the listed words (``size`` of them) over all divisions of each text, in whole ``micro``-counts a text,
    summed over the texts. ``chances``: of the words of each size, by number or place in the level."""
    at = Sections(numbers, model)
    plain = model.places[numbers[~at.inside & (numbers > UNKNOWN)]]
    sums = np.bincount(plain[plain != NONE], minlength=size) * micro
    if not len(at.members):
        return sums
    shares = _by_way(at.ways, chances, 0.0)  # of the divisions up to the end of a word, those with this word
    scale, backward = np.ones(len(at.members)), np.ones(len(at.members))
    longest = len(shares)

    for section in at.one_by_one():
        _one_by_one([s[section] for s in shares], scale[section], backward[section])
    first, last = at.first[at.alone :], (at.first + at.lengths - 1)[at.alone :]
    for step, active in at.side_by_side():
        m = first[:active] + step
        # Summed as ``sum`` does, with what is lost by each addition.
        total, lost, found = np.zeros(active), np.zeros(active), []
        for n in range(min(longest, step + 1), 0, -1):
            x = shares[n - 1][m]
            for k in range(n - 1, 0, -1):
                x = x / scale[m - k]
            both = total + x
            lost += np.where(total >= x, (total - both) + x, (x - both) + total)
            total = both
            found.append((n, x))
        total += lost
        scale[m] = total
        for n, x in found:
            shares[n - 1][m] = x / total
    for step, active in at.side_by_side():
        if step:
            m = last[:active] - step
            sum_ = np.zeros(active)
            for n in range(min(longest, step), 0, -1):
                sum_ += shares[n - 1][m + n] * backward[m + n]
            backward[m] = sum_

    text = np.cumsum(numbers == END)[at.members]
    keys, values = [], []
    for way, share, places in zip(at.ways, shares, [model.places, *[p for _, _, p in model.levels]]):
        place = np.where(way == NONE, NONE, places[way])
        listed = np.flatnonzero(place != NONE)
        keys.append(text[listed] * size + place[listed])
        values.append(share[listed] * backward[listed])
    found, places = np.unique(np.concatenate(keys), return_inverse=True)
    whole = np.rint(np.bincount(places, np.concatenate(values), len(found)) * micro)
    return sums + np.bincount(found % max(1, size), whole, size).astype(np.int64)


def _one_by_one(shares: list[np.ndarray], scale: np.ndarray, backward: np.ndarray) -> None:
    """The same steps for one section; its arrays are written to."""
    mine, scales, back = [s.tolist() for s in shares], scale.tolist(), backward.tolist()
    longest, length = len(mine), len(scales)
    for m in range(length):
        found = []
        for n in range(min(longest, m + 1), 0, -1):
            x = mine[n - 1][m]
            if x:
                for k in range(n - 1, 0, -1):
                    x /= scales[m - k]
            found.append((n, x))
        scales[m] = total = sum(x for _, x in found)
        for n, x in found:
            mine[n - 1][m] = x / total
    for m in range(length - 2, -1, -1):
        total = 0.0
        for n in range(min(longest, length - 1 - m), 0, -1):
            total += mine[n - 1][m + n] * back[m + n]
        back[m] = total
    scale[:], backward[:] = scales, back
    for s, x in zip(shares, mine):
        s[:] = x


def glued(numbers: np.ndarray, model: NumberedModel) -> np.ndarray:
    """True for each syllable that is joined to the next in the cheapest division of its text, of equal ones the one
    with fewer words, then the one whose last differing word is longer."""
    at = Sections(numbers, model)
    out = np.zeros(len(numbers), bool)
    if not len(at.members):
        return out
    far = np.iinfo(np.int64).max // 4
    costs = _by_way(at.ways, [model.costs, *[c for _, c, _ in model.levels]], far)
    best, words, sizes = (np.zeros(len(at.members), np.int64) for _ in range(3))
    ends, longest = np.zeros(len(at.members), bool), len(costs)

    for section in at.one_by_one():
        ends[section] = _cheapest([c[section].tolist() for c in costs])
    first, last = at.first[at.alone :], (at.first + at.lengths - 1)[at.alone :]
    for step, active in at.side_by_side():
        m = first[:active] + step
        for n in range(min(longest, step + 1), 0, -1):
            cost = costs[n - 1][m] + (best[m - n] if n <= step else 0)
            count = 1 + (words[m - n] if n <= step else np.zeros(active, np.int64))
            if n == min(longest, step + 1):
                now, number, size = cost, count, np.full(active, n, np.int64)
            else:
                less = (cost < now) | ((cost == now) & (count < number))
                now, number, size = np.where(less, cost, now), np.where(less, count, number), np.where(less, n, size)
        best[m], words[m], sizes[m] = now, number, size
    while len(last):
        ends[last] = True
        last = last - sizes[last]
        more = last >= first
        first, last = first[more], last[more]
    out[at.members] = ~ends
    return out


def _cheapest(costs: list[list[int]]) -> list[bool]:
    """The same steps for one section: where its words end."""
    longest, length = len(costs), len(costs[0])
    best, sizes = [(0, 0)], []
    for m in range(length):
        now = size = None
        for n in range(min(longest, m + 1), 0, -1):
            before = best[m + 1 - n]
            found = (before[0] + costs[n - 1][m], before[1] + 1)
            if now is None or found < now:
                now, size = found, n
        best.append(now)
        sizes.append(size)
    ends = [False] * length
    while length:
        ends[length - 1] = True
        length -= sizes[length - 1]
    return ends
