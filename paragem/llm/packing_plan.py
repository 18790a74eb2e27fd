"""How many sequences of which lengths to form, from the histogram of piece lengths alone.

Linear grouping: the large lengths, in descending order, are cut into groups of equal
cardinality and rounded up to their group's largest. With so few sizes the fractional
optimum over configurations comes from column generation; its whole part is used, and
the actual lengths replace the rounded ones in order. What is left over, and then
the small lengths, go by best fit into the room that remains. All steps handle runs of
equal pieces, so the cost depends on the capacity and not on the number of pieces.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np

#: Lengths above a share of the capacity are large; the share of these that needs the fewest sequences is taken.
LARGE = (1 / 2, 1 / 8)
#: Number of groups that large lengths are cut into.
GROUPS = 48
#: A sequence that wastes more tokens than this once all are formed is dissolved and its pieces go by best fit.
WASTE = 2
EPSILON = 1e-9

#: A kind of sequence: how often each length lies in it, as (length, times) in order; and the number of sequences.
Contents = tuple[tuple[int, int], ...]


def linear_groups(histogram: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count] in descending order, cut into at most ``groups`` lists of equal cardinality.

    Groups with one rounded size are one group.
    """
    total = sum(histogram.values())
    each = -(-total // groups) if total else 0
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            if not room:
                if not out or out[-1][0][0] != length:
                    out.append([])
                room = each
            take = min(room, count)
            out[-1].append([length, take])
            room, count = room - take, count - take
    return out


def best_column(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of highest price that fits (unbounded knapsack over the capacity)."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        value[c] = value[c - 1]
        if len(fits):
            worth = value[c - sizes[fits]] + prices[fits]
            if worth.max() > value[c] + EPSILON:
                value[c], last[c] = worth.max(), fits[worth.argmax()]
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            column[last[c]] += 1
            c -= sizes[last[c]]
    return float(value[capacity]), column


def fractional_optimum(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, covering ``demand`` with the fewest sequences (column generation)."""
    basis = np.diag((capacity // sizes).astype(float))
    level = demand / np.diag(basis)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = best_column(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        up = step > EPSILON
        if not up.any():
            break
        ratio = np.full(len(sizes), np.inf)
        ratio[up] = level[up] / step[up]
        out = int(ratio.argmin())
        level = np.maximum(level - ratio[out] * step, 0)
        level[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, k], float(level[k])) for k in range(len(sizes))]


@dataclass
class Room:
    """Sequences under construction, by the room left in them."""

    capacity: int

    def __post_init__(self) -> None:
        self.kinds: dict[int, dict[Contents, int]] = defaultdict(dict)

    def total(self) -> int:
        return sum(sum(kinds.values()) for kinds in self.kinds.values())

    def add(self, contents: Contents, count: int) -> None:
        if count:
            left = self.capacity - sum(length * times for length, times in contents)
            self.kinds[left][contents] = self.kinds[left].get(contents, 0) + count

    def best_fit(self, length: int, count: int) -> None:
        """Place ``count`` pieces, each into the fullest sequence that can take it, opening new ones at the end."""
        while count:
            left = next((r for r in range(length, self.capacity) if self.kinds.get(r)), self.capacity)
            contents, there = self.kinds[left].popitem() if left < self.capacity else ((), count)
            times = min(left // length, count)
            used = min(there, count // times)
            self.add((*contents, (length, times)), used)
            if left < self.capacity:
                self.add(contents, there - used)
            count -= used * times


def substituted(groups: list[list[list[int]]], column: np.ndarray, count: int) -> list[tuple[Contents, int]]:
    """``count`` sequences of one configuration with the next actual lengths of each group."""
    slots = []
    for g, times in enumerate(column.astype(int)):
        for _ in range(times):
            runs, need = [], count
            while need:
                length, there = groups[g][0]
                take = min(need, there)
                runs.append((length, take))
                groups[g][0][1] -= take
                if not groups[g][0][1]:
                    groups[g].pop(0)
                need -= take
            slots.append(runs)
    out: list[tuple[Contents, int]] = []
    while count:
        take = min(runs[0][1] for runs in slots)
        held: dict[int, int] = defaultdict(int)
        for runs in slots:
            held[runs[0][0]] += 1
            runs[0] = (runs[0][0], runs[0][1] - take)
            if not runs[0][1]:
                runs.pop(0)
        out.append((tuple(sorted(held.items(), reverse=True)), take))
        count -= take
    return out


def grouped_plan(histogram: dict[int, int], capacity: int, groups: int, share: float) -> Room:
    """The plan in which lengths above ``share`` of the capacity are large."""
    room = Room(capacity)
    room.add(((capacity, 1),), histogram.get(capacity, 0))
    cut = linear_groups({n: c for n, c in histogram.items() if capacity * share < n < capacity and c}, groups)
    if cut:
        sizes = np.array([g[0][0] for g in cut])
        demand = np.array([float(sum(c for _, c in g)) for g in cut])
        for column, level in fractional_optimum(sizes, demand, capacity):
            there = [sum(c for _, c in g) for g in cut]
            most = min([int(there[g] // column[g]) for g in np.flatnonzero(column)], default=0)
            whole = min(int(level + 1e-6), most)
            if whole:
                for contents, count in substituted(cut, column, whole):
                    room.add(contents, count)
    left: dict[int, int] = defaultdict(int)
    for length, count in (run for g in cut for run in g):
        left[length] += count
    for length in sorted(left, reverse=True):
        room.best_fit(length, left[length])
    for length in sorted((n for n in histogram if n <= capacity * share), reverse=True):
        room.best_fit(length, histogram[length])
    return room


def dissolved(room: Room, waste: int) -> Room:
    """``room`` with the pieces of all sequences that waste more than ``waste`` placed anew by best fit."""
    out, loose = Room(room.capacity), defaultdict(int)
    for left, kinds in room.kinds.items():
        for contents, count in kinds.items():
            if left <= waste:
                out.add(contents, count)
            else:
                for length, times in contents:
                    loose[length] += times * count
    for length in sorted(loose, reverse=True):
        out.best_fit(length, loose[length])
    return out


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[tuple[Contents, int]]:
    """Kinds of sequences and their numbers that use up the histogram exactly.

    Lengths lie in 1 to ``capacity``. There are at most a few thousand kinds, whatever the counts.
    """
    grouped = [grouped_plan(histogram, capacity, groups, share) for share in LARGE]
    room = min((r for g in grouped for r in (dissolved(g, WASTE), g)), key=Room.total)
    return [(c, n) for left in sorted(room.kinds) for c, n in sorted(room.kinds[left].items())]
