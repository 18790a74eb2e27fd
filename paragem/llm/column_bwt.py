"""The transform of a collection of aligned strings, built column by column.

Every round inserts one symbol in front of each string, from the last column to the
first. What is kept is the order of the strings by what they hold from the column on,
and for each neighbour in that order how much of it they share. The symbols that a
round inserts, read in the order of the round before, are that column of the
collection's Burrows-Wheeler transform. Both follow from the round before by one
stable sort and one range minimum, so strings are only ever read one column at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Column:
    """One round: strings in order, their inserted symbols in the order before, prefixes shared with the string before."""

    at: int
    order: np.ndarray
    transform: np.ndarray
    shared: np.ndarray


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for each pair, first <= last."""
    ends = np.empty(2 * len(first), np.int64)
    ends[0::2], ends[1::2] = first, last + 1
    return np.minimum.reduceat(np.append(values, 0), ends)[0::2] if len(first) else np.zeros(0, values.dtype)


def columns(strings: list[bytes], left: np.ndarray, group: np.ndarray) -> Iterator[Column]:
    """Rounds over ``strings``; symbol k of string i stands in column k - left[i].

    Strings of different ``group`` (0, 1, ...) share nothing. A string takes part from
    its last column to its first; before its last symbol it sorts as empty.
    """
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum(length) - length + left
    first, last = -left, length - left - 1
    entering = np.argsort(-last, kind="stable")
    group = group.astype(np.uint16 if group.max(initial=0) < 1 << 16 else np.int64)
    order, shared, entered = np.zeros(0, np.int64), np.zeros(0, np.int32), 0
    for at in range(int(last.max(initial=-1)), int(first.min(initial=0)) - 1, -1):
        more = entered
        while more < len(entering) and last[entering[more]] >= at:
            more += 1
        new, entered = entering[entered:more], more
        staying = first[order] <= at
        if not staying.all():
            kept = np.flatnonzero(staying)
            before = np.concatenate(([0], kept[:-1] + 1)) if len(kept) else kept
            order, shared = order[kept], range_minima(shared, before, kept)
        order = np.concatenate((new, order))
        shared = np.concatenate((np.zeros(len(new), np.int32), shared))
        if len(shared) > len(new):
            shared[len(new)] = 0
        symbols = flat[base[order] + at]
        by_symbol = np.argsort(symbols, kind="stable")
        moved = by_symbol[np.argsort(group[order[by_symbol]], kind="stable")]
        own, of = symbols[moved], group[order[moved]]
        alike = np.flatnonzero((own[1:] == own[:-1]) & (of[1:] == of[:-1])) + 1
        longer = np.zeros(len(order), np.int32)
        longer[alike] = 1 + range_minima(shared, moved[alike - 1] + 1, moved[alike])
        transform, order, shared = symbols, order[moved], longer
        yield Column(at, order, transform, shared)


def repeated_runs(
    strings: list[bytes], left: np.ndarray, group: np.ndarray, span: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first start, last start) of each run of starts whose ``span`` symbols another string has in its columns."""
    ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
    begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
    hit = np.zeros(int(ends[-1]) + 2 if len(strings) else 2, bool)  # one place per symbol, framed
    for column in columns(strings, left, group):
        long = column.shared >= span
        if long.any():
            long[:-1] |= long[1:]
            own = column.order[long]
            hit[begin[own] + left[own] + column.at + 1] = True
    # a start is followed by the rest of its string, so no run goes on into the next
    first, last = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:]) - 1
    own = np.searchsorted(ends, first, side="right")
    return own, first - begin[own], last - begin[own]
