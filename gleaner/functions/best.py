"""The best rows of many groups within a task, and rounding as Spark rounds."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Half up by the shortest decimal of each double, as Spark's round; only values near a half need that decimal."""
    unit = 10.0**digits
    scaled = values * unit
    plain = np.isfinite(values) & (np.abs(values) < 1e9)
    out = np.where(plain, np.rint(scaled) / unit + 0.0, values)  # no negative zero
    for i in np.flatnonzero(plain & (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3)):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class Best:
    """The first k rows of each group by value, rounded, then by id (null first).

    What is held is k rows a group and the rows of one call; of these, rows beyond a group's k-th value are left out first.
    """

    def __init__(self, groups: int, k: int, digits: int, falling: bool = False) -> None:
        self.k, self.digits, self.sign = k, digits, -1.0 if falling else 1.0
        self.worst = np.full(groups, np.inf)  # sign * value of the k-th row
        self.group, self.value, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, group: np.ndarray, value: np.ndarray, ids: pa.Array, at: np.ndarray) -> None:
        """Rows (group, value, ids[at])."""
        near = self.sign * value <= self.worst[group] + 10.0**-self.digits
        group, value, at = group[near], rounded(value[near], self.digits), at[near]
        if not len(group):
            return
        new = ids.take(pa.array(at))
        every = new if self.ids is None else pa.concat_arrays([self.ids, new])
        group, value = np.concatenate([self.group, group]), np.concatenate([self.value, value])
        place = pc.rank(every, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        order = np.lexsort((place, self.sign * value, group))
        sorted_group = group[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
        last = order[rank == self.k - 1]
        self.worst[group[last]] = self.sign * value[last]
        stays = order[rank < self.k]
        self.group, self.value, self.ids = group[stays], value[stays], every.take(pa.array(stays))
