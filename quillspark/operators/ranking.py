"""The best of many scores, gathered in a task batch by batch, so that what is shuffled does not grow with the pairs scored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores of the best kept in a pass: groups of queries times k.
KEPT = 4_000_000
#: Rows beyond the best that are held until they are cut.
SLACK = 100_000


class Best:
    """The k best of each group by score, ties by the lower chunk id; a NaN is the greatest score, as it is in SQL."""

    def __init__(self, groups: int, k: int, least: float = -np.inf):
        """Scores below ``least`` are never kept."""
        self.k, self.least = k, np.full(groups, least)
        self._held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self._fresh, self._n = [], 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the groups from ``first`` on (rows) with the chunks ``ids`` (columns)."""
        n, least = scores.shape[1], self.least[first : first + len(scores), None]
        near = ~(scores < least)
        if n > self.k and np.count_nonzero(near) > 4 * self.k * len(scores):
            near &= ~(scores < np.partition(scores, n - self.k, axis=1)[:, n - self.k, None])
        group, place = np.nonzero(near)
        if len(group):
            self._fresh.append((group + first, ids[place], scores[group, place]))
            self._n += len(group)
            if self._n > 2 * self.k * len(self.least) + SLACK:
                self._cut()

    def _cut(self) -> None:
        group, ids, score = (np.concatenate(c) for c in zip(self._held, *self._fresh, strict=True))
        order = np.lexsort((ids, np.where(np.isnan(score), -np.inf, -score), group))
        group, ids, score = group[order], ids[order], score[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        last = rank == self.k - 1
        self.least[group[last]] = score[last]
        kept = rank < self.k
        self._held, self._fresh, self._n = (group[kept], ids[kept], score[kept]), [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, chunk id and score of what is kept."""
        self._cut()
        return self._held


def record_batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
