"""Consensus of rankings with ties.

A ranking is a list of buckets. The consensus minimises the weighted generalised Kendall distance
to the input rankings by local search: an element moves to the bucket, or the new bucket
between two, that lowers the cost of its pairs most, until no move helps. What a move costs is summed by bucket, so
memory grows with the number of elements, the classes of components that the caller makes, and not with its square.
"""

from __future__ import annotations

import numpy as np


def dense_ranks(scores: list[float]) -> np.ndarray:
    """Rank of each score from 0 in ascending order; equal scores share a rank."""
    return np.unique(np.asarray(scores, float), return_inverse=True)[1]


class Costs:
    """Cost of a ranking against weighted input rankings; a pair tied in only one of the two counts ``tie``."""

    def __init__(self, rankings: np.ndarray, weights: list[float], tie: float = 1.0) -> None:
        self.rankings, self.weights, self.tie = rankings, np.asarray(weights, float)[:, None], tie

    def of_slots(self, i: int, position: np.ndarray) -> np.ndarray:
        """Cost of the pairs of element i if it stood in each slot, from -1 (before all) to one after the last position."""
        mine = self.rankings[:, i : i + 1]
        first, second = (self.weights * (mine < self.rankings)).sum(axis=0), (self.weights * (self.rankings < mine)).sum(axis=0)
        same = self.tie * (self.weights * (self.rankings == mine)).sum(axis=0)
        kinds = [second + same, first + same, self.tie * (first + second)]  # i before j, after j, with j
        top = int(position.max()) + 1
        sums = []
        for x in kinds:
            x[i] = 0.0
            sums.append(np.bincount(position, x, top))
        before, after, equal = sums
        # elements behind slot s are behind i, those in front of it in front of i
        behind = before.sum() - np.concatenate([[0.0], np.cumsum(before), [before.sum()]])
        front = np.concatenate([[0.0, 0.0], np.cumsum(after)])
        return behind + front + np.concatenate([[0.0], equal, [0.0]])

    def of(self, position: np.ndarray) -> float:
        """Total cost of a ranking given as the bucket number of each element."""
        return sum(float(self.of_slots(i, position)[position[i] + 1]) for i in range(len(position))) / 2


def improve(position: np.ndarray, costs: Costs) -> np.ndarray:
    """The ranking after local search; positions are even, odd ones are between two buckets."""
    position = dense_ranks(position.tolist()) * 2
    while True:
        moved = False
        for i in range(len(position)):
            price = costs.of_slots(i, position)
            best = int(np.argmin(price))
            if price[best] < price[position[i] + 1] - 1e-9:
                position[i] = best - 1
                position = dense_ranks(position.tolist()) * 2
                moved = True
        if not moved:
            return position // 2


def consensus(scores: list[list[float]], weights: list[float]) -> list[list[int]]:
    """Buckets of element indexes, best first; lower scores rank first. The best of the local optima from all inputs."""
    rankings = np.stack([dense_ranks(s) for s in scores])
    costs = Costs(rankings, weights)
    found = [improve(r.copy(), costs) for r in rankings]
    best = min(found, key=costs.of)
    return [np.flatnonzero(best == b).tolist() for b in range(best.max() + 1)]
