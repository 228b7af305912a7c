"""Linear-chain conditional random field with two labels: training, marginals and the best labelling."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chain:
    """``weights`` by feature name add to the score of label 1; label 0 scores 0. ``bias`` is on every item."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    start: tuple[float, float] = (0.0, 0.0)
    end: tuple[float, float] = (0.0, 0.0)

    def best(self, scores: list[float]) -> list[int]:
        """Viterbi: the likeliest labels for items with these scores of label 1; none for no items."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.step
        a, b = self.start[0], self.start[1] + scores[0]
        back = []
        for e in scores[1:]:
            back.append((int(b + s10 > a + s00), int(b + s11 >= a + s01)))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + e
        out = [int(b + self.end[1] > a + self.end[0])]
        for p in reversed(back):
            out.append(p[out[-1]])
        return out[::-1]

    def marginals(self, items: int, at: list[int], scores: list[float]) -> list[float]:
        """Probability of label 1 at the places ``at``, which have ``scores``; all other items have the bias alone.

        Forward and backward messages jump over runs of equal items by powers of
        one 2 x 2 matrix, so the work follows the places, not the items.
        """
        step, start, end = np.exp(np.array(self.step)), np.exp(np.array(self.start)), np.exp(np.array(self.end))
        plain = np.array([1.0, np.exp(self.bias)])
        powers: dict[int, np.ndarray] = {}

        def run(k: int) -> np.ndarray:
            if k not in powers:
                out, base, n = np.eye(2), step * plain, k
                while n:
                    if n & 1:
                        out = out @ base
                        out /= out.sum()
                    base = base @ base
                    base /= base.sum()
                    n >>= 1
                powers[k] = out
            return powers[k]

        own = [np.array([1.0, np.exp(min(s, 60.0))]) for s in scores]
        forward = []
        for i, p in enumerate(at):
            if i == 0:
                m = start * own[0] if p == 0 else (start * plain) @ run(p - 1) @ step * own[0]
            else:
                m = forward[-1] @ run(p - at[i - 1] - 1) @ step * own[i]
            forward.append(m / m.sum())
        back = [run(items - 1 - at[-1]) @ end] if at else []
        for i in range(len(at) - 2, -1, -1):
            m = run(at[i + 1] - at[i] - 1) @ step @ (own[i + 1] * back[-1])
            back.append(m / m.sum())
        return [float(m[1] / m.sum()) for m in (f * b for f, b in zip(forward, reversed(back), strict=True))]


def train(sequences: list[list[list[str]]], labels: list[list[int]], rounds: int = 150, l2: float = 0.05, rate: float = 0.2) -> Chain:
    """Fits a chain to labelled sequences; each item is a list of feature names.

    Maximum likelihood with an L2 penalty, by Adam over all sequences at once.
    Sequences of no items are left out; none at all gives a chain of zeros.
    """
    kept = sorted(((s, y) for s, y in zip(sequences, labels, strict=True) if s), key=lambda p: len(p[0]))
    names = {n: i + 1 for i, n in enumerate(sorted({f for s, _ in kept for item in s for f in item}))}
    if not kept:
        return Chain()
    blocks = []
    for i in range(0, len(kept), 256):
        part = kept[i : i + 256]
        longest = len(part[-1][0])
        place, gold, ids, ptr = np.full((len(part), longest), -1), np.zeros((len(part), longest), dtype=int), [], []
        for r, (s, y) in enumerate(part):
            for c, item in enumerate(s):
                place[r, c] = len(ptr)
                ptr.append(len(ids))
                ids += [0, *(names[f] for f in item)]
            gold[r, : len(y)] = y
        blocks.append((place, gold, np.array(ids), np.array(ptr)))
    theta = np.zeros(len(names) + 1 + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    items = sum(len(s) for s, _ in kept)
    for t in range(1, rounds + 1):
        slope = l2 * theta
        for block in blocks:
            _add_slope(theta, block, slope, len(names) + 1)
        slope /= items
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta - rate / (1 + t / 50) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    tail = theta[len(names) + 1 :].tolist()
    return Chain({n: float(theta[i]) for n, i in names.items()}, float(theta[0]), ((tail[0], tail[1]), (tail[2], tail[3])), (tail[4], tail[5]), (tail[6], tail[7]))


def _add_slope(theta: np.ndarray, block: tuple, slope: np.ndarray, n: int) -> None:
    """Adds a block's expected minus observed counts."""
    place, gold, ids, ptr = block
    step, start, end = theta[n : n + 4].reshape(2, 2), theta[n + 4 : n + 6], theta[n + 6 : n + 8]
    scores = np.add.reduceat(theta[ids], ptr)
    live = place >= 0
    e = np.zeros((*place.shape, 2))
    e[..., 1] = np.where(live, scores[place], 0.0)
    rows, width = place.shape
    last = live.sum(axis=1) - 1
    f = np.zeros((width, rows, 2))
    f[0] = start + e[:, 0]
    for t in range(1, width):
        m = np.logaddexp(f[t - 1][:, :1] + step[0], f[t - 1][:, 1:] + step[1]) + e[:, t]
        f[t] = np.where(live[:, t, None], m, f[t - 1])
    b = np.zeros((width, rows, 2))
    b[width - 1] = end
    for t in range(width - 2, -1, -1):
        m = step[None] + (e[:, t + 1] + b[t + 1])[:, None, :]
        b[t] = np.where(live[:, t + 1, None], np.logaddexp(m[..., 0], m[..., 1]), end)
    total = np.logaddexp(f[-1][:, 0] + end[0], f[-1][:, 1] + end[1])
    one = np.exp(f[:, :, 1] + b[:, :, 1] - total).T
    per_item = np.zeros(len(ptr))
    per_item[place[live]] = (one - gold)[live]
    np.add.at(slope, ids, np.repeat(per_item, np.diff(np.append(ptr, len(ids)))))
    r = np.arange(rows)
    for y in (0, 1):
        slope[n + 4 + y] += ((one[:, 0] if y else 1 - one[:, 0]) - (gold[:, 0] == y)).sum()
        slope[n + 6 + y] += ((one[r, last] if y else 1 - one[r, last]) - (gold[r, last] == y)).sum()
    for x in (0, 1):
        for y in (0, 1):
            both = live[:, 1:]
            p = np.exp(f[:-1, :, x].T + step[x, y] + e[:, 1:, y] + b[1:, :, y].T - total[:, None])
            slope[n + 2 * x + y] += (p - ((gold[:, :-1] == x) & (gold[:, 1:] == y)))[both].sum()
