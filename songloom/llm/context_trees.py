"""Context-tree weighting over bytes: counts, weights and predictions of all contexts, in numpy on sorted codes.

A byte is eight binary decisions, a walk down 255 inner nodes. Each node has its own tree of contexts, the bytes that come
before, up to ``depth`` of them. A context's estimate after n0 zeros and n1 ones is that of Krichevsky and Trofimov. Its weighted
probability is the mean of its estimate's and the product of the weighted probabilities of the contexts one byte longer; at full
depth it is the estimate's alone. A prediction mixes the estimates along the way from the empty context to the full one, each with
the share it has earned.

A code holds a context and the byte after it, the byte before in the highest place: ``c1 c2 .. cd x``. Sorted by code all
contexts that end alike stand together, and so do the binary nodes of a context at any bit, so sums are runs.
"""

from __future__ import annotations

import math

import numpy as np

#: Logarithms of the gamma function at whole and half numbers up to here come from a table, beyond from Stirling's series.
TABLE = 4096
_WHOLE = np.array([math.lgamma(n + 1.0) for n in range(TABLE)])
_HALF = np.array([math.lgamma(n + 0.5) for n in range(TABLE)])
_LOG_PI, _LOG_HALF = math.log(math.pi), math.log(0.5)


def _log_gamma(n: np.ndarray, shift: float, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(n, TABLE - 1)]
    large = n >= TABLE
    if large.any():
        x = n[large] + shift
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(n0, 0.5, _HALF) + _log_gamma(n1, 0.5, _HALF) - _log_gamma(n0 + n1, 1.0, _WHOLE) - _LOG_PI


def log_weighted(estimate: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Logarithm of the mean of the estimate's probability and that of the longer contexts."""
    return np.logaddexp(estimate, longer) + _LOG_HALF


def share(estimate: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """What a context's own estimate has earned of its weighted probability."""
    return np.exp(estimate - weighted + _LOG_HALF)


class Level:
    """Contexts of one length: per bit the node keys (context, bits so far), zeros, ones and log probabilities."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes, counts
        self.keys, self.node_of, self.n0, self.n1, self.estimate = [], [], [], [], []
        self.weighted: list[np.ndarray] = []
        self.parent: list[np.ndarray] = []
        for bit in range(8):
            key = codes >> (8 - bit)
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            one = counts * ((codes >> (7 - bit)) & 1)
            total, ones = (np.add.reduceat(v, starts) if len(starts) else v for v in (counts, one))
            self.keys.append(key[starts])
            self.node_of.append(np.cumsum(new) - 1)
            self.n0.append(total - ones)
            self.n1.append(ones)
            self.estimate.append(log_estimate(total - ones, ones))

    def shorter(self) -> Level:
        """Contexts without their oldest byte."""
        codes = (self.codes >> 16 << 8) | (self.codes & 255)
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        counts = np.add.reduceat(self.counts[order], starts) if len(starts) else self.counts
        return Level(codes[starts], counts)

    def lift(self, parent: Level) -> None:
        """Find each node's parent, and weigh the parent's nodes."""
        parent.weighted = []
        for bit in range(8):
            up = (self.keys[bit] >> (bit + 8) << bit) | (self.keys[bit] & ((1 << bit) - 1))
            place = np.searchsorted(parent.keys[bit], up)
            self.parent.append(place)
            longer = np.bincount(place, weights=self.weighted[bit], minlength=len(parent.keys[bit]))
            parent.weighted.append(log_weighted(parent.estimate[bit], longer))


def lifted(codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels ``depth`` to ``top`` over sorted distinct codes, all weighted."""
    levels = [Level(codes, counts)]
    levels[0].weighted = list(levels[0].estimate)
    for _ in range(depth - top):
        parent = levels[-1].shorter()
        levels[-1].lift(parent)
        levels.append(parent)
    return levels


def rows_of(level: Level) -> tuple[np.ndarray, ...]:
    """Context, node number (1 to 255), zeros, ones, weighted, one row per node."""
    context = np.concatenate([k >> bit for bit, k in enumerate(level.keys)])
    node = np.concatenate([(1 << bit) | (k & ((1 << bit) - 1)) for bit, k in enumerate(level.keys)])
    return context, node, *(np.concatenate(v) for v in (level.n0, level.n1, level.weighted))


def log_chances(levels: list[Level], going: list[np.ndarray], said: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each code's predicted probability.

    ``going`` and ``said`` come from above for the nodes of the last level, per bit: the share that is still to be given, and
    the chance of a one as far as it has been given.
    """
    out = np.zeros(len(levels[0].codes))
    for bit in range(8):
        left, chance = going[bit], said[bit]
        for at in range(len(levels) - 1, -1, -1):
            level = levels[at]
            own = (level.n1[bit] + 0.5) / (level.n0[bit] + level.n1[bit] + 1.0)
            if at == 0:
                chance = chance + left * own
                break
            part = share(level.estimate[bit], level.weighted[bit])
            chance, left = chance + left * part * own, left * (1 - part)
            below = levels[at - 1].parent[bit]
            chance, left = chance[below], left[below]
        chance = chance[levels[0].node_of[bit]]
        one = (levels[0].codes >> (7 - bit)) & 1
        out += np.log(np.where(one == 1, chance, 1 - chance))
    return out
