"""A maximum-entropy classifier over hashed categorical features, fitted from positive and unlabelled examples."""

from __future__ import annotations

import numpy as np

from millrace.functions.codepoints import mix

BITS = 18
#: A class with fewer held-out labelled examples is not judged, but has the chance that it is given.
FEW = 10


def hashed(features: list[np.ndarray]) -> np.ndarray:
    """One column of weight indices per feature; the feature's number is part of its hash."""
    out = np.empty((len(features[0]), len(features)), np.int32)
    for k, values in enumerate(features):
        salted = np.asarray(values).astype(np.uint64) + np.uint64((k + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        out[:, k] = (mix(salted) >> np.uint64(64 - BITS)).astype(np.int32)
    return out


class MaxEnt:
    """P(y | features) with one weight per hashed feature.

    The examples are positive or unlabelled. With the chance ``reach[k]`` that a true boundary of
    class k was labelled, P(true) = P(labelled) / reach[k] (Elkan and Noto, 2008). ``least[k]`` is
    the chance from which on an example of class k is taken for true.
    """

    def __init__(self, weights: np.ndarray, reach: np.ndarray, least: np.ndarray):
        self.weights, self.reach, self.least = weights, reach, least

    @classmethod
    def untrained(cls, least: np.ndarray) -> MaxEnt:
        return cls(np.zeros(1 << BITS, np.float32), np.ones(len(least), np.float32), least.astype(np.float32))

    @classmethod
    def fit(cls, features: np.ndarray, labelled: np.ndarray, kinds: np.ndarray, least: np.ndarray) -> MaxEnt:
        """``least``: for classes with too few labelled examples to fit it on."""
        own, partly = cls.untrained(least), cls.untrained(least)
        if not len(features) or not labelled.any():
            return own
        # reach and least are taken from examples that the weights were not fitted on
        half = np.arange(len(labelled)) % 2 == 0
        partly.weights = _weights(features[half], labelled[half])
        p, kind, positive = partly.chance(features[~half], kinds[~half]), kinds[~half], labelled[~half]
        for k in range(len(least)):
            of_kind = p[(kind == k) & positive]
            if len(of_kind) >= FEW:
                own.reach[k] = max(of_kind.mean(), 1e-3)
                own.least[k] = _parting(p[(kind == k) & ~positive] / own.reach[k], of_kind / own.reach[k])
        own.weights = _weights(features, labelled)
        return own

    def chance(self, features: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-self.weights[features].sum(1)))
        return np.minimum(1, p / self.reach[kinds])

    def accepts(self, features: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return self.chance(features, kinds) >= self.least[kinds]


def _parting(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The chance that parts the true and the false unlabelled examples with the fewest mistakes, but no more than that of all but a hundredth of the positive ones, and less where those are few, as their tail is then not seen.

    If hardly any is less likely than nearly all positive ones, there are no false ones, and half
    of the least positive chance is enough. Else the unlabelled are a mixture of ones like the
    positive and of false ones; the part of the former is told from the likely half.
    """
    below = (unlabelled < np.quantile(positive, 0.005)).sum()
    if below < 0.1 * len(unlabelled) or not below:
        return float(positive.min()) / 2
    middle = np.median(positive)
    part = min(1.0, (unlabelled >= middle).mean() / (positive >= middle).mean())
    places = np.exp(np.linspace(np.log(1e-3), np.log(middle), 300))
    lost = np.searchsorted(np.sort(positive), places) / len(positive)
    taken = 1 - np.searchsorted(np.sort(unlabelled), places) / len(unlabelled)
    mistakes = 2 * part * lost + taken
    best = np.flatnonzero(mistakes <= mistakes.min() + 1e-9)
    return float(min(places[best[len(best) // 2]], np.quantile(positive, 0.01) * len(positive) / (len(positive) + 50)))


def _weights(features: np.ndarray, labelled: np.ndarray, rounds: int = 150, decay: float = 1.0, least: int = 8) -> np.ndarray:
    """Penalised maximum likelihood; features seen fewer than ``least`` times get no weight."""
    weights = np.zeros(1 << BITS, np.float32)
    used, small, seen = np.unique(features, return_inverse=True, return_counts=True)
    small = small.reshape(features.shape)
    known = seen >= least
    w = np.zeros(len(used))
    m, v = np.zeros_like(w), np.zeros_like(w)
    y = labelled.astype(float)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-w[small].sum(1)))
        slope = (np.bincount(small.ravel(), np.repeat(p - y, small.shape[1]), len(used)) + decay * w) * known / np.sqrt(seen)
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-3) / (1 + t / 40)
    weights[used] = w
    return weights
