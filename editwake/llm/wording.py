"""A linear model of wording: does a passage read like a filler or error message rather than like the texts around it?"""

from __future__ import annotations

import numpy as np

#: Weights of hashed character n-grams.
SLOTS = 1 << 16
GRAMS = (2, 3, 4, 5)
EPOCHS = 12
_PRIMES = np.array([2_654_435_761, 2_246_822_519, 3_266_489_917, 668_265_263, 374_761_393], np.uint32)  # fixed values: odd mixing factors


def _slots(passages: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Slot of the n-gram at each character, for each n, of all passages one after another; where passages start and end.

    Passages are taken with a blank on either side; every digit counts as 0.
    """
    codes = np.frombuffer(("".join(f" {p} " for p in passages)).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    ends = np.cumsum([len(p) + 2 for p in passages]) if passages else np.zeros(0, int)
    starts = np.r_[0, ends[:-1]] if passages else ends
    out = []
    for n in GRAMS:
        if len(codes) < n:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * _PRIMES[k]
            h ^= h >> np.uint32(15)
        out.append((h % np.uint32(SLOTS)).astype(np.int64))
    return out, starts, ends


class Wording:
    """score() above 0: like the positive examples; below: like the others. Passages of any length and script."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, passages: list[str]) -> np.ndarray:
        if not passages:
            return np.zeros(0)
        grams, starts, ends = _slots(passages)
        total, number = np.zeros(len(passages)), np.zeros(len(passages))
        for n, slots in zip(GRAMS, grams, strict=True):
            upto = np.r_[0.0, np.cumsum(self.weights[slots])]
            last = np.maximum(starts, ends - n + 1)
            total += upto[np.minimum(last, len(slots))] - upto[np.minimum(starts, len(slots))]
            number += last - starts
        return total / np.sqrt(np.maximum(number, 1)) + self.bias


def fit(positive: list[str], other: dict[str, int], seed: int = 1) -> Wording:
    """Logistic regression by gradient steps of falling size, of positive examples against others with their frequencies.

    A passage weighs as often as it was met, 20 times at most; the positive ones together weigh half as much as the others.
    """
    rng = np.random.default_rng(seed)
    rows = []
    often = [float(min(20, n)) for n in other.values()]
    each = sum(often) / max(1, len(positive)) / 2
    for examples, label, weights in ((positive, 1.0, [each] * len(positive)), (list(other), 0.0, often)):
        grams, starts, ends = _slots(examples)
        for s, e, weight in zip(starts.tolist(), ends.tolist(), weights, strict=True):
            slots = np.unique(np.concatenate([g[s : max(s, e - n + 1)] for n, g in zip(GRAMS, grams, strict=True)]))
            if len(slots):
                rows.append((slots, label, min(weight, 40.0)))
    w, squares, bias = np.zeros(SLOTS), np.full(SLOTS, 1e-8), 0.0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            slots, label, weight = rows[i]
            scale = len(slots) ** -0.5
            error = (1 / (1 + np.exp(-(w[slots].sum() * scale + bias))) - label) * weight
            if abs(error) < 1e-3:
                continue
            step = error * scale + 1e-5 * w[slots]
            squares[slots] += step * step
            w[slots] -= 0.3 * step / np.sqrt(squares[slots])
            bias -= 0.01 * error
    return Wording(w, bias)
