"""Hashed subword bags: embeddings averaged into a linear softmax, trained jointly by stochastic gradient descent in numpy.

The features of a text are the byte n-grams of its words (A-Z lower-cased, each word between two spaces), hashed into
buckets. A class's score of a window is linear in the mean of its n-grams' embeddings, so for scoring the
product of embeddings and softmax weights is kept, a row of class scores for each bucket, unless there are more
classes than an embedding has numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SIZES = (2, 3, 4, 5)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[9:14] = 32


@dataclass
class Model:
    table: np.ndarray  # buckets x classes, or buckets x width
    bias: np.ndarray
    classes: list
    bits: int
    sizes: tuple[int, ...] = SIZES
    least: int = 1  # a window with fewer n-grams is filled up with empty ones
    heat: float = 1.0  # divides the logits: fitted on rows that training has not seen
    out: np.ndarray | None = None  # with many classes the table has embeddings, and these are the softmax weights
    shift: float = 0.0  # added to a text's log-odds: fitted likewise


def clean(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts after one another, each begun and ended by a space, lower-cased; and where each begins, with the end."""
    raw = np.frombuffer(b" " + b"\n ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    return _LOW[raw], np.concatenate(([0], ends))


def grams(low: np.ndarray, sizes: tuple[int, ...], bits: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the places and buckets (of 2 ** bits) of the n-grams that don't go over a word's end (a space may be first or last).

    Those that begin where skip is true are left out.
    """
    n, space = len(low), low == 32
    out, h, done = [], low.astype(np.uint64), 1
    letters = h + np.uint64(1)
    barred = np.zeros(n, bool)  # by a space strictly inside
    for size in sizes:
        while done < size and n > done:
            if done > 1:
                barred = barred[:-1] | space[done - 1 : n - 1]
            else:
                barred = barred[:-1]
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + letters[done:]
            done += 1
        if n < size:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        free = ~barred
        if size == 2:
            free &= ~(space[:-1] & space[1:])
        if skip is not None:
            free &= ~skip[: len(free)]
        at = np.flatnonzero(free)
        x = h[at]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((at, (x >> np.uint64(64 - bits)).astype(np.int64)))
    return out


def windows(low: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each window begins, its text): runs of so many words; 0 makes each text one window.

    What is left at a text's end goes to its last window, so only texts of fewer words have shorter ones.
    """
    n_text = len(starts) - 1
    if not words:
        return starts[:-1], np.arange(n_text)
    begin = np.flatnonzero((low[1:] != 32) & (low[:-1] == 32))  # the space before each word
    text = np.searchsorted(starts, begin, "right") - 1
    first = np.searchsorted(begin, starts[:-1])
    nth = np.arange(len(begin)) - first[text]
    count = np.bincount(text, minlength=n_text)
    keep = (nth % words == 0) & ((nth == 0) | (count[text] - nth >= words))
    has = count > 0
    at = np.concatenate((begin[keep], starts[:-1][~has]))
    of = np.concatenate((text[keep], np.flatnonzero(~has)))
    order = np.argsort(at, kind="stable")
    return at[order], of[order]


def repeats(low: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which bytes belong to a word (with the space before it) that its window has had before."""
    words = np.flatnonzero((low[1:] != 32) & (low[:-1] == 32))
    if not len(words):
        return np.zeros(len(low), bool)
    span = np.diff(words, append=len(low))
    place = np.arange(words[0], len(low)) - np.repeat(words, span)
    power = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
    letters = np.where(low[words[0] :] == 32, 0, low[words[0] :]).astype(np.uint64)
    value = np.add.reduceat(letters * power[place % 256], words - words[0])
    window = np.searchsorted(begins, words, "right").astype(np.uint64)
    _, first = np.unique(value ^ (window * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
    again = np.ones(len(words), bool)
    again[first] = False
    out = np.zeros(len(low), bool)
    out[words[0] :] = np.repeat(again, span)
    return out


def window_logits(model: Model, low: np.ndarray, begins: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """Mean class scores of each window's n-grams, with the bias; a window without n-grams has the bias alone."""
    k = model.table.shape[1]
    sums, count = np.zeros((k, len(low))), np.zeros(len(low), np.int32)
    columns = np.ascontiguousarray(model.table.T)
    used = [c for c in range(k) if columns[c].any()]
    for at, bucket in grams(low, model.sizes, model.bits, skip):
        count[at] += 1
        for c in used:
            sums[c][at] += columns[c][bucket]
    n = np.maximum(np.add.reduceat(count, begins), model.least)
    means = np.stack([np.add.reduceat(x, begins) / n for x in sums], axis=1)
    return ((means if model.out is None else means @ model.out) + model.bias) / model.heat


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def chunks(texts: list[bytes], size: int = 1 << 18):
    """Runs of texts of about so many bytes: (first, texts)."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        total += len(t)
        if total >= size:
            yield first, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, held


class Trainer:
    """Embeddings (2 ** bits x width) and softmax weights (width x classes), trained together with AdaGrad steps."""

    def __init__(self, classes: list, bits: int, width: int, sizes: tuple[int, ...], seed: int, rate: float, least: int = 1):
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1, 1, (1 << bits, width)).astype(np.float32) / width
        self.w = rng.normal(0, 0.5, (width, len(classes))).astype(np.float32)
        self.b = np.zeros(len(classes), np.float32)
        self.ge, self.gw, self.gb = np.full(1 << bits, 1e-6, np.float32), np.full_like(self.w, 1e-6), np.full_like(self.b, 1e-6)
        self.classes, self.bits, self.sizes, self.rate, self.least, self.rng = classes, bits, sizes, rate, least, rng

    def model(self) -> Model:
        if len(self.classes) > self.w.shape[0]:
            return Model(self.e.astype(float), self.b.astype(float), self.classes, self.bits, self.sizes, self.least, out=self.w.astype(float))
        return Model((self.e @ self.w).astype(float), self.b.astype(float), self.classes, self.bits, self.sizes, self.least)

    def step(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        """One step on a batch: the buckets of each window, its class, its weight."""
        size = np.array([len(x) for x in bags])
        if not size.sum():
            return
        f = np.concatenate(bags)
        owner = np.repeat(np.arange(len(bags)), size)
        share = (1.0 / np.maximum(size, self.least)).astype(np.float32)
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        h = np.add.reduceat(np.vstack([self.e[f], np.zeros((1, self.e.shape[1]), np.float32)]), np.minimum(at, len(f)), axis=0) * (share * (size > 0))[:, None]
        p = softmax(h @ self.w + self.b)
        p[np.arange(len(y)), y] -= 1
        p = (p * weight[:, None] / weight.sum()).astype(np.float32)
        gw, gb, gh = h.T @ p, p.sum(axis=0), (p @ self.w.T) * share[:, None]
        self.gw += gw**2
        self.gb += gb**2
        self.w -= self.rate * gw / np.sqrt(self.gw)
        self.b -= self.rate * gb / np.sqrt(self.gb)
        order = np.argsort(f, kind="stable")
        fs = f[order]
        cut = np.concatenate(([0], np.flatnonzero(fs[1:] != fs[:-1]) + 1))
        g = np.add.reduceat(gh[owner[order]], cut, axis=0)
        u = fs[cut]
        self.ge[u] += (g**2).mean(axis=1)
        self.e[u] -= self.rate * g / np.sqrt(self.ge[u])[:, None]


def window_bags(low: np.ndarray, begins: np.ndarray, sizes: tuple[int, ...], bits: int, chosen: np.ndarray, skip: np.ndarray | None = None) -> list[np.ndarray]:
    """The buckets of each chosen window (a sorted list of window numbers)."""
    parts, owner, number = [], [], np.zeros(len(low), np.int64)
    number[begins[1:]] = 1
    number = np.cumsum(number)
    for at, bucket in grams(low, sizes, bits, skip):
        w = number[at]
        j = np.searchsorted(chosen, w)
        hit = (j < len(chosen)) & (chosen[np.minimum(j, len(chosen) - 1)] == w)
        parts.append(bucket[hit])
        owner.append(j[hit])
    f, o = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return np.split(f[order], np.cumsum(np.bincount(o, minlength=len(chosen)))[:-1])


def fit_heat(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that training has not seen."""
    best = (np.inf, 1.0)
    for heat in np.geomspace(0.25, 8, 41):
        p = softmax(logits / heat)[np.arange(len(y)), y]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(heat)))
    return best[1]


def fit_odds(z: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """(slope, shift) of the log-odds slope * z + shift that fit labels y (0 or 1) best, by Newton steps; a ridge holds the slope near 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        w = p * (1 - p)
        grad = np.array([((p - y) * z).sum() + ridge * (a - 1), (p - y).sum()])
        hess = np.array([[(w * z * z).sum() + ridge, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / np.abs(step).max(initial=1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)
