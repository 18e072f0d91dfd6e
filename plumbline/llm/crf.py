"""A linear-chain conditional random field over words, in numpy.

A word's score for each language is the sum of the weights of its features: affixes, letter n-grams
and membership in the lexicon of each language. Transitions between neighbouring words are learned
too. Forward-backward runs over many chains at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

LETTERS = re.compile(r"[^\W\d_]+")  # and numbers that are no digits, such as superscripts
BUCKETS = 1 << 17
CHAIN = 256
LONGEST = 32
KEPT_WORDS = 200_000


def core(chunk: str) -> str:
    """The letters of a chunk in lower case; empty if it has none."""
    found = "".join(LETTERS.findall(chunk))
    return (found if found.isalpha() else "".join(filter(str.isalpha, found))).lower()


def chunks(text: str) -> list[str]:
    """Words of a text between white space, over-long ones in pieces."""
    words = text.split()
    if words and len(max(words, key=len)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of unsigned 64-bit values, apart for each kind of feature."""
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(47)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int], unused: int) -> np.ndarray:
    """One row of hashed features per word: bigrams, trigrams, affixes of up to four letters, lexicon mark.

    Words are given by their letters; places without a feature hold `unused`.
    """
    n = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4")
    width = int(n.max()) + 2
    letters = np.zeros((len(words), width), np.uint64)
    letters[np.arange(width) < (n + 2)[:, None]] = flat
    one, two = np.uint64(0x100000001B3), np.uint64(0xC2B2AE3D27D4EB4F)
    pairs = letters[:, :-1] * one + letters[:, 1:]
    found = [np.where(letters[:, 1:] > 0, _bucket(pairs, 2), unused)]
    if width > 2:
        found.append(np.where(letters[:, 2:] > 0, _bucket(pairs[:, :-1] * two + letters[:, 2:], 3), unused))
    rows = np.arange(len(words))
    front = back = np.zeros(len(words), np.uint64)
    for k in range(1, 5):
        front = front * one + letters[rows, np.minimum(k, width - 1)]
        back = back * one + letters[rows, np.maximum(n + 1 - k, 0)]
        for kind, h in ((10 + k, front), (20 + k, back)):
            found.append(np.where(n >= k, _bucket(h, kind), unused)[:, None])
    found.append(np.array([[BUCKETS + lexicon.get(w, 0)] for w in words], np.int64))
    return np.concatenate(found, axis=1)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word and expected transitions.

    emit: (chains, longest, labels) scores; lengths descending. Each step handles the chains that
    reach so far; values are scaled to sum to one at every step.
    """
    chains, longest, labels = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    a = np.exp(transit - transit.max())
    live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # chains longer than t
    forward = np.zeros_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, longest):
        f = (forward[: live[t], t - 1] @ a) * e[: live[t], t]
        forward[: live[t], t] = f / f.sum(1, keepdims=True)
    back = np.ones((chains, labels))
    marginals, expected = np.zeros_like(e), np.zeros((labels, labels))
    for t in range(longest - 1, -1, -1):
        m = forward[: live[t], t] * back[: live[t]]
        marginals[: live[t], t] = m / m.sum(1, keepdims=True)
        if t:
            after = e[: live[t], t] * back[: live[t]]
            both = forward[: live[t], t - 1, :, None] * a * after[:, None, :]
            expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
            b = after @ a.T
            back[: live[t]] = b / b.sum(1, keepdims=True)
    return marginals, expected


class Field:
    """Weights (features x labels), transitions and the lexicon; made by `train`."""

    def __init__(self, labels: list[str], weights: np.ndarray, transit: np.ndarray, lexicon: dict[str, int]):
        self.labels, self.weights, self.transit, self.lexicon = labels, weights, transit, lexicon
        self.place: dict[str, int] = {}  # chunk -> row of scores, -1 without letters
        self.row: dict[str, int] = {}  # letters of a chunk -> row of scores
        self.scores = np.zeros((0, len(labels)), np.float32)

    def _learn(self, unseen: list[str]) -> None:
        """Scores of chunks not seen before by this worker."""
        cores = [core(c) for c in unseen]
        new = sorted({w for w in cores if w}.difference(self.row), key=len)
        added = [self.scores]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            added.append(self.weights[features(some, self.lexicon, len(self.weights) - 1)].sum(1))
            self.row.update(zip(some, range(len(self.row), len(self.row) + len(some))))
        self.scores = np.concatenate(added)
        self.place.update((c, self.row[w] if w else -1) for c, w in zip(unseen, cores))

    def predict(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """Language and its mean marginal over the words of each text; (None, 0) without letters."""
        split = [chunks(t) for t in texts]
        seen = set().union(*split)
        unseen = seen.difference(self.place)
        if unseen and len(self.place) + len(unseen) > KEPT_WORDS:
            self.place, self.row, self.scores, unseen = {}, {}, self.scores[:0], seen
        if unseen:
            self._learn(list(unseen))
        place = self.place
        codes = [np.fromiter(map(place.__getitem__, words), np.int64, len(words)) for words in split]
        codes = [c[c >= 0] for c in codes]
        parts = [(i, c[at : at + CHAIN]) for i, c in enumerate(codes) for at in range(0, len(c), CHAIN)]
        sums = np.zeros((len(texts), len(self.labels)))
        parts.sort(key=lambda p: -len(p[1]))
        for at in range(0, len(parts), 2048):
            some = parts[at : at + 2048]
            lengths = np.array([len(c) for _, c in some])
            padded = np.zeros((len(some), lengths[0]), np.int64)
            for row, (_, c) in zip(padded, some):
                row[: len(c)] = c
            marginals, _ = forward_backward(self.scores[padded], lengths, self.transit)
            np.add.at(sums, [i for i, _ in some], marginals.sum(1))
        found = []
        for total, c in zip(sums, codes):
            best = int(total.argmax()) if len(c) else -1
            found.append((self.labels[best], float(min(1.0, total[best] / len(c)))) if best >= 0 else (None, 0.0))
        return found


def train(samples: list[tuple[str, str]], rounds: int = 30, seed: int = 7) -> Field | None:
    """A field from (text, language) samples, or None if they hold no word.

    Every other sample of a language gives the lexicon, the others the chains, so lexicon marks are
    learned on words that did not make them. Chains are runs of words of several samples one after
    another, as in code-switched text.
    """
    labels = sorted({lang for _, lang in samples})
    draw = np.random.default_rng(seed)
    counts: list[Counter] = [Counter() for _ in labels]
    runs: list[tuple[int, list[str]]] = []
    turn: Counter = Counter()
    for text, lang in samples:
        words = [w for w in map(core, chunks(text)) if w]
        label = labels.index(lang)
        turn[label] += 1
        if turn[label] % 2 == 0:
            counts[label].update(words)
        if turn[label] % 2 or len(labels) == 1:
            at = 0
            while at < len(words):
                n = int(draw.integers(4, 40))
                runs.append((label, words[at : at + n]))
                at += n
    if not runs:
        return None
    total: Counter = Counter()
    for c in counts:
        total.update(c)
    lexicon = {
        w: 1 + i for i, c in enumerate(counts) for w, n in c.items() if n >= 2 and 10 * n >= 9 * total[w]
    }
    order = draw.permutation(len(runs))
    chains = [[runs[i] for i in order[at : at + 4]] for at in range(0, len(order), 4)]
    chains.sort(key=lambda chain: -sum(len(w) for _, w in chain))
    lengths = np.array([sum(len(w) for _, w in chain) for chain in chains])
    place: dict[str, int] = {}
    codes = np.zeros((len(chains), lengths[0]), np.int64)
    truth = np.zeros_like(codes)
    for r, chain in enumerate(chains):
        words = [(place.setdefault(w, len(place)), label) for label, run in chain for w in run]
        codes[r, : len(words)], truth[r, : len(words)] = zip(*words)
    size, n = BUCKETS + 2 + len(labels), len(labels)
    found = features(list(place), lexicon, size - 1)
    owner, at = np.nonzero(found < size - 1)
    index = found[owner, at]
    weights, transit = np.zeros((size, n)), np.zeros((n, n))
    inside = np.arange(lengths[0]) < lengths[:, None]
    real = np.eye(n)[truth] * inside[:, :, None]
    steps = inside[:, 1:]
    seen = np.zeros((n, n))
    np.add.at(seen, (truth[:, :-1][steps], truth[:, 1:][steps]), 1)
    square_w, square_t = np.full_like(weights, 1e-6), np.full_like(transit, 1e-6)
    scale = 1 / inside.sum()
    for _ in range(rounds):
        scores = np.zeros((len(found), n))
        for k in range(n):
            scores[:, k] = np.bincount(owner, weights[index, k], len(found))
        marginals, expected = forward_backward(scores[codes], lengths, transit)
        missing = (real - marginals)[inside]
        words = codes[inside]
        for k in range(n):
            per_word = np.bincount(words, missing[:, k], len(found))
            gradient = scale * np.bincount(index, per_word[owner], size) - 1e-6 * weights[:, k]
            square_w[:, k] += gradient**2
            weights[:, k] += 0.3 * gradient / np.sqrt(square_w[:, k])
        gradient = scale * (seen - expected) - 1e-6 * transit
        square_t += gradient**2
        transit += 0.3 * gradient / np.sqrt(square_t)
    return Field(labels, weights.astype(np.float32), transit, lexicon)
