"""A linear-chain conditional random field in NumPy.

Labels depend on hashed features of each word and on the label before. Training
follows the gradient of the log-likelihood on a bounded sample; inference is
exact forward-backward, done in blocks so that one long text takes few steps:
each block's transfer matrix first, then the blocks of a text in turn, then all
blocks side by side.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np

BLOCK = 64
#: Bits of the feature space, and words a worker's score cache holds.
FEATURE_BITS = 18
CACHE_WORDS = 200_000


#: Scripts written without blanks: there a word is two letters.
_ASTRAL = "\U00020000"
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Characters that count as numbers without being digits, such as fractions.
NUMERALS = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


class Words:
    """The lower-cased words of a text and their places in it: runs of ``one``,
    the pattern of a character, that hold none of the characters ``without``."""

    def __init__(self, one: str, without: str = ""):
        self._plain = re.compile(f"{one}+")
        # One bitmap, as long as no character lies beyond the basic plane.
        self._odd = re.compile(f"[{_UNSPACED.split(_ASTRAL)[0]}{''.join(c for c in without if c <= '\uffff')}]")
        own = f"(?:(?![{without}]){one})" if without else one
        self._short = re.compile(f"(?:(?=[{_UNSPACED}]){own}){{1,2}}|(?:(?![{_UNSPACED}]){own})+")

    def _pattern(self, text: str) -> re.Pattern:
        if text.isascii() or not (self._odd.search(text) or len(text.encode("utf-16-le")) > 2 * len(text)):
            return self._plain
        return self._short

    def words(self, text: str) -> list[str]:
        low = text.lower()
        if len(low) == len(text):
            return self._pattern(low).findall(low)
        return [w.lower() for w in self._pattern(text).findall(text)]  # some letter is longer in lower case

    def places(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each of ``words``, in code points of the text."""
        low = text.lower()
        own = low if len(low) == len(text) else text
        return [m.span() for m in self._pattern(own).finditer(own)]


def affix_features(word: str) -> list[int]:
    """Hashed features: the word, prefixes of 3 to 9 bytes, suffixes of 2 to 5, and all inner trigrams."""
    b, mask = word.encode(), (1 << FEATURE_BITS) - 1
    n = len(b)
    out = [crc32(b) & mask]
    out += [crc32(b[:k], 1) & mask for k in range(3, min(9, n) + 1)]
    out += [crc32(b[-k:], 2) & mask for k in range(2, min(5, n) + 1)]
    out += [crc32(b[i : i + 3], 3) & mask for i in range(n - 2)]
    return out


def _blocks(lengths: np.ndarray):
    """Blocks of all texts: first token, length, text, and whether it begins the text."""
    per = -(-lengths // BLOCK)
    text = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    k = np.arange(per.sum()) - np.repeat(first, per)
    start = np.repeat(np.cumsum(lengths) - lengths, per) + k * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, per) - k * BLOCK)
    return start, size, k, per, first


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of each word's label, with scaled alphas and betas.

    scores: a row of label scores for each word of all texts, one after the
    other; lengths: words of each text; moves, begin: log potentials.
    """
    n, k = scores.shape
    if not n:
        return scores.copy(), scores.copy(), scores.copy()
    lengths = lengths[lengths > 0]
    u = np.exp(scores - scores.max(1, keepdims=True))
    a, pi = np.exp(moves - moves.max()), np.exp(begin - begin.max())
    start, size, nth, per, first = _blocks(lengths)
    order = np.argsort(-size, kind="stable")
    s_start, s_size, s_nth = start[order], size[order], nth[order]
    active = np.searchsorted(-s_size, -np.arange(BLOCK), "left")  # blocks longer than t

    transfer = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for t in range(BLOCK):
        m = active[t]
        if not m:
            break
        new = (transfer[:m].reshape(-1, k) @ a).reshape(m, k, k) if t else np.where((s_nth[:m] == 0)[:, None, None], transfer[:m], a)
        new = new * u[s_start[:m] + t][:, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        transfer[:m] = new
    by_block = np.empty_like(transfer)
    by_block[order] = transfer

    enter, leave = np.empty((len(order), k)), np.ones((len(order), k))
    texts = np.argsort(-per, kind="stable")
    s_first, s_per = first[texts], per[texts]
    enter[s_first] = pi
    for j in range(1, int(s_per[0])):
        at = s_first[: np.searchsorted(-s_per, -j, "left")] + j
        v = np.einsum("ij,ijk->ik", enter[at - 1], by_block[at - 1])
        enter[at] = v / v.sum(1, keepdims=True)
    for j in range(int(s_per[0]) - 1, 0, -1):
        at = s_first[: np.searchsorted(-s_per, -j, "left")] + j
        w = np.einsum("ijk,ik->ij", by_block[at], leave[at])
        leave[at - 1] = w / w.sum(1, keepdims=True)

    alpha, beta = np.empty_like(u), np.empty_like(u)
    into = enter[order]
    for t in range(BLOCK):
        m = active[t]
        if not m:
            break
        v = into[:m] if t == 0 else alpha[s_start[:m] + t - 1]
        moved = v @ a
        if t == 0:
            moved = np.where((s_nth[:m] == 0)[:, None], v, moved)
        moved = moved * u[s_start[:m] + t]
        alpha[s_start[:m] + t] = moved / moved.sum(1, keepdims=True)
    beta[s_start + s_size - 1] = leave[order]
    for t in range(BLOCK - 1, 0, -1):
        m = active[t]
        if m:
            at = s_start[:m] + t
            w = (u[at] * beta[at]) @ a.T
            beta[at - 1] = w / w.sum(1, keepdims=True)
    both = alpha * beta
    return both / both.sum(1, keepdims=True), alpha, beta


class ChainModel:
    """Weights of a trained field; small enough to broadcast (fixed by FEATURE_BITS)."""

    def __init__(self, labels: list, extra=None):
        self.labels, k = labels, len(labels)
        self.weights = np.zeros((1 << FEATURE_BITS, k), np.float32)
        self.moves, self.begin = np.zeros((k, k)), np.zeros(k)
        self.extra = extra or {}  # word: ids of lexicon features
        self.lexicon = np.zeros((k, k), np.float32)

    def features(self, word: str) -> list[int]:
        return affix_features(word)

    def score(self, word: str) -> np.ndarray:
        s = self.weights[affix_features(word)].sum(0)
        for i in self.extra.get(word, ()):
            s = s + self.lexicon[i]
        return s

    def fit(self, texts: list[list[str]], tags: list[np.ndarray], rounds: int = 30, rate: float = 0.3, l2: float = 1e-6, tag_weight: np.ndarray | None = None) -> "ChainModel":
        """AdaGrad on the mean log-likelihood gradient; words are cut into chains of BLOCK."""
        vocab: dict[str, int] = {}
        words = np.array([vocab.setdefault(w, len(vocab)) for t in texts for w in t], np.int64)
        gold = np.concatenate([np.asarray(t, np.int64) for t in tags]) if tags else np.zeros(0, np.int64)
        if not len(words):
            return self
        lengths = np.array([n for t in texts for n in [BLOCK] * (len(t) // BLOCK) + [len(t) % BLOCK] if n], np.int64)
        ids, counts = array("i"), array("i")
        for w in vocab:
            f = affix_features(w)
            ids.extend(f)
            counts.append(len(f))
        f_word = np.repeat(np.arange(len(counts), dtype=np.int32), np.frombuffer(counts, np.int32))
        used, f_id = np.unique(np.frombuffer(ids, np.int32), return_inverse=True)
        f_id = f_id.astype(np.int32)
        lex = [(i, j) for w, i in vocab.items() for j in self.extra.get(w, ())]
        lex_w, lex_f = np.array([x for x, _ in lex], np.int64), np.array([y for _, y in lex], np.int64)
        k, n, v = len(self.labels), len(words), len(vocab)
        weight = np.ones(n) if tag_weight is None else tag_weight[gold]
        first = np.zeros(n, bool)
        first[np.cumsum(lengths) - lengths] = True
        hot = np.zeros((n, k))
        hot[np.arange(n), gold] = 1
        theta = np.zeros((len(used), k))
        sums = [np.full(x, 1e-6) for x in ((len(used), k), (k, k), (k,), (k, k))]

        def step(x, g, acc):
            acc += g * g
            x += rate * g / np.sqrt(acc)

        def per(index, values, size):
            return np.stack([np.bincount(index, values[:, c], size) for c in range(k)], 1)

        def gather(index, source, at, size):
            return np.stack([np.bincount(index, source[at, c], size) for c in range(k)], 1)

        for _ in range(rounds):
            word_scores = gather(f_word, theta, f_id, v)
            if len(lex):
                word_scores += per(lex_w, self.lexicon[lex_f].astype(float), v)
            scores = word_scores[words]
            marginal, alpha, beta = forward_backward(scores, lengths, self.moves, self.begin)
            g = (hot - marginal) * weight[:, None]
            g_word = per(words, g, v)
            inner = np.flatnonzero(~first)
            right = np.exp(scores[inner] - scores[inner].max(1, keepdims=True)) * beta[inner]
            a = np.exp(self.moves - self.moves.max())
            left = alpha[inner - 1]
            z = np.einsum("ni,ij,nj->n", left, a, right)
            pair = a * ((left / z[:, None]).T @ right)
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
            step(theta, gather(f_id, g_word, f_word, len(used)) / n - l2 * theta, sums[0])
            step(self.moves, (seen - pair) / n, sums[1])
            step(self.begin, (hot - marginal)[first].sum(0) / n, sums[2])
            if len(lex):
                lex_g = np.stack([np.bincount(lex_f, g_word[lex_w][:, c], k) for c in range(k)], 1)
                step(self.lexicon, lex_g / n, sums[3])
        self.weights[used] = theta
        return self


class ChainScorer:
    """Marginals on a worker, with a bounded cache of word scores."""

    def __init__(self, model: ChainModel):
        self.model = model
        self._index: dict[str, int] = {}
        self._rows: list[np.ndarray] = []

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label marginals of the words of each text, texts whole."""
        if len(self._index) > CACHE_WORDS:
            self._index, self._rows = {}, []
        index, rows, score = self._index, self._rows, self.model.score
        flat = [w for t in texts for w in t]
        for w in set(flat).difference(index):
            index[w] = len(rows)
            rows.append(score(w))
        at = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(t) for t in texts], np.int64)
        k = len(self.model.labels)
        table = np.array(rows, np.float64).reshape(-1, k)
        m, _, _ = forward_backward(table[at], lengths, self.model.moves, self.model.begin)
        return np.split(m, np.cumsum(lengths)[:-1]) if len(lengths) else []
