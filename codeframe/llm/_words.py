"""Words of many texts at once, as numpy arrays over one byte buffer.

Words are ``[^\\x20\\x09-\\x0D]+`` on UTF-8 bytes, which equals the same on code
points.  Hashes are polynomials over random odd byte values modulo 2**64 with a
final mix, taken from one prefix sum, so that any stretch costs two look-ups.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_B = 0x9E3779B97F4A7C15
_TABLE = np.random.RandomState(20240607).randint(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, _U)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


class Hasher:
    """Hashes of stretches of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_TABLE[data] * powers(_B, n), out=self.sums[1:])
        self.back = powers(pow(_B, -1, 2**64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


class Words:
    """Word bounds of the texts ``data[offs[i]:offs[i+1]]``, and the text that each is in."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n_docs = data, offs, len(offs) - 1
        solid = ~WHITE[data]
        edge = np.ones(len(data) + 1, bool)  # a word may start here or end before here
        if len(data):
            edge[1:-1] = solid[1:] != solid[:-1]
            edge[offs] = True
        at = np.nonzero(edge)[0]
        pick = solid[at[:-1]] if len(data) else np.zeros(0, bool)
        self.start, self.end = at[:-1][pick], at[1:][pick]
        first = np.searchsorted(self.start, offs)
        self.first, self.per_doc = first[:-1], np.diff(first)
        self.doc = np.repeat(np.arange(self.n_docs), self.per_doc)
        self.solid = solid

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offs[1:]] - sums[self.offs[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of one text."""
    return mix(hashes + doc.astype(_U) * _U(0xA24BAED4963EE407))


def windows(w: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of ``size`` words inside a text, and the index of each one's first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.nonzero(w.doc[:n] == w.doc[size - 1 :])[0]
    out = h[at]
    for k in range(1, size):
        out = mix(out * _U(0xC2B2AE3D27D4EB4F) + h[at + k])
    return out, at


def base_counts(w: Words, hasher: Hasher, h: np.ndarray) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of each text, and n_words."""
    data, offs = w.data, w.offs
    out = {"n_words": w.per_doc.astype(np.int64)}
    out["word_chars"] = w.per_text(w.solid & ((data & 0xC0) != 0x80))
    out["n_symbols"] = w.per_text(SYMBOLS[data])
    # lines: between line ends and text bounds
    cut = np.unique(np.concatenate([offs, np.nonzero(data == 10)[0] + 1]))
    ls, le = cut[:-1], cut[1:]
    le = le - (data[le - 1] == 10) if len(le) else le
    filled = np.searchsorted(w.start, le) > np.searchsorted(w.start, ls)
    ls, le = ls[filled], le[filled]
    ld = np.searchsorted(offs, ls, side="right") - 1
    lines = np.bincount(ld, minlength=w.n_docs)
    _, one = np.unique(in_doc(hasher(ls, le), ld), return_index=True)
    out["n_dup_lines"] = (lines - np.bincount(ld[one], minlength=w.n_docs)).astype(np.int64)
    g, at = windows(w, h, 3)
    covered = np.zeros(len(h) + 2, bool)
    hit = at[repeated(in_doc(g, w.doc[at]))]
    for k in range(3):
        covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(w.doc, weights=covered[: len(h)], minlength=w.n_docs).astype(np.int64)
    return out


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the texts as numbers, and offsets into them; bytes where a text is no UTF-8."""
    lead = (data & 0xC0) != 0x80
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(codes) != int(lead.sum()):
        return data.astype(np.uint32), offs
    return codes, np.concatenate([[0], np.cumsum(lead)])[offs]


def hashed_counts(w: Words, h: np.ndarray, n_word: int, n_char: int, floor: float = 1) -> np.ndarray:
    """A row per text: square roots of the shares of word 1- and 2-grams in ``n_word`` bins, and of character 3-grams in ``n_char``.

    Shares are of at least ``floor`` grams, which holds short texts near zero.
    """
    n = w.n_docs
    two, at = windows(w, h, 2)
    bins = np.concatenate([w.doc * n_word + (h % _U(n_word)).astype(np.int64), w.doc[at] * n_word + (two % _U(n_word)).astype(np.int64)])
    word = np.bincount(bins, minlength=n * n_word).reshape(n, n_word).astype(np.float32)
    d, offs = code_points(w.data, w.offs)
    if len(d) >= 3:
        code = d[:-2] * np.uint32(0x85EBCA6B)
        code += d[1:-1]
        code *= np.uint32(0xC2B2AE35)
        code += d[2:]
        code *= np.uint32(0x9E3779B1)
        code >>= np.uint32(32 - int(n_char).bit_length() + 1)
        doc = np.repeat(np.arange(n, dtype=np.int64) * n_char, np.diff(offs))[:-2]
        inside = np.ones(len(code), bool)
        for k in (1, 2):
            cross = offs[1:-1] - k
            inside[cross[(cross >= 0) & (cross < len(code))]] = False
        char = np.bincount((doc + code)[inside], minlength=n * n_char).reshape(n, n_char).astype(np.float32)
    else:
        char = np.zeros((n, n_char), np.float32)
    for x in (word, char):
        x /= np.maximum(x.sum(1, keepdims=True), floor)
        np.sqrt(x, out=x)
    return np.concatenate([word, char], 1)
