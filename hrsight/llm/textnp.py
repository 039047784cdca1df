"""Vectorised word helpers shared by the operators that run inside tasks.

A batch of texts is laid out as one byte buffer with a blank after every text,
so no word crosses a text. Words are maximal runs of bytes other than
`[\\x20\\x09-\\x0D]`; they are fingerprinted by a polynomial over per-byte random
values, finished with a 64-bit mixer.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix64(x):
    """Bijective 64-bit finaliser (splitmix64 constants)."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))
_LOWER = _BYTE.copy()
_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_powers: dict[int, np.ndarray] = {}


def powers(base, n):
    """base**0 .. base**(n-1) modulo 2**64, kept between batches of a worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, int(n * 1.25))
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def buffer_of(texts):
    """One byte buffer, and the offset at which each text starts (plus the total)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    return np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8), starts


def words_of(texts, lower=False):
    """(fingerprint of each word, first word of each text plus the total, word starts, word ends)."""
    buf, at = buffer_of(texts)
    if len(texts) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U64), np.zeros(1, dtype=np.int64), none, none
    blank = _BLANK[buf]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    n = len(buf)
    with np.errstate(over="ignore"):
        run = np.empty(n + 1, dtype=U64)
        run[0] = 0
        np.cumsum((_LOWER if lower else _BYTE)[buf] * powers(_BASE, n), out=run[1:])
        h = mix64((run[end] - run[start]) * powers(_INV, n)[start] + (end - start).astype(U64))
    return h, np.searchsorted(start, at), start, end


def gram_hashes(h, first, k):
    """Fingerprints of all k-word windows; the window at word i belongs to i's text.

    Returns (fingerprints, first window of each text plus the total). A text
    with 1..k-1 words has one window, its whole word sequence.
    """
    n = np.diff(first)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(h) - k + 1), dtype=U64)
        for j in range(k):
            acc = mix64(acc * U64(0xD6E8FEB86659FD93) + h[j : j + len(acc)])
    full = np.maximum(n - k + 1, 0)
    count = np.where((n > 0) & (full == 0), 1, full)
    begin = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(begin[-1], dtype=U64)
    owner = np.repeat(np.arange(len(n)), full)
    within = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(full)))[:-1], full)
    out[begin[owner] + within] = acc[first[owner] + within]
    for d in np.flatnonzero((n > 0) & (full == 0)):
        x = U64(n[d])
        with np.errstate(over="ignore"):
            for j in range(first[d], first[d + 1]):
                x = mix64(x * U64(0xA0761D6478BD642F) + h[j])
        out[begin[d]] = x
    return out, begin


_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[_BLANK] = 0
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_CLASS[0x30:0x3A] = 2


def tokens_of(texts):
    """(fingerprint of each token, first token of each text plus the total).

    Tokens are maximal runs of letters, of digits, or of other non-blank bytes; case counts.
    """
    buf, at = buffer_of(texts)
    if len(texts) == 0:
        return np.zeros(0, dtype=U64), np.zeros(1, dtype=np.int64)
    kind = _CLASS[buf]
    start = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    end = np.append(start[1:], len(buf))
    real = kind[start] != 0
    start, end = start[real], end[real]
    n = len(buf)
    with np.errstate(over="ignore"):
        run = np.empty(n + 1, dtype=U64)
        run[0] = 0
        np.cumsum(_BYTE[buf] * powers(_BASE, n), out=run[1:])
        h = mix64((run[end] - run[start]) * powers(_INV, n)[start] + (end - start).astype(U64))
    return h, np.searchsorted(start, at)
