"""Vectorised 64-bit hashes of words and word sequences.

A word's hash is a polynomial over a random byte table, taken from differences of
running sums, so a block of text costs a fixed number of NumPy passes whatever
its words are. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
CHUNK = 1 << 18  # bytes hashed at a time; a worker holds some ten arrays of eight times that
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 2**64, 256, dtype=U)
_R = U(0x9E3779B97F4A7C15)
_R_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers: dict[int, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for reuse up to the block size."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, CHUNK + 1), base, U)]))
        if n <= 4 * CHUNK:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in a byte array."""
    word = ~SPACE[buf]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each buf[start:end]."""
    n = len(buf)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, U)
        np.cumsum(_TABLE[buf] * powers(_R, n), out=run[1:])
        raw = (run[ends] - run[starts]) * powers(_R_INV, n + 1)[starts]
        return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text, in order; texts of any length, in chunks cut between words."""
    out, at = [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            while end < len(data) and not SPACE[data[end]]:
                end += 1
        buf = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
        out.append(segment_hashes(buf, *spans(buf)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def batch_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of each text's words); the offsets have one more entry than texts."""
    hashes, counts, held, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        data = b"\n".join(held)
        buf = np.frombuffer(data, np.uint8)
        s, e = spans(buf)
        hashes.append(segment_hashes(buf, s, e))
        begin = np.cumsum([0] + [len(t) + 1 for t in held])
        counts.extend(np.diff(np.searchsorted(s, begin)))
        held, size = [], 0

    for t in texts:
        if len(t) >= CHUNK:
            flush()
            h = word_hashes(t)
            hashes.append(h)
            counts.append(len(h))
            continue
        if size + len(t) > CHUNK:
            flush()
        held.append(t)
        size += len(t) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def window_hashes(words: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of each k consecutive entries of words."""
    n = len(words)
    if n < k:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        if n > CHUNK:  # windows of a long sequence, in overlapping runs
            return np.concatenate([window_hashes(words[i : i + CHUNK], k, base) for i in range(0, n - k + 1, CHUNK - k + 1)])
        run = np.zeros(n + 1, U)
        np.cumsum(words * powers(U(base), n), out=run[1:])
        return mix((run[k:] - run[:-k]) * powers(U(pow(base, -1, 2**64)), n + 1)[: n - k + 1])
