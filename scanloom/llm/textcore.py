"""Vectorised hashing of words and byte windows, shared by the operators on whole texts.

Everything here works on the UTF-8 bytes of one text or of several texts laid end to end, with numpy only. Words go through
a keyed permutation lane by lane; the polynomial, cheaper for all windows of a text, is for windows of bounded length.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, so that the polynomial below isn't over the bytes themselves.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)
_P_INV = U64(pow(int(_P), -1, 2**64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, _P))), dtype=U64)
            _INV = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, _P_INV))), dtype=U64)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A full-avalanche permutation of 64-bit values."""
    x = np.asarray(x)
    rest = x >> U64(30)
    x = x ^ rest
    for factor, shift in ((U64(0xBF58476D1CE4E5B9), U64(27)), (U64(0x94D049BB133111EB), U64(31))):
        x *= factor
        np.right_shift(x, shift, out=rest)
        x ^= rest
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


#: Bytes of words between white space, and of words of letters, digits and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte values times powers: the hash of any span follows from two entries."""
    pow_, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUE[data] * pow_[: len(data)], dtype=U64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: equal for equal bytes wherever they lie."""
    _, inv = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Words of more bytes than this are hashed by BLAKE2, so that a text without white space costs no more than others.
LONG_WORD = 64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
_SEEDS = [U64(int(x) | 1) for x in _rng.integers(1, 2**63, 4, dtype=np.uint64)]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash for each word, eight bytes a step through a permutation of the state; ``which`` (0 or 1) names independent ones."""
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(U64) * _SEEDS[0] + _SEEDS[1 + which])
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        open_, step = np.flatnonzero(size <= LONG_WORD), 0
        while len(open_):
            lane = lanes[starts[open_] + step] & _MASK[np.minimum(size[open_] - step, 8)]
            out[open_] = mix((out[open_] ^ lane) + _SEEDS[3])
            step += 8
            open_ = open_[size[open_] > step]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        found = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        out[i] = int.from_bytes(found[8 * which : 8 * which + 8], "little")
    return out


_STEP = [U64(int(x) | 1) for x in _rng.integers(1, 2**63, 64, dtype=np.uint64)]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` consecutive words, order included."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = np.zeros(count, U64)
    for at in range(0, count, 1 << 14):  # what is at work stays in the cache
        part = out[at : at + (1 << 14)]
        for i in range(n):
            step = _STEP[i % 64] ^ U64(i // 64 << 1)
            one = mix(words[at + i : at + i + len(part)] ^ step)
            one *= step
            part += one
        part[:] = mix(part)
    return out


@dataclass
class Words:
    """The words of all texts of a batch: lower-cased bytes end to end, each word's place, and each text's first word (and a last bound)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    places: np.ndarray  # where each text begins

    @classmethod
    def of(cls, data: np.ndarray, places: np.ndarray, in_word: np.ndarray) -> Words:
        """``places`` are where texts begin in ``data``, and its end."""
        data = lowered(data)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = in_word[data]
        cut = np.zeros(len(data) + 1, bool)  # a text begins here
        cut[places] = True
        here = inside[1:-1]
        starts = np.flatnonzero(here & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(here & (~inside[2:] | cut[1:])) + 1
        return cls(data, starts, ends, np.searchsorted(starts, places), places)

    def hashes(self, which: int = 0) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, which)


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
