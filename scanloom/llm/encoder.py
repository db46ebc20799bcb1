"""Encoding whole texts with a public tokenizer, piece by piece through a bounded table of pieces seen before.

A byte-level BPE vocabulary cuts texts before it merges: always between a character that isn't white space and
white space that follows, and always between a letter and a following ASCII mark or digit. So texts are cut there, all
texts of a batch at once, and pieces of up to 24 bytes, which nearly all are, are looked up by their bytes in a hash table
in arrays. What isn't there goes to the library, and so do longer pieces. Texts with white space other than blanks, tabs
and line ends, or with the name of a special token, go to the library whole.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa

from .arrow import laid_out
from .textcore import mix

U64 = np.uint64
#: Entries of the table of pieces (32 bytes each), and the ids that it may refer to before it starts anew.
SLOTS, STORE = 1 << 21, 1 << 23
#: Texts longer than this are worked on in parts, cut where the vocabulary cuts.
PART = 2 << 20
SHORT = 24
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
#: ASCII that is neither a letter nor white space of any kind.
MARK = np.zeros(256, bool)
MARK[0x21:0x7F] = ~LETTER[0x21:0x7F]
#: Second bytes of the letters from U+00C0 to U+00FF, whose first byte is C3.
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One for each Python worker, which outlives tasks: the vocabulary is loaded once, and pieces stay known."""
    return Encoder(path, special_as_text)


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space other than blanks, tabs and line ends begins."""
    low = (data == 0x0B) | (data == 0x0C) | ((data >= 0x1C) & (data <= 0x1F))
    found = [np.flatnonzero(low)]
    first = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(first):
        padded = np.concatenate((data, np.zeros(2, np.uint8)))
        a, b, c = data[first], padded[first + 1], padded[first + 2]
        odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
        found.append(first[odd])
    return np.concatenate(found)


def parted(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` with more of them inside texts that are longer than ``PART``, where white space follows an ASCII mark or letter."""
    more = []
    for i in np.flatnonzero(np.diff(places) > PART).tolist():
        at, end = int(places[i]) + PART, int(places[i + 1])
        while at < end:
            near = data[at - 1 : min(at + 4096, end)]
            cut = np.flatnonzero(SPACE[near[1:]] & (MARK | LETTER)[near[:-1]])
            if len(cut):
                more.append(at + int(cut[0]))
                at = more[-1] + PART
            else:
                at += 4096
    return np.sort(np.concatenate((places, np.array(more, np.int64)))) if more else places


class Encoder:
    """Texts to ids as the library has them with ``add_special_tokens=False``.

    Names of special tokens in a text are these tokens, as in the library's plain call, or ordinary text with ``special_as_text``.
    """

    def __init__(self, path: str, special_as_text: bool = False, slots: int = SLOTS, store: int = STORE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.tokenizer.model._resize_cache(0)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        cut = said.get("pre_tokenizer") or {}
        #: whether the vocabulary cuts as this module says
        self.by_piece = said.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.special = [] if special_as_text else [x["content"].encode() for x in said.get("added_tokens", [])]
        self.shift = U64(64 - (slots.bit_length() - 1))
        self.table, self.most = np.zeros((slots, 4), U64), store
        self.store, self.used = np.zeros(store, np.uint32), 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of ids in the store, which they are added to."""
        count = np.array([len(x) for x in found], np.int64)
        total = int(count.sum())
        while self.used + total > len(self.store):
            self.store = np.concatenate((self.store, np.zeros(len(self.store), np.uint32)))
        self.store[self.used : self.used + total] = [y for x in found for y in x]
        place = self.used + np.cumsum(count) - count
        self.used += total
        return place, count

    def looked_up(self, raw: bytes, lanes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of the ids of short pieces; new ones are encoded and entered."""
        key = np.zeros((len(starts), 4), U64)
        key[:, 0] = lanes[starts] & _MASK[np.minimum(size, 8)]
        for i in (1, 2):
            longer = np.flatnonzero(size > 8 * i)
            key[longer, i] = lanes[starts[longer] + 8 * i] & _MASK[np.minimum(size[longer] - 8 * i, 8)]
        hash_ = mix(mix(mix(key[:, 0] ^ size.astype(U64) << U64(56)) ^ key[:, 1]) ^ key[:, 2])
        meta = np.zeros(len(starts), U64)
        open_ = np.arange(len(starts))
        slot = (hash_ >> self.shift).astype(np.int64)
        with np.errstate(over="ignore"):
            other = (hash_ * U64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
        for where in (slot, other):
            rows, mine = self.table[where[open_]], key[open_]
            hit = (rows[:, 0] == mine[:, 0]) & (rows[:, 1] == mine[:, 1]) & (rows[:, 2] == mine[:, 2]) & ((rows[:, 3] & U64(255)).astype(np.int64) == size[open_])
            meta[open_[hit]] = rows[hit, 3]
            open_ = open_[~hit]
        if len(open_):
            said = [raw[a : a + n] for a, n in zip(starts[open_].tolist(), size[open_].tolist(), strict=True)]
            new = {x: i for i, x in enumerate(dict.fromkeys(said))}
            place, count = self.keep(self.library([x.decode("utf-8", "surrogatepass") for x in new]))
            index = np.array([new[x] for x in said])
            meta[open_] = place[index].astype(U64) << U64(32) | count[index].astype(U64) << U64(8) | size[open_].astype(U64)
            first = open_[np.unique(index, return_index=True)[1]]
            key[first, 3] = meta[first]
            taken = self.table[slot[first], 3] != 0
            self.table[np.where(taken, other[first], slot[first])] = key[first]
        return (meta >> U64(32)).astype(np.int64), (meta >> U64(8) & U64(0xFFFFFF)).astype(np.int64)

    def some(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end, and the number of each text's."""
        if self.used > self.most:  # the store is full: all is forgotten
            self.table[:] = 0
            self.used, self.store = 0, np.zeros(self.most, np.uint32)
        raw = data.tobytes()
        cut = np.zeros(len(data) + 1, bool)
        cut[places] = True
        cut = cut[:-1]
        space, letter = SPACE[data], LETTER[data]
        cut[1:] |= space[1:] & ~space[:-1]
        letter[1:] |= LATIN[data[1:]] & (data[:-1] == 0xC3)
        cut[1:] |= letter[:-1] & MARK[data[1:]]
        starts = np.flatnonzero(cut)
        size = np.diff(np.concatenate((starts, [len(data)])))
        first = np.searchsorted(starts, places)
        row = np.repeat(np.arange(len(places) - 1), np.diff(first))
        odd = set((np.searchsorted(places, odd_spaces(data), "right") - 1).tolist())
        for name in self.special:
            at = raw.find(name)
            while at >= 0:
                odd.add(int(np.searchsorted(places, at, "right")) - 1)
                at = raw.find(name, at + 1)
        if not self.by_piece:
            odd = set(np.flatnonzero(np.diff(places)).tolist())
        place, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        whole = np.zeros(len(places), bool)
        whole[list(odd)] = True
        mine = ~whole[row]
        short = np.flatnonzero(mine & (size <= SHORT))
        lanes = np.ndarray(len(data) + 17, "<u8", np.concatenate((data, np.zeros(24, np.uint8))), strides=(1,))
        for i in range(0, len(short), 1 << 16):
            part = short[i : i + (1 << 16)]
            place[part], count[part] = self.looked_up(raw, lanes, starts[part], size[part])
        long_ = np.flatnonzero(mine & (size > SHORT))
        if len(long_):
            said = [raw[a : a + n] for a, n in zip(starts[long_].tolist(), size[long_].tolist(), strict=True)]
            new = {x: i for i, x in enumerate(dict.fromkeys(said))}
            index = np.array([new[x] for x in said])
            at, n = self.keep(self.library([x.decode("utf-8", "surrogatepass") for x in new]))
            place[long_], count[long_] = at[index], n[index]
        if odd:
            rows = np.array(sorted(odd))
            at, n = self.keep(self.library([raw[places[r] : places[r + 1]].decode("utf-8", "surrogatepass") for r in rows.tolist()]))
            place[first[rows]], count[first[rows]] = at, n  # a text's first piece stands for all of it
        ends = np.cumsum(count)
        ids = self.store[np.repeat(place - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        before = np.concatenate(([0], ends))
        return ids, before[first[1:]] - before[first[:-1]]

    def encode(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's bounds in them (one more than texts)."""
        parts = parted(data, places)
        ids, count, begin = [], [], 0
        while begin < len(parts) - 1:
            end = max(begin + 1, int(np.searchsorted(parts, parts[begin] + PART, "right")) - 1)
            a, b = int(parts[begin]), int(parts[end])
            if b > a:
                found = self.some(data[a:b], parts[begin : end + 1] - a)
                ids.append(found[0])
                count.append(found[1])
            else:
                count.append(np.zeros(end - begin, np.int64))
            begin = end
        before = np.concatenate(([0], np.cumsum(np.concatenate(count or [np.zeros(0, np.int64)]))))
        # texts that were parted are one again: of equal places the first is where a text begins
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), before[self.kept(parts, places)]

    @staticmethod
    def kept(parts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where each of ``places``, repetitions included, is in ``parts``."""
        return np.arange(len(places)) if len(parts) == len(places) else np.flatnonzero(np.isin(parts, places))

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts and their bounds; null has no ids. ``end_id`` is added to each."""
        ids, bounds = self.encode(*laid_out(column))
        if end_id is None:
            return ids, bounds
        n = len(bounds) - 1
        out = np.full(len(ids) + n, end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
        return out, bounds + np.arange(n + 1)
