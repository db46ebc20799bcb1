"""Sum-of-squares online packing of token ids into windows.

Whole windows of a long document are sequences of their own. What is left of it goes into the fill level
that makes the sum, over all levels, of the squared number of windows partly filled to that level least; the
counts are kept in an array with an entry for each level. Each task packs its own documents. When it holds
too many open windows, and at its end, the emptiest windows are given up: their pieces go whole into the others by the same
rule, and only those that fit nowhere are cut to fill them. The very last window is cut into sequences whose lengths are
powers of two. So there is no padding, and few documents that a window could hold are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrow import batch_of, map_batches, row_groups
from .encoder import default_tokenizer, encoder
from .shared import bounded_batches

WINDOW = 2048
OPEN_WINDOWS = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Takes documents one by one; gives rows of the pieces of closed sequences.

    A piece is ``(doc_id, start, ids, doc_tokens)``. ``count[h]`` is the number of open windows filled to ``h``.
    """

    def __init__(self, window: int = WINDOW, most_open: int = OPEN_WINDOWS, first_sequence: int = 0):
        self.window, self.most_open, self.sequence = window, most_open, first_sequence
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def level_for(self, n: int, new: bool = True) -> int:
        """The fill level at which adding ``n`` leaves the least sum of squares, the fullest of equals; 0 for a new window, or, without ``new``, for none."""
        best, least = 0, (2 * int(self.count[n]) + 1 if n < self.window else 0) if new else np.iinfo(np.int64).max
        levels = np.flatnonzero(self.count[1 : self.window - n + 1]) + 1
        if len(levels):
            change = 1 - 2 * self.count[levels] + np.where(levels + n == self.window, 0, 2 * self.count[levels + n] + 1)
            i = len(levels) - 1 - int(change[::-1].argmin())
            if change[i] <= least:
                best = int(levels[i])
        return best

    def place(self, piece: tuple, level: int) -> None:
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        self.put([*pieces, piece], level + len(piece[2]))

    def put(self, pieces: list[tuple], fill: int) -> None:
        if fill == self.window:
            self.close(pieces)
        else:
            self.open[fill].append(pieces)
            self.count[fill] += 1
            self.n_open += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.close([(doc_id, at, ids[at : at + self.window], total)])
            at += self.window
        if n := total - at:
            self.place((doc_id, at, ids[at:].copy(), total), self.level_for(n))
        if self.n_open > self.most_open:
            self.settle()

    def settle(self, end: bool = False) -> None:
        """Fills as many of the open windows as can be full from the emptiest ones.

        Pieces of the emptiest go, the largest first, whole into the levels that the same rule names; only what fits nowhere
        is cut. What is over stays open, or at the end is cut into sequences whose lengths are powers of two.
        """
        full = sum(h * int(k) for h, k in enumerate(self.count)) // self.window
        waiting = []
        for h in range(1, self.window):
            while self.open[h] and self.n_open > full:
                waiting += self.open[h].pop()
                self.count[h] -= 1
                self.n_open -= 1
        rest = []
        for piece in sorted(waiting, key=lambda p: -len(p[2])):
            level = self.level_for(len(piece[2]), new=False)
            if level:
                self.place(piece, level)
            else:
                rest.append(piece)
        for h in range(self.window - 1, 0, -1):
            for pieces in self.open[h]:
                self.close([*pieces, *self.cut(rest, self.window - h)])
            self.open[h] = []
        self.count[:] = 0
        self.n_open = 0
        left = sum(len(p[2]) for p in rest)
        while end and left:
            room = 1 << (left.bit_length() - 1)
            self.close(self.cut(rest, room))
            left -= room
        if left:
            self.put(rest, left)

    @staticmethod
    def cut(rest: list[tuple], room: int) -> list[tuple]:
        """Takes ``room`` ids off the end of ``rest``; of a piece that is too long, its beginning."""
        taken = []
        while room:
            doc_id, start, ids, total = rest.pop()
            taken.append((doc_id, start, ids[:room], total))
            if len(ids) > room:
                rest.append((doc_id, start + room, ids[room:], total))
            room -= min(room, len(ids))
        return taken

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            rows, self.rows = self.rows, []
            yield batch_of(**{n: pa.array(x, pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)})


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece. Null and empty texts are the end id alone; rows that share a key are packed each.

    ``sequence_id`` has the task's number in its upper bits: unique, not gapless. Without any document there is no row.
    """

    def run(batches):
        words = encoder(tokenizer)
        packer = Packer(window, first_sequence=TaskContext.get().partitionId() << 40)
        for batch in row_groups(batches, "text", 1 << 20):
            ids, bounds = words.encode_column(batch.column("text"), end_id)
            bounds = bounds.tolist()
            for k, a, b in zip(batch.column("key").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                packer.add(k, ids[a:b])
            yield from packer.taken()
        packer.settle(end=True)
        yield from packer.taken()

    bounded_batches(docs.sparkSession)
    return map_batches(docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")), run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, default_tokenizer(), end_id=1)
