"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of ``least`` bytes covers it that also starts earlier in the corpus. So what counts are
the suffixes of all texts, compared on their first ``least`` bytes (windows from here on):

1. Anchors. In every window the ``GRAM``-byte string of the smallest hash is its anchor; equal windows have equal
   anchors at equal places. Consecutive windows with one anchor are a stretch. Stretches with an anchor that no
   other stretch has cannot repeat; equal stretches repeat as a whole and all but the first go; both are settled
   by sorting stretches by anchor, after each batch has sent only its first of equal stretches.
2. What is left are different stretches around one anchor, each read from its text once. Tasks hold all
   stretches of an anchor, in corpus order. Each batch of them gets a suffix array of its windows, is merge-scanned
   against the levels of the family so far for matches of the full length, and becomes a level; levels of
   equal size merge, so n batches leave log n levels. An anchor with very many stretches is dealt out over
   tasks by the hash of the window, which keeps equal windows together.
3. The texts, brought together by document a second time from the same shuffle, lose the bytes found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, byte_rows, map_batches, row_groups
from .shared import bounded_batches, saved
from .textcore import mix, prefix_hash, span_hash

LEAST = 100
GRAM = 16
#: Texts are looked at in segments of so many windows.
SEGMENT = 2 << 20
#: Stretches in a batch of the family, and windows after which it starts anew once an anchor is complete.
BATCH, FAMILY = 2048, 400_000
#: Stretches of one anchor above which its windows are dealt by their hash.
HOT = 8192


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def stretches(data: np.ndarray, least: int, segment: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, stretch hash, first window, number of windows, and place of the anchor in the first window."""
    gram = min(GRAM, least)
    found = []
    for at in range(0, max(0, len(data) - least + 1), segment):
        part = data[at : at + segment + least - 1]
        sums, places = prefix_hash(part), np.arange(len(part) - gram + 1)
        grams = span_hash(sums, places, places + gram)
        # the smallest hash, the leftmost of equals
        key = (grams >> np.uint64(24) << np.uint64(24)) | places.astype(np.uint64)
        anchor = (sliding_min(key, least - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.concatenate((first[1:], [len(anchor)])) - 1
        whole = span_hash(sums, first, last + least)
        found.append((grams[anchor[first]], mix(whole + (anchor[first] - first).astype(np.uint64)), first + at, last - first + 1, anchor[first] - first))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def packed(first: np.ndarray, windows: np.ndarray, settled: np.ndarray | int) -> np.ndarray:
    return first << 16 | windows << 1 | settled


def all_stretches(docs: DataFrame, least: int) -> DataFrame:
    """A row ``(anchor, whole, doc_id, place)`` for each stretch; those equal to an earlier one of the batch are marked settled."""
    segment = SEGMENT

    def run(batches):
        for batch in row_groups(batches, "text", 8 << 20):
            ids = batch.column("doc_id").to_numpy()
            parts = []
            texts = list(byte_rows(batch.column("text")))
            order = np.argsort(ids, kind="stable")
            again = np.concatenate(([False], ids[order[1:]] == ids[order[:-1]]))
            for i in order[~again]:  # rows that share an id are one document
                anchor, whole, first, windows, _ = stretches(texts[i], least, segment)
                if len(first):
                    parts.append((anchor, whole, np.full(len(first), ids[i]), first, windows))
            if not parts:
                continue
            anchor, whole, doc, first, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((whole, anchor))  # stable: equal stretches stay in corpus order
            a, w, d, f = anchor[order], whole[order], doc[order], first[order]
            again = np.concatenate(([False], (a[1:] == a[:-1]) & (w[1:] == w[:-1])))
            # settled rows go to any task: not to the one that all of a hot passage would go to
            a = np.where(again, mix(d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + f.astype(np.uint64)), a)
            yield batch_of(anchor=a.view(np.int64), whole=w.view(np.int64), doc_id=d, place=packed(f, windows[order], again.astype(np.int64)))

    return map_batches(docs.where("doc_id IS NOT NULL"), run, "anchor long, whole long, doc_id long, place long")


def settled_stretches(rows: DataFrame) -> DataFrame:
    """Of all stretches: those that repeat an earlier one whole (``anchor`` null), and the first of each kind whose anchor has several kinds."""

    def run(batches):
        held = None  # the last first-of-its-kind: (anchor, whole, doc_id, place, whether its anchor had another kind before)
        for batch in batches:
            anchor, whole, doc, place = (batch.column(i).to_numpy() for i in range(4))
            done = (place & 1).astype(bool)
            out = [(np.zeros(done.sum(), np.int64), doc[done], place[done] >> 1 << 1, np.ones(done.sum(), bool))]
            anchor, whole, doc, place = anchor[~done], whole[~done], doc[~done], place[~done]
            if len(anchor):
                new = np.concatenate(([held is None or held[0] != anchor[0] or held[1] != whole[0]], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])))
                firsts = np.flatnonzero(new)
                # a row repeats the first of its kind, unless it is the same place again
                kind = np.cumsum(new) - 1
                first_doc, first_place = doc[firsts], place[firsts]
                if held is not None:
                    kind, first_doc, first_place = kind + 1, np.concatenate(([held[2]], first_doc)), np.concatenate(([held[3]], first_place))
                repeats = ~new & ((doc != first_doc[kind]) | (place != first_place[kind]))
                out.append((np.zeros(repeats.sum(), np.int64), doc[repeats], place[repeats], np.ones(repeats.sum(), bool)))
                if len(firsts):
                    a, d, p = anchor[firsts], doc[firsts], place[firsts]
                    before = np.zeros(len(firsts), bool)
                    if held is not None:
                        a, d, p = np.concatenate(([held[0]], a)), np.concatenate(([held[2]], d)), np.concatenate(([held[3]], p))
                        before = np.concatenate(([held[4]], before))
                    before[1:] |= a[1:] == a[:-1]
                    several = before.copy()
                    several[:-1] |= a[1:] == a[:-1]
                    take = np.flatnonzero(several[:-1])
                    out.append((a[take], d[take], p[take], np.zeros(len(take), bool)))
                    held = (a[-1], whole[firsts[-1]], d[-1], p[-1], bool(before[-1]))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield batch_of(anchor=pa.array(columns[0], pa.int64(), mask=columns[3]), doc_id=columns[1], place=columns[2])
        if held is not None and held[4]:
            yield batch_of(anchor=pa.array([held[0]], pa.int64()), doc_id=pa.array([held[2]], pa.int64()), place=pa.array([held[3]], pa.int64()))

    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", "whole", "doc_id", "place")
    return map_batches(ordered, run, "anchor long, doc_id long, place long")


def windows_at(data: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """A row of ``least`` bytes for each place, without an index for each byte."""
    return np.lib.stride_tricks.sliding_window_view(data, least)[places]


class SuffixFamily:
    """Levels of sorted windows; ``add`` takes the windows of a batch in corpus order and tells which occur earlier."""

    def __init__(self, least: int):
        self.least, self.levels = least, []

    def __len__(self) -> int:
        return sum(map(len, self.levels))

    def add(self, windows: np.ndarray) -> np.ndarray:
        rows = np.ascontiguousarray(windows).view(f"S{self.least}").ravel()
        order = np.argsort(rows, kind="stable")  # the batch's suffix array
        array = rows[order]
        seen = np.concatenate(([False], array[1:] == array[:-1]))
        own = np.flatnonzero(~seen)
        distinct = array[own]
        hit = np.zeros(len(distinct), bool)
        for level in self.levels:
            place = np.searchsorted(level, distinct)
            place[place == len(level)] = 0
            hit |= level[place] == distinct
        seen[own[hit]] = True
        # a window that repeats one of its own batch is seen even if that one is new
        self.levels.append(distinct[~hit])
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            merged = np.concatenate((self.levels.pop(), self.levels.pop()))
            merged.sort(kind="stable")
            self.levels.append(merged)
        self.levels = [x for x in self.levels if len(x)]
        out = np.zeros(len(rows), bool)
        out[order] = seen
        return out


def earlier_windows(rows: DataFrame, least: int) -> DataFrame:
    """``(anchor, deal, doc_id, first, data)`` of stretches to the intervals ``(doc_id, start, end)`` that occur earlier."""

    def run(batches):
        family, anchor_now, last = SuffixFamily(least), None, None
        for whole in batches:
            if not whole.num_rows:
                continue
            # a stretch that was read from several rows of its document is one
            places = np.stack([whole.column(i).to_numpy() for i in range(4)], axis=1)
            new = np.concatenate(([last is None or (places[0] != last).any()], (places[1:] != places[:-1]).any(axis=1)))
            last = places[-1]
            whole = whole.filter(pa.array(new))
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                keys = np.stack([batch.column(i).to_numpy() for i in range(2)], axis=1)
                # the family may start anew where the batch begins a new anchor
                cuts = [0]
                if len(family) > FAMILY:
                    differs = np.flatnonzero((keys != (anchor_now if anchor_now is not None else keys[0])).any(axis=1))
                    if len(differs):
                        cuts.append(int(differs[0]))
                anchor_now = keys[-1]
                for begin, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                    if begin:
                        family = SuffixFamily(least)
                    if begin < end:
                        yield from found(batch.slice(begin, end - begin), family)

    def found(batch, family):
        doc, first = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        data = list(byte_rows(batch.column(4)))
        sizes = np.array([len(x) for x in data])
        joined, starts = np.concatenate(data), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        count = sizes - least + 1
        row = np.repeat(np.arange(len(data)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        seen = family.add(windows_at(joined, starts[row] + step, least))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], seen.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            return
        # runs of windows, cut where one stretch ends and the next begins
        hits = np.flatnonzero(seen)
        new = np.concatenate(([True], (np.diff(hits) > 1) | (np.diff(row[hits]) > 0)))
        begin = hits[new]
        end = hits[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hits) - 1]))]
        yield batch_of(doc_id=doc[row[begin]], start=first[row[begin]] + step[begin], end=first[row[end]] + step[end] + least)

    ordered = rows.repartition("anchor", "deal").sortWithinPartitions("anchor", "deal", "doc_id", "first")
    return map_batches(ordered, run, "doc_id long, start long, end long")


def repeated_intervals(docs: DataFrame, least: int) -> DataFrame:
    """Intervals of bytes to remove, by ``doc_id``; they may touch and overlap."""
    marked = saved(settled_stretches(all_stretches(docs, least)), "stretches")
    whole = marked.where("anchor IS NULL").select("doc_id", F.expr("shiftright(place, 16)").alias("start"), F.expr(f"shiftright(place, 16) + (shiftright(place, 1) & 32767) + {least - 1}").alias("end"))
    open_ = marked.where("anchor IS NOT NULL")
    hot = open_.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    wanted = open_.join(hot, "anchor", "left").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))

    def read(batches):
        for batch in row_groups(batches, "text"):
            anchor, deal, doc, first, data = [], [], [], [], []
            for d, text, asked in zip(batch.column("doc_id").to_pylist(), byte_rows(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                for x in asked or ():
                    begin, windows = x["place"] >> 16, x["place"] >> 1 & 32767
                    raw = text[begin : begin + windows + least - 1].tobytes()
                    pieces = [(begin + i, raw[i : i + least]) for i in range(windows)] if x["hot"] else [(begin, raw)]
                    for at, piece in pieces:
                        anchor.append(x["anchor"])
                        deal.append(int.from_bytes(hashlib.blake2b(piece, digest_size=4).digest(), "little") if x["hot"] else 0)
                        doc.append(d)
                        first.append(at)
                        data.append(piece)
            if doc:
                yield batch_of(anchor=pa.array(anchor, pa.int64()), deal=pa.array(deal, pa.int64()), doc_id=pa.array(doc, pa.int64()), first=pa.array(first, pa.int64()), data=pa.array(data, pa.binary()))

    # a left join of the same columns, here and where the bytes are removed, so that both read one shuffle of the texts
    texts = map_batches(docs.join(wanted, "doc_id", "left").select(*docs.columns, "wanted"), read, "anchor long, deal long, doc_id long, first long, data binary")
    return whole.union(earlier_windows(texts, least))


REPORT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def with_kept(docs: DataFrame, least: int, carry: bool) -> DataFrame:
    """``docs(doc_id, text, ...)`` to the report on each row, and with ``carry`` also to its other columns and the text ``kept``."""
    bounded_batches(docs.sparkSession)
    by_doc = repeated_intervals(docs, least).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("cut"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if carry else []

    def run(batches):
        for batch in row_groups(batches, "text"):
            rows = []
            missing = batch.column("text").is_null().to_pylist()
            for data, cut, null in zip(byte_rows(batch.column("text")), batch.column("cut").to_pylist(), missing, strict=True):
                change = np.zeros(len(data) + 1, np.int32)
                for x in cut or ():
                    change[min(x["start"], len(data))] += 1
                    change[min(x["end"], len(data))] -= 1
                gone = np.cumsum(change[:-1]) > 0
                spans = int(gone[:1].sum()) + int((np.diff(gone.view(np.int8)) == 1).sum())
                kept = data[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if carry and not null else None))
            n, removed, spans, sha, kept = zip(*rows, strict=True)
            report = {"n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            more = {c: batch.column(c) for c in others} | {"kept": pa.array(kept, pa.string())} if carry else {}
            yield batch_of(doc_id=batch.column("doc_id"), **report, **more)

    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", REPORT, *(f"`{c}` {types[c]}" for c in others), *["kept string"] * carry])
    return map_batches(docs.join(by_doc, "doc_id", "left").select(*docs.columns, "cut"), run, schema)


def repeats(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes, null is empty; texts shorter than ``least`` have no window and stay whole. Strings are judged on
    the input. Rows that share a ``doc_id`` must share a text: they are one document, and come out each. Rows
    without a ``doc_id`` come before and after nothing: they stay whole. An empty table gives an empty result.
    """
    return with_kept(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), least, carry=False)


def remove_repeats(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what is kept of each text; all rows and other columns as they are, null texts null.

    Where a cut falls inside a character, what is left of the character goes too.
    """
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"))
    kept = with_kept(whole, least, carry=True)
    return kept.select(*[F.col("kept").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeats(docs)
