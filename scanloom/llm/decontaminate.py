"""Benchmark decontamination: a hash set of test n-grams against the windows of training texts.

The windows of all benchmark items are hashed into a sorted array that every task gets. Each text's windows
are hashed and looked up there; every hit is verified word by word before it counts. A benchmark that is too large for
that is worked through in slices, one broadcast after the other, and the hits of all slices are joined by
key and text: what a row is judged on is its own text alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, byte_rows, laid_out, map_batches, row_groups
from .shared import bounded_batches, saved
from .textcore import WORD_BYTE, Words, gram_hashes

WORDS = 10
#: Benchmarks up to so many characters are sent to every task (with their index some six bytes for each); larger ones are
#: worked through in slices of it.
SLICE_BYTES = 16 << 20
#: Texts that are looked at together.
BATCH_BYTES = 1 << 20


@dataclass
class GramIndex:
    """The windows of items, some 30 bytes each: by window length their sorted hashes, items and first words; and the items' words."""

    sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # sorted hashes, item and first word of each
    items: list[str]
    data: bytes
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[object, str | None]], n: int) -> GramIndex:
        texts = [(text or "").encode("utf-8", "surrogatepass") for _, text in rows]
        words = Words.of(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), WORD_BYTE)
        count, hashes = np.diff(words.first), words.hashes()
        sizes = {}
        for size in np.unique(np.minimum(count[count > 0], n)).tolist():
            mine = np.flatnonzero(count >= n if size == n else count == size)
            per = count[mine] - size + 1
            item = np.repeat(mine, per)
            word = np.repeat(words.first[mine] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            found = gram_hashes(hashes, size)[word]
            order = np.argsort(found, kind="stable")
            sizes[size] = (found[order], item[order].astype(np.int32), word[order].astype(np.int32))
        names = ["" if item is None else str(item) for item, _ in rows]
        return cls(sizes, names, words.data.tobytes(), words.starts.astype(np.int32), words.ends.astype(np.int32))

    @staticmethod
    def said(data: bytes, starts: np.ndarray, ends: np.ndarray, at: int, size: int) -> bytes:
        """A window's words with blanks, which no word has, between them."""
        return b" ".join(data[a:b] for a, b in zip(starts[at : at + size].tolist(), ends[at : at + size].tolist(), strict=True))

    def windows(self, size: int, begin: int, known: dict) -> dict[bytes, set[str]]:
        """The items of each window that shares the hash at ``begin``."""
        if (size, begin) not in known:
            keys, item, word = self.sizes[size]
            found: dict[bytes, set[str]] = {}
            for r in range(begin, int(np.searchsorted(keys, keys[begin], "right"))):
                found.setdefault(self.said(self.data, self.starts, self.ends, int(word[r]), size), set()).add(self.items[item[r]])
            known[size, begin] = found
        return known[size, begin]

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """For each word whether an occurring window covers it, and for each text that is hit the items with occurring windows."""
        hashes = words.hashes()
        change, owners = np.zeros(len(hashes) + 1, np.int32), {}
        text_of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        raw, known = None, {}
        for size, (keys, _, _) in self.sizes.items():
            grams = gram_hashes(hashes, size)
            if not len(grams):
                continue
            begin = np.searchsorted(keys, grams)
            here = np.flatnonzero((keys[np.minimum(begin, len(keys) - 1)] == grams) & (text_of[: len(grams)] == text_of[size - 1 :]))
            for at in here.tolist():
                raw = words.data.tobytes() if raw is None else raw
                if found := self.windows(size, int(begin[at]), known).get(self.said(raw, words.starts, words.ends, at, size)):
                    change[at] += 1
                    change[at + size] -= 1
                    owners.setdefault(int(text_of[at]), set()).update(found)
        return np.cumsum(change[:-1]) > 0, owners


def slices(benchmark: DataFrame, item: str, text: str):
    """The benchmark in runs of rows of bounded size, each on the driver for a moment."""
    rows, size = [], 0
    for r in benchmark.select(item, text).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= SLICE_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def covered_words(n: int, begins: list[int], ends: list[int]) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, np.minimum(np.asarray(begins, np.int64), n), 1)
    np.add.at(change, np.minimum(np.asarray(ends, np.int64), n), -1)
    return np.cumsum(change[:-1]) > 0


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def slice_hits(docs: DataFrame, index, key: str, text: str) -> DataFrame:
    """``(key, begins, ends, items)`` of the documents that a slice of the benchmark hits."""

    def run(batches):
        for batch in row_groups(batches, text, BATCH_BYTES):
            keys, hashes, begins, ends, items = [], [], [], [], []
            words = Words.of(*laid_out(batch.column(text)), WORD_BYTE)
            hit, found = index.value.hits(words)
            for i in sorted(found):
                a, b = runs(hit[words.first[i] : words.first[i + 1]])
                keys.append(batch.column("_key")[i].as_py())
                hashes.append(batch.column("_hash")[i].as_py())
                begins.append(a.tolist())
                ends.append(b.tolist())
                items.append(sorted(found[i]))
            yield batch_of(_key=pa.array(keys, pa.string()), _hash=pa.array(hashes, pa.string()), _begins=pa.array(begins, pa.list_(pa.int32())), _ends=pa.array(ends, pa.list_(pa.int32())), _items=pa.array(items, pa.list_(pa.string())))

    return map_batches(docs.select(*row_name(docs, key, text), text), run, "_key string, _hash string, _begins array<int>, _ends array<int>, _items array<string>")


def row_name(docs: DataFrame, key: str, text: str) -> list:
    """What rows are known by between slices: the key, empty for null, and the text's hash, so that rows without a key are judged too."""
    return [F.coalesce(docs[key].cast("string"), F.lit("")).alias("_key"), F.sha2(F.coalesce(docs[text], F.lit("")), 256).alias("_hash")]


def judged(docs: DataFrame, benchmark: DataFrame, n: int, key: str, text: str, item: str, item_text: str, extra: list[str], remove: bool = False) -> DataFrame:
    """``extra`` columns of each row with the judgement on it; with ``remove`` also the text without the words hit."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = slices(benchmark, item, item_text)
    first, second = next(parts, []), next(parts, None)
    index = None
    source = docs.select(*dict.fromkeys([*extra, text]))
    if second is None:
        index = spark.sparkContext.broadcast(GramIndex.build(first, n))
    else:
        found = []
        for rows in chain([first, second], parts):
            one = spark.sparkContext.broadcast(GramIndex.build(rows, n))
            found.append(saved(slice_hits(docs, one, key, text), "slice-hits"))
            one.destroy()
        flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("_begins", "_ends", "_items")]
        whole = reduce(DataFrame.union, found).distinct().groupBy("_key", "_hash").agg(*flat)
        source = docs.select(*source.columns, *row_name(docs, key, text)).join(whole, ["_key", "_hash"], "left")

    def run(batches):
        for batch in row_groups(batches, text, BATCH_BYTES):
            rows = []
            words = Words.of(*laid_out(batch.column(text)), WORD_BYTE)
            given = None if index is not None else [batch.column(c).to_pylist() for c in ("_begins", "_ends", "_items")]
            marked, owners = index.value.hits(words) if given is None else (None, None)
            for i in range(batch.num_rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                if given is None:
                    hit, items = marked[a:b], owners.get(i, ())
                else:
                    hit, items = covered_words(b - a, given[0][i] or [], given[1][i] or []), set(given[2][i] or [])
                clean = None
                if remove and hit.any():
                    begin, end = int(words.places[i]), int(words.places[i + 1])
                    keep = np.ones(end - begin, bool)
                    for x, y in zip(*runs(hit), strict=True):
                        keep[words.starts[a + x] - begin : words.ends[a + y - 1] - begin] = False
                    data = next(byte_rows(batch.column(text).slice(i, 1)))
                    clean = data[keep].tobytes().decode("utf-8", "replace")
                said = ",".join(sorted(items))
                rows.append((b - a, int(hit.sum()), len(items), hashlib.sha256(said.encode()).hexdigest(), bool(hit.any()), clean))
            n_words, n_hit, n_items, sha, bad, clean = zip(*rows, strict=True)
            out = {c: batch.column(c) for c in extra}
            if remove:
                out[text] = pa.array([t if c is None else c for t, c in zip(batch.column(text).to_pylist(), clean, strict=True)], pa.string())
            out |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(n_items, pa.int64()), "items_sha256": pa.array(sha, pa.string()), "contaminated": pa.array(bad, pa.bool_())}
            yield batch_of(**out)

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in extra), *([f"`{text}` string"] if remove else []), "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"])
    return map_batches(source, run, schema)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of ``docs``: ``n_words, n_hit, n_items, items_sha256, contaminated`` beside its key.

    Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII. Null and empty texts have no words;
    items without words have no windows; items that repeat count once for each ``item_id``. An empty benchmark
    hits nothing. Rows are judged each, with a key or without.
    """
    return judged(docs, benchmark, n, key, text, item, item_text, [key])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, mode: str = "documents", key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents (mode ``documents``) or without the words hit (mode ``spans``)."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    own = {"n_words", "n_hit", "n_items", "items_sha256", "contaminated"}
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in own})
    remove = mode == "spans"
    out = judged(renamed, benchmark, n, key, text, item, item_text, [c for c in renamed.columns if not (remove and c == text)], remove)
    kept = out if remove else out.where(~F.col("contaminated"))
    return kept.select(*[F.col(f"_own_{c}" if c in own else c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM dw, sizes WHERE len(w) >= size)
), hits AS (
  SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.size = x.size AND g.g = x.g
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
