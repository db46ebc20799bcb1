"""Language identification by words first, with a backoff to character n-grams.

A word that training saw scores by its logarithmic frequency in each language. A word it did not see is looked at
through its character 5-grams (with marks for both ends); if none of them is known, through its 4-grams, and
so on down to single characters. The language of the largest sum wins. Words and n-grams go by 64-bit hashes, so that the
tables are sorted arrays, and hold all that the sample has.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, map_batches, row_groups
from .shared import bounded_batches
from .textcore import word_hashes

#: The bound of the classifier: labelled rows that it is fitted on, the expected number of a sample by hash. All their words and n-grams count.
TRAIN_ROWS = 20_000
LONGEST = 5
NONE = "und"
#: Words whose scores a task remembers.
CACHED = 150_000


#: Characters beyond the first plane, which a pattern knows by a long list.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@cache
def word_pattern(last: int) -> re.Pattern:
    """Letters (Unicode L) with the marks (M) that follow letters, of characters up to ``last``."""
    ranges = {"L": [], "M": []}
    begin = was = None
    for c in range(last + 2):
        kind = unicodedata.category(chr(c))[0] if c <= last else None
        if kind != was:
            if was in ranges:
                ranges[was].append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin, was = c, kind
    letters, marks = "".join(ranges["L"]), "".join(ranges["M"])
    return re.compile(f"[{letters}][{letters}{marks}]*")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return word_pattern(sys.maxunicode if not low.isascii() and ASTRAL.search(low) else 0xFFFF).findall(low)


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def hashed(strings: list[str]) -> np.ndarray:
    raw = [x.encode("utf-8", "surrogatepass") for x in strings]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends[:-1])) if len(raw) else ends, ends)


@dataclass
class Model:
    """Languages in order; for words (at 0) and each length of n-grams sorted hashes and a row of log frequencies by language for each."""

    languages: list[str]
    keys: list[np.ndarray]
    rows: list[np.ndarray]

    def find(self, n: int, strings: list[str]) -> np.ndarray:
        """Each string's row in a table, -1 for none."""
        keys, wanted = self.keys[n], hashed(strings)
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: of the word itself, or of the longest n-grams that are known; zeros if not even a character is."""
        out = np.zeros((len(words), len(self.languages)))
        at = self.find(0, words)
        seen = at >= 0
        out[seen] = self.rows[0][at[seen]]
        open_ = np.flatnonzero(~seen)
        for n in range(LONGEST, 0, -1):
            if not len(open_):
                break
            grams = [grams_of(words[i], n) for i in open_.tolist()]
            owner = np.repeat(np.arange(len(open_)), [len(g) for g in grams])
            at = self.find(n, list(chain.from_iterable(grams)))
            owner, at = owner[at >= 0], at[at >= 0]
            known, first, count = np.unique(owner, return_index=True, return_counts=True)
            if len(known):
                # the mean of the n-grams, so that a word counts as one piece of evidence however long it is
                out[open_[known]] = np.add.reduceat(self.rows[n][at], first, axis=0) / count[:, None]
            open_ = np.delete(open_, known)
        return out


def learn(names: list[str], lang: np.ndarray, size: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """From counts by language (its place in ``names``), length (0 for words) and hash."""
    languages = sorted(names)
    place = np.array([languages.index(x) for x in names], np.int64)[lang] if names else np.zeros(0, np.int64)
    tables, rows = [], []
    for n in range(LONGEST + 1):
        mine = np.flatnonzero(size == n)
        keys, at = np.unique(gram[mine], return_inverse=True)
        matrix = np.zeros((len(keys), len(languages)))
        np.add.at(matrix, (at, place[mine]), count[mine])
        tables.append(keys)
        rows.append(np.log((matrix + 0.5) / (matrix.sum(axis=0) + 0.5 * (len(keys) + 1))))
    return Model(languages, tables, rows)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, size, gram, count)`` over all texts of ``labelled(lang, text)``, grams by hash."""

    def run(batches):
        for batch in row_groups(batches, "text", 1 << 20):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, found in words.items():
                own, times = list(found), np.fromiter(found.values(), np.int64, len(found))
                for n in range(LONGEST + 1):
                    grams = [grams_of(w, n) for w in own] if n else [[w] for w in own]
                    keys, at = np.unique(hashed(list(chain.from_iterable(grams))), return_inverse=True)
                    count = np.bincount(at, np.repeat(times, [len(g) for g in grams]), len(keys)).astype(np.int64)
                    if len(keys):
                        yield batch_of(lang=pa.array([lang] * len(keys), pa.string()), size=np.full(len(keys), n, np.int32), gram=keys.view(np.int64), count=count)

    return map_batches(labelled.select("lang", "text"), run, "lang string, size int, gram long, count long").groupBy("lang", "size", "gram").agg(F.sum("count").alias("count"))


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on a sample by the hash of the text, of about ``rows`` rows that have a text and a language.

    Without any row the model knows no language.
    """
    bounded_batches(labelled.sparkSession)
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    total = usable.count()
    share = min(1.0, rows / total) if total else 1.0
    sample = usable.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    # bounded by the sample: numbers of some bytes, no strings but the languages' names
    found = gram_counts(sample).toArrow()
    lang = found.column("lang").combine_chunks().dictionary_encode()
    size, gram, count = (found.column(c).to_numpy() for c in ("size", "gram", "count"))
    return learn(lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False), size, gram.view(np.uint64), count)


class Known:
    """The scores of words that a task has met."""

    def __init__(self, model: Model):
        self.model, self.places, self.used = model, {}, 0
        self.scores = np.zeros((CACHED, max(1, len(model.languages))))

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.places))
        if self.used + len(new) > len(self.scores):  # full: begun anew, with room for these at least
            self.places, self.used, new = {}, 0, list(words)
            if len(new) > len(self.scores):
                self.scores = np.zeros((len(new), self.scores.shape[1]))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            self.scores[self.used : self.used + len(some)] = self.model.scores(some)
            self.places.update(zip(some, range(self.used, self.used + len(some)), strict=True))
            self.used += len(some)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the winner's share among the languages; columns of these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0; so is every text if the model knows no language. Of equal
    sums the first language in order wins. Repeated rows come out each.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = Known(shared.value)
        languages = known.model.languages
        for batch in row_groups(batches, text, 1 << 20):
            words = [words_of(t) for t in batch.column(text).to_pylist()] if languages else [[]] * batch.num_rows
            known.learn(set().union(*words))
            lang, score = [], []
            get = known.places.__getitem__
            for found in words:
                if not found:
                    lang.append(NONE)
                    score.append(0.0)
                    continue
                total = known.scores[np.fromiter(map(get, found), np.int64, len(found))].sum(axis=0)
                best = int(total.argmax())
                lang.append(languages[best])
                score.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
            yield batch_of(**{c: batch.column(c) for c in own}, lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()))

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in own), "lang_pred string, score double"])
    return map_batches(docs.select(*own), run, schema)


def held_out(key: Column) -> Column:
    """Documents that the classifier never learns from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: Model, least: float | None = None, text: str = "text") -> DataFrame:
    """``docs`` without those that are ``und`` or score ``least`` at most; its columns unchanged.

    By default documents go only if nothing in them says which language they are in: a score no better than an even guess.
    """
    if least is None:
        least = 1 / len(model.languages) * (1 + 1e-9) if len(model.languages) > 1 else 0.0
    renamed = docs.withColumnsRenamed({"lang_pred": "_own_lang_pred", "score": "_own_score"})
    kept = predict(renamed, model, text).where((F.col("lang_pred") != NONE) & (F.col("score") > least))
    return kept.drop("lang_pred", "score").withColumnsRenamed({"_own_lang_pred": "lang_pred", "_own_score": "score"}).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
