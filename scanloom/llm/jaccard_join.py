"""Exact set-similarity join of documents on word n-grams, with skipping by set relations.

Documents with equal sets are one node, which goes by its smallest doc_id. Under a total order of all shingles (by hash,
the most frequent ones last), two sets that are similar enough share a shingle of their prefixes, so each set is filed
under its prefix only. An index list holds its sets in blocks of one size, each block by the shingle's position:

* index-level skipping: for two blocks of a list the sizes say how early the shingle must stand in a set of either, if
  it is the first that two sets share. Blocks whose first position is too late are skipped whole, and of the others
  what stands behind that position; what meets no block is dropped before any text is touched.
* answer-level skipping: lists that begin with one set, its near copies' lists, are one family, and each size class of it has
  a leader. A set that links to its leader takes over the leader's component, so its answer comes from a set that is like
  it; families that lie in one component are skipped whole, and elsewhere only sets of different components
  meet. Rounds in which each set meets its most similar one of another component go on until they find no link; a
  last round then takes all pairs that are left.

Pairs are sifted by parity sketches, and each that is left is verified on the words of both whole texts. Nothing is capped:
lists and families of any length are split over tasks in blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, byte_rows, laid_out, map_batches, row_groups
from .shared import bounded_batches, connected_components, forget, saved
from .textcore import NOT_SPACE, Words, gram_hashes, mix

WORDS, PERCENT = 5, 80
#: The order puts at most so many shingles last, those that most prefixes hold. Any choice gives the same links.
LAST_SHINGLES, LAST_FROM = 1 << 20, 3
SKETCH_WORDS = 32
#: A family of more sets than this is split into blocks, and pairs of blocks are separate groups.
BLOCK = 4096
#: An index list that a task holds at once while entries that cannot link are dropped.
LIST = 1 << 16
#: Candidate pairs that a task holds before it gives them away without their repetitions.
PAIRS = 1 << 20
#: Up to so many identifiers a semi-join of documents is broadcast (8 MB); beyond, it is a shuffled join.
BROADCAST_IDS = 1_000_000


def needed(a, b, percent: int):
    """The least intersection with which sets of sizes ``a`` and ``b`` link."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def half_name(grams: np.ndarray) -> int:
    return int(grams.sum(dtype=np.uint64) >> np.uint64(1))


def shingles(column: pa.Array, words: int, named: bool = False):
    """For each text its distinct shingles, sorted by hash, and with ``named`` the halves of the set's name, 63 bits each.

    They are sums over the set of two hashes of each shingle, from two independent hashes of its words.
    """
    found = Words.of(*laid_out(column), NOT_SPACE)
    first = found.first.tolist()
    hashes = [found.hashes(which) for which in range(1 + named)]
    grams = [gram_hashes(h, words) for h in hashes]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            yield np.zeros(0, np.uint64), (0, 0)
            continue
        mine = [g[a : b - words + 1] if b - a >= words else gram_hashes(h[a:b], b - a) for g, h in zip(grams, hashes, strict=True)]
        if not named:
            yield np.unique(mine[0]), None
            continue
        order = np.argsort(mine[0])
        one, two = mine[0][order], mine[1][order]
        new = np.concatenate(([True], one[1:] != one[:-1]))
        one, two = one[new], two[new]
        yield one, (half_name(one), half_name(two))


def sketch_of(grams: np.ndarray) -> bytes:
    """Parities of the set over 2,048 cells: differing parities never outnumber differing shingles."""
    cells = np.bincount((mix(grams) >> np.uint64(53)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def word_set(data: np.ndarray, words: int) -> set:
    """The set in the words themselves."""
    found = data.tobytes().lower().split()  # both know ASCII only: A-Z, and blanks, tabs and line ends
    n = min(words, len(found))
    return set(zip(*(found[i:] for i in range(n)), strict=False)) if n else set()


def features(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """For each document its set's size and name, and its prefix by hash, the latter once for a set and task."""

    def run(batches):
        seen = set()
        for batch in row_groups(batches, "text", 1 << 20):
            n, name, prefix = [], [], []
            for grams, this in shingles(batch.column("text"), words, named=True):
                n.append(len(grams))
                name.append(this)
                fresh = len(grams) and this not in seen
                seen.add(this)
                prefix.append(grams[: prefix_size(len(grams), percent)].view(np.int64) if fresh else None)
            one, two = zip(*name, strict=True)
            yield batch_of(doc_id=batch.column("doc_id"), n=pa.array(n, pa.int32()), one=pa.array(one, pa.int64()), two=pa.array(two, pa.int64()), prefix=pa.array(prefix, pa.list_(pa.int64())))

    return map_batches(docs, run, "doc_id long, n int, one long, two long, prefix array<long>")


def last_shingles(found: DataFrame) -> np.ndarray:
    """Shingles that go last in the order, the most frequent at the end: a bounded table, so it may be broadcast."""
    counts = found.select(F.explode("prefix").alias("gram")).groupBy("gram").count().where(F.col("count") >= LAST_FROM)
    rows = counts.orderBy(F.desc("count"), "gram").limit(LAST_SHINGLES).select("gram").toArrow()
    return rows.column("gram").to_numpy()[::-1].view(np.uint64)


def index_entries(docs: DataFrame, last: np.ndarray, words: int, percent: int) -> DataFrame:
    """A row for each shingle of each set's prefix under the order; sets go by half their names here."""
    places = np.argsort(last, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((last[places], places + 1))

    def run(batches):
        keys, ranks = shared.value
        seen = set()
        for batch in row_groups(batches, "text", 1 << 20):
            gram, one, size, pos = [], [], [], []
            for grams, _ in shingles(batch.column("text"), words):
                if not (total := len(grams)) or (name := hashlib.blake2b(grams, digest_size=16).digest()) in seen:
                    continue
                seen.add(name)
                half = half_name(grams)
                take = prefix_size(total, percent)
                if len(keys):
                    at = np.searchsorted(keys, grams)
                    at[at == len(keys)] = 0
                    late = np.where(keys[at] == grams, ranks[at], 0)
                    head = np.flatnonzero(late == 0)
                    if len(head) < take:
                        head = np.concatenate((head, (order := np.flatnonzero(late))[np.argsort(late[order], kind="stable")]))
                    grams = grams[head[:take]]
                gram.append(grams[:take])
                one.append(half)
                size.append(total)
                pos.append(np.arange(take, dtype=np.int32))
            if gram:
                times = [len(x) for x in gram]
                yield batch_of(gram=np.concatenate(gram).view(np.int64), one=np.repeat(np.array(one, np.int64), times), n=np.repeat(np.array(size, np.int32), times), pos=np.concatenate(pos))

    return map_batches(docs.select("text"), run, "gram long, one long, n int, pos int")


def complete_groups(batches, keys: int, most: int | None = None):
    """Sorted batches as tables of whole groups by the first ``keys`` columns, with the groups' bounds.

    With ``most``, a group that grows beyond so many rows is passed on in pieces, each as ``(table, None)``, its rest too.
    """
    held = passed = None  # passed: the group that pieces were passed on of last, while it may go on
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None and len(held) else table
        columns = [table.column(i).to_numpy() for i in range(keys)]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in columns], axis=0)) + 1
        if passed is not None and len(table):
            rest = 0
            if passed == [k[0] for k in columns]:
                rest = int(change[0]) if len(change) else len(table)
                yield table.slice(0, rest), None
            if rest < len(table):
                passed = None
            table, change = table.slice(rest), change[change > rest] - rest
        if len(change):
            yield table.slice(0, change[-1]), np.concatenate(([0], change))
            held = table.slice(change[-1])
        else:
            held = table
        if most is not None and len(held) > most:
            yield held, None
            held, passed = held.slice(len(held)), [k[-1] for k in columns]
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def linkable(gram: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Rows of whole lists, sorted by size and position, that can link with another row of their list if its shingle is the first they share.

    Blocks of one size are compared with blocks at a growing distance; lists that have ended drop out, and so do sizes out of reach.
    """
    if not len(gram):
        return np.zeros(0, bool)
    begin = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (n[1:] != n[:-1]))))
    count = np.diff(np.concatenate((begin, [len(gram)])))
    list_, size, first = gram[begin], n[begin], pos[begin]
    second = np.where(count > 1, pos[np.minimum(begin + 1, len(pos) - 1)], np.iinfo(np.int64).max)
    last = size - needed(size, size, percent)
    last = np.where(second <= last, last, -1)  # the latest position of a block that meets any other row
    open_, step = np.arange(len(begin)), 1
    while len(open_):
        open_ = open_[open_ + step < len(begin)]
        open_ = open_[(list_[open_ + step] == list_[open_]) & (percent * size[open_ + step] <= 100 * size[open_])]
        a, b = open_, open_ + step
        need = needed(size[a], size[b], percent)
        meet = (first[a] <= size[a] - need) & (first[b] <= size[b] - need)
        a, b, need = a[meet], b[meet], need[meet]
        last[a] = np.maximum(last[a], size[a] - need)
        last[b] = np.maximum(last[b], size[b] - need)
        step += 1
    return pos <= np.repeat(last, count)


def shared_entries(entries: DataFrame, percent: int) -> DataFrame:
    """Sets that, by sizes and positions, can link with another of a list, with the list's first set as its head: ``(head, head_n, one, n)``.

    Lists that are too long to hold are passed on whole, piece by piece.
    """

    def run(batches):
        last = None
        for table, bounds in complete_groups(batches, 1, LIST):
            gram, one, n, pos = (table.column(i).to_numpy().astype(np.int64) for i in range(4))
            keep = np.ones(len(gram), bool)  # one entry for a set
            keep[1:] = (gram[1:] != gram[:-1]) | (one[1:] != one[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])
            gram, one, n, pos = gram[keep], one[keep], n[keep], pos[keep]
            rows = np.arange(len(gram)) if bounds is None else np.flatnonzero(linkable(gram, n, pos, percent))
            if not len(rows):
                continue
            gram, one, n = gram[rows], one[rows], n[rows]
            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            times = np.diff(np.concatenate((first, [len(gram)])))
            head, head_n = np.repeat(one[first], times), np.repeat(n[first], times)
            if last is not None and last[0] == gram[0]:  # a list that goes on
                head[gram == gram[0]], head_n[gram == gram[0]] = last[1:]
            last = (gram[-1], head[-1], head_n[-1])
            yield batch_of(head=head, head_n=head_n.astype(np.int32), one=one, n=n.astype(np.int32))

    ordered = entries.repartition("gram").sortWithinPartitions("gram", "n", "pos", "one")
    return map_batches(ordered, run, "head long, head_n int, one long, n int").distinct()


def sketched(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, sketch, text)`` of the documents that ``nodes(node)`` name."""
    small = nodes.count() <= BROADCAST_IDS

    def run(batches):
        for batch in row_groups(batches, "text", 1 << 20):
            found = [sketch_of(grams) for grams, _ in shingles(batch.column("text"), words)]
            yield batch_of(node=batch.column("doc_id"), sketch=pa.array(found, pa.binary()), text=batch.column("text"))

    mine = docs.join(F.broadcast(nodes) if small else nodes, docs["doc_id"] == nodes["node"], "left_semi").select("doc_id", "text")
    return saved(map_batches(mine, run, "node long, sketch binary, text string"), "texts")


def sketch_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)


def within(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many parities of sketches differ, or -1 where that is more than sets of sizes ``n`` and ``m`` that link can; ``y`` may be one row."""
    y = np.broadcast_to(y, x.shape)
    most = n + m - 2 * needed(n, m, percent)
    differ = np.bitwise_count(x[:, :8] ^ y[:, :8]).sum(axis=1, dtype=np.int64)
    near = np.flatnonzero(differ <= most)
    differ[differ > most] = -1
    whole = differ[near] + np.bitwise_count(x[near, 8:] ^ y[near, 8:]).sum(axis=1, dtype=np.int64)
    differ[near] = np.where(whole <= most[near], whole, -1)
    return differ


def star_pairs(families: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Each set of a family with the leader of its size class, where sizes and sketches leave a link possible."""
    step = F.log(F.lit(100.0 / percent))
    classed = families.withColumn("class", F.floor(F.log(F.col("n") / F.col("head_n")) / step + 1e-9).cast("int"))
    leaders = classed.groupBy("head", "class").agg(F.min(F.struct("n", "node")).alias("leader"))
    pairs = classed.join(leaders, ["head", "class"]).where((F.col("node") != F.col("leader.node")) & (100 * F.col("leader.n") >= percent * F.col("n")))
    pairs = pairs.select(F.col("node").alias("a"), "n", F.col("leader.node").alias("b"), F.col("leader.n").alias("m")).distinct()
    one, two = (sketches.withColumnsRenamed({"node": c, "sketch": f"sketch_{c}"}) for c in "ab")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 3))
                fits = within(sketch_rows(batch.column(4)), sketch_rows(batch.column(5)), n, m, percent) >= 0
                yield batch.select([0, 2]).filter(pa.array(fits))

    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "n", "b", "m", "sketch_a", "sketch_b"), run, "a long, b long")


def cross_pairs(families: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of sets of one family and different components that may link.

    With ``nearest``, only for each set of a family the pair whose sketches differ least. Families in one
    component are dropped before anything else. Larger ones than ``BLOCK`` are dealt as pairs of blocks; blocks of the
    component that most of a family lies in don't meet each other.
    """
    labelled = families.select("head", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = labelled.groupBy("head", "label").count().groupBy("head").agg(F.sum("count").alias("all"), F.max_by("label", F.struct("count", "label")).alias("major"), F.max("count").alias("most"), F.count("*").alias("labels"))
    open_ = counts.where("labels > 1").select("head", "major", *[F.when(F.col("all") <= BLOCK, F.lit(0)).otherwise(F.ceil(c / BLOCK)).cast("int").alias(n) for c, n in ((F.col("most"), "majors"), (F.col("all") - F.col("most"), "minors"))])
    of_most = F.col("label") == F.col("major")
    mine = F.pmod(F.xxhash64("node"), F.greatest(F.when(of_most, F.col("majors")).otherwise(F.col("minors")), F.lit(1))).cast("int") + F.when(of_most, F.lit(0)).otherwise(F.col("majors"))
    others = F.when(F.col("minors") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.when(of_most, F.col("majors")).otherwise(F.lit(0)), F.col("majors") + F.col("minors") - 1))
    dealt = (
        labelled.join(open_, "head")
        .withColumn("mine", F.when(F.col("minors") == 0, F.lit(0)).otherwise(mine))
        .join(sketches, "node")
        .withColumn("other", F.explode(others))
        .select("head", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), "mine", "n", "node", "label", "sketch")
    )

    def run(batches):
        given, held = [], 0

        def distinct():
            pairs = np.unique(np.concatenate(given), axis=0)
            return batch_of(a=pairs[:, 0].copy(), b=pairs[:, 1].copy())

        for table, bounds in complete_groups(batches, 3):
            first, second, mine, n, node, label = [table.column(i).to_numpy().astype(np.int64) for i in range(1, 7)]
            sketch = sketch_rows(table.column(7))
            for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if given and held > PAIRS:
                    yield distinct()
                    given, held = [], 0
                if e - b < 2 or (label[b:e] == label[b]).all():
                    continue
                blocks = first[b] != second[b]
                ends = b + np.searchsorted(n[b:e], n[b:e] * 100 // percent, "right")
                least, partner = np.full(e - b, 1 << 30), np.zeros(e - b, np.int64)
                for i in range(b, e - 1):
                    j = slice(i + 1, ends[i - b])
                    fits = label[j] != label[i]
                    if blocks:
                        fits &= mine[j] != mine[i]
                    k = np.flatnonzero(fits) + i + 1
                    if not len(k):
                        continue
                    differ = within(sketch[k], sketch[i : i + 1], n[k], n[i : i + 1], percent)
                    k, differ = k[differ >= 0], differ[differ >= 0]
                    if not len(k):
                        continue
                    if nearest:
                        best = int(differ.argmin())
                        if differ[best] < least[i - b]:
                            least[i - b], partner[i - b] = differ[best], k[best]
                        better = differ < least[k - b]
                        least[k[better] - b], partner[k[better] - b] = differ[better], i
                    else:
                        given.append(np.stack((np.minimum(node[k], node[i]), np.maximum(node[k], node[i])), axis=1))
                        held += len(k)
                if nearest and len(k := np.flatnonzero(least < 1 << 30)):
                    one, two = node[k + b], node[partner[k]]
                    given.append(np.stack((np.minimum(one, two), np.maximum(one, two)), axis=1))
                    held += len(k)
        if given:
            yield distinct()

    order = ["head", "first", "second"]
    return map_batches(dealt.repartition(*order).sortWithinPartitions(*order, "n", "node"), run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """Those of ``pairs(a, b)`` of nodes whose sets link, judged on the words of the whole texts."""
    # the leaders, which many pairs share, come last: their texts aren't shuffled once for each pair
    one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    joined = pairs.join(one, "a").join(two, "b")

    def run(batches):
        last: tuple = (None, set())
        for batch in batches:
            left, right = [], []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), byte_rows(batch.column("text_a")), byte_rows(batch.column("text_b")), strict=True):
                if last[0] != b:
                    last = (b, word_set(y, words))
                mine = word_set(x, words)
                both = len(mine & last[1])
                if 100 * both >= percent * (len(mine) + len(last[1]) - both):
                    left.append(a)
                    right.append(b)
            yield batch_of(a=pa.array(left, pa.int64()), b=pa.array(right, pa.int64()))

    return saved(map_batches(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long"), f"{name}-links")


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row ``doc_id, n_shingles, component_id``: components of the links with 100 * intersection >= percent * union.

    Words are maximal runs of bytes other than blanks, tabs and line ends, A-Z lower-cased. Texts of fewer than
    ``words`` words have their whole sequence as one shingle. Null, empty and blank texts have the empty set and
    are components of their own. Rows that share a ``doc_id`` must share a text and come out each. Rows without a
    ``doc_id`` link with nothing and have no component: it is null. An empty table gives an empty result. Links are
    judged on words. Equal sets are known by 126 bits from two
    independent hashes of their words; shingles are counted by 64.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    bounded_batches(spark)
    with_prefix = saved(features(docs, words, percent), "features")
    last = last_shingles(with_prefix)
    found = saved(with_prefix.drop("prefix"), "sets")
    forget(spark, with_prefix)
    nodes = saved(found.where("n > 0 AND doc_id IS NOT NULL").groupBy("one", "two").agg(F.min("doc_id").alias("node"), F.first("n").alias("n")), "nodes")
    shared = saved(shared_entries(index_entries(docs.where("doc_id IS NOT NULL"), last, words, percent), percent), "entries")
    # should two sets share half a name, both come out here
    heads = nodes.select(F.col("one").alias("head"), F.col("n").alias("head_n"), F.col("node").alias("head_node"))
    placed = shared.join(nodes.select("one", "n", "node"), ["one", "n"]).join(heads, ["head", "head_n"])
    families = saved(placed.select(F.col("head_node").alias("head"), "head_n", "node", "n").distinct(), "families")
    forget(spark, shared)
    texts = sketched(docs, families.select("node").distinct(), words)
    sketches = texts.select("node", "sketch")

    links = verified(star_pairs(families, sketches, percent), texts, words, percent, "star")
    while True:
        group = connected_components(links, "components")
        labels = group.withColumnsRenamed({"component": "label"})
        more = verified(cross_pairs(families, labels, sketches, percent, nearest=True), texts, words, percent, "nearest")
        if more.isEmpty():
            break
        links = group.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    rest = verified(cross_pairs(families, labels, sketches, percent, nearest=False), texts, words, percent, "rest")
    if not rest.isEmpty():
        group = connected_components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest), "components")
    for done in (families, texts):
        forget(spark, done)
    # a node is its smallest doc_id, so a component's smallest node is its smallest doc_id
    answer = nodes.select("one", "two", "node").join(group, "node", "left").select("one", "two", F.coalesce("component", "node").alias("component_id"))
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return found.join(answer, ["one", "two"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def drop_similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest key, all its equal rows included.

    Rows without a key link with nothing, so all of them stay.
    """
    kept = similar_components(docs, words, percent, key, text).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    keyed = docs[key].cast("long")
    return docs.join(kept, keyed == kept["_kept"], "left_semi").union(docs.where(keyed.isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_components(docs)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, md5_number_lower(array_to_string(w[i + 1 : i + least(len(w), 5)], chr(1))) AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(len(w), 5) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= 80 * (s.n + t.n - k)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
