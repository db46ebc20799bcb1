"""Each operator against a plain version, on ordinary rows and on nulls, empty and long texts, ties, repeats and empty tables."""

import os
import tracemalloc
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanloom.llm import arrow, decontaminate, html_text, jaccard_join, language_id, metric_join, packing, sharding, suffix_dedup, token_table, url_filter
from scanloom.llm.encoder import Encoder, default_tokenizer

DOCS = "doc_id long, text string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.integers(vocabulary)}x{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, odd rows, and a group of near copies that is larger than the blocks used in tests."""
    rng = np.random.default_rng(11)
    rows, passage = [], prose(rng, 40)
    bases = [prose(rng, int(rng.integers(30, 200))) for _ in range(12)]
    for base in bases:
        for _ in range(6):
            w = base.split()
            for _ in range(int(rng.integers(0, 5))):
                w[rng.integers(len(w))] = f"edit{rng.integers(10**6)}"
            rows.append(" ".join(w))
    group = prose(rng, 120).split()
    for _ in range(60):
        w = list(group)
        for _ in range(int(rng.integers(0, 7))):
            w[rng.integers(len(w))] = f"near{rng.integers(10**6)}"
        rows.append(" ".join(w))
    for _ in range(40):
        rows.append(prose(rng, int(rng.integers(5, 80))) + " " + passage + " " + prose(rng, int(rng.integers(0, 40))))
    rows += [None, "", "   \n\t", "one two", "ONE two", "one two three four five", "a" * 450, "b" * 99, "ab" * 300, "é" * 120, "é" * 120]
    rows += [prose(rng, 6000, 40), bases[0], bases[0], bases[0].upper()]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j]) for i, j in enumerate(order)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(5)


def with_clashes(df):
    """Columns that are called like the operators' own."""
    return df.withColumns({c: F.lit(1) for c in ("n", "node", "key", "kept", "cut", "shard", "n_bytes", "host", "score", "lang_pred", "n_hit", "contaminated", "row", "rep")})


# -- 1 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4096, 16])
def test_jaccard_join(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(frame(spark, corpus)).collect()}
    assert got == brute.similar(corpus)


def test_jaccard_join_long_lists(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST", 8)
    monkeypatch.setattr(jaccard_join, "LAST_FROM", 10**6)
    rows = corpus[:120]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(frame(spark, rows)).collect()}
    assert got == brute.similar(rows)


def test_groups_in_pieces_have_no_ordinary_rest():
    keys = [1] * 3 + [2] * 23 + [3] * 2 + [4] * 9 + [5] * 20
    for rows in (1, 4, 5, 7, 30):
        batches = [pa.RecordBatch.from_pydict({"gram": keys[i : i + rows], "row": list(range(i, min(i + rows, len(keys))))}) for i in range(0, len(keys), rows)]
        groups, pieces, order = [], set(), []
        for table, bounds in jaccard_join.complete_groups(iter(batches), 1, 8):
            order += table.column("row").to_pylist()
            found = table.column("gram").to_pylist()
            if bounds is None:
                assert len(set(found)) == 1
                pieces.add(found[0])
            else:
                groups += [found[b:e] for b, e in zip(bounds[:-1], bounds[1:])]
        assert order == list(range(len(keys)))
        assert not pieces & {g[0] for g in groups} and all(g == [g[0]] * keys.count(g[0]) for g in groups)
        assert rows > 8 or {2, 5} <= pieces


@pytest.mark.parametrize("batch", ["5", "7"])
def test_jaccard_join_lists_in_pieces_with_a_rest(spark, monkeypatch, batch):
    monkeypatch.setattr(jaccard_join, "LIST", 16)
    monkeypatch.setattr(jaccard_join, "LAST_FROM", 10**6)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        # the largest sets end the lists: each links with small ones only, which lie in the pieces before
        rng = np.random.default_rng(2)
        template = prose(rng, 104, 10**6)
        rows = [(i, template + "".join(f" own{i}x{j}" for j in range(i % 26))) for i in range(70)]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == brute.similar(rows)


def test_jaccard_join_keeps_one_of_each_group(spark, corpus):
    df = with_clashes(frame(spark, corpus))
    kept = jaccard_join.drop_similar(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute.similar(corpus).values()})


def test_jaccard_join_without_ids(spark):
    rng = np.random.default_rng(4)
    a, b, alone = (prose(rng, 60) for _ in range(3))
    w = b.split()
    chain = [" ".join(["y"] * 6 + w[6:]), b, " ".join(w[:-6] + ["z"] * 6)]  # neighbours link, the ends don't
    rows = [(1, a), (2, a), (None, a), (None, a), (3, chain[0]), (None, chain[1]), (4, chain[2]), (None, alone), (None, ""), (None, None), (5, "")]
    df = frame(spark, rows)
    assert {c for _, c in brute.similar([(3, chain[0]), (9, chain[1]), (4, chain[2])]).values()} == {3}
    assert brute.similar([(3, chain[0]), (4, chain[2])])[4][1] == 4
    got = jaccard_join.similar_components(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute.similar([r for r in rows if r[0] is not None])
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None) == [(0, None)] * 2 + [(56, None)] * 4  # of no text twice, of a twice, of b and of alone
    kept = [tuple(r) for r in jaccard_join.drop_similar(df).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[0] != 2], key=str)


def test_jaccard_join_compares_words(spark):
    """Words of which hashes that are polynomials of their letters can't tell: a structured word and its complement."""
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(frame(spark, [(1, word), (2, other), (3, word), (4, word + " x"), (5, other + " x")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_blocks_of_lists_are_skipped_only_if_nothing_links():
    rng = np.random.default_rng(9)
    for percent in (80, 55):
        rows = sorted({(int(rng.integers(30)), int(n := rng.integers(1, 40)), int(rng.integers(0, jaccard_join.prefix_size(int(n), percent)))) + (i,) for i in range(600)})
        gram, n, pos, _ = (np.array(x) for x in zip(*rows))
        room = np.minimum((n - pos)[:, None], (n - pos)[None])
        meet = (gram[:, None] == gram[None]) & (room >= jaccard_join.needed(n[:, None], n[None], percent)) & ~np.eye(len(n), dtype=bool)
        assert (jaccard_join.linkable(gram, n, pos, percent) == meet.any(axis=1)).all()


def test_jaccard_join_survives_half_names_that_clash(spark, corpus, monkeypatch):
    for name in ("features", "index_entries"):
        monkeypatch.setattr(jaccard_join, name, lambda *args, real=getattr(jaccard_join, name): real(*args).withColumn("one", (F.col("n") % 3).cast("long")))
    rows = [r for r in corpus if r[1] is None or len(r[1]) < 900][:70]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(frame(spark, rows)).collect()}
    assert got == brute.similar(rows)


def test_jaccard_join_empty(spark):
    assert jaccard_join.similar_components(frame(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard_join.similar_components(frame(spark, [(4, None), (4, None)])).collect()] == [(4, 0, 4)] * 2


# -- 2 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages():
    rng = np.random.default_rng(3)
    parts = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["eau", "oux", "tre", "que"]}
    rows = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        text = " ".join("".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(30))
        rows.append((i, text, lang if i % 17 else None))
    return rows


def test_language_id(spark, languages):
    df = spark.createDataFrame(languages, "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    assert {r["doc_id"]: r["held_out"] for r in df.collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in languages}
    model = language_id.fit(df.where("NOT held_out"))
    assert model.languages == ["aa", "bb", "cc"]
    got = language_id.predict(with_clashes(df), model).collect()
    truth = {i: lang for i, _, lang in languages if lang}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_odd_texts(spark, languages):
    model = language_id.fit(spark.createDataFrame(languages, "doc_id long, text string, lang string"))
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !? ½ ² ①"), (4, "schungver " * 20_000), (5, "日本語"), (5, "日本語")])
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language_id.predict(odd, model).collect())
    assert got[:4] == [(1, "und"), (2, "und"), (3, "und"), (4, "bb")] and got[4] == got[5] and got[4][1] in model.languages
    kept = language_id.keep_identified(with_clashes(odd), model)
    assert {r["doc_id"] for r in kept.collect()} == {4} and kept.columns == with_clashes(odd).columns


def test_language_id_without_anything_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.fit(empty)
    assert language_id.predict(empty, model).count() == 0
    assert language_id.predict(frame(spark, [(1, "word")]), model).first()["lang_pred"] == "und"


def test_backoff_goes_to_shorter_grams():
    counts = [("x", 0, "abc", 5), ("y", 0, "def", 5), ("x", 3, "abc", 5), ("y", 1, "z", 2), ("x", 1, "q", 2)]
    lang, size, gram, count = zip(*counts)
    model = language_id.learn(["y", "x"], np.array(["yx".index(x) for x in lang]), np.array(size), language_id.hashed(gram), np.array(count))
    scores = model.scores(["abc", "zabcz", "zzz", "???"])
    assert model.languages == ["x", "y"] and scores[0, 0] > scores[0, 1] and scores[1, 0] > scores[1, 1] and scores[2, 1] > scores[2, 0] and not scores[3].any()


def test_language_scores_equal_plain_ones(spark, languages, monkeypatch):
    texts = [(i, t) for i, t, _ in languages[:40]] + [(900, "kalo schxx zzeau éé q"), (901, "kaxlo tremendous"), (902, "ß")]
    want = brute.language_scores([(t, lang) for _, t, lang in languages if lang], texts)
    model = language_id.fit(spark.createDataFrame(languages, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(frame(spark, texts), model).collect()}
    for i, _ in texts:
        assert got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-9)


def test_language_words_are_letters_with_their_marks(monkeypatch):
    assert language_id.words_of("½ ² ① Ⅳ 12 _ \u0301") == [] and language_id.words_of("हिन्दी, e\u0301te a1b 日本語x2") == ["हिन्दी", "e\u0301te", "a", "b", "日本語x"]
    monkeypatch.setattr(language_id, "CACHED", 3)
    model = language_id.learn(["x"], np.zeros(2, int), np.array([0, 1]), language_id.hashed(["ab", "c"]), np.array([3, 2]))
    known = language_id.Known(model)
    for words in ({"ab", "c"}, {"ab", "d", "e"}, {"ab", "c", "d", "e", "f"}, {"ab"}):
        known.learn(words)
        for w in words:
            assert (known.scores[known.places[w]] == model.scores([w])[0]).all()


# -- 3 ---------------------------------------------------------------------------------------------------------------

ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def benchmark():
    rng = np.random.default_rng(5)
    return [(10, prose(rng, 25)), (11, prose(rng, 10)), (2, "short item here"), (3, None), (4, "..."), (5, "one"), (10, None), (12, prose(rng, 12))]


@pytest.fixture(scope="module")
def dirty(benchmark):
    rng = np.random.default_rng(6)
    long = benchmark[0][1].split()
    rows = [prose(rng, 50), None, "", "!!!", "x " + " ".join(long[3:15]) + " y", " ".join(long[3:12]), "A SHORT, item. here!", "no one here", benchmark[1][1].upper() + " é " + benchmark[1][1], ", ".join(long), prose(rng, 30_000, 30) + " " + benchmark[1][1]]
    return list(enumerate(rows + rows[4:6]))


def test_decontaminate(spark, dirty, benchmark, monkeypatch):
    found = decontaminate.find_contaminated(frame(spark, dirty), spark.createDataFrame(benchmark, ITEMS))
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert got == brute.contaminated(dirty, benchmark)
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 50)
    again = decontaminate.find_contaminated(frame(spark, dirty), spark.createDataFrame(benchmark, ITEMS))
    assert {r["doc_id"]: tuple(r)[1:] for r in again.collect()} == got


def test_decontaminate_rows_without_key(spark, dirty, benchmark, monkeypatch):
    rows = [(None, t) for _, t in dirty] + [(7, dirty[4][1]), (7, dirty[0][1])]
    bad = [x[-1] for x in brute.contaminated(list(enumerate(t for _, t in rows)), benchmark).values()]
    df, bench = frame(spark, rows), spark.createDataFrame(benchmark, ITEMS)
    seen = {}
    for size in (decontaminate.SLICE_BYTES, 50):
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", size)
        kept = sorted((tuple(r) for r in decontaminate.decontaminate(df, bench).collect()), key=str)
        assert kept == sorted([r for r, b in zip(rows, bad, strict=True) if not b], key=str)
        seen[size] = sorted((tuple(r) for r in decontaminate.find_contaminated(df, bench).collect()), key=str)
    whole, sliced = seen.values()
    assert whole == sliced


def test_decontaminate_removes(spark, dirty, benchmark):
    df, bench = with_clashes(frame(spark, dirty)), spark.createDataFrame(benchmark, ITEMS)
    bad = {i for i, x in brute.contaminated(dirty, benchmark).items() if x[-1]}
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in dirty} - bad
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench, mode="spans").collect()}
    assert spans[0] == dirty[0][1] and spans[4] == "x  y" and spans[1] is None


def test_decontaminate_empty(spark, dirty):
    none = spark.createDataFrame([], ITEMS)
    assert not any(r["contaminated"] for r in decontaminate.find_contaminated(frame(spark, dirty), none).collect())
    assert decontaminate.find_contaminated(frame(spark, []), none).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("settings", [{}, {"HOT": 3, "BATCH": 20, "FAMILY": 300, "SEGMENT": 900}])
def test_suffix_dedup(spark, corpus, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeats(frame(spark, corpus)).collect()}
    assert got == brute.repeats(corpus)


def test_suffix_dedup_of_texts(spark, corpus):
    df = with_clashes(frame(spark, corpus))
    got = suffix_dedup.remove_repeats(df)
    assert got.columns == df.columns and got.count() == len(corpus)
    by_id = {r["doc_id"]: r["text"] for r in got.collect()}
    want = brute.repeats(corpus)
    for i, t in corpus:
        if t is None:
            assert by_id[i] is None
        elif want[i][1] == 0:
            assert by_id[i] == t


def test_suffix_dedup_odd_rows(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(400))
    rows = [(1, long), (1, long), (None, long), (2, long), (3, None)]
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["n_removed"]) for r in suffix_dedup.repeats(frame(spark, rows)).collect() if r["doc_id"] in (2, 3, None))
    assert [n for _, n in got] == [400, 0, 0]
    first = [r["n_removed"] for r in suffix_dedup.repeats(frame(spark, rows)).where("doc_id = 1").collect()]
    assert len(first) == 2 and len(set(first)) == 1
    assert suffix_dedup.repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("settings", [{}, {"HOT": 3, "BATCH": 20, "FAMILY": 300, "SEGMENT": 900}])
def test_suffix_dedup_of_repeated_rows(spark, corpus, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    rows = corpus + corpus[::2] + corpus[::3]
    want = brute.repeats(corpus)
    for parts in (1, 5):
        got = suffix_dedup.repeats(frame(spark, rows).repartition(parts)).collect()
        assert len(got) == len(rows) and all(tuple(r)[1:] == want[r["doc_id"]] for r in got)


def test_suffix_windows_need_little_besides_themselves():
    """An index for each byte of each window took eight times the windows; workers held it in the pipeline's fullest stage."""
    rng = np.random.default_rng(3)
    rows = [rng.integers(97, 123, 180, dtype=np.uint8).tobytes() for _ in range(500)]
    rows += rows[:20]
    batch = pa.RecordBatch.from_pydict(
        {"anchor": [1] * len(rows), "deal": [0] * len(rows), "doc_id": list(range(len(rows))), "first": [7] * len(rows), "data": rows},
        pa.schema([(c, pa.int64()) for c in ("anchor", "deal", "doc_id", "first")] + [("data", pa.binary())]),
    )

    class Captured:
        """Stands for the table, and hands over the function of the tasks."""

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, schema):
            return run

    run = suffix_dedup.earlier_windows(Captured(), 100)
    tracemalloc.start()
    found = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(tuple(r.values()) for x in found for r in x.to_pylist()) == [(i, 7, 187) for i in range(500, 520)]
    assert peak < 6 * len(rows) * 81 * 100


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE")


def test_tasks_leave_no_memory():
    """What a task freed below something that lives on stayed with the worker for the stages after it."""
    pins = []

    def run(batches):
        held = [np.ones(4000) for _ in range(8000)]  # 256 MB in pieces that come from the heap
        pins.append(np.ones(4000))
        yield from batches
        del held

    def used(task):
        before = resident()
        list(task(iter([])))
        return resident() - before

    assert used(arrow.leaving_no_memory(run)) < 64 << 20


def test_suffix_family_merges_levels():
    family = suffix_dedup.SuffixFamily(8)
    rng = np.random.default_rng(0)
    seen = set()
    for _ in range(40):
        batch = rng.integers(97, 99, (30, 8)).astype(np.uint8)
        want = []
        for w in map(bytes, batch):
            want.append(w in seen)
            seen.add(w)
        assert family.add(batch).tolist() == want
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


# -- 5 and 7 -----------------------------------------------------------------------------------------------------------

TEXTS = [None, "", "plain words, here. And  two  blanks", "don't can't it's!'s", "\n word\n\n two\r\n", "tab\tand\x0bvertical  em", "é à ünïcödé 日本語 ½²", "<|endoftext|> inside", "x" * 5000, "many words " * 3000, "a", "a", "trailing  ", " ,. !? #$%"]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def encoded(e, texts):
    ids, bounds = e.encode_column(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_encoder_equals_the_library(ids):
    for slots, store in ((4, 16), (1 << 12, 1 << 12)):
        e = Encoder(default_tokenizer(), slots=slots, store=store)
        for _ in range(2):
            assert encoded(e, TEXTS) == ids
    assert encoded(e, []) == [] and encoded(e, [None, "", None]) == [[], [], []]
    got, bounds = e.encode_column(pa.array(TEXTS, pa.string()).slice(2, 4), end_id=7)
    assert [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*x, 7] for x in ids[2:6]]


def test_encoder_takes_special_tokens_as_text_if_told():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    text = "a <|endoftext|> b<|endoftext|>"
    assert encoded(Encoder(default_tokenizer(), special_as_text=True), [text]) == [t.encode(text, add_special_tokens=False).ids]
    assert encoded(Encoder(default_tokenizer()), [text])[0].count(50256) == 2


@pytest.mark.parametrize("part", [1 << 21, 40])
def test_encoder_cuts_where_the_library_does(monkeypatch, part):
    from tokenizers import Tokenizer

    from scanloom.llm import encoder

    monkeypatch.setattr(encoder, "PART", part)
    t, rng = Tokenizer.from_file(default_tokenizer()), np.random.default_rng(3)
    parts = ["a", "Be", "the", "don", "'t", "'S", "'", "''", " ", " ", "  ", "\n", "\t", "\r\n", ".", ",", "!?", "(", "7", "42", "é", "ß", "×", "÷", "日", "\u0301", "\u00a0", "\u2003", "\u200b", "\x0b", "\x1d", "\x00", "_", "-", "😀", "<|endoftext|>", "<|", "supercalifragilisticexpialidocious", "\u2019", "\u3000", "\u0085"]
    texts = ["".join(rng.choice(parts[:31] if i % 3 else parts, int(rng.integers(0, 30)))) for i in range(4000)]
    e = Encoder(default_tokenizer(), slots=1 << 10, store=1 << 10)
    assert encoded(e, texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_token_tables(spark, ids, tmp_path):
    rows = [(3 * i - 7 if i else None, t) for i, t in enumerate(TEXTS)]
    manifest = token_table.write_tables(frame(spark, rows), f"file://{tmp_path}/t", default_tokenizer(), 0)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_table.read_tables(manifest).collect()}
    start = 0
    for (i, _), x in zip(rows, ids, strict=True):
        x = np.array([*x, 0], "<u4")
        assert got[i] == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    readers = [token_table.TableReader(r["path"]) for r in manifest.collect()]
    for (i, _), x in zip(rows[1:], ids[1:], strict=True):
        assert [r.get(i).tolist() for r in readers if r.get(i) is not None] == [[*x, 0]]
    assert all(r.get(10**9) is None for r in readers)


def test_token_tables_repeat_and_roll_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_table, "FILE_BYTES", 100)
    monkeypatch.setattr(token_table, "BLOCK_BYTES", 40)
    rows = [(1, "same words here")] * 5 + [(2, "other")]
    manifest = token_table.write_tables(frame(spark, rows), f"file://{tmp_path}/t", default_tokenizer(), 0)
    assert manifest.count() == 1  # the documents of a key stay together, and these are few
    got = sorted(tuple(r) for r in token_table.read_tables(manifest).collect())
    assert [g[0] for g in got] == [1] * 5 + [2] and [g[1] for g in got] == list(np.cumsum([0] + [g[2] for g in got])[:-1])
    assert token_table.read_tables(token_table.write_tables(frame(spark, []), f"file://{tmp_path}/e", default_tokenizer(), 0)).count() == 0


@pytest.mark.parametrize("sent", [1 << 18, 5])
def test_token_table_look_up(spark, ids, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(token_table, "FILE_BYTES", 100)
    monkeypatch.setattr(token_table, "BLOCK_BYTES", 40)
    monkeypatch.setattr(token_table, "IDS_SENT", sent)
    low = -(1 << 63)
    rows = [(i, t) for i, t in zip([None, None, low, *range(-4, 3 * len(TEXTS), 3)], TEXTS)] + [(10_000, "same words here")] * 40 + [(10_001, None)]
    manifest = token_table.write_tables(frame(spark, rows), f"file://{tmp_path}/t", default_tokenizer(), 0)
    assert manifest.count() > 3
    plain = Encoder(default_tokenizer())
    wanted = [None, low, 5, 5, 6, 10_000, 10_001, 10_002, 10**12, -5]
    keys = spark.createDataFrame([(k, "x") for k in wanted], "doc_id long, path string")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in token_table.look_up(manifest, keys).collect())
    asked = {k for k in wanted if k is not None}
    assert got == sorted((k, (*encoded(plain, [t or ""])[0], 0)) for k, t in rows if k in asked)
    every = token_table.look_up(manifest, frame(spark, rows))
    assert every.count() == sum(k is not None for k, _ in rows)
    assert token_table.look_up(manifest, frame(spark, [])).count() == 0
    empty = token_table.write_tables(frame(spark, []), f"file://{tmp_path}/e", default_tokenizer(), 0)
    assert token_table.look_up(empty, keys).count() == 0


@pytest.mark.parametrize("block", [64 << 10, 8])
def test_token_table_file_round_trip(tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_table, "BLOCK_BYTES", block)
    w = token_table.TableWriter(4)
    w.add(None, np.arange(3))
    w.add(None, np.arange(2))
    w.add(-(1 << 63), np.arange(1))
    for i in range(-50, 50, 3):
        w.add(i, np.arange(abs(i)))
    with pytest.raises(ValueError):
        w.add(-1000, np.arange(2))
    (tmp_path / "x.slt").write_bytes(w.bytes())
    r = token_table.TableReader(f"file://{tmp_path}/x.slt")
    assert [(k, len(x)) for k, x in r.scan()] == [(None, 3), (None, 2), (-(1 << 63), 1)] + [(i, abs(i)) for i in range(-50, 50, 3)]
    assert len(r.get(-(1 << 63))) == 1 and len(r.get(-50)) == 50 and r.get(51) is None


def check_packed(rows, texts, ids, window):
    whole = {i: np.array([*x, 1], "<u4") for (i, _), x in zip(texts, ids, strict=True)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        x = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for found, total in [*((p, len(whole[i])) for i, p in pieces.items()), *((s, None) for s in sequences.values())]:
        at = 0
        for start, n in sorted(found):
            assert start == at and n > 0
            at += n
        assert total is None and at <= window or at == total
    assert set(pieces) == set(whole)
    return [sum(n for _, n in s) for s in sequences.values()]


def test_packing(spark, ids):
    rows = list(enumerate(TEXTS))
    lengths = check_packed(packing.pack(frame(spark, rows), default_tokenizer(), 1).collect(), rows, ids, 2048)
    assert all(n & (n - 1) == 0 for n in lengths)
    assert packing.pack(frame(spark, []), default_tokenizer(), 1).count() == 0


def test_packer_chooses_the_least_sum_of_squares():
    p = packing.Packer(10)
    p.count[[3, 5, 8]] = [2, 4, 1]
    change = {h: sum(c * c for c in after(p.count, h, 2, 10)) for h in (0, 3, 5, 8)}
    assert change[p.level_for(2)] == min(change.values())


def after(count, level, n, window):
    c = count.copy()
    c[level] -= level > 0
    if level + n < window:
        c[level + n] += 1
    return c.tolist()


def test_packer_settles_when_many_windows_are_open():
    p, rng = packing.Packer(64, most_open=5), np.random.default_rng(1)
    docs = [np.arange(rng.integers(33, 60), dtype="<u4") for _ in range(200)]
    for i, d in enumerate(docs):
        p.add(i, d)
        assert p.n_open <= 5
    p.settle(end=True)
    assert sum(r[2] for r in p.rows) == sum(map(len, docs))


def test_packer_cuts_few_documents_that_a_window_could_hold():
    p, rng = packing.Packer(256), np.random.default_rng(2)
    for i in range(600):
        p.add(i, np.arange(rng.integers(10, 200), dtype="<u4"))
    p.settle(end=True)
    pieces, filled = defaultdict(int), defaultdict(int)
    for doc_id, _, length, _, _, sequence, _ in p.rows:
        pieces[doc_id] += 1
        filled[sequence] += length
    assert sum(n > 1 for n in pieces.values()) <= 0.05 * len(pieces)
    assert all(n & (n - 1) == 0 for n in filled.values())


# -- 6 ---------------------------------------------------------------------------------------------------------------

URLS = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q=/es/", "http://example.org", "http://x.com/fr/1#a", "http://com/de/", "http://notcom/de/", "ftp://b.example.org/en/2", "no scheme", "", None, "a://b://example.com/fr/", "http://example.com?x=/fr/", "http://example.org/es", "http://x.org/" + "a" * 100_000]


def plainly(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize("inline", [10_000, 0])
def test_url_filter(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE_RULES", inline)
    rows = list(enumerate(URLS)) + [(99, URLS[0]), (99, URLS[0])]
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(with_clashes(frame(spark, rows, "page_id long, url string")), url_filter.RULES).collect()]
    assert sorted(got, key=str) == sorted([(i, *plainly(u, url_filter.RULES)) for i, u in rows], key=str)


def test_url_filter_without_rules_or_rows(spark):
    df = frame(spark, [(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.filter_urls(df, [], "block").first()["verdict"] == "block"
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0


def test_url_filter_stays_native(spark):
    plan = url_filter.filter_urls(frame(spark, [(1, "http://a.org/")], "page_id long, url string"), url_filter.RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- 8 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [4096, 25])
def test_metric_join(spark, monkeypatch, cell):
    monkeypatch.setattr(metric_join, "CELL", cell)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    v = [(c + rng.normal(0, s, 8)).astype(np.float32).tolist() for c in centres for s in (0.05, 0.2, 0.35) for _ in range(6)]
    v += [v[0], v[0], [3 * x for x in v[0]], None, [], [0.0] * 8, [1.0] * 7 + [None], [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0] * 4, [1.0] * 4, [1e-30] * 8, [1e30] * 8]
    rows = [(int(i), x) for i, x in zip(rng.permutation(len(v)), v, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in metric_join.link_vectors(df).collect()}
    exact = [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for i, x in rows]
    assert got == brute.vector_links(exact)


@pytest.mark.parametrize("kind", ["double", "float"])
def test_metric_join_of_scaled_copies(spark, monkeypatch, kind):
    monkeypatch.setattr(metric_join, "CELL", 10)
    rng = np.random.default_rng(12)
    bases = rng.normal(size=(2, 64))
    v = [(b * f).astype(np.float32 if kind == "float" else float).tolist() for b in bases for f in rng.uniform(0.3, 3, 150)]
    rows = list(enumerate(v))
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in metric_join.link_vectors(df).collect()}
    assert got == brute.vector_links(rows)


@pytest.mark.parametrize("seeds", [(2, 5, 11, 19, 24, 25), tuple(range(100, 106))])
def test_metric_join_loses_no_link_among_scaled_and_noisy_copies(spark, monkeypatch, seeds):
    monkeypatch.setattr(metric_join, "CELL", 25)
    rows, want = [], {}
    for k, seed in enumerate(seeds):  # lengths keep the draws apart: only vectors of one length are compared
        rng = np.random.default_rng(seed)
        size = 8 + k
        bases = rng.normal(size=(4, size))
        bases /= np.linalg.norm(bases, axis=1, keepdims=True)
        v = [bases[i % 4] * rng.uniform(0.2, 5) + (rng.normal(0, 0.04, size) if i % 3 == 0 else 0) for i in range(480)]
        rows += [(1000 * k + i, x.tolist()) for i, x in enumerate(v)]
        u = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
        near = u @ u.T
        assert not (np.abs(near - 0.9) < 1e-9).any()
        want |= {1000 * k + i: int(n) - 1 for i, n in enumerate((near >= 0.9).sum(axis=1))}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert {r["vec_id"]: r["n_links"] for r in metric_join.link_vectors(df).collect()} == want


def test_metric_join_without_ids(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01]), (None, None)]
    got = metric_join.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False), (None, 0, None, False)], key=str)


def test_metric_join_empty(spark):
    assert metric_join.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert [tuple(r) for r in metric_join.link_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [(1, 0, 1, True)]


# -- 9 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit,step", [(10**9, 16), (3000, 16), (900, 12)])
def test_sharding(spark, corpus, monkeypatch, limit, step):
    monkeypatch.setattr(sharding, "STEP_BITS", step)
    got = sharding.shard(with_clashes(frame(spark, corpus)), limit).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in corpus)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"], r["shard_part"]].append(r["n_bytes"])
    assert all(sum(s) <= limit or len(s) == 1 for s in shards.values())
    names = sorted({s for s, _ in shards})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    total = defaultdict(int)
    for r in got:
        total[r["shard"]] += r["n_bytes"]
    for s in names:
        if s and limit > 10_000:
            parent = sum(n for k, n in total.items() if k.startswith(s[:-1]))
            assert parent > limit  # only buckets over the limit split


def test_sharding_one_key(spark):
    rows = [(7, "x" * n) for n in (400, 400, 400, 100, 1500, 1500, 90)]
    got = sharding.shard(frame(spark, rows), 1000).collect()
    assert {len(r["shard"]) for r in got} == {60}
    parts = defaultdict(list)
    for r in got:
        parts[r["shard_part"]].append(r["n_bytes"])
    assert all(sum(p) <= 1000 or len(p) == 1 for p in parts.values())
    assert sharding.shard(frame(spark, []), 1000).count() == 0


def test_sharding_a_key_of_many_rows_and_columns_of_any_name(spark):
    rows = [(7, "x" * (1 + i % 3)) for i in range(400)] + [(i, "y" * 10) for i in range(8, 60)] + [(None, None), (None, "z" * 50)]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("row", "hash", "task", "parent", "_parent", "cell", "depth", "part", "large", "bytes", "shard_part")})
    got = sharding.shard(df, 60)
    assert got.columns == [c for c in df.columns if c != "shard_part"] + ["shard", "shard_depth", "shard_part", "n_bytes"]
    total = defaultdict(int)
    for r in (found := got.collect()):
        total[r["shard"], r["shard_part"]] += r["n_bytes"]
    assert len(found) == len(rows) and all(n <= 60 for n in total.values())
    assert len({p for (s, p) in total if len(s) == 60}) > 10


def test_shards_written(spark, corpus, tmp_path):
    df = sharding.shard(frame(spark, corpus), 3000)
    sharding.write_shards(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(corpus)


# -- 10 --------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Top, of, page, with, commas</p></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, many, many, of them.</p></div>
<div id="main-content"><h2>Head&eacute;</h2><p>First,   paragraph
with &amp; <b>bold</b><br>line.</p><p>Second one, <a href=x>link</a>.<div class="ad">Buy, buy, buy now</div>
<form><input value=x><p>Sign up, here, today</p></form><script>var a="<p>no</p>";</script>
<blockquote>Quoted, text.</blockquote></div><aside><p>Side, bar, text, more, text.</p></aside>
<div class="comments"><p>I think, therefore, I comment, a, lot.</p></div><footer>Foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Headé\nFirst, paragraph with & bold line.\nSecond one, link.\nQuoted, text."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>", ""), ("<nav>menu</nav>", ""), ("<p>a<p>b", "a\nb"), ("<article><p>x &lt;y&gt; &#233;&#x41;</article>", "x <y> éA"),
        ("<article><p>un<b>closed<p>tags</article><footer>f", "unclosed\ntags"), ("<article><p>cut off &amp", "cut off &"), ("<article><p>a</p><!-- <p>no</p> --><p>b</p>", "a\nb"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"), ("<article><script>never closed <p>x", ""), ("<article><ul><li>one<li>two</ul></article>", "one\ntwo"),
    ],
)
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div class="content has-sidebar"><article><p>Text</article></div>', "Text"), ('<body><div class="site no-sidebar"><p>One, two.</p></div>', "One, two."),
        ('<article><p>Some text, long enough.</p><div class="related-work"><p>Earlier work</p></div></article>', "Some text, long enough.\nEarlier work"),
        ('<article><h2 class="section-header">Head</h2><p>Text, text.</p></article>', "Head\nText, text."), ('<article><div class="section-header"><p>Head</p></div><p>Text, text.</p></article>', "Head\nText, text."),
        ('<div class="sidebar wrapper"><article><p>All, of, the text.</p></article></div>', "All, of, the text."),
        ('<article><p>Short, text.</p></article><div class="comment-list"><article><p>' + "I think, therefore. " * 40 + "</p></article></div>", "Short, text."),
        ('<div class="page-header"><p>Top</p></div><article><p>Text, text.</p></article><div class="related-posts"><p>More</p></div><div id=left_sidebar>Side</div>', "Text, text."),
        ("<article><p title=it's>hello</p></article>", "hello"), ('<article><p title="a>b" class=x"y>hello <a href=/q?x="1>there</a></p></article>', "hello there"), ("<article><p title='never closed>hello</p></article>", "hello"),
        ("<article><p>&<b>amp;</b> &am<!-- -->p; &amp;lt;</p></article>", "&amp; &amp; &lt;"), ("<article><p><![CDATA[a &amp; b]]></p></article>", "a &amp; b"),
    ],
)
def test_names_quotes_and_references(page, want):
    assert html_text.main_text(page) == want


class Plain(HTMLParser):
    """The text of the article element, block by block, of pages that close what they open or leave out the end of p."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in html_text.BLOCK:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in html_text.BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(t for b in self.blocks if (t := " ".join(b.split())))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_pages_equal_a_plain_extractor(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_text.query(spark, "/root/testdata/sf0.01").collect()}
    with_article = [r for r in rows if "<article" in (r["html"] or "")]
    assert len(got) == len(rows) and len(with_article) > 0.9 * len(rows)
    for r in with_article:
        plain = Plain()
        plain.feed(r["html"])
        plain.close()
        assert got[r["page_id"]] == plain.text()


@pytest.mark.parametrize("depth", [10, 399, 400, 500, 30_000])
def test_deep_pages(depth):
    down, up = "<div>" * depth, "</div>" * depth
    assert html_text.main_text(f"<div><article>{down}{up}<p>rest</p></article></div>") == "rest"
    assert html_text.main_text(f"<article><p>a</p>{down}<p>in</p><nav>menu</nav><div class=ad>Buy <i>now</i></div><form><p>Sign up</p></form>{up}<p>z</p></article>") == "a\nin\nz"
    fonts = "<font>" * depth
    assert html_text.main_text(f"<article><p>a{fonts}b<nav>menu</nav></em></p><p>c</p></article>") == "ab\nc"


def test_deep_pages_take_time_in_proportion():
    for step in ("</b>", "<div></div>", "<li>x</li>", "<td>x"):
        assert html_text.parse("<font>" * 50_000 + step * 50_000) is not None


def test_extract(spark):
    rows = [(1, PAGE, 1), (1, PAGE, 1), (2, None, 2), (3, "<article><p>" + "word, " * 50_000 + "</article>", 3)]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars int")
    got = html_text.extract(df).orderBy("page_id").collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got] and got[0]["text"] == got[1]["text"] and got[2]["text"] == "" and got[3]["n_chars"] == 6 * 50_000 - 1
    assert html_text.extract(df.limit(0)).count() == 0
