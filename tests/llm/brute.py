"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import unicodedata

import numpy as np


def words(text, pattern):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(pattern, low)


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_sets(rows, n=5):
    out = {}
    for doc_id, text in rows:
        w = words(text, r"[^\x20\x09-\x0D]+")
        out[doc_id] = {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()
    return out


def similar(rows, percent=80):
    sets = shingle_sets(rows)
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = components(ids, links)
    return {i: (len(sets[i]), group[i]) for i in ids}


def repeats(rows, least=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            if w in seen:
                gone[k : k + least] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(gone[:1].sum()) + int((np.diff(gone.astype(np.int8)) == 1).sum())
        out[doc_id] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def contaminated(rows, items, n=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for item, text in items:
        w = words(text, pattern)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc_id, text in rows:
        w = words(text, pattern)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (owners := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= owners
        said = ",".join(sorted(found))
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(said.encode()).hexdigest(), bool(hit))
    return out


def vector_links(rows, least=0.9):
    fine = {}
    for vec_id, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            fine[vec_id] = x / np.linalg.norm(x)
    ids = sorted(i for i, _ in rows)
    links = [(a, b) for a in fine for b in fine if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= least]
    group = components(ids, links)
    return {i: (sum(i in x for x in links), group[i]) for i in ids}


def language_scores(labelled, texts, longest=5):
    """Words by Unicode category; the known word's log frequency, or the mean of the longest known n-grams'."""

    def words(text):
        out, now = [], ""
        for c in (text or "").lower() + " ":
            kind = unicodedata.category(c)[0]
            if kind == "L" or now and kind == "M":
                now += c
            elif now:
                out.append(now)
                now = ""
        return out

    def grams(word, n):
        marked = f"<{word}>" if n > 1 else word
        return [word] if n == 0 else [marked[i : i + n] for i in range(len(marked) - n + 1)]

    counts = {}
    for text, lang in labelled:
        for w in words(text):
            for n in range(longest + 1):
                for g in grams(w, n):
                    counts.setdefault(n, {}).setdefault(g, {}).setdefault(lang, 0)
                    counts[n][g][lang] += 1
    langs = sorted({lang for _, lang in labelled})
    total = {n: {x: sum(c.get(x, 0) for c in counts[n].values()) for x in langs} for n in counts}

    def row(n, g):
        return [math.log((counts[n][g].get(x, 0) + 0.5) / (total[n][x] + 0.5 * (len(counts[n]) + 1))) for x in langs]

    out = {}
    for doc_id, text in texts:
        sums = [0.0] * len(langs)
        for w in words(text):
            for n in (0, *range(longest, 0, -1)):
                if rows := [row(n, g) for g in grams(w, n) if g in counts[n]]:
                    sums = [s + sum(r[i] for r in rows) / len(rows) for i, s in enumerate(sums)]
                    break
        best = max(sums)
        out[doc_id] = (langs[sums.index(best)], 1 / sum(math.exp(s - best) for s in sums))
    return out
