"""Small document tables with awkward rows, and plain-Python versions of the definitions."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, parts=3, first=0):
    """A documents table from texts (or (id, text) pairs), with extra columns whose names clash with inner ones."""
    rows = [(t if isinstance(t, tuple) else (first + i, t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 2}", None) for k, (i, t) in enumerate(rows)], DOC)
    for name in ("id", "tag", "row", "host", "print", "words", "key", "n", "token", "block", "rest", "mask"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(parts) if rows else df


def corpus(seed, n=120, vocabulary=150):
    """Random texts with shared passages, copies, near copies, repeats, nulls, empty texts and one long text."""
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdeé')}{rng.randrange(vocabulary)}{rng.choice(['', '', '', '.', ',', 'X'])}"
    passages = [[word() for _ in range(rng.randrange(4, 90))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.1:
            words = words * 3
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t ", "\r\n"]) for w in words))
        if rng.random() < 0.15:
            out.append(rng.choice(out))
        if rng.random() < 0.2 and words:
            near = list(words)
            near[rng.randrange(len(near))] = word()
            out.append(" ".join(near))
    out += [None, "", "  \n\t", None, "one", "é ü", " ".join(word() for _ in range(30000)), "<|endoftext|> a <|endoftext|>b"]
    rng.shuffle(out)
    return out


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, size=5):
    w = words(lower(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(docs, size=5, percent=80):
    sets = {k: shingles(t, size) for k, t in docs}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    have = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            have[g].append(k)
    for k, s in sets.items():
        for j, n in Counter(j for g in s for j in have[g] if j < k).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def cut(docs, window=13):
    """(id, words, words removed, kept words) of each document."""
    first = {}
    for k, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, k), k)
    out = []
    for k, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        out.append((k, len(w), sum(gone), " ".join(a for a, b in zip(w, gone) if not b)))
    return out


def hits(docs, items, window=13):
    """id -> (words, words hit, item ids) by comparing every window."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    found = defaultdict(set)
    for k, t in items:
        w = split(t)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            found[tuple(w[i : i + m])].add(str(k))
    sizes = {len(g) for g in found}
    out = []
    for k, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (g := tuple(w[i : i + m])) in found:
                    hit |= set(range(i, i + m))
                    ids |= found[g]
        out.append((k, len(w), len(hit), sorted(ids)))
    return out
