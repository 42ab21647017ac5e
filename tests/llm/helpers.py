"""Small fixtures and brute-force versions for the training-data operators."""

from __future__ import annotations

import random
import re
import string
from collections import defaultdict

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def words(text, lower=False):
    raw = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.translate(LOWER) if lower else raw)


def corpus(seed=1, n=60):
    """Texts over a small vocabulary with copies, near copies, shared passages, junk, nulls and a long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(60)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            t = text(rng.randint(1, 120))
        elif kind == 1:
            t = rng.choice(out)
        elif kind == 2:
            w = rng.choice(out).split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        elif kind == 3:
            t = text(rng.randint(0, 30)) + "\n" + passage + "\t\t" + text(rng.randint(0, 90))
        elif kind == 4:
            t = text(rng.randint(20, 60)).title().replace(" ", "  ", 3) + " été 日本"
        else:
            line = text(5)
            t = "\n".join([line] * rng.randint(1, 12))
        out.append(t)
    out += ["", None, "   \n\t ", "one", "a b c d", text(4000), "\x00 \x1c x"]
    return [(i, t) for i, t in enumerate(out)]


def brute_components(rows, size=5):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_removed(rows, size=13):
    """doc_id -> list of flags, True for removed words."""
    own = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(own):
        for k in range(len(own[i]) - size + 1):
            first.setdefault(tuple(own[i][k : k + size]), i)
    out = {}
    for i, w in own.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = gone
    return out


def brute_contained(docs, items, size=5):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}

    index = defaultdict(set)
    for d, t in docs:
        index[d] = grams(t)
    out = set()
    for i, t in items:
        g = grams(t)
        out |= {(d, i, len(g), len(g & s)) for d, s in index.items() if g and 10 * len(g & s) >= 8 * len(g)}
    return out
