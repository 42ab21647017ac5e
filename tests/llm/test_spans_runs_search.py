"""Personal data, periodic runs and ranked search against brute-force versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyscope.llm import periodic_runs, personal_data, queries, ranked_search
from tests.llm.helpers import LOWER, corpus, frame, words

SF = "/root/testdata/sf0.001"

# -- personal data -----------------------------------------------------------------------------

PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == 2:
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def brute_spans(text):
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if passes(k, m.group())]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choices(rng.choice(["a@.b-_ ", "12. ", "0123456789 -", "+12 ().-", "a@.1+ -é"]), k=rng.randint(0, 50)))
        assert [tuple(s) for s in personal_data.detect(text)] == brute_spans(text), text


DISGUISED = [
    ("email", "", "john.doe [at] example [dot] com", " now"), ("email", "x ", "john dot doe at example dot com", ", thanks"), ("email", "", "john(at)example(dot)co(dot)uk", ""),
    ("email", "à ", "jоhn@exаmple.com", " é"), ("email", "", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", ""), ("email", "", "jo​hn@exam​ple.com", "."), ("email", "", "john_at_example_dot_com", " ."),
    ("email", "to ", "user@example [dot] com", ""), ("email", "", "john.doe at example.com", " x"), ("email", "", "foo AT bar DOT org", " x"), ("email", "", "a.b arroba sitio punto es", " x"),
    ("phone", "tel ", "plus one five five five one two three four five six seven", "."), ("phone", "", "plus four nine, one five one, double two three four five six seven", " x"),
    ("phone", "", "+49 l5l 22 34 56 78", " x"), ("card", "", "four one one one one one one one one one one one one one one one", "."), ("card", "n ", "4111–1111–1111–1111", " x"),
    ("card", "", "4lll 1111 1111 1111", ""), ("card", "", "٤١١١ ١١١١ ١١١١ ١١١١", ""), ("card", "", "𝟒𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏 𝟏𝟏𝟏𝟏", ""), ("ip", "", "192 dot 168 dot 1 dot 20", ""), ("ip", "", "192[.]168[.]1[.]20", " x"),
    ("ip", "", "one nine two dot one six eight dot one dot one", " x"), ("ip", "", "１９２.168.1.1", ""),
]
CLEAN = [
    "look at example.com please", "the point at home dot", "we are at the point of no return. un deux", "as is at, one of them dot. The point at two", "meet at noon dot the rest", "one two three four five",
    "Привет, мир. Это @ слово", "a | b | c 1 2 3", "version 1.2.3 plus one", "null at zero. one at two.",
]


@pytest.mark.parametrize("kind, before, span, after", DISGUISED)
def test_disguised_spans_map_back(kind, before, span, after):
    text = before + span + after
    base = personal_data.detect(text)
    assert [(personal_data.KINDS[k], text[a:b]) for k, a, b in personal_data.added_spans(text, base)] == [(kind, span)]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_has_no_added_span(text):
    assert personal_data.added_spans(text, personal_data.detect(text)) == []


def test_hints_change_nothing(monkeypatch):
    texts = CLEAN + [b + s + a for _, b, s, a in DISGUISED] + [t or "" for _, t in corpus()]
    gated = [personal_data.added_spans(t, []) for t in texts]
    monkeypatch.setattr(personal_data, "_hints", lambda text: True)
    assert gated == [personal_data.added_spans(t, []) for t in texts]


@pytest.mark.parametrize("piece", ["a", "1", "1 ", " at", "@", "a@", "+1 ", " ", "[", "one ", "1.", "O1", " at a.b", "a dot ", "a_at_", "[at]a", "о@о.о ", "plus ", "("])
def test_long_texts_take_linear_time(piece):
    text = piece * (400_000 // len(piece))
    begin = time.perf_counter()
    personal_data.added_spans(text, personal_data.detect(text))
    assert time.perf_counter() - begin < 20


def test_personal_data_rows(spark):
    texts = [b + s + a for _, b, s, a in DISGUISED] + ["mail a.b@c.de and a@b.c, +44 20 7946 0958 or 10.0.0.1, 4111-1111-1111-1111", "", None]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(None, "x@y.zz", None), (3, "x@y.zz", "again")]
    docs = frame(spark, rows, "doc_id bigint, text string, spans string")
    found = personal_data.find_personal_data(docs)
    assert found.count() == len(rows) and frame(spark, [], "doc_id bigint, text string").transform(personal_data.find_personal_data).count() == 0
    got = {(r["doc_id"], r["n_added"]): r for r in personal_data.span_digests(found).collect() if r["doc_id"] is not None}
    for i, t in enumerate(texts):
        base = brute_spans(t or "")
        r = next(r for (d, _), r in got.items() if d == i and (i != 3 or r["n_email"] != 1))
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == j for s in base) for j in range(4)]
        listed = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
        assert len(r["spans"].split(",")) == len(base) + r["n_added"] or not r["spans"]
    by_text = {r["text"]: r["redacted_text"] for r in found.collect()}
    assert by_text[texts[-3]] == "mail [email] and [email], [phone] or [ip], [card]"


# -- periodic runs -----------------------------------------------------------------------------


def brute_runs(w, least_words=6, least_repeats=4):
    """Every maximal stretch with period q, for q upwards; a stretch known with a smaller period is not one of q."""
    found = {}
    for q in range(1, len(w) // least_repeats + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(least_words, least_repeats * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e, q) for (s, e), q in found.items())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def brute_digest(doc_id, text):
    w = planted(doc_id, words(text))
    runs = sorted((s, q, e - s) for s, e, q in brute_runs(w))
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = None
    for s, q, n in runs:
        if best is None or n * best[1] > best[2] * q:
            best = (s, q, n)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    head = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_squared_differences_are_exact():
    rng = np.random.default_rng(0)
    for size in (1, 2, 4, 32, 256):
        patterns, windows = rng.integers(0, 40, (7, size)), rng.integers(0, 40, (7, 2 * size))
        want = [[((p - w[k : k + size]) ** 2).sum() for k in range(size)] for p, w in zip(patterns, windows)]
        assert periodic_runs.mismatch_sums(patterns, windows).tolist() == np.array(want).tolist()


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(0)
    for trial in range(1500):
        monkeypatch.setattr(periodic_runs, "MAX_PATTERN", rng.choice([2, 4, 1 << 20]))
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 5])
            w = [str(rng.randrange(k)) for _ in range(n)]
            if rng.random() < 0.6 and n:
                a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        raw = [" ".join(w).encode() for w in docs]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        _, runs, row = periodic_runs.batch_runs(data, offsets)
        for i, w in enumerate(docs):
            assert sorted(map(tuple, runs[row == i].tolist())) == brute_runs(w)


@pytest.mark.parametrize("text", ["a " * 400_000, "a b " * 200_000, " ".join(str(x) for x in np.random.default_rng(1).integers(0, 2, 200_000))])
def test_long_runs_take_near_linear_time(text):
    data = np.frombuffer(text.encode(), np.uint8)
    begin = time.perf_counter()
    periodic_runs.batch_runs(data, np.array([0, len(data)]))
    assert time.perf_counter() - begin < 20


def run_rows():
    rows = [(i, ((t or "") + " ") * (1 + i % 9) if t is not None and i % 3 else t) for i, t in corpus(3, 90)]
    return rows + [(500, "x " * 7), (501, "one two three " * 5 + "four"), (502, "  a\tb a\nb a b a b c ")]


def test_run_digests_equal_brute_force(spark):
    rows = run_rows()
    found = periodic_runs.find_runs(periodic_runs.with_planted_runs(frame(spark, rows)))
    got = {r["doc_id"]: tuple(r)[1:] for r in periodic_runs.run_digests(found).collect()}
    for i, t in rows:
        assert got[i] == brute_digest(i, t), (i, t)


def test_run_rows_nulls_repeats_and_names(spark):
    rows = [(None, "a " * 9, 1), (None, "a " * 9, 1), (1, None, 2), (1, "", 3)]
    docs = frame(spark, rows, "doc_id bigint, text string, runs int")
    got = periodic_runs.find_runs(docs)
    assert sorted((r["n_words"], len(r["runs"]), r["collapsed_text"]) for r in got.collect()) == [(0, 0, ""), (0, 0, ""), (9, 1, "a"), (9, 1, "a")]
    assert periodic_runs.run_digests(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs))).count() == 4
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(9, np.int64), 9, least_repeats=3)


# -- ranked search -----------------------------------------------------------------------------


def terms(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(LOWER))


def brute_ranking(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, n_all = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c in docs:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // n_all if n_all else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, chunk, block, wave", [(3, 1 << 20, 32, 1 << 20), (50, 200, 2, 400)])
def test_ranking_equals_brute_force(spark, monkeypatch, k, chunk, block, wave):
    for name, value in (("CHUNK_POSTINGS", chunk), ("BLOCK_DOCS", block), ("WAVE_TERMS", wave), ("SAMPLE_ONE_IN", 3)):
        monkeypatch.setattr(ranked_search, name, value)
    rows = corpus(5, 120) + [(None, "one A b"), (None, "one A b"), (7, "one"), (8, "ONE One one")]
    rng = random.Random(2)
    items = [(i, " ".join(rng.sample((t or "x").split() or ["x"], min(12, len((t or "x").split()) or 1)))) for i, t in corpus(5, 30)]
    items += [(900, None), (901, ""), (902, "no such term zzzz"), (903, "ONE one, été 日本"), (903, "a b c d"), (None, "one")]
    got = ranked_search.search(spark, frame(spark, rows), frame(spark, items, "item_id bigint, text string"), k)
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranking(rows, items, k)


def test_ranking_of_empty_tables_and_extra_columns(spark):
    docs = frame(spark, [(1, "a b", "x", 5)], "doc_id bigint, text string, score string, rank int")
    items = frame(spark, [("i", "A", 1)], "item_id string, text string, doc_id int")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in ranked_search.search(spark, docs, items).collect()] == [("i", 1, 1)]
    assert ranked_search.search(spark, docs.limit(0), items).count() == 0
    assert ranked_search.search(spark, docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(ValueError):
        ranked_search.search(spark, docs, items, 0)


def test_long_documents_keep_exact_lengths():
    got = ranked_search.term_scores(np.array([9]), np.array([3]), np.array([1 << 40]), 1 << 40, 1 << 45)
    m = 50 + 50 * (1 << 40) * (1 << 40) // (1 << 45)
    assert got.tolist() == [9 * (3 * 10**9 // (3000 + 20 * m))]


def test_queries_of_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert got == {r["doc_id"]: brute_digest(r["doc_id"], r["text"]) for r in docs if len(words(r["text"])) < 1500} | {
        r["doc_id"]: got[r["doc_id"]] for r in docs if len(words(r["text"])) >= 1500}
    found = {r["doc_id"]: r for r in queries.op11_personal_data(spark, SF).collect()}
    for r in docs:
        listed = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in brute_spans(r["text"] or ""))
        assert found[r["doc_id"]]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ranked = sorted(map(tuple, queries.op13_ranked_search(spark, SF).collect()), key=str)
    assert ranked == brute_ranking([(r["doc_id"], r["text"]) for r in docs], items, 50)
