"""Operators over the whole corpus, against brute force: packing, Jaccard join, substring dedup, decontamination, LM."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyscope.llm import decontamination, exchange, graph, ngram_join, packing, queries, substring_dedup, suffix_tree_lm
from tests.llm.helpers import brute_components, brute_contained, brute_removed, corpus, frame, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(rows, texts, capacity=1024):
    """Every piece holds its document's ids, and every sequence is gapless and within capacity."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert len(own) == 1 if len(ids) <= capacity else all(r["length"] == capacity for r in own[1:])
        at = 0
        for r in own:
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 16)
    rows = corpus(n=120) + [(5000, "<|endoftext|> x" * 3), (5001, "y\x1c  \x85z" * 900)]
    docs = frame(spark, rows)
    cut = packing.pieces(docs, PATH)
    made = check_packing(packing.pack(spark, cut).collect(), dict(rows))
    assert packing.bound_of(cut) <= made <= packing.bound_of(cut) + 3
    assert packing.pack_documents(spark, docs.limit(0), PATH).count() == 0


def test_best_fit_and_bound():
    rng = random.Random(2)
    for _ in range(50):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 12))])
        bins, offsets = packing.best_fit_decreasing(sizes, 20)
        for b in set(bins.tolist()):
            places = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist()))
            assert [o for o, _ in places] == np.cumsum([0, *(s for _, s in places)])[:-1].tolist() and sum(s for _, s in places) <= 20
        best = optimum(sorted(sizes.tolist(), reverse=True), 20)
        assert packing.bin_bound(np.bincount(sizes, minlength=21), 20) <= best <= bins.max() + 1


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in {load: k for k, load in enumerate(loads) if load + sizes[i] <= capacity}.values():
            place(i + 1, [*loads[:k], loads[k] + sizes[i], *loads[k + 1 :]])
        place(i + 1, [*loads, sizes[i]])

    place(0, [])
    return best


def components_of(spark, rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(spark, frame(spark, rows)).collect()}


def test_jaccard_join(spark):
    rows = corpus(seed=4, n=90)
    assert components_of(spark, rows) == brute_components(rows)


def test_jaccard_join_hot_groups(spark, monkeypatch):
    """Many near copies in chains, and a passage that most documents share; frequent shingles are found by the sample."""
    monkeypatch.setattr(exchange, "FREQUENT_SHARE", 0.05)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    first = [word() for _ in range(100)]
    rows, chain = [], first
    for i in range(60):
        chain = list(chain)
        chain[rng.randrange(100)] = word()
        rows.append((i, " ".join(chain)))
    passage = [word() for _ in range(50)]
    rows += [(100 + i, " ".join([*passage, *(word() for _ in range(rng.randint(2, 60)))])) for i in range(60)]
    rows += [(200 + i, " ".join(first)) for i in range(40)]
    assert components_of(spark, rows) == brute_components(rows)


def test_jaccard_join_edges(spark):
    t = "a b c d e f g h"
    rows = [(5, t), (5, "other words stand here now and then"), (6, t.upper()), (7, "Other words stand here now and then"), (None, t), (8, None), (9, "a b"), (10, "A  b"), (11, "")]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(spark, frame(spark, rows)).collect())
    assert got == collections.Counter([(5, 4, 5), (5, 3, 5), (6, 4, 5), (7, 3, 5), (None, 4, None), (8, 0, 8), (9, 1, 9), (10, 1, 9), (11, 0, 11)])
    assert ngram_join.link_components(spark, frame(spark, []).limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in graph.components(spark, edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 200: 100, 150: 100}


@pytest.mark.parametrize("sampled", [False, True])
def test_substring_dedup(spark, monkeypatch, sampled):
    if sampled:
        monkeypatch.setattr(exchange, "FREQUENT_SHARE", 0.05)
    rows = corpus(seed=9, n=90)
    want = brute_removed(rows)
    texts = dict(rows)
    docs = frame(spark, rows).withColumn("n_words", F.lit("clash"))
    got = substring_dedup.remove_repeats(spark, docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        w, gone = words(texts[r["doc_id"]]), want[r["doc_id"]]
        kept = [x for x, g in zip(w, gone) if not g]
        assert (r["n_words"], r["n_removed"]) == (len(w), sum(gone))
        assert r["kept_sha256"] == hashlib.sha256(b" ".join(kept)).hexdigest()
        assert [k for s in r["removed"] for k in range(s["start"], s["end"])] == [k for k, g in enumerate(gone) if g]
        assert words(r["kept_text"]) == kept
        if not any(gone):
            assert r["kept_text"] == (texts[r["doc_id"]] or "")


def test_substring_dedup_edges(spark):
    t = " ".join(f"w{i}" for i in range(20))
    rows = [(3, t), (3, t), (4, t), (None, t), (5, None)]
    got = collections.Counter((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(spark, frame(spark, rows)).collect())
    assert got == collections.Counter([(3, 0), (3, 0), (4, 20), (None, 0), (5, 0)])
    assert substring_dedup.remove_repeats(spark, frame(spark, []).limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 9, 20, 70])))) for i in range(30)] + [(90, None), (91, ""), (92, "Été à la mer, bien-sûr!")]
    docs = []
    for d in range(80):
        body = [word() for _ in range(rng.randint(0, 300))]
        part = rng.choice(items)[1] or ""
        own = part.split()
        if rng.random() < 0.5 and own:
            own[rng.randrange(len(own))] = word()
        docs.append((d, " ".join([*body, "(" + " ".join(own).upper() + ")", *body[:5]])))
    docs += [(900, None), (901, ""), (902, "x été À LA MER bien sûr y")]
    got = decontamination.find_contained(spark, frame(spark, docs), frame(spark, items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_common"]) for r in got.collect()} == brute_contained(docs, items)
    none = frame(spark, []).limit(0)
    assert decontamination.find_contained(spark, none, frame(spark, items, "item_id bigint, text string")).count() == 0
    assert decontamination.find_contained(spark, frame(spark, docs), none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_decontamination_by_shuffle(spark, monkeypatch):
    """The same without any broadcast."""
    for name in ("SKETCH_BROADCAST", "IDS_BROADCAST", "ITEM_BROADCAST_BYTES"):
        monkeypatch.setattr(decontamination, name, 0)
    test_decontamination(spark)


def brute_base(rows, held):
    counts = collections.Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*words(t, lower=True), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    for i, t in rows:
        w = [*words(t, lower=True), b"\n"]
        yield i, held(i), len(w), sum(x in counts for x in w), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)


@pytest.mark.parametrize("head", [400_000, 40])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(suffix_tree_lm, "HEAD_WORDS", head)
    rows = corpus(seed=6, n=90)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(spark, frame(spark, rows), f"{queries.crc_remainder('doc_id', 7)} = 2").collect()}
    for i, h, n, known, total, base in brute_base(rows, held):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, n, known, total)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    same = collections.defaultdict(set)
    for i, t in rows:
        same[t].add(got[i]["score"])
    assert all(max(v) - min(v) < 1e-3 for v in same.values())
    empty = suffix_tree_lm.score(spark, frame(spark, rows), "true").collect()
    assert {r["train_tokens"] for r in empty} == {0} and all(r["base_score"] == 0 for r in empty)
    assert suffix_tree_lm.score(spark, frame(spark, []).limit(0), "doc_id = 2").count() == 0


@pytest.mark.parametrize(("head", "deltas"), [(1, 0), (40, 1 << 20)])
def test_every_passing_context_scores_whatever_is_broadcast(spark, monkeypatch, head, deltas):
    rows = corpus(seed=8, n=60)
    run = lambda: {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(spark, frame(spark, rows), "doc_id % 7 = 2").collect()}
    whole = run()
    monkeypatch.setattr(suffix_tree_lm, "HEAD_STATES", head)
    monkeypatch.setattr(suffix_tree_lm, "DELTAS", deltas)
    assert run() == pytest.approx(whole, rel=1e-5)


def test_suffix_tree_is_a_distribution():
    rng = np.random.default_rng(1)
    n = 500
    d, ctx = rng.integers(0, 2, n), rng.integers(0, 64, n)
    tree = suffix_tree_lm.tables_of(d, np.where(d == 0, 0, ctx), rng.integers(0, 64, n), rng.integers(1, 9, n), np.zeros(256, np.uint8))
    p = 10.0 ** tree.logp.reshape(-1, 64).astype(float)
    p[:, 63] *= 256 - 62
    assert np.allclose(p.sum(1), 1, atol=1e-5)


def test_language_model_beats_unigrams_on_held_out(spark):
    r = queries.op5_suffix_tree_lm(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


@pytest.mark.parametrize("seed, words_, edits", [(1, 60, (1, 5)), (2, 120, (3, 7))])
def test_jaccard_join_near_copies_around_the_threshold(spark, seed, words_, edits):
    """Copies that are hardly or just not near their base, and near each other by changes that they share."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words_)]
    rows = [(0, " ".join(base))]
    shared = [[(rng.randrange(words_), f"s{k}-{i}") for i in range(4)] for k in range(6)]
    for i in range(1, 140):
        own = list(base)
        for at, word in (rng.choice(shared) if rng.random() < 0.6 else []):
            own[at] = word
        for _ in range(rng.randint(*edits)):
            own[rng.randrange(words_)] = f"e{rng.randrange(3)}"
        if rng.random() < 0.3:
            del own[: rng.randint(1, words_ // 8)]
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_components(spark, frame(spark, rows)).collect()}
    assert got == brute_components(rows)
