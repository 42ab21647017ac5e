"""Language identification with a string kernel.

The kernel is the blended spectrum in presence form: k(x, y) counts the distinct character
n-grams (n = 1..3, over folded letters) that both texts hold, divided by the root of
k(x, x) k(y, y). A bounded sample of labelled windows trains the model: some of its windows
are Nystroem landmarks, kernel ridge regression is fitted one-versus-rest on the Nystroem
features. Scoring takes every window of the whole text, and windows are scored in batches as
a product of their n-gram incidence matrix with the landmarks', then with the weights; a
text's answer is the mean over its windows, weighted by their length.

The outputs of a window always sum to 2 - labels, so the best score says which label, not
whether any: it is at least 1 / labels for every text. A text that no label fits is told by
its strangeness: the share of its distinct 3-grams that the sample doesn't hold, against a
limit from sampled documents that are each held against the others.

Null text and text without a letter give ``und`` with score 0. Training reads only text and
label of the rows that ``train`` selects. Labels and ids are never inputs of a prediction;
equal texts get equal answers. With no training row every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.ragged import row_slices
from tallyscope.llm.tables import wider

#: Characters of a window; every character of a text is in exactly one window.
WINDOW = 1500
#: Bounds of the training sample (documents, and windows of each) and of the landmarks, per label.
TRAIN_PER_LABEL = 256
TRAIN_WINDOWS = 4
LANDMARKS_PER_LABEL = 48
RIDGE = 1e-3
#: Share of unknown 3-grams up to which a text is never strange, and what the limit is above its 0.99 quantile in the sample.
UNKNOWN_LEAST = 0.1
UNKNOWN_MARGIN = 2.0
PER_WORD = 4
ORDERS = (1, 2, 3)
#: Symbols: code points folded by lower-casing into this many classes.
SYMBOLS = 64
_LETTER = re.compile(r"[^\W\d_]")


def _fold_table() -> np.ndarray:
    """Symbol of each code point below U+3000: 0 for all that is not a letter, 1-26 a-z, others by remainder."""
    table = np.zeros(0x3000, np.int64)
    for c in range(0x3000):
        ch = chr(c).lower()[:1]
        if ch.isalpha():
            table[c] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % (SYMBOLS - 27)
    return table


_FOLD = _fold_table()


def symbols(text: str) -> np.ndarray:
    """Folded symbols of a text; runs of non-letters become one 0."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    out = np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], 27 + points % (SYMBOLS - 27))
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def gram_codes(symbol: np.ndarray) -> list[np.ndarray]:
    """For each order the n-gram code at every position (codes of different orders differ)."""
    out, code, base = [], symbol, 0
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            code = code[:-1] * SYMBOLS + symbol[n - 1 :]
        if n in ORDERS:
            out.append(code + base)
        base += SYMBOLS**n
    return out


GRAM_SPACE = sum(SYMBOLS**n for n in range(1, max(ORDERS) + 1))


def windows_of(symbol: np.ndarray) -> list[np.ndarray]:
    """Windows of about WINDOW symbols; a short rest goes to the last full one."""
    n = max(1, round(len(symbol) / WINDOW))
    return np.array_split(symbol, n)


@dataclass
class KernelModel:
    labels: list[str]
    column: np.ndarray  # n-gram code -> column of the incidence matrix, or -1
    landmarks: np.ndarray  # columns x landmarks, each scaled to unit self-kernel
    weights: np.ndarray  # (landmarks + 1) x labels, the last row is the mean target
    unknown: float  # share of unknown 3-grams that a text of a learned language may have

    def profile(self, wins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Incidence (windows x columns) of known n-grams, the root of each self-kernel, unknown and all distinct 3-grams."""
        width = self.landmarks.shape[0]
        seen = np.zeros((len(wins), width + 1), np.float32)
        norm = np.zeros(len(wins))
        strange = np.zeros((len(wins), 2))
        for i, w in enumerate(wins):
            distinct = 0
            for codes in gram_codes(w):
                mark = np.unique(codes)
                distinct += len(mark)
                at = self.column[mark]
                seen[i, at] = 1.0
            norm[i] = max(distinct, 1)
            strange[i] = np.count_nonzero(at == width), len(mark)
        return seen[:, :width], np.sqrt(norm), strange

    def scores(self, wins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Regression outputs, windows x labels, by two batched matrix products; unknown and all distinct 3-grams."""
        seen, norm, strange = self.profile(wins)
        kernel = (seen @ self.landmarks) / norm[:, None]
        return kernel @ self.weights[:-1] + self.weights[-1], strange

    def strangeness(self, unknown: np.ndarray, distinct: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Share of unknown 3-grams by the share allowed to texts with as many a window; over 1 no label fits.

        Unknown 3-grams come in words, PER_WORD at a time. A short text may have three standard
        deviations and one word more, so a single odd word decides nothing. Windows that repeat
        each other don't make a text longer.
        """
        each = np.maximum(distinct / windows / PER_WORD, 1e-9)
        return unknown / np.maximum(distinct, 1) / (self.unknown + 3 * np.sqrt(self.unknown / each) + 1 / each)


def fit(texts: list[str], targets: list[str], seed: int = 7) -> KernelModel:
    """Fit on a bounded sample: Nystroem features on landmark windows, then ridge regression."""
    labels = sorted(set(targets))
    picked = [(w, labels.index(t), i) for i, (text, t) in enumerate(zip(texts, targets)) for w in windows_of(symbols(text))[:TRAIN_WINDOWS] if np.any(w)]
    grams = [np.unique(np.concatenate(gram_codes(w))) for w, _, _ in picked]
    y = np.array([t for _, t, _ in picked])
    known = np.unique(np.concatenate(grams))
    rng = np.random.default_rng(seed)
    column = np.full(GRAM_SPACE, len(known), np.int32)
    column[known] = np.arange(len(known))
    phi = np.zeros((len(picked), len(known)), np.float32)
    for i, g in enumerate(grams):
        phi[i, column[g]] = 1.0 / np.sqrt(len(g))
    marks = np.sort(np.concatenate([rng.permutation(np.flatnonzero(y == c))[:LANDMARKS_PER_LABEL] for c in range(len(labels))]))
    landmark = phi[marks]
    kmm = (landmark @ landmark.T).astype(np.float64)
    knm = (phi @ landmark.T).astype(np.float64)
    value, vector = np.linalg.eigh(kmm + 1e-6 * np.eye(len(marks)))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T  # Kmm^(-1/2)
    z = knm @ root
    target = np.where(y[:, None] == np.arange(len(labels)), 1.0, -1.0)
    # labels of few windows weigh as much as frequent ones
    weight = (len(y) / (len(labels) * np.bincount(y, minlength=len(labels))))[y]
    mean = np.average(target, axis=0, weights=weight)
    zw = z * weight[:, None]
    alpha = np.linalg.solve(zw.T @ z + RIDGE * len(y) * np.eye(len(marks)), zw.T @ (target - mean))
    return KernelModel(labels, column, np.ascontiguousarray(landmark.T), np.vstack([root @ alpha, mean]).astype(np.float32), unknown_share(grams, np.array([i for *_, i in picked])))


def unknown_share(grams: list[np.ndarray], owner: np.ndarray) -> float:
    """Limit of the share of unknown 3-grams, from documents (``owner`` of each window's n-grams) held against all others.

    A few odd documents in the sample don't move it, a sample too small to know its own
    languages makes it 1 or more: then nothing is strange.
    """
    long = [g[g >= GRAM_SPACE - SYMBOLS**3] for g in grams]
    docs = np.split(np.arange(len(grams)), np.flatnonzero(np.diff(owner)) + 1)
    holders = np.bincount(np.concatenate([np.unique(np.concatenate([long[i] for i in d])) for d in docs]), minlength=GRAM_SPACE)
    share = [sum(np.count_nonzero(holders[long[i]] < 2) for i in d) / n for d in docs if (n := sum(len(long[i]) for i in d))]
    return max(UNKNOWN_LEAST, UNKNOWN_MARGIN * float(np.quantile(share, 0.99))) if share else 1.0


def sample(docs: DataFrame, train: str, label_col: str, text_col: str, id_col: str) -> tuple[list[str], list[str]]:
    """At most TRAIN_PER_LABEL documents of each label by a hash of the id; of a long text TRAIN_WINDOWS windows drawn by hash from the whole.

    The labels are few by nature; the counts per label give a hash threshold, so that only
    about twice the sample leaves the scan.
    """
    rows = docs.filter(train).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(F.lit("sample"), F.col(id_col)).alias("h")).filter("label is not null and text rlike '\\\\p{L}'")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, 2.0 * TRAIN_PER_LABEL / n))).otherwise(share)
    near = rows.withColumn("u", F.expr("pmod(h, 1000003) / 1000003.0D")).filter(F.col("u") < share)
    drawn = F.transform(F.sequence(F.lit(1), F.lit(TRAIN_WINDOWS)), lambda k: F.substring(F.col("text"), F.pmod(F.xxhash64("h", k), F.length("text") - WINDOW).cast("int") + 1, F.lit(WINDOW)))
    windows = F.when(F.length("text") > TRAIN_WINDOWS * WINDOW, F.array_join(drawn, " ")).otherwise(F.col("text"))
    got = near.select("label", windows.alias("text"), "h").collect()
    texts, labels, taken = [], [], dict.fromkeys(counts, 0)
    for r in sorted(got, key=lambda r: (r["h"], r["label"], r["text"])):
        if taken[r["label"]] < TRAIN_PER_LABEL:
            taken[r["label"]] += 1
            texts.append(r["text"])
            labels.append(r["label"])
    return texts, labels


def judge_texts(model: KernelModel | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Label, score and strangeness of each text; over 1 none of the labels fits."""
    wins, owner, out = [], [], [("und", 0.0, 0.0)] * len(texts)
    for i, t in enumerate(texts):
        if model is not None and t and _LETTER.search(t):
            for w in windows_of(symbols(t)):
                wins.append(w)
                owner.append(i)
    if wins:
        size = np.array([len(w) for w in wins], float)
        at = np.array(owner)
        batches = [model.scores(wins[a : a + 256]) for a in range(0, len(wins), 256)]
        score = np.concatenate([s for s, _ in batches]) * size[:, None]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        mean = np.add.reduceat(score, first, axis=0) / np.add.reduceat(size, first)[:, None]
        unknown, distinct = np.add.reduceat(np.concatenate([s for _, s in batches]), first, axis=0).T
        strange = model.strangeness(unknown, distinct, np.diff(np.r_[first, len(at)]))
        for i, best, value, odd in zip(at[first].tolist(), mean.argmax(1).tolist(), mean.max(1).tolist(), strange.tolist()):
            out[i] = (model.labels[best], float(np.clip((value + 1) / 2, 0.0, 1.0)), odd)
    return [o[0] for o in out], [o[1] for o in out], [o[2] for o in out]


def predict_texts(model: KernelModel | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    return judge_texts(model, texts)[:2]


def predict(docs: DataFrame, model: KernelModel | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and ``<prefix>lang_pred``, ``<prefix>score``, ``<prefix>strangeness``; no shuffle.

    The model is bounded by its parameters (labels x landmarks x n-grams seen in the sample).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}strangeness"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in row_slices(batches, text_col):
            label, score, strange = judge_texts(shared.value, rb.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(strange, pa.float64())], [*rb.schema.names, *names])

    kept = docs.drop(*names)
    return kept.mapInArrow(run, wider(kept.schema, f"{names[0]} string, {names[1]} double, {names[2]} double"))


def identify(docs: DataFrame, train: str, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fit on the rows of ``docs`` that the SQL predicate ``train`` selects and label every row."""
    texts, labels = sample(docs, train, label_col, text_col, id_col)
    return predict(docs, fit(texts, labels) if texts else None, text_col)
