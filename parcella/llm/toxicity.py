"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are rates of lexicon words (a fixed lexicon, and words and word beginnings learned from labels), of their
most telling one, of lexicon words near the second person, of words that only undoing obfuscation brings into the lexicon,
of capitals, of punctuation and of digits inside words, and its length. Words are counted over the whole text.

Fitting takes a bounded sample of labelled rows: at most `positives` and `negatives` rows by the order of a hash of their
ids, with class weights that restore the ratio of all labelled rows. Learned words score a fitted row by the counts of the
other rows only, so that trees see them as they are on new texts. The trees are calibrated on predictions for rows that
they weren't fitted on. The fitted model is small and goes to executors with the task.

Cases: a null or empty text has a score too, that of no features. Labels that are null, of missing documents or of
documents without a text don't count. Without labels of both kinds every score is the share of label 1 (0 without labels). Repeated
rows score alike. Very long texts are read whole. Extra columns don't matter to score(); mark() replaces a column of the
score's name. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcella.llm.common import with_arrow_batches

#: Labelled rows that a model is fitted on at most.
POSITIVES, NEGATIVES = 3000, 5000
#: A starting lexicon of insults, in natural order.
LEXICON = frozenset(
    """
    arse ass asshole bastard bitch brainless clown coward creep cretin crap damn dimwit disgusting douche dumb dumbass dunce
    fat fool freak garbage gross hate hideous idiot idiotic imbecile jerk kill lame liar loser lunatic maggot miserable moron
    moronic nasty pathetic pig prick psycho rat rubbish scum shit shut sick sleazy slime slut stink stinking stupid suck sucks
    terrible thug toxic trash twat ugly useless vermin vile wanker weak weirdo whore witless worm worthless wretched
    arschloch blöd depp dumm dummkopf idiot schwein trottel verdammt wertlos
    abruti connard crétin débile dégoûtant imbécile merde minable ordure salaud stupide
    asqueroso basura cabrón estúpido gilipollas imbécil inútil mierda patético payaso tonto
    """.split()
)
#: Words of the second person.
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine tu toi te ton ta tes vous votre vos usted ustedes tú tus vosotros".split())
#: Characters that stand in for letters.
OBFUSCATED = str.maketrans("013457@$!|", "oleastasil")
NEAR = 4
#: Lengths of the word beginnings that are learned.
STEMS = (4, 5, 6)
TOKEN = re.compile(r"[^\s.,;:?\"()\[\]{}<>/\\]+")
NAMES = ("fixed", "learned", "stems", "best", "hits", "near", "hidden", "capitals", "shouted", "marks", "digits", "length")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text or "")


def plain(token: str) -> str:
    return token.lower().strip("!'*-_")


def pieces(words: set[str]) -> set[str]:
    """Words and their beginnings, the latter with a mark."""
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


@dataclass
class Learned:
    """How often words and beginnings occur in texts of either label; weights of the telling ones."""

    positive: dict[str, int] = field(default_factory=dict)
    total: dict[str, int] = field(default_factory=dict)
    ratio: float = 1.0  # negatives stand for so many rows each

    def weight(self, piece: str, own: int | None = None) -> float:
        """Log odds of label 1, smoothed, less what the row at hand (own: its label) contributed."""
        p, t = self.positive.get(piece, 0), self.total.get(piece, 0)
        n = t - p
        if own is not None:
            p, n = p - own, n - (1 - own)
        return float(np.log((p + 0.3) / (n * self.ratio + 0.3))) if p >= 2 else 0.0


TELLING = 1.5
#: What tokens a worker remembers at most.
REMEMBERED = 500_000
CAPITALS = bytes(range(65, 91))


class Reader:
    """Turns texts into features, remembering what it found out about tokens. own: the label of the row at hand, when fitting."""

    def __init__(self, learned: Learned, own: int | None = None) -> None:
        self.learned, self.own = learned, own
        self.known: dict[str, tuple | int] = {}

    def look(self, token: str) -> tuple | int:
        """0 for a token that has no part in any feature, else its kinds and its weight."""
        w = plain(token)
        kinds, score = 0, 0.0
        if w in LEXICON:
            kinds |= 1
        elif not w.isalpha() and w.translate(OBFUSCATED) in LEXICON:
            kinds |= 2
        of = self.learned.weight
        whole, stems = of(w, self.own), max((of(w[:k] + "*", self.own) for k in STEMS if len(w) > k), default=0.0)
        if whole > TELLING:
            kinds |= 4
        if stems > TELLING:
            kinds |= 8
        score = max(whole, stems)
        if len(token) > 2 and token.isupper():
            kinds |= 16
        if not token.isalpha() and any(c.isdigit() for c in token) and not token.isdigit():
            kinds |= 32
        return (kinds, score) if kinds else 0

    def __call__(self, text: str | None) -> list[float]:
        raw = tokens(text)
        known = self.known
        new = set(raw).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(raw)
        for w in new:
            known[w] = self.look(w)
        counts, best, hits, near = [0] * 6, 0.0, 0, 0
        for i, found in enumerate(map(known.__getitem__, raw)):
            if not found:
                continue
            kinds, score = found
            for k in range(6):
                counts[k] += kinds >> k & 1
            if kinds & 15:
                near += any(plain(x) in SECOND for x in raw[max(0, i - NEAR) : i + NEAR + 1])
                if score > TELLING:
                    hits += 1
                    best = max(best, score)
        n = len(raw) or 1
        data = (text or "").encode("utf-8", "surrogatepass")
        marks = data.count(b"!") + data.count(b"?")
        capitals = len(data) - len(data.translate(None, CAPITALS))
        fixed, hidden, learned, stems, shouted, digits = (c / n for c in counts)
        return [fixed, learned, stems, best, float(np.log1p(hits)), near / n, hidden, capitals / (len(data) or 1), shouted, marks / n, digits, float(np.log1p(len(raw)))]


@dataclass
class Trees:
    """Boosted regression trees on binned features, for the logistic loss."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)  # complete trees: feature, bin, value of a leaf

    DEPTH, ROUNDS, RATE, BINS, LEAST, RIDGE = 3, 60, 0.15, 32, 3.0, 1.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b, width = self.binned(x), self.BINS + 1
        rate = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        for _ in range(self.ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            g, h = w * (y - p), w * p * (1 - p)
            tree: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (self.DEPTH + 1) - 1)
            node = np.zeros(len(y), np.int64)
            for at in range(2**self.DEPTH - 1):
                rows = np.nonzero(node == at)[0]
                split = self._split(b[rows], g[rows], h[rows], w[rows], width) if len(rows) > 1 else None
                if split is None:
                    continue
                tree[at] = (*split, 0.0)
                node[rows] = 2 * at + 1 + (b[rows, split[0]] > split[1])
            for at in np.unique(node):
                rows = node == at
                value = self.RATE * g[rows].sum() / (h[rows].sum() + self.RIDGE)
                tree[at] = (-1, 0, float(value))
                margin[rows] += value
            self.trees.append(tree)
        return self

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, width: int) -> tuple[int, int] | None:
        score = lambda a, c: a * a / (c + self.RIDGE)
        best, found = 1e-6, None
        for k in range(b.shape[1]):
            gs, hs, ws = (np.bincount(b[:, k], v, width).cumsum() for v in (g, h, w))
            ok = (ws[:-1] >= self.LEAST) & (ws[-1] - ws[:-1] >= self.LEAST)
            gain = np.where(ok, score(gs[:-1], hs[:-1]) + score(gs[-1] - gs[:-1], hs[-1] - hs[:-1]) - score(gs[-1], hs[-1]), 0)
            if gain.max() > best:
                best, found = float(gain.max()), (k, int(gain.argmax()))
        return found

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x) or not self.trees:
            return out
        b = self.binned(x)
        rows = np.arange(len(x))
        for tree in self.trees:
            feature, cut, value = (np.array(v) for v in zip(*tree))
            node = np.zeros(len(x), np.int64)
            for _ in range(self.DEPTH):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (b[rows, np.maximum(f, 0)] > cut[node]))
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step function of x that is nearest to y, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        blocks.append([b * c, c, a, a])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return xs, ys


@dataclass
class Model:
    learned: Learned
    trees: Trees
    points: tuple[np.ndarray, np.ndarray] | None
    constant: float = 0.0
    reader: Reader | None = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.points is None:
            return np.full(len(texts), self.constant)
        if self.reader is None:
            self.reader = Reader(self.learned)
        x = np.array([self.reader(t) for t in texts]).reshape(-1, len(NAMES))
        m = self.trees.margin(x)
        # a trace of the margin keeps the order within a step of the calibration
        return np.clip(0.999 * np.interp(m, *self.points) + 0.001 / (1 + np.exp(-m)), 0, 1)


def fit(texts: list[str | None], labels: list[int], ratio: float = 1.0, seed: int = 7) -> Model:
    """ratio: labelled rows with label 0 that one of these stands for, over the same of label 1."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(Learned(), Trees(), None, float(y.mean()) if len(y) else 0.0)
    positive, total = Counter(), Counter()
    for t, label in zip(texts, labels):
        if label:
            positive.update(pieces({plain(w) for w in tokens(t)}))
    learned = Learned({p: c for p, c in positive.items() if c >= 2}, {}, ratio)
    for t in texts:
        total.update(p for p in pieces({plain(w) for w in tokens(t)}) if p in learned.positive)
    learned.total = dict(total)
    readers = [Reader(learned, k) for k in (0, 1)]
    x = np.array([readers[int(label)](t) for t, label in zip(texts, labels)])
    w = np.where(y > 0, 1.0, ratio)
    fold = np.random.default_rng(seed).permutation(len(y)) % 3
    held = np.zeros(len(y))
    for k in range(3):
        rest = fold != k
        if y[rest].min() < y[rest].max():
            held[~rest] = Trees().fit(x[rest], y[rest], w[rest]).margin(x[~rest])
    # beyond fitting, only what can tell anything is kept
    learned.positive = {p: c for p, c in learned.positive.items() if learned.weight(p) > TELLING}
    learned.total = {p: total[p] for p in learned.positive}
    return Model(learned, Trees().fit(x, y, w), isotonic(held, y, w))


def sample(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int], float]:
    """At most so many labelled texts of either label, and the ratio of weights that restores the labels' own ratio.

    Labels are chosen by the order of a hash of their ids, so only chosen ids, a bounded number, meet the documents.
    """
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (allowed if allowed is not None else F.lit(True)))
    own = own.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    first = lambda k, n: own.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = first(1, positives).unionByName(first(0, negatives))  # positives + negatives rows at most
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), F.col("d") == F.col("id")).groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id").collect()
    used = Counter(r["label"] for r in rows)
    ratio = (counts.get(0, 0) / max(1, used[0])) / (counts.get(1, 0) / max(1, used[1])) if used[0] and used[1] else 1.0
    return [r["text"] for r in rows], [r["label"] for r in rows], ratio


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of docs."""
    with_arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.scores(b.column(1).to_pylist()))], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")


def mark(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """docs with the score of each text in score_col."""
    with_arrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array(sent.value.scores(b.column(text_col).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), scores], names=[*names, score_col])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in names), StructField(score_col, DoubleType())]))
