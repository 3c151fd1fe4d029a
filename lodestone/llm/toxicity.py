"""Toxicity: a support vector machine over a subsequence string kernel, with Nystroem landmarks.

The kernel of two words counts their common subsequences of ORDER characters, each weighted by DECAY to the power of
the stretch it spans in either word, and is normalised to 1 for equal words. Gaps and inserted characters lower it only
a little; blanks inserted are met by joining neighbouring short words. Kernels up to FLOOR count as none. The unit is
the sentence: its kernel with a landmark is that of its best word. A document is the bag of its sentences, and its
features are the best sentence's kernel and the density of such sentences (their sum against the document's length).
Of either vector k, K^(-1/2) k are features, K being the landmarks' own kernel matrix; a linear SVM is trained on them,
and Platt scaling turns its margin into a score. Labels are those of documents, so a sentence is labelled by the
document it stands in.

Landmarks and training rows come from bounded samples of labelled rows (the smallest hashes of ids). Scoring is one
pass over whole texts without a shuffle: the distinct words of each slice of text are compared with the landmarks once.
"""

from __future__ import annotations

import math
import re
import string
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, map_arrow, shuffle_width, slices, spread, table, texts
from .quality import held_out

ORDER = 3
DECAY = 0.8
#: Kernels up to this count as none, those above in proportion.
FLOOR = 0.3
#: Landmarks, chosen among so many beginnings of words that mark toxic rows.
LANDMARKS, CANDIDATES = 64, 1500
#: Landmarks are words and beginnings of words, of so many characters.
SHORTEST, LONGEST = 4, 12
#: No two landmarks are this alike.
ALIKE = 0.6
#: What a row that has a landmark already counts for in the choice of the next one.
COVERED = 0.7
#: Neighbouring words of at most so many characters are also joined.
JOINED = 4
#: Words of a document to one sentence with a landmark, at which its density is one half.
SPREAD = 50
#: At most so many rows of either label are trained on.
SAMPLE = 2000
HELD_OUT_OF, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Subsequences handled at once.
BATCH = 100_000
#: A longer word is compared in overlapping pieces of so many characters, so that no landmark is cut.
PIECE = 32
#: Words whose kernels a task holds; emptied when full.
MAX_ENTRIES = 300_000

#: Marks taken off the ends of words (fixed values: the marks of ASCII, then common ones of Latin scripts).
_MARKS = string.punctuation + "¡¿«»‘’“”„…–—"
_ENDS = re.compile(r"[.!?\n\u3002]+")


def sentences(text: str) -> list[list[str]]:
    """Lower-case words by sentence: without marks at their ends, long ones in pieces, and joins of short neighbours.

    A run of single characters counts as the word that it spells.
    """
    out = []
    for part in _ENDS.split(text.lower()):
        words = [w for w in (x.strip(_MARKS) for x in part.split()) if w]
        if not words:
            continue
        size = list(map(len, words))
        found = words
        if max(size) > PIECE:
            found = [w for w in words if len(w) <= PIECE]
            for w in words:
                if len(w) > PIECE:
                    found += [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
        joins = [a + b for a, b, m, n in zip(words, words[1:], size, size[1:]) if m <= JOINED and n <= JOINED]
        if size.count(1) > 2:
            spelled = "".join(w if n == 1 else " " for w, n in zip(words, size))
            joins += [w[i : i + PIECE] for w in spelled.split() if len(w) > 2 for i in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]
        out.append(found + joins if joins else found)
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, (length, words)."""
    return np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).T)


def _own(codes: np.ndarray) -> np.ndarray:
    """The kernel of each word (length, n) with itself, not normalised: common subsequences by dynamic programming."""
    length, n = codes.shape
    decay = np.float32(DECAY)
    # held[q]: subsequences of q + 1 characters by the character they end at in one copy, decayed to here in the other
    held = [np.zeros((length, n), np.float32) for _ in range(ORDER - 1)]
    ends = [np.empty((length, n), np.float32) for _ in range(ORDER)]
    out, below = np.zeros(n, np.float32), np.empty(n, np.float32)
    for code in codes:
        np.copyto(ends[0], codes == code)
        for q in range(1, ORDER):
            was, now, match = held[q - 1], ends[q], ends[0]
            below[:] = 0
            for j in range(length):
                np.multiply(match[j], below, out=now[j])
                below *= decay
                below += was[j]
        for q in range(ORDER - 1):
            held[q] *= decay
            held[q] += ends[q]
        out += ends[-1].sum(0)
    return out * decay ** (2 * ORDER)  # a stretch counts its own characters too


class Landmarks:
    """The kernel's feature vectors of some words: a weight for each subsequence of ORDER characters, in rows by subsequence."""

    def __init__(self, words: list[str]):
        self.words = words
        letters = sorted(set("".join(words)))
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.base = len(letters) + 1
        rows: dict[int, dict[int, float]] = {}
        for k, w in enumerate(words):
            at = [letters.index(c) + 1 for c in w]
            for places in combinations(range(len(w)), ORDER):
                row = rows.setdefault(reduce(lambda x, i: x * self.base + at[i], places, 0), {})
                row[k] = row.get(k, 0.0) + DECAY ** (places[-1] - places[0] + 1)
        self.row = np.zeros(self.base**ORDER, np.int32)
        self.weight = np.zeros((len(rows) + 1, len(words)), np.float32)
        for i, (key, of) in enumerate(rows.items(), 1):
            self.row[key] = i
            for k, x in of.items():
                self.weight[i, k] = x
        self.weight /= np.sqrt(np.maximum((self.weight**2).sum(0), 1e-12))

    def _batch(self, words: list[str]) -> np.ndarray:
        codes = _codes(words)
        places = np.array(list(combinations(range(len(codes)), ORDER)), np.int32)
        place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        at = np.where(self.letters[place] == codes, place + 1, 0).astype(np.int32).T
        key = at[:, places[:, 0]]
        for q in range(1, ORDER):
            key = key * self.base + at[:, places[:, q]]
        # a character that no landmark has is 0 and may collide with nothing, as rows hold letters from 1 on
        row = self.row[key]
        word, which = np.nonzero(row)
        out = np.zeros((len(words), len(self.words)), np.float32)
        if len(word):
            span = (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float32)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[first]] = np.add.reduceat(span[which, None] * self.weight[row[word, which]], first)
        return out / np.sqrt(_own(codes))[:, None]

    def kernels(self, words: list[str]) -> np.ndarray:
        """Normalised kernels (words, landmarks); 0 for words of fewer than ORDER characters."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= ORDER:
                by_length.setdefault(len(w), []).append(i)
        if self.words:
            for length, rows in by_length.items():
                size = max(8, BATCH // math.comb(length, ORDER))
                for at in range(0, len(rows), size):
                    part = rows[at : at + size]
                    out[part] = self._batch([words[i] for i in part])
        return out


class Model:
    """Landmarks, weights on their kernels, bias."""

    def __init__(self, landmarks: list[str], beta: np.ndarray, bias: float):
        self.landmarks, self.beta, self.bias = landmarks, beta, bias

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.beta + self.bias, -30, 30)))


class Pool:
    """The features of texts: for each landmark the best sentence's kernel, then the density of sentences."""

    def __init__(self, landmarks: list[str], max_entries: int = MAX_ENTRIES):
        self.landmarks, self.max_entries = Landmarks(landmarks), max_entries
        self.seen: set[str] = set()
        self.place: dict[str, int] = {}  # of words with a kernel above FLOOR
        self.kernels = np.zeros((0, len(landmarks)), np.float32)

    def _fill(self, words: set[str]) -> None:
        new = words - self.seen
        if len(self.seen) + len(new) > self.max_entries:
            self.seen, self.place, self.kernels, new = set(), {}, self.kernels[:0], words
        self.seen |= new
        listed = list(new)
        k = np.maximum(0, self.landmarks.kernels(listed) - FLOOR) / (1 - FLOOR)
        near = np.flatnonzero(k.max(1) > 0) if k.size else np.zeros(0, np.int64)
        self.place.update(zip([listed[i] for i in near.tolist()], range(len(self.place), len(self.place) + len(near))))
        self.kernels = np.concatenate([self.kernels, k[near]])

    def __call__(self, rows: list[str]) -> np.ndarray:
        each = [sentences(t) for t in rows]
        self._fill(set().union(*[w for doc in each for w in doc]))
        n, place = len(self.landmarks.words), self.place
        out = np.zeros((len(rows), 2 * n), np.float32)
        for i, doc in enumerate(each):
            met = [x for x in ([place[w] for w in said if w in place] for said in doc) if x]
            if met:
                k = np.array([self.kernels[x].max(0) for x in met])
                out[i, :n] = k.max(0)
                out[i, n:] = np.minimum(1, k.sum(0) / (1 + len(rows[i].split()) / SPREAD))
        return out


def pick(candidates: list[tuple[str, float]], rows: list[list[int]], most: int = LANDMARKS) -> list[str]:
    """Landmarks, no two of which are ALIKE: each has the most gain over rows (given as indices of candidates) that few of those before it cover."""
    words = [w for w, _ in candidates]
    gain = np.array([g for _, g in candidates])
    has = np.zeros((len(rows), len(words)), np.float32)
    for i, of in enumerate(rows):
        has[i, of] = 1
    weight, free, out = np.ones(len(rows)), np.ones(len(words), bool), []
    while free.any() and len(out) < most:
        value = np.where(free, weight @ has * gain, -1.0)
        best = int(value.argmax())
        if value[best] <= 0:
            break
        out.append(words[best])
        weight *= np.where(has[:, best] > 0, COVERED, 1.0)
        free &= Landmarks([words[best]]).kernels(words)[:, 0] < ALIKE
    return out


def fit(x: np.ndarray, y: np.ndarray, landmarks: list[str], steps: int = 800, cost: float = 40.0) -> Model:
    """A linear SVM (squared hinge, classes weighed alike) on Nystroem features, then Platt scaling."""
    if not landmarks or not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(landmarks, np.zeros(2 * len(landmarks)), float(np.log((share + 0.01) / (1.01 - share))))
    value, vector = np.linalg.eigh(Landmarks(landmarks).kernels(landmarks).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    root = np.kron(np.eye(2), root)
    z, sign = x @ root, np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y) * cost
    w, b = np.zeros(z.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        slack = np.maximum(0, 1 - sign * (z @ w + b))
        g = np.append(w / len(w) - z.T @ (weight * sign * slack), -(weight * sign * slack).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    margin = z @ w + b
    a, c = 1.0, 0.0
    hit = (y > 0).astype(np.float64) * 0.998 + 0.001
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        d = (p - hit) * weight
        h = p * (1 - p) * weight + 1e-9
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        a, c = np.array([a, c]) - np.clip(np.linalg.solve(hess, [(d * margin).sum(), d.sum()]), -0.5, 0.5)
    return Model(landmarks, a * (root @ w), a * b + c)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Labels of held-out rows are never read; an id with several labels counts with its largest, null labels don't count."""
    held = held_out("doc_id", HELD_OUT_OF, HELD_OUT)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mixed = F.xxhash64("doc_id", F.lit("toxicity"))
    ids = known.filter("toxic = 1").orderBy(mixed, "doc_id").limit(sample).unionByName(known.filter("toxic = 0").orderBy(mixed, "doc_id").limit(sample))
    # at most two samples of ids
    stage = Stage(docs.sparkSession, "toxicity")
    rows = stage.save(texts(docs).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic").repartition(shuffle_width(docs.sparkSession)), "sample")

    def beginnings(text: str) -> set[str]:
        return {w[:k] for said in sentences(text) for w in set(said) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}

    def split(batches):
        for b in slices(batches, "text"):
            yield {"toxic": b.column("toxic"), "words": [list(beginnings(t or "")) for t in b.column("text").to_pylist()]}

    said = stage.save(map_arrow(rows, split, "toxic int, words array<string>"), "said")
    sizes = {r.toxic: r.n for r in said.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    seen = said.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    share_p, share_n = (F.col("p") + 0.5) / pos, (F.col("n") + 0.5) / neg
    listed = [(r.word, r.gain) for r in seen.filter((F.col("p") >= 3) & (share_p > share_n)).select("word", F.log(share_p / share_n).alias("gain"), "p").orderBy((F.col("p") * F.col("gain")).desc(), F.length("word").desc(), "word").limit(CANDIDATES).collect()]
    place = {w: k for k, (w, _) in enumerate(listed)}

    def cover(batches):
        for b in batches:
            yield {"of": [[place[w] for w in words if w in place] for words in b.column("words").to_pylist()]}

    # one row for each toxic row of the sample
    landmarks = pick(listed, [r.of for r in map_arrow(said.filter("toxic = 1"), cover, "of array<int>").collect()])

    def pool(batches):
        pooled = Pool(landmarks)
        for b in slices(batches, "text"):
            yield {"toxic": b.column("toxic"), "k": pooled([t or "" for t in b.column("text").to_pylist()]).tolist()}

    got = map_arrow(rows, pool, "toxic int, k array<float>").toPandas()
    return fit(np.array(got["k"].tolist(), np.float64).reshape(len(got), 2 * len(landmarks)), got["toxic"].to_numpy().astype(int), landmarks)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    A null text scores as an empty one. Repeated rows and ids each give their own row; a null id stays null and isn't
    held out. Other columns are ignored, whatever their names. An empty table gives an empty table. Long texts are
    scored whole. Equal texts tie.
    """

    def run(batches):
        pooled = Pool(model.landmarks)
        for b in slices(batches, "text"):
            s = model.scores(pooled([t or "" for t in b.column("text").to_pylist()]))
            yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return map_arrow(texts(docs, held_out("doc_id", HELD_OUT_OF, HELD_OUT).alias("held_out")), run, "doc_id bigint, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


ORACLE_SQL = None  # a fitted model can't be said in SQL
