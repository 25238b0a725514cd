"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums, over the three-character subsequences that they share,
decay^(length of both occurrences with their gaps), and is normalised. An insult with characters put in, or with gaps,
keeps most of its subsequences and so stays close to the plain one; an ending never seen in training
leaves the stem's subsequences. No gap is too wide within a unit: the decay alone bounds them.

Units are the lower-cased words of a text (long ones in overlapping windows) and runs of single
characters joined. Landmarks are units of labelled training texts that tell toxic ones best, far
enough from each other, and a few frequent others. A unit's kernel values with the landmarks,
whitened by the inverse root of the landmarks' own kernel matrix, are its features (the Nystroem
map) for a linear support vector machine. A text is as toxic as its most toxic unit, so training
alternates between picking each toxic text's witness and each clean text's worst unit, and fitting
the machine to them. A logistic curve through the two largest margins of each text gives the score: a second
suspicious unit makes a toxic text likelier. As the margin is linear in the kernel, each subsequence
has one weight in the end, which makes scoring cheap.

Training takes at most `sample` labelled texts of each class, those with the smallest hash of their
id; this bound is a parameter. Of a text all units are taken.
The workers make the units. Every text is scored whole.

Defined results: a null text is the empty text, and both get the score of a text without units; a
null doc_id counts as the empty text in the held-out rule; of labels that repeat a doc_id the
largest counts; a null label is no label; without both classes in training the score is the only
class seen, or 0; repeated rows get equal rows; an empty table gives no rows; further columns of the
input don't matter.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspring.llm.common import crc_bucket, table

SAMPLE = 2_000
LANDMARKS, BACKGROUND = 80, 8
LONGEST, STEP = 24, 12
#: Occurrences that span more characters than SPAN are left out of the kernel; no unit is longer.
DECAY, SPAN = 0.7, LONGEST
#: Largest margins that make a text's score.
TOPS = 2
#: Units kept in a worker's table, which is emptied when full.
KEPT = 300_000
ROUNDS = 6
SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S)+(?!\S)")
EDGES = ".,;:!?\"'()[]{}|*&%$#"


def units(text: str | None) -> set[str]:
    """Distinct units: words without marks at their edges, windows of long words, joined runs."""
    text = (text or "").lower()
    found = {w.strip(EDGES) for w in set(text.split())}
    for m in SINGLES.finditer(text):
        found.add("".join(m[0].split()))
    for long in [w for w in found if len(w) > LONGEST]:
        found.remove(long)
        found.update(long[a : a + LONGEST] for a in range(0, len(long) - STEP, STEP))
    found.discard("")
    return found


@lru_cache(maxsize=64)
def occurrences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(3, count) positions of the three-character occurrences in n characters, and decay^length."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(at, dtype=np.int64).reshape(-1, 3).T
    return at, DECAY ** (at[2] - at[0] + 1.0)


class Kernel:
    """Weights of the subsequences that occur in the landmarks: row r of `weights` has, for each
    landmark, the weight of subsequence r, divided by the landmark's norm; row 0 is any other."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        letters = sorted(set("".join(landmarks)))
        self.base = len(letters) + 1
        self.letter = np.zeros(65536, dtype=np.int64)
        for i, c in enumerate(letters, 1):
            self.letter[min(ord(c), 65535)] = i
        found = [self._of(s) for s in landmarks]
        known = np.unique(np.concatenate([f[0] for f in found])) if found else np.zeros(0, np.int64)
        self.row = np.zeros(self.base**3, dtype=np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.weights = np.zeros((len(known) + 1, len(landmarks)))
        for j, (codes, w) in enumerate(found):
            np.add.at(self.weights[:, j], self.row[codes], w)
        self.weights /= np.maximum(np.sqrt((self.weights**2).sum(axis=0)), 1e-12)

    def _codes(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of strings of one length: (strings, occurrences) codes and the occurrences' weights."""
        at, w = occurrences(len(strings[0]))
        c = self.letter[np.minimum(np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32), 65535)].reshape(len(strings), -1)
        x, y, z = (c[:, a] for a in at)
        return np.where((x > 0) & (y > 0) & (z > 0), (x * self.base + y) * self.base + z, 0), w

    def _of(self, s: str) -> tuple[np.ndarray, np.ndarray]:
        codes, w = self._codes([s])
        return codes[0], w

    def apply(self, strings: list[str], weights: np.ndarray) -> np.ndarray:
        """For each string, the sum over its occurrences of decay^length * weights[subsequence],
        divided by the string's norm."""
        out = np.zeros((len(strings), *weights.shape[1:]))
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            if len(s) >= 3:
                by_length.setdefault(len(s), []).append(i)
        for at in by_length.values():
            for a in range(0, len(at), 1024):
                part = at[a : a + 1024]
                own = [strings[i] for i in part]
                codes, w = self._codes(own)
                rows = self.row[codes]
                norm = norms_of_length(own)
                if weights.ndim == 1:
                    out[part] = weights[rows] @ w / norm
                else:
                    i, j = np.nonzero(rows)
                    if len(i):
                        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                        out[np.array(part)[i[first]]] = np.add.reduceat(weights[rows[i, j]] * w[j][:, None], first, axis=0) / norm[i[first]][:, None]
        return out

    def values(self, strings: list[str]) -> np.ndarray:
        """(strings, landmarks) normalised kernel values."""
        return self.apply(strings, self.weights)


def norms_of_length(strings: list[str]) -> np.ndarray:
    """Square roots of the kernels with themselves of strings of one length, three or more."""
    at, w = occurrences(len(strings[0]))
    c = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), -1).astype(np.int64)
    codes = (c[:, at[0]] << 42) | (c[:, at[1]] << 21) | c[:, at[2]]
    order = np.argsort(codes, axis=1)
    codes = np.take_along_axis(codes, order, axis=1)
    new = np.ones(codes.shape, dtype=bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    first = np.flatnonzero(new.reshape(-1))
    sums = np.add.reduceat(w[order].reshape(-1), first)
    return np.sqrt(np.bincount(first // codes.shape[1], sums**2, len(strings)))


def gains(own: list[np.ndarray], y: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How well each unit's presence tells toxic texts (Fisher's criterion, with a pseudo-count that
    keeps rare units behind; -1 for units of one toxic text or of few characters), and the number of
    clean texts with it. own: the units of each text, as numbers."""
    counts = [np.zeros(len(names)), np.zeros(len(names))]
    for units_of, label in zip(own, y, strict=True):
        counts[int(label)][units_of] += 1
    clean, toxic = counts
    n_toxic, n_clean = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    p, q = toxic / n_toxic, clean / n_clean
    gain = (p - q) / np.sqrt((p + q) / 2 + 2.0 / n_toxic)
    short = np.fromiter((len(u) < 3 for u in names), bool, len(names))
    return np.where((toxic >= 2) & ~short, gain, -1.0), np.where(short, 0, clean)


def chosen_landmarks(gain: np.ndarray, clean: np.ndarray, names: list[str], count: int = LANDMARKS, background: int = BACKGROUND, apart: float = 0.9) -> list[int]:
    """The units of the highest gain that are apart from those before, then the most frequent others."""
    likely = [i for i in np.lexsort((names, -gain))[: 5 * count] if gain[i] > 0]
    picked: list[int] = []
    if likely:
        near = Kernel([names[i] for i in likely]).values([names[i] for i in likely])
        at: list[int] = []
        for i in range(len(likely)):
            if len(at) < count - background and (not at or near[i, at].max() < apart):
                at.append(i)
        picked = [int(likely[i]) for i in at]
    rest = [int(i) for i in np.argsort(-clean, kind="stable")[: 2 * count] if clean[i] > 0 and i not in picked]
    return picked + rest[: count - len(picked)]


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine (hinge loss, classes weighted evenly) by dual coordinate ascent."""
    sign = np.where(y > 0, 1.0, -1.0)
    share = y.mean()
    most = np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * cost
    z = np.column_stack([x, np.ones(len(x))])
    alpha, w, norm = np.zeros(len(z)), np.zeros(z.shape[1]), (z**2).sum(axis=1)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(z)):
            new = min(max(alpha[i] - (sign[i] * (z[i] @ w) - 1) / norm[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * sign[i] * z[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1], float(w[-1])


def platt(margins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and offset of the logistic curve through the margins, by Newton steps with a small ridge."""
    z = np.column_stack([margins, np.ones(len(margins))])
    theta = np.zeros(z.shape[1])
    theta[0] = 1.0
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(theta)), z.T @ (goal - p) - 1e-3 * theta)
        theta = theta + step
        if np.abs(step).max() < 1e-6:
            break
    return theta


def tops(margins: np.ndarray | list[float], nothing: float) -> list[float]:
    """The TOPS largest margins; that of nothing where a text has fewer units."""
    return [*sorted(margins, reverse=True)[:TOPS], *[nothing] * (TOPS - len(margins))]


class Model:
    def __init__(self, texts: list[str | None], labels: list[int], bags: list[list[str]] | None = None):
        """bags: the units of each text, where they are made already."""
        bags = [sorted(units(t)) for t in texts] if bags is None else bags
        y = np.array(labels, dtype=float)
        self.only = float(y[0]) if len(y) and (y == y[0]).all() else 0.0
        self.kernel, self.kept = None, {}
        if len(set(labels)) < 2:
            return
        # units as numbers, one string for each: the texts' own would fill the driver's memory
        place: dict[str, int] = {}
        own = [np.array([place.setdefault(u, len(place)) for u in bag], dtype=np.int64) for bag in bags]
        names = list(place)
        del place
        of_gain, clean = gains(own, y, names)
        chosen = chosen_landmarks(of_gain, clean, names)
        if not chosen:
            self.only = float(y.mean())
            return
        landmarks = [names[i] for i in chosen]
        self.kernel = Kernel(landmarks)
        m = self.kernel.values(landmarks)
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T
        margin, picked, self.weights, self.bias = of_gain, {}, np.zeros(len(self.kernel.weights)), 0.0
        # landmarks of toxic texts are witnesses too, whole and with a character put in
        told = [names[i] for i in chosen if of_gain[i] > 0 and not clean[i]]
        told += [u[:i] + "*" + u[i:] for u in told for i in range(1, len(u))]
        fixed = self.kernel.values(told) @ root
        for _ in range(ROUNDS):
            # a toxic text's witness is its likeliest unit; a clean text's worst ones add up
            witness = {int(o[margin[o].argmax()]): 1 for o, label in zip(own, y, strict=True) if label and len(o)}
            before = len(picked)
            for o, label in zip(own, y, strict=True):
                if not label and len(o):
                    picked.update(dict.fromkeys(map(int, o[np.argsort(-margin[o], kind="stable")[:2]]), 0))
            rows = {u: 1 for u in witness if u not in picked} | picked
            at = np.fromiter(rows, np.int64, len(rows))
            x = self.kernel.values([names[i] for i in at]) @ root
            marks = np.fromiter(rows.values(), np.float64, len(rows))
            w, self.bias = svm(np.concatenate([x, fixed]), np.concatenate([marks, np.ones(len(told))]))
            self.weights = self.kernel.weights @ (root @ w)
            margin = self.kernel.apply(names, self.weights) + self.bias
            if len(picked) == before:
                break
        self.curve = platt(np.array([tops(margin[o], self.bias) for o in own]), y)

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    def margins(self, bags: list[set[str]]) -> np.ndarray:
        """Of each text the largest margins of its units."""
        new = list(set().union(*bags).difference(self.kept))
        if len(self.kept) + len(new) > KEPT:
            self.kept = {}
            new = list(set().union(*bags))
        self.kept.update(zip(new, (self.kernel.apply(new, self.weights) + self.bias).tolist(), strict=True))
        return np.array([tops([self.kept[u] for u in b], self.bias) for b in bags])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), self.only)
        out = [self.margins([units(t) for t in texts[a : a + 200]]) for a in range(0, len(texts), 200)]
        z = np.concatenate(out) @ self.curve[:-1] + self.curve[-1] if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = 5) -> Model:
    """From labelled rows outside the held-out bucket."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(crc_bucket("doc_id", buckets) != 0)
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = [marks.where(F.col("toxic") > 0).orderBy(*order).limit(sample), marks.where(F.col("toxic") <= 0).orderBy(*order).limit(sample)]
    ids = F.broadcast(picked[0].union(picked[1]))  # at most two samples of id and label

    def cut_up(batches):
        for batch in batches:
            bags = [sorted(units(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("h"), pa.array(bags, pa.list_(pa.string()))], names=["doc_id", "toxic", "h", "bag"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(ids, "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("h"), "text")
    # ids that repeat bring more rows; each class keeps its own
    nth = F.row_number().over(Window.partitionBy(F.col("toxic") > 0).orderBy(F.xxhash64("doc_id"), "doc_id", "h"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= sample).drop("nth")
    rows = rows.mapInArrow(cut_up, "doc_id long, toxic int, h long, bag array<string>").orderBy("doc_id", "h").toArrow()
    return Model([], [int(t > 0) for t in rows.column("toxic").to_pylist()], rows.column("bag").to_pylist())


def score_documents(docs: DataFrame, model: Model, buckets: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by landmarks

    def run(batches):
        model = sent.value
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                s = model.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (crc_bucket("doc_id", buckets) == 0).alias("held_out"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those that are predicted to be toxic; all columns stay."""
    model = train(docs, labels, sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keep = np.concatenate([model.scores(texts[a : a + 500]) < 0.5 for a in range(0, len(texts), 500)]) if texts else np.zeros(0, bool)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
