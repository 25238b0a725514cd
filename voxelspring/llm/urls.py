"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for the rest.

Host, path and rule come from column expressions. The urls that a rule decides are the labelled
ones; trees are trained on them and judge the urls that no rule fits. The features are lexical:
lengths, depth, digit ratio, entropy, parameter counts, and how often urls with the same suffix of
the host, first label of the host or first segment of the path were blocked in training. A training
url gets these shares from the other folds alone, so that they say nothing about its own label.
Training takes the `sample` labelled urls with the smallest hash (the bound is a parameter); scoring
takes every row.

Defined results: a null url, or one without "://", has empty host and path, fits no rule and is
judged by the trees on its raw text (null: the empty text); repeated urls get equal rows; without
both kinds of labels the trees give the only kind seen, or "allow"; an empty table gives no rows;
further columns of the input don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring.llm.common import table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
SAMPLE = 20_000
#: Folds of the shares in training, and the urls of the average share that smooth one.
FOLDS, PRIOR = 5, 20
A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without "://"."""
    # what follows the first "://"; null where there is none
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, *A_TO_Z), F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule and rule_verdict; the longest rule that fits wins, and of
    equally long ones the first."""
    host, path = host_and_path(F.col("url"))
    out = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def names(host: str, path: str) -> tuple[str, ...]:
    """What shares are kept of: the host's last label, its last two, its first, the path's first segment."""
    labels = host.split(".")
    return "1" + labels[-1], "2" + ".".join(labels[-2:]), "3" + labels[0], "4" + path.lstrip("/").partition("/")[0]


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    n = max(1, len(url))
    query = url.partition("?")[2].partition("#")[0]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    digits = sum(c.isdigit() for c in url)
    return [len(url), len(host), len(path), host.count(".") + 1 if host else 0, sum(bool(p) for p in path.split("/")), digits / n, sum(c.isdigit() for c in host) / max(1, len(host)), url.count("-") + url.count("_"), entropy, sum(bool(p) for p in query.split("&")), len(query), float("#" in url), float(url.startswith("https"))]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on quantile bins of each feature. Each
    tree takes a share of the features, drawn by a fixed seed, so that several features that tell the
    labels equally well all have their say on urls where they differ."""

    def __init__(self, depth: int = 4, rounds: int = 60, rate: float = 0.15, bins: int = 32, least: int = 5, ridge: float = 1.0, columns: float = 0.4):
        self.depth, self.rounds, self.rate, self.bins, self.least, self.ridge, self.columns = depth, rounds, rate, bins, least, ridge, columns

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        # half way between quantiles, so that a value never seen goes to the nearer side
        found = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins))) for c in x.T]
        self.edges = [(q[1:] + q[:-1]) / 2 for q in found]
        binned = self._binned(x)
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.trees = math.log(share / (1 - share)), []
        at = np.full(len(y), self.base)
        rng, share = np.random.default_rng(11), max(1, math.ceil(self.columns * x.shape[1]))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-at))
            tree = self._grow(binned, y - p, p * (1 - p), np.sort(rng.permutation(x.shape[1])[:share]))
            self.trees.append(tree)
            at += self._walk(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, binned: np.ndarray, grad: np.ndarray, curve: np.ndarray, columns: np.ndarray):
        """Complete tree by levels: split feature, split bin and leaf value of each node."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
        rows = {0: np.arange(len(grad))}
        for node in range(size):
            own = rows.pop(node, None)
            if own is None:
                continue
            g, h = grad[own], curve[own]
            value[node] = self.rate * g.sum() / (h.sum() + self.ridge)
            best = (1e-6, None)
            if 2 * node + 2 < size and len(own) >= 2 * self.least:
                whole = g.sum() ** 2 / (h.sum() + self.ridge)
                for f in columns:
                    b = binned[own, f]
                    sums = [np.cumsum(np.bincount(b, w, self.bins))[:-1] for w in (g, h, None)]
                    ok = (sums[2] >= self.least) & (len(own) - sums[2] >= self.least)
                    gain = np.where(ok, sums[0] ** 2 / (sums[1] + self.ridge) + (g.sum() - sums[0]) ** 2 / (h.sum() - sums[1] + self.ridge) - whole, 0)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], (f, at))
            if best[1] is not None:
                feature[node], cut[node] = best[1]
                left = binned[own, best[1][0]] <= best[1][1]
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return feature, cut, value

    def _walk(self, tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[node]
            right = binned[np.arange(len(node)), np.maximum(f, 0)] > cut[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return 1 / (1 + np.exp(-(self.base + sum(self._walk(t, binned) for t in self.trees))))


class Shares:
    """How many urls have a name, and how many of them are blocked."""

    def __init__(self, rows: list[tuple[str | None, str, str, int]]):
        self.rows, self.total = len(rows), sum(r[3] for r in rows)
        self.seen: Counter[str] = Counter()
        self.blocked: Counter[str] = Counter()
        for _, host, path, label in rows:
            for name in names(host, path):
                self.seen[name] += 1
                self.blocked[name] += label

    def features(self, host: str, path: str) -> list[float]:
        """The smoothed share of blocked urls for each name, and how frequent the host's suffix is."""
        average = (self.total + 1) / (self.rows + 2)
        found = names(host, path)
        return [*((self.blocked[n] + PRIOR * average) / (self.seen[n] + PRIOR) for n in found), math.log1p(1000 * self.seen[found[1]] / max(1, self.rows))]


def features(rows, shares: Shares) -> np.ndarray:
    return np.array([[*lexical(*r[:3]), *shares.features(*r[1:3])] for r in rows])


class UrlModel:
    """Trees with the shares that scoring reads, which are those of all training urls."""

    def __init__(self, rows: list[tuple[str | None, str, str, int]]):
        y = np.array([r[3] for r in rows], dtype=float)
        self.only = float(y[0]) if len(y) and (y == y[0]).all() else 0.0
        self.trees, self.shares = None, Shares(rows)
        if len(set(y)) < 2:
            return
        fold = np.array([zlib.crc32((r[0] or "").encode("utf-8", "replace")) % FOLDS for r in rows])
        x = np.zeros((len(rows), 0))
        for f in np.unique(fold):
            own = np.flatnonzero(fold == f)
            made = features([rows[i] for i in own], Shares([r for r, g in zip(rows, fold, strict=True) if g != f]))
            x = np.zeros((len(rows), made.shape[1])) if not x.shape[1] else x
            x[own] = made
        self.trees = Trees().fit(x, y)

    def predict(self, rows) -> np.ndarray:
        if self.trees is None or not rows:
            return np.full(len(rows), self.only)
        return self.trees.predict(features(rows, self.shares))


def train(ruled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    label = (F.col("rule_verdict") == "block").cast("int").alias("label")
    # a url decides its host, path and label
    labelled = ruled.where(F.col("rule_verdict").isNotNull()).select("url", "host", "path", label).dropDuplicates(["url"])
    order, n = F.pmod(F.xxhash64("url"), F.lit(1 << 30)), labelled.count()
    smallest = lambda df: df.orderBy(order, "url").limit(sample).collect()
    rows = []
    if n > 2 * sample:
        # by hash on the workers first, so that tasks don't each send a whole sample to the driver
        rows = smallest(labelled.where(order < int(1.5 * sample / n * (1 << 30))))
    if len(rows) < min(sample, n):
        rows = smallest(labelled)
    return UrlModel([tuple(r) for r in rows])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of "block")."""
    ruled = with_rules(pages, rules)
    sent = pages.sparkSession.sparkContext.broadcast(train(ruled, sample))  # bounded by the sample

    def run(batches):
        model = sent.value
        for batch in batches:
            scores = model.predict(list(zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True)))
            verdict = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(batch.column("rule_verdict").to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return ruled.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the judgement that SQL can express: host, path, rule and the rule's verdict."""
    return with_rules(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "rule_verdict")


RULES_ORACLE = """
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(name, verdict, host, path) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
         ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), fits AS (
  SELECT s.*, r.name, r.verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.name) DESC) AS nth
  FROM split s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT page_id, host, path, name AS rule, verdict AS rule_verdict FROM fits WHERE nth = 1
"""
