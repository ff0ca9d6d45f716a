"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier."""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.common import documents, filter_rows, map_columns, remainder_is, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
GROUPS = 8
SHARES = (0.002, 0.005, 0.01, 0.015, 0.02, 0.03)
DISTINCT = (2, 3, 5)


def terms_of(word: str) -> list[str]:
    """The word itself, and its first letters as patterns ("abc*") where more follow."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many labelled texts each word or prefix occurs."""

    def make():
        def fn(text, toxic):
            counts = {1: Counter(), 0: Counter()}
            for t, y in zip(text, toxic, strict=True):
                counts[y].update({x for w in set(WORD.findall((t or "").lower())) for x in terms_of(w)})
            every = counts[0].keys() | counts[1].keys()
            return [list(every), [counts[1][x] for x in every], [counts[0][x] for x in every]] if every else None

        return fn

    parts = map_columns(labelled.select("text", "toxic"), make, "term string, toxic long, clean long", rows=2000)
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame, n_toxic: int, n_clean: int, size: int = 300, least: float = 2.0) -> list[str]:
    """The ``size`` terms (a parameter, and so a bound) that tell most: by signed chi-square among those with log odds
    of at least ``least`` and in over 1% of the toxic texts."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n_toxic + 0.5 - F.col("toxic"))) - F.log(b / (n_clean + 0.5 - F.col("clean")))
    share_a, share_b = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    every = (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
    strength = (share_a - share_b) ** 2 / (every * (1 - every) + 1e-6)
    told = counts.where((odds >= least) & (F.col("toxic") >= max(3, 0.01 * n_toxic))).withColumn("strength", strength)
    return [r.term for r in told.orderBy(F.desc("strength"), "term").limit(size).collect()]


class Voters:
    """Votes and features of a text. Terms are dealt to groups by rank; each group is a voter (toxic or silent), as
    are the share of words that are hits, the number of distinct hits, and the absence of any (clean)."""

    def __init__(self, terms: list[str], capacity: int = 500_000):
        words = [t for t in terms if t[-1] != "*"]
        prefixes = [t for t in terms if t[-1] == "*"]
        self.group = {t: i % GROUPS for i, t in enumerate(words)} | {t: GROUPS + i % GROUPS for i, t in enumerate(prefixes)}
        self.known: dict[str, tuple] = {}
        self.capacity = capacity

    def hits(self, word: str) -> tuple:
        if len(self.known) >= self.capacity:
            self.known.clear()
        found = self.known[word] = tuple(t for t in terms_of(word) if t in self.group)
        return found

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        words = WORD.findall((text or "").lower())
        known, hits = self.known, self.hits
        found = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = hits(w)
            if h:
                found.append((w, h))
        n = max(1, len(words))
        by = np.zeros(2 * GROUPS)
        for _, h in found:
            for t in h:
                by[self.group[t]] += 1
        share, distinct = len(found) / n, len({w for w, _ in found})
        votes = [1 if x else 0 for x in by] + [(1 if share >= s else -1 if not found else 0) for s in SHARES] + [(1 if distinct >= d else -1 if not found else 0) for d in DISTINCT]
        features = [*np.minimum(by / n * 100, 10.0), *np.log1p(by), *map(float, votes), min(share * 100, 20.0), np.log1p(distinct), np.log1p(len(words))]
        return votes, [float(x) for x in features]


@dataclass
class LabelModel:
    """The joint distribution of a text's class and its votes: a prior of the class, and within each class a tree of
    voters in which each vote depends on that of its parent. So a voter that mostly repeats another adds little."""

    prior: float
    table: np.ndarray  # voter, class, vote (-1, 0, 1): P(vote | class), the voter's accuracy
    given: np.ndarray  # voter, class, the parent's vote, vote: P(vote | parent's vote, class)
    parent: np.ndarray  # -1: none

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes + 1
        ratio = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, up in enumerate(self.parent):
            p = self.table[j][:, v[:, j]] if up < 0 else self.given[j][:, v[:, up], v[:, j]]
            ratio += np.log(p[1]) - np.log(p[0])
        return 1 / (1 + np.exp(-np.clip(ratio, -40, 40)))


def correlation_tree(strength: np.ndarray, least: float) -> np.ndarray:
    """The parent of each voter in the spanning forest of greatest strength, without edges under ``least``."""
    m = len(strength)
    parent, best, todo = np.full(m, -1), np.full(m, -np.inf), set(range(m))
    link = np.full(m, -1)
    while todo:
        j = max(todo, key=lambda i: (best[i], -i))
        todo.remove(j)
        parent[j] = link[j] if best[j] >= least else -1
        for i in todo:
            if strength[j, i] > best[i]:
                best[i], link[i] = strength[j, i], j
    return parent


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 40, least: float = 0.01) -> LabelModel:
    """Expectation maximisation from first guesses ``start`` of the posteriors. Each round estimates the accuracies anew,
    and the correlations: the tree of greatest mutual information given the class (edges under ``least`` nats dropped)."""
    p, (n, m) = start.astype(float), votes.shape
    hot = (votes[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * m).astype(float)
    for _ in range(rounds):
        table, pairs, strength = np.empty((m, 2, 3)), np.empty((2, m, 3, m, 3)), np.zeros((m, m))
        for y, w in ((0, 1 - p), (1, p)):
            table[:, y] = ((w @ hot).reshape(m, 3) + 0.5) / (w.sum() + 1.5)
            pairs[y] = (hot.T @ (hot * w[:, None])).reshape(m, 3, m, 3)
            joint = (pairs[y] + 0.5 / 3) / (w.sum() + 1.5)
            one = joint.sum(3)[:, :, 0][:, :, None, None]
            strength += w.sum() / n * (joint * np.log(joint / (one * joint.sum(1)[0][None, None]))).sum((1, 3))
        parent = correlation_tree(strength, least)
        given = np.zeros((m, 2, 3, 3))
        for j in np.flatnonzero(parent >= 0):
            counts = pairs[:, parent[j], :, j, :]
            given[j] = (counts + table[j][:, None, :]) / (counts.sum(2, keepdims=True) + 1)
        model = LabelModel(float(np.clip(p.mean(), 1e-3, 1 - 1e-3)), table, given, parent)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    return model


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1) @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> Linear:
    """Logistic regression on soft labels by Newton steps with a ridge."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), grad)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Linear(mean, scale, w)


def train(labelled: DataFrame, most: int = 20_000) -> tuple[list[str], Linear | float]:
    """Fits on labelled rows (doc_id, text, toxic 0/1): on all, or on about ``most`` of them by a hash of their ids
    where there are more. That bounds what the driver fits on; terms are counted in Spark.

    Without two classes to learn from, the "classifier" is the smoothed share of toxic labels.
    """
    labelled = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    n = labelled.count()
    if n > most:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    labelled = written(labelled, "labelled")
    n_toxic, n = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < n_toxic < n:
        return [], (n_toxic + 0.01) / (n + 1)
    terms = lexicon(term_counts(labelled), n_toxic, n - n_toxic)

    def make():
        voters = Voters(terms)

        def fn(text, toxic):
            made = [voters(t) for t in text]
            return [toxic, [v for v, _ in made], [f for _, f in made]]

        return fn

    rows = map_columns(labelled.select("text", "toxic"), make, "toxic int, votes array<int>, features array<double>").toArrow()  # about ``most`` rows
    toxic = rows.column("toxic").to_numpy()
    votes, x = (np.array(rows.column(c).to_pylist()) for c in ("votes", "features"))
    # the label itself is one more voter, whose accuracy is estimated with the others
    votes = np.concatenate([votes, np.where(toxic == 1, 1, -1)[:, None]], axis=1)
    model = fit_label_model(votes, np.where(toxic == 1, 0.95, 0.05))
    return terms, fit_linear(x, model.posterior(votes))


def score_toxicity(docs: DataFrame, terms: list[str], model: Linear | float, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every whole text. Null and empty texts get the score of a text without hits; each
    row in gives a row out; other columns are ignored."""

    def make():
        voters = Voters(terms)

        def fn(doc_id, text):
            score = np.full(len(text), model) if isinstance(model, float) else model(np.array([voters(t)[1] for t in text]))
            return [doc_id, score, [int(s >= threshold) for s in score]]

        return fn

    return map_columns(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, terms: list[str], model: Linear | float, threshold: float = 0.3) -> DataFrame:
    """``docs``, all columns kept, without the rows whose text scores ``threshold`` or more."""

    def make():
        voters = Voters(terms)

        def fn(text):
            score = np.full(len(text), model) if isinstance(model, float) else model(np.array([voters(t)[1] for t in text]))
            return score < threshold

        return fn

    return filter_rows(docs, make)


def training_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labelled rows outside the held-out fold: those whose crc32(doc_id as text) mod 4 isn't 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~remainder_is(4, 2))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(labels, "doc_id")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by a model of the labelled rows outside the held-out fold; see ``score_toxicity``."""
    docs = documents(spark, sf_dir)
    terms, model = train(training_rows(spark, docs, sf_dir))
    scored = score_toxicity(docs, terms, model)
    return scored.select("doc_id", remainder_is(4, 2).alias("held_out"), "score", "predicted")
