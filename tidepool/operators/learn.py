"""Training of the option selector on a bounded labelled sample."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.config import Selector, Training

#: Most labelled rows that a selector is trained on, and options that one may choose from.
SAMPLE, MOST_OPTIONS = 1_000, 10_000


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return re.findall("[a-z0-9_]+", low) + re.findall("[一-鿿]", low)


def split(rows: list, share: float = 0.3, seed: int = 11, rounded: bool = False) -> tuple[list, list]:
    """(train, test) after a seeded shuffle; share n rows, cut to a whole number or ``rounded``, at least one, are the test."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    n = max(1, round(len(rows) * share) if rounded else int(len(rows) * share))
    return rows[n:], rows[:n]


@dataclass
class Lexicon:
    idf: dict[str, float]
    avgdl: float
    n: int

    @classmethod
    def fit(cls, texts: list[str]) -> Lexicon:
        docs = [d for d in map(words, texts) if d]
        df = Counter(w for d in docs for w in set(d))
        n = len(docs)
        return cls({w: math.log(1 + (n - k + 0.5) / (k + 0.5)) for w, k in df.items()}, sum(map(len, docs)) / n if n else 1.0, n)


class Examples:
    """Features of contexts against all options, as arrays of indices and values."""

    def __init__(self, options: list[str], lexicon: Lexicon, p: Selector = Selector()) -> None:
        self.index: dict[str, int] = {"bm25": 0}
        self.lexicon, self.p = lexicon, p
        self.options = [(Counter(o), set(o), set(zip(o, o[1:], strict=False)), len(o)) for o in map(words, options)]

    def _of(self, name: str) -> int:
        return self.index.setdefault(name, len(self.index))

    def of(self, context: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(indices, values) for each option; index 0 is the bm25 feature."""
        c = words(context)
        mine, pairs = set(c), set(zip(c, c[1:], strict=False))
        out = []
        for counts, theirs, grams, size in self.options:
            shared = sorted(mine & theirs)
            names = [*(f"x:{t}" for t in shared), *(f"o:{t}" for t in sorted(theirs)), f"ov:{min(len(shared), 5)}"]
            names += [f"or:{min(int(len(shared) / max(1, len(theirs)) * 10), 10)}", "bias", *(f"xb:{a}_{b}" for a, b in sorted(pairs & grams))]
            k1, b = self.p.k1, self.p.b
            bm25 = sum(self.lexicon.idf.get(w, 0.0) * counts[w] * (k1 + 1) / (counts[w] + k1 * (1 - b + b * size / self.lexicon.avgdl)) for w in shared)
            values = np.ones(len(names) + 1)
            values[0] = min(bm25, self.p.cap) / self.p.scale
            out.append((np.array([0, *map(self._of, names)]), values))
        return out


def _chances(weights: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    scores = np.array([weights[i] @ v for i, v in pairs])
    e = np.exp(scores - scores.max())
    return e / e.sum()


def _top1(weights: np.ndarray, rows: list) -> float:
    return sum(int(np.argmax(_chances(weights, x)) == label) for x, label in rows) / len(rows) if rows else 0.0


def train(rows: list[tuple[str, int]], options: list[str], held_out: list[tuple[str, int]] = (), t: Training = Training()) -> dict:
    """Weights of the selector after passes over (context, option index) rows, and how they did.

    Each example moves every option's features by its clipped gradient with decay; the bm25 weight
    stays 1. The weights of the best pass on the held-out rows are kept, the untrained ones unless a
    pass is better by ``least_gain``. Steps go down the loss; ``ascend`` turns them up.
    """
    examples = Examples(options, Lexicon.fit(options))
    train_rows = [(examples.of(c), label) for c, label in rows if 0 <= label < len(options)]
    test_rows = [(examples.of(c), label) for c, label in held_out if 0 <= label < len(options)]
    weights = np.zeros(len(examples.index))
    weights[0] = 1.0
    best, best_weights, best_epoch = _top1(weights, test_rows), weights.copy(), 0
    order, rnd, curve = list(range(len(train_rows))), random.Random(t.seed), []
    sign = 1.0 if t.ascend else -1.0
    for epoch in range(1, t.epochs + 1):
        rnd.shuffle(order)
        loss = 0.0
        for i in order:
            pairs, label = train_rows[i]
            chances = _chances(weights, pairs)
            loss -= math.log(max(chances[label], 1e-12))
            for j, (at, values) in enumerate(pairs):
                step = np.clip((chances[j] - (j == label)) * values[1:], -1.0, 1.0)
                weights[at[1:]] = weights[at[1:]] * (1 - t.rate * t.l2) + sign * t.rate * step
        curve.append(loss / max(1, len(train_rows)))
        if test_rows and (now := _top1(weights, test_rows)) > best + t.least_gain:
            best, best_weights, best_epoch = now, weights.copy(), epoch
    if test_rows:
        weights = best_weights
    names = {i: k for k, i in examples.index.items()}
    return {"w": {names[i]: float(x) for i, x in enumerate(weights) if x}, "b": 0.0, "best_epoch": best_epoch, "top1": _top1(weights, test_rows) if test_rows else None, "loss_curve": curve, "n_train": len(train_rows)}


def catalogue(options: DataFrame) -> list[tuple[str, str]]:
    """(name, text) of all options, by oid; too many to train on are an error."""
    names = [(r.name, r.text) for r in options.select("oid", "name", "text").orderBy("oid").limit(MOST_OPTIONS + 1).collect()]
    if len(names) > MOST_OPTIONS:
        raise ValueError(f"more than {MOST_OPTIONS} options")
    return names


def learned(gold: DataFrame, options: DataFrame, t: Training = Training(), sample: int = SAMPLE) -> DataFrame:
    """(n_train, n_test, best_epoch, test_top1, first_loss, last_loss) of a selector trained on gold (qid, context, label).

    At most ``sample`` labelled rows are fetched, by a hash of their id; more than MOST_OPTIONS options are an error.
    """
    spark = gold.sparkSession
    names = catalogue(options)
    place = {name: i for i, (name, _) in enumerate(names)}
    known = gold.join(F.broadcast(options.select(F.col("name").alias("label"))), "label", "left_semi")
    rows = known.orderBy(F.xxhash64("qid"), "qid").limit(sample).select("qid", "context", "label").collect()
    a, b = split([(r.context, place[r.label]) for r in sorted(rows)]) if rows else ([], [])
    m = train(a, [x for _, x in names], b, t) if rows else {"n_train": 0, "best_epoch": 0, "top1": None, "loss_curve": []}
    first, last = (m["loss_curve"] or [None])[0], (m["loss_curve"] or [None])[-1]
    return spark.createDataFrame([(m["n_train"], len(b), m["best_epoch"], m["top1"], first, last)], "n_train bigint, n_test bigint, best_epoch bigint, test_top1 double, first_loss double, last_loss double")


class Scorer:
    """Chances of options by a stored model: weights by the names of features, and the lexicon fitted on its options."""

    def __init__(self, w: dict[str, float], lexicon: Lexicon) -> None:
        self.w, self.lexicon = w, lexicon

    @classmethod
    def of(cls, model: dict) -> Scorer:
        lex = model["lex"]
        return cls(model["w"], Lexicon(lex["idf"], lex["avgdl"], lex["n"]))

    def chances(self, context: str | None, options: list[str]) -> np.ndarray:
        """The probability of each option; nothing without options."""
        if not options:
            return np.zeros(0)
        examples = Examples(options, self.lexicon)
        pairs = examples.of(context)
        return _chances(np.array([self.w.get(name, 0.0) for name in examples.index]), pairs)


def decided(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """(label, ok, p_gold, confidence, margin) of decision rows (context, options, label), each with options of its own.

    Rows whose label is no place in their options, or null, are left out.
    """

    def run(batches):
        for batch in batches:
            out = []
            for context, options, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if options and label is not None and 0 <= label < len(options):
                    p = scorer.chances(context, options)
                    best = np.argsort(-p, kind="stable")
                    second = p[best[1]] if len(p) > 1 else 0.0
                    out.append((options[label].split()[0] if options[label].split() else "", bool(best[0] == label), float(p[label]), float(p[best[0]]), float(p[best[0]] - second)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["label", "ok", "p_gold", "confidence", "margin"])

    return rows.select("context", "options", F.col("label").cast("int")).mapInArrow(run, "label string, ok boolean, p_gold double, confidence double, margin double")
