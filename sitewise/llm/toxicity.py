"""Operator 4: toxicity by a linear-chain conditional random field.

The field tags words as toxic or not. Its token labels come from labelled
documents: in a document marked toxic, a word counts as toxic if the word or a
prefix of it is much commoner in toxic documents than in others. Forward-backward
marginals give a probability for each word; a document's score is a logistic
function of their power sum, and its spans are the words whose marginal is at
least one half.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, crc_fold, hashed_sample
from .crf import ChainModel, ChainScorer, Words

#: The bounded sample the model is fitted on: documents of each class, taken in
#: the order of a hash of the id, and the longest text among them.
SAMPLE_TOXIC = 800
SAMPLE_CLEAN = 1600
SAMPLE_CHARS = 5000
#: A cue is so much commoner in toxic documents that, over all candidates, so
#: many such words would be expected by chance.
CUE_CHANCE = 0.02
WORDS_AT_ONCE = 400_000

_words = Words(r"[^\W_]")
words_of = _words.words


def _cues(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Words (as "w:...") and prefixes of 4 to 7 letters ("p:...") that mark toxic documents."""

    def keys(words):
        out = set()
        for w in set(words):
            out.add("w:" + w)
            out.update("p:" + w[:k] for k in range(4, min(7, len(w)) + 1))
        return out

    a, b = Counter(), Counter()
    for t in toxic:
        a.update(keys(t))
    for t in clean:
        b.update(keys(t))
    p = max(len(toxic), 1) / max(len(toxic) + len(clean), 1)
    least = np.log(max(len(a), 1) / CUE_CHANCE)

    def evidence(n, other):
        share = n / (n + other)
        if share <= p or p >= 1:
            return 0.0
        return n * np.log(share / p) + (other * np.log((1 - share) / (1 - p)) if other else 0.0)

    return {x for x, n in a.items() if n > 3 and n > 4 * b[x] and evidence(n, b[x]) > least}


class ToxicityModel:
    """The field and the logistic function on top of it."""

    def __init__(self, toxic: list[str], clean: list[str]):
        pos, neg = [words_of(t) for t in toxic], [words_of(t) for t in clean]
        cues = _cues(pos, neg)

        def marked(w):
            return "w:" + w in cues or any("p:" + w[:k] in cues for k in range(4, min(7, len(w)) + 1))

        known: dict[str, bool] = {}
        tags = [np.array([known[w] if w in known else known.setdefault(w, marked(w)) for w in t], np.int64) for t in pos]
        tags += [np.zeros(len(t), np.int64) for t in neg]
        self.field = ChainModel([0, 1]).fit(pos + neg, tags, rounds=50, rate=0.8, tag_weight=np.array([1.0, 3.0]))
        x = np.array([self._evidence(m) for m in ChainScorer(self.field).marginals(pos + neg)])
        y = np.array([1.0] * len(pos) + [0.0] * len(neg))
        self.slope, self.shift = _logistic(x, y)

    @staticmethod
    def _evidence(marginals: np.ndarray) -> float:
        """The log of a power sum of the marginals, so that faint ones add up to little."""
        return float(np.log((marginals[:, 1] ** 4).sum() + 1e-6)) if len(marginals) else float(np.log(1e-6))

    def score(self, marginals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self._evidence(marginals) + self.shift, -35, 35))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge; constant if a class is missing."""
    if not len(y) or y.min() == y.max():
        return 0.0, (5.0 if len(y) and y[0] else -5.0)
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, design.T @ (y - p) - 1e-3 * w)
    return float(w[0]), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    An id labelled twice counts as toxic if one label says so; null labels,
    null ids and ids without a document are left out. Of several documents of
    one id the first in the order of texts is taken.
    """
    rows = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1)).where(crc_fold("i", folds) != fold)
    rows = rows.groupBy("i").agg(F.max("y").alias("y"))
    picked = [hashed_sample(rows.where(F.col("y") == y), "i", n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most the two sample sizes
    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.length("t").between(1, SAMPLE_CHARS)).join(ids, "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect()
    found.sort(key=lambda r: (r["i"], r["t"]))
    return ToxicityModel([r["t"] for r in found if r["y"] == 1], [r["t"] for r in found if r["y"] == 0])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The id, score, predicted and spans (start, end, probability) of every row.

    Offsets are code points of the text. Null and empty texts score as a text
    without toxic words and have no spans. Null and repeated ids keep their
    rows; an empty table gives no rows; other columns play no part. Texts of any
    length are scored whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def run(batches):
        model = shipped.value
        scorer = ChainScorer(model.field)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            score, spans = [0.0] * len(texts), [None] * len(texts)
            for lo, hi in batches_of([len(texts[i]) // 6 for i in order], WORDS_AT_ONCE):
                own = order[lo:hi]
                for i, m in zip(own, scorer.marginals([words_of(texts[i]) for i in own])):
                    score[i] = model.score(m)
                    hit = np.flatnonzero(m[:, 1] >= 0.5)
                    spans[i] = []
                    if len(hit):
                        at = _words.places(texts[i])
                        spans[i] = [{"start": at[j][0], "end": at[j][1], "probability": float(m[j, 1])} for j in hit.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array(spans, pa.list_(span))], ["_id", "score", "predicted", "spans"])

    schema = f"_id {id_type}, score double, predicted int, spans array<struct<start:int,end:int,probability:double>>"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
