"""Operator 6: quality rules with an isolation forest on rule statistics.

Base rules reject short and repetitive texts. Statistics of the others go to an
isolation forest: random splits isolate odd rows on short paths. How short a
path rejects a document is calibrated on all labelled rows, each scored by trees
that have not seen it, so that hardly any row labelled good is lost.
"""

from __future__ import annotations

from collections import Counter
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, materialize

#: Trees, and the rows that each of them draws, which is what makes it an isolation
#: tree: together they can look at so many different rows and no more.
TREES = 300
TREE_ROWS = 256
#: Labelled rows are dealt out to so many folds; a share of the trees does without each.
FOLDS = 5
#: Scores are told apart in steps of one part in so many.
STEPS = 1 << 16
#: The share of rows labelled good that the calibrated threshold may reject.
CLEAN_LOSS = 0.005
#: How many times a good row's loss weighs a bad row's.
CLEAN_WEIGHT = 20
#: The share of rows labelled bad among those that grow the trees: few enough
#: to be isolated early, and enough to give each statistic a range.
CONTAMINATION = 0.03
#: Rows judged and handed back at once.
SLICE_ROWS = 256
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

_odd = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], np.uint64)
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(ids: list[int]) -> int:
    """Words in windows of WINDOW words that stand twice or more in the text."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    a = np.array(ids, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += a[k : k + n] * _odd[k]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    suspects = np.zeros(n, bool)
    suspects[order[1:][same]] = True
    suspects[order[:-1][same]] = True
    windows: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(suspects).tolist():  # equal hashes are compared in full
        windows.setdefault(tuple(ids[i : i + WINDOW]), []).append(i)
    edge = np.zeros(len(ids) + 1, np.int64)
    for at in windows.values():
        if len(at) > 1:
            edge[at] += 1
            edge[np.array(at) + WINDOW] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five rule statistics, and what the forest looks at: each of them, as a
    ratio or a logarithm, and three ratios more.
    """
    words = text.encode().split()  # blanks here are ASCII's alone
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += bool(line.encode().split())
        else:
            seen.add(line)
    repeat = repeated_words(ids)
    upper = sum(1 for a, b in zip(text, text.lower()) if a != b)
    marks = text.count("!") + text.count("?")
    w, c = max(n, 1), max(chars, 1)
    # How evenly the most frequent word stands out from the rest.
    top = max(Counter(ids).values(), default=0) / w
    return [n, chars, symbols, dup, repeat], [chars / w, symbols / w, upper / c, marks / w, top, log1p(n), log1p(dup + repeat)]


def base_failed(stats: list[int]) -> bool:
    return stats[0] < MIN_WORDS or 100 * stats[4] > MAX_REPEAT_PERCENT * stats[0]


def _path_norm(n: int) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


class IsolationForest:
    """Trees of random splits as flat arrays; the score is 2^(-mean path / norm)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.norm = max(_path_norm(min(size, len(rows))), 1e-9)
        depth = int(np.ceil(np.log2(max(min(size, len(rows)), 2))))
        self.trees = []
        for _ in range(trees):
            own = rows[rng.choice(len(rows), min(size, len(rows)), replace=False)]
            feature, cut, child, path = [], [], [], []

            def grow(part, level):
                at = len(feature)
                feature.append(-1), cut.append(0.0), child.append((at, at)), path.append(level + _path_norm(len(part)))
                spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
                if level < depth and len(spread):
                    f = int(rng.choice(spread))
                    t = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                    below = part[:, f] <= t
                    feature[at], cut[at] = f, t
                    child[at] = (grow(part[below], level + 1), grow(part[~below], level + 1))
                return at

            grow(own, 0)
            self.trees.append((np.array(feature), np.array(cut), np.array(child), np.array(path)))
        self.depth = depth

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        everyone = np.arange(len(rows))
        for feature, cut, child, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = rows[everyone, np.maximum(f, 0)] > cut[at]
                at = child[at, right.astype(np.int64)]
            total += path[at]
        return 2 ** (-total / max(len(self.trees), 1) / self.norm)


class QualityModel:
    """Forests and the level of their mean score above which a document is rejected.

    The k-th forest grows on the rows given that are not of the fold k; the threshold
    is calibrated on counts of levels. Until then nothing is rejected.
    """

    def __init__(self, ratios: np.ndarray, good: np.ndarray, folds: np.ndarray | None = None):
        self.forests, self.threshold = [], np.inf
        for k in range(FOLDS if folds is not None else 0):
            clean, junk = ratios[(folds != k) & (good == 1)], ratios[(folds != k) & (good == 0)]
            own = np.concatenate([clean, junk[: max(1, int(CONTAMINATION * len(clean)))]])
            if len(own) < 2:
                self.forests = []
                return
            self.forests.append(IsolationForest(own, TREES // FOLDS, seed=7 + k))

    def levels(self, ratios: np.ndarray, folds: np.ndarray | None = None) -> np.ndarray:
        """The mean of all forests' scores, or of rows of known folds that of the
        forest which has not seen them, in steps."""
        score = np.array([f.score(ratios) for f in self.forests])
        return np.floor((score.mean(0) if folds is None else score[folds, np.arange(len(ratios))]) * STEPS).astype(np.int64)

    def calibrate(self, cuts: np.ndarray, clean: np.ndarray, junk: np.ndarray) -> None:
        """By the counts of good and bad rows at each level, the levels rising."""
        if not clean.sum() or not junk.sum():
            return
        lost = 1 - np.cumsum(clean) / clean.sum()
        missed = np.cumsum(junk) / junk.sum()
        cost = np.where(lost <= CLEAN_LOSS, CLEAN_WEIGHT * lost + missed, np.inf)
        best = len(cuts) - 1 - int(np.argmin(cost[::-1]))
        if missed[best] < 1:
            self.threshold = float((cuts[best] + cuts[best + 1]) / 2)

    def rejects(self, ratios: np.ndarray) -> np.ndarray:
        if not self.forests or not len(ratios):
            return np.zeros(len(ratios), bool)
        return self.levels(ratios) > self.threshold


def _judged(texts: list, model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [statistics(t or "") for t in texts]
    stats = np.array([s for s, _ in found], np.int64).reshape(-1, len(STATISTICS))
    failed = np.array([base_failed(s) for s, _ in found], bool)
    kept = ~failed
    rest = np.flatnonzero(kept)
    if len(rest):
        kept[rest] = ~model.rejects(np.array([found[i][1] for i in rest]))
    return stats, failed, kept


def labelled_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """i, y, r (what the forest looks at) of every labelled row that passes the base rules.

    An id with two labels counts as good if one says so; of several documents of
    an id the one of the smallest r counts. Null labels and ids, and ids without a
    document, are left out. Texts are read where they lie: r alone is shuffled.
    """
    rows = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1))
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches):
        for b in batches:
            found = [statistics(t or "") for t in b.column(1).to_pylist()]
            passed = np.array([not base_failed(s) for s, _ in found], bool)
            keys = b.column(0).filter(pa.array(passed, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([r for (_, r), ok in zip(found, passed) if ok], pa.list_(pa.float64()))], ["i", "r"])

    measured = own.mapInArrow(run, f"i {own.schema['i'].dataType.simpleString()}, r array<double>")
    return measured.join(rows.groupBy("i").agg(F.max("y").alias("y")), "i").groupBy("i", "y").agg(F.min("r").alias("r"))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on all labelled rows that pass the base rules (``labelled_ratios``).

    A hash of the id deals them out to FOLDS folds. The trees' rows are drawn by
    hash from all of them; no more come to the driver than all trees together can
    hold. Every row counts for the threshold: tasks score it by the forest that did
    without its fold, and counts of levels come to the driver, STEPS at most for
    each label. Without rows of both labels the forests reject nothing.
    """
    # Another hash than that of hashed_sample, so that folds are drawn from evenly.
    fold = F.pmod(F.xxhash64(F.lit("fold"), "i"), F.lit(FOLDS)).cast("int")
    rows = materialize(labelled_ratios(docs, labels, id_col, text_col, label_col).withColumn("fold", fold))
    width = len(statistics("")[1])

    def drawn(y: int, most: int) -> list:
        return sorted((r["r"], y, r["fold"]) for r in hashed_sample(rows.where(F.col("y") == y), "i", most).select("r", "fold").collect())

    good = drawn(1, TREES * TREE_ROWS)
    own = good + drawn(0, max(FOLDS, int(CONTAMINATION * len(good))))
    model = QualityModel(np.array([r for r, _, _ in own]).reshape(-1, width), np.array([y for _, y, _ in own]), np.array([f for _, _, f in own]))
    if not model.forests:
        return model
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        for b in batches:
            level = shipped.value.levels(np.array(b.column(2).to_pylist()).reshape(-1, width), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(level), b.column(0)], ["level", "y"])

    levels = rows.select("y", "fold", "r").mapInArrow(run, "level long, y int")
    of = lambda y: F.count(F.when(F.col("y") == y, True))
    counts = sorted(tuple(r) for r in levels.groupBy("level").agg(of(1), of(0)).collect())
    model.calibrate(*np.array(counts, np.int64).reshape(-1, 3).T)
    return model


def quality_rules(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the five statistics, base_failed and kept of every row.

    A null text has no words and fails the base rules, as an empty one does.
    Null and repeated ids keep their rows; an empty table gives no rows; other
    columns play no part. Texts of any length are judged whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        for b in batches:
            stats, failed, kept = _judged(b.column(1).to_pylist(), shipped.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(stats[:, k]) for k in range(len(STATISTICS))), pa.array(failed), pa.array(kept)], ["_id", *STATISTICS, "base_failed", "kept"])

    schema = "_id {}, {}, base_failed boolean, kept boolean".format(id_type, ", ".join(f"{s} long" for s in STATISTICS))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, every column as it was."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), SLICE_ROWS):  # what goes back is held a slice at a time
                part = b.slice(lo, SLICE_ROWS)
                _, _, kept = _judged(part.column(at).to_pylist(), shipped.value)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
