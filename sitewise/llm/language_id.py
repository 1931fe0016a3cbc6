"""Operator 7: language identification by a linear-chain conditional random field.

Each word gets a label by its affixes, character n-grams and membership in
lexicons learned from the training texts, and by learned transitions, so that
code-switched text is labelled span by span. Forward-backward marginals, added
over the words of a text, give its main language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, crc_fold
from .crf import NUMERALS, ChainModel, ChainScorer, Words

#: The bounded sample the model is fitted on: texts of each language, by a hash
#: of the id, texts in all, the longest text among them, and languages: the
#: commonest, as a label takes a column of weights. Rarer ones are not learned.
SAMPLE_PER_LANGUAGE = 300
SAMPLE_TEXTS = 12_000
SAMPLE_LANGUAGES = 256
SAMPLE_CHARS = 8000
#: A word is in a language's lexicon if it stands in so many sampled texts and
#: so large a share of them is in that language.
LEXICON_DOCS = 4
LEXICON_SHARE = 0.9
LEXICON_WORDS = 20_000
WORDS_AT_ONCE = 300_000
UNDETERMINED = "und"

#: Runs of letters alone: numerals such as fractions are no words.
_words = Words(r"[^\W\d_]", NUMERALS)
words_of = _words.words


def _lexicons(texts: list[list[str]], tags: list[int], k: int) -> dict[str, list[int]]:
    docs = [Counter() for _ in range(k)]
    for words, y in zip(texts, tags):
        docs[y].update(set(words))
    total = Counter()
    for c in docs:
        total.update(c)
    out: dict[str, list[int]] = {}
    for y in range(k):
        kept = [w for w, n in docs[y].items() if n >= LEXICON_DOCS and n >= LEXICON_SHARE * total[w]]
        for w in sorted(kept, key=lambda w: (-docs[y][w], w))[:LEXICON_WORDS]:
            out.setdefault(w, []).append(y)
    return out


def train_language_model(texts: list[str], langs: list[str]) -> ChainModel:
    """A field whose labels are the sorted languages of the sample."""
    labels = sorted(set(langs))
    words = [words_of(t) for t in texts]
    tags = [labels.index(x) for x in langs]
    model = ChainModel(labels, _lexicons(words, tags, len(labels)))
    return model.fit(words, [np.full(len(w), y) for w, y in zip(words, tags)], rounds=12, rate=0.5)


def fit_languages(docs: DataFrame, fold: int = 2, folds: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ChainModel | None:
    """Fit on a bounded sample outside the held-out fold; None if it is empty.

    Rows with a null id, text or language take no part; of more than
    SAMPLE_LANGUAGES languages the commonest are learned.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(F.col("i").isNotNull() & F.col("l").isNotNull() & (crc_fold("i", folds) != fold))
    rows = rows.where(F.length("t").between(1, SAMPLE_CHARS))
    langs = {r["l"]: r["count"] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(SAMPLE_LANGUAGES).collect()}
    if not langs:
        return None
    # Half again as many as are asked for, by hash; the smallest hashes stay.
    span, each = 1 << 30, max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS // len(langs)))
    bound = F.lit(0)
    for lang, n in sorted(langs.items()):
        bound = F.when(F.col("l") == lang, min(span, int(1.5 * each / n * span) + 1)).otherwise(bound)
    picked = rows.withColumn("h", F.pmod(F.xxhash64("i"), F.lit(span))).where(F.col("h") < bound)
    found = picked.limit(4 * each * len(langs)).select("l", "h", "i", "t").collect()
    found.sort(key=lambda r: (r["l"], r["h"], str(r["i"]), r["t"]))
    kept, have = [], Counter()
    for r in found:
        have[r["l"]] += 1
        if have[r["l"]] <= each:
            kept.append(r)
    return train_language_model([r["t"] for r in kept], [r["l"] for r in kept])


def label_languages(docs: DataFrame, model: ChainModel | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """The id, lang_pred, score and, if asked for, spans (start, end, lang).

    score is the mean marginal of lang_pred over the words; ties go to the
    smaller language code. Neighbouring words with one label make a span, in
    code points of the text. A null text, a text without a letter, and any text
    if nothing was learned give "und" with score 0 and no spans. Null and
    repeated ids keep their rows; an empty table gives no rows; other columns
    play no part. Texts of any length are labelled whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches):
        model = shipped.value
        scorer = ChainScorer(model) if model else None
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            pred, score, found = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            for lo, hi in batches_of([len(texts[i]) // 6 for i in order] if model else [], WORDS_AT_ONCE):
                own = order[lo:hi]
                for i, m in zip(own, scorer.marginals([words_of(texts[i]) for i in own])):
                    if len(m):
                        mean = m.mean(0)
                        best = int(mean.argmax())
                        pred[i], score[i] = model.labels[best], float(min(mean[best], 1.0))
                        if spans:
                            found[i] = _spans(texts[i], m.argmax(1), model.labels)
            cols = [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())] + [pa.array(found, pa.list_(kind))] * spans
            yield pa.RecordBatch.from_arrays(cols, ["_id", "lang_pred", "score"] + ["spans"] * spans)

    schema = f"_id {id_type}, lang_pred string, score double" + ", spans array<struct<start:int,end:int,lang:string>>" * spans
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _spans(text: str, best: np.ndarray, labels: list[str]) -> list[dict]:
    at = _words.places(text)
    cuts = np.flatnonzero(np.diff(best)) + 1
    return [{"start": at[a][0], "end": at[z - 1][1], "lang": labels[best[a]]} for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(best)])]
