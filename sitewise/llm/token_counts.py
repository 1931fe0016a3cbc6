"""Operator 1: token counts without a shuffle of pre-tokens.

Two tiers. A compact table of the most frequent pre-tokens and their token
counts is broadcast; its size is bounded by ``table_entries``. A pre-token that
is not in it goes through the worker's own cache, and only the cache's misses
reach the tokenizer. Every document is counted where it is read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the word-end BPE.
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"

#: Documents that warm the first tier. It bounds work only: a pre-token missing
#: from the table is counted exactly through the second tier.
WARM_DOCUMENTS = 2000
TABLE_ENTRIES = 65_536
CACHE_ENTRIES = 250_000


class _Lengths(dict):
    """Second tier: pre-token to token count, filled on demand and bounded."""

    def __init__(self, counter: "PretokenCounter"):
        super().__init__()
        self._encode = counter.tokenizer.encode
        self._first = counter.first
        self._older: dict[str, int] = {}

    def __missing__(self, pretoken: str) -> int:
        n = self._first.get(pretoken) or self._older.get(pretoken)
        if n is None:
            n = len(self._encode(pretoken, add_special_tokens=False).ids)
        if len(self) >= CACHE_ENTRIES:
            self._older = dict(self)
            self.clear()
        self[pretoken] = n
        return n


class PretokenCounter:
    """Counts tokens of whole texts as the tokenizer file's library gives them."""

    def __init__(self, path: str, first: dict[str, int] | None = None):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.first = first or {}
        self._find = regex.compile(_PRETOKEN).findall
        added = self.tokenizer.get_added_tokens_decoder().values()
        names = sorted((t.content for t in added), key=len, reverse=True)
        self._specials = names
        self._split = regex.compile("|".join(regex.escape(n) for n in names)).split if names else None
        self.lengths = _Lengths(self)

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special strings stand in it."""
        if self._split and any(s in text for s in self._specials):
            parts = self._split(text)
            found = [t for p in parts for t in self._find(self._normal(p))]
            return found, len(parts) - 1
        return self._find(self._normal(text)), 0

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def count(self, text: str) -> int:
        found, special = self.pretokens(text)
        return sum(map(self.lengths.__getitem__, found)) + special


def frequent_pretokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", entries: int = TABLE_ENTRIES, warm: int = WARM_DOCUMENTS) -> dict[str, int]:
    """The first tier: at most ``entries`` pre-tokens of about ``warm`` documents.

    The documents are drawn by a hash of the id and tallied where they are read;
    of a repeated id no task takes more than ``warm``.
    """
    total, span = docs.count(), 1 << 30
    if not total:
        return {}
    drawn = docs.where(F.pmod(F.xxhash64(id_col), F.lit(span)) < min(span, 1 + int(span * warm / total)))

    def tally(batches):
        counter, seen, left = PretokenCounter(tokenizer_path), Counter(), warm
        for b in batches:
            for text in b.column(0).slice(0, left).to_pylist():
                seen.update(counter.pretokens(text or "")[0])
            left -= min(left, len(b))
            if len(seen) > 4 * entries:
                seen = Counter(dict(seen.most_common(2 * entries)))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])

    parts = drawn.select(F.col(text_col).alias("text")).mapInArrow(tally, "pretoken string, n long")
    top = parts.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(entries).collect()
    counter = PretokenCounter(tokenizer_path)
    words = [r["pretoken"] for r in top]
    encoded = counter.tokenizer.encode_batch(words, add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(words, encoded)}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Columns: the id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null texts count as empty (0, 0, false). Rows with a null or repeated id
    each keep their own row; other columns of ``docs`` play no part. An empty
    table gives an empty result. Texts of any length are counted whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    first = frequent_pretokens(docs, tokenizer_path, id_col, text_col)
    # The compact form: one joined string and one byte per length.
    words = list(first)
    shipped = docs.sparkSession.sparkContext.broadcast(("\n".join(words), bytes(min(first[w], 255) for w in words)))

    def run(batches):
        joined, lengths = shipped.value
        table = dict(zip(joined.split("\n"), lengths)) if joined else {}
        counter = PretokenCounter(tokenizer_path, {w: n for w, n in table.items() if n < 255})
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
