"""Operator 12 against brute force, with hostile texts and small chunks."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from sitewise.llm import collocations as co

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_n=5, least=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        cand = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        inner = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        scored = []
        for p, a in cand.items():
            if inner[p] >= a:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, s[2].decode(), -s[1], s[3], s[4], n[lang], -s[0]) for i, s in enumerate(sorted(scored)[:top])]
    return Counter(out)


def rows_of(seed, n=300):
    rng = random.Random(seed)
    words = "the The of SET a b new york city É é 漢字 😀 x\x00y \x1c \xa0 | don't 12".split(" ")
    glue = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", ";", "?!"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(60)))) for _ in range(n)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", " \t\n"), ("en", "one two three four five six " * 300), ("xx", "solo")]
    return rows + [("en", "same copy of a passage, word for word")] * 40


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, seed, small, monkeypatch):
    if small:  # every way that chunks, splits and overflow can go
        for name, value in {"WORDS_AT_ONCE": 50, "REMEMBERED": 9, "RANGE_ROWS": 40, "RANGE_MOST": 30, "SHORT_CODES": 5}.items():
            monkeypatch.setattr(co, name, value)
    rows = rows_of(seed)
    df = spark.createDataFrame([(i, *r, 1, "k", 2.0) for i, r in enumerate(rows)], "doc_id long, lang string, text string, n int, key string, total double").repartition(3)
    got = Counter(tuple(r) for r in co.collocations(df, least=3, top=150).collect())
    assert got == brute(rows, least=3, top=150)
    assert len(got) > 300


def test_no_rows_and_other_lengths(spark):
    kind = "lang string, text string"
    assert co.collocations(spark.createDataFrame([], kind)).count() == 0
    assert co.collocations(spark.createDataFrame([("en", "a b")], kind)).count() == 0
    rows = [("en", "p q r s t u " * 30), ("en", "q r. p q")]
    for max_n in (2, 3, 7):
        got = Counter(tuple(r) for r in co.collocations(spark.createDataFrame(rows, kind), max_n=max_n, least=5).collect())
        assert got == brute(rows, max_n, 5) and got


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("word " * 50 + "x" * 300 + "\n" + "a,b  " * 40).encode()
    whole = [w for t in co._tokens([text, b"", b"end"]) for w in t if w]
    monkeypatch.setattr(co, "CHUNK_BYTES", 64)
    parts = list(co._tokens([text, b"", b"end"]))
    assert len(parts) > 5 and [w for t in parts for w in t if w] == whole


def test_scores_beyond_64_bits(spark):
    """The arithmetic of a score is exact where its products pass 64 bits."""
    big = 10**12 + 7
    row = spark.sql(f"SELECT (cast(1000 as decimal(4,0)) * (cast({big}L as decimal(18,0)) * cast({big * 9}L as decimal(18,0)))) div (cast({big - 5}L as decimal(18,0)) * cast({big - 4}L as decimal(18,0))) AS s").first()
    assert row["s"] == 1000 * big * big * 9 // ((big - 5) * (big - 4))
