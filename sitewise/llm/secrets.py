"""Operator 2: secret scans, built of DataFrame functions alone.

Three base patterns find assigned secrets, access keys and hexadecimal strings.
Beside them, two first-order Markov models over characters, one of random
strings and one of ordinary identifiers, are compared: a run of key characters
whose log-likelihood ratio favours the random model is a span too. Both models
are trained from labelled samples and are a table of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample

#: The base patterns, in the order in which kinds are listed, with
#: the group whose length counts and the least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex", "random"]
#: Longer runs alone can reach the least length, so these two say it outright:
#: a run's matches start at its first character and end at its last.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: A run is random if the ratio is so large in all, and so large by character.
LEAST_TOTAL = 12.0
LEAST_MEAN = 0.45
#: A rule of one repeated character is like neither sample.
LEAST_DISTINCT = 8
#: The labelled samples: random strings of digests of the first integers, and
#: identifiers of words of so many documents by a hash of the id.
RANDOM_SAMPLES = 3000
IDENTIFIER_DOCUMENTS = 400
IDENTIFIER_CHARS = 20_000
SAMPLE_TASKS = 16

#: Matches whose offsets are added up in one go, and code points of a piece of
#: text that spans are looked up in or cut out of.
BLOCK = 256
PIECE = 4096


def _found(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1, keep: bool = False) -> Column:
    """All leftmost matches as spans: the gaps between them give the offsets.

    Offsets add up in blocks of matches, so that many matches cost no more each
    than few. With ``keep`` a span has its match too, as s.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    part = lambda gap, own: F.struct(F.length(gap).alias("gap"), F.length(own["whole"]).alias("size"), F.length(own["value"]).alias("value"), own["whole"].alias("s"))
    matches = F.zip_with(F.split(text, pattern, -1), F.arrays_zip(whole.alias("whole"), value.alias("value")), part)
    matches = F.filter(matches, lambda m: m["size"].isNotNull())  # the last gap has no match behind it
    n_blocks = lambda m: F.ceil(F.size(m) / F.lit(BLOCK)).cast("int")
    blocks = lambda m: F.transform(F.sequence(F.lit(0), n_blocks(m) - 1), lambda i: F.slice(m, i * BLOCK + 1, F.lit(BLOCK)))
    fields = ["start", "kind", "end"] + ["s"] * keep
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int" + ",s:string" * keep + ">>)")

    def one(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + m["size"]
        made = {"start": start, "kind": F.lit(kind), "end": end, "s": m["s"]}
        span = F.array(F.struct(*[made[f].alias(f) for f in fields]))
        return F.struct(end.alias("at"), F.when(m["value"] >= least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def block(state: Column, part: Column) -> Column:
        size = F.aggregate(part, F.lit(0), lambda n, m: n + m["gap"] + m["size"])
        return F.struct((state["at"] + size).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def spans(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
        starts = F.aggregate(parts, begin, block, lambda s: s["starts"])
        own = F.zip_with(parts, starts, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), empty.alias("spans")), one, lambda s: s["spans"]))
        return F.flatten(own)

    # One element, so that each step is computed once for a text.
    chain = F.transform(F.array(matches), lambda m: F.when(F.size(m) > 0, blocks(m)))
    return F.when(text.rlike(pattern), F.get(F.transform(chain, spans), F.lit(0))).otherwise(empty)


def labelled_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training sample: columns random (boolean) and s.

    Random strings are digests in base 64, in hexadecimal, and in capitals and
    digits. Identifiers are one to five neighbouring words of documents, joined
    by nothing, an underscore or a hyphen.
    """
    spark = docs.sparkSession
    n = F.col("id").cast("string")
    digest = F.sha2(n, 256)
    forms = F.array(
        F.base64(F.unhex(digest)), F.substring(digest, 1, 40), F.upper(F.substring(digest, 1, 40)),
        F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")), F.translate(F.base64(F.unhex(digest)), "+/", "-_"),
    )
    made = spark.range(RANDOM_SAMPLES).select(F.lit(True).alias("random"), F.explode(forms).alias("s"))
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    texts = hashed_sample(own, "i", IDENTIFIER_DOCUMENTS).where(F.length("t") <= IDENTIFIER_CHARS).repartition(SAMPLE_TASKS)
    words = F.regexp_extract_all("t", F.lit("[A-Za-z]+"), F.lit(0))
    grouped = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.struct((F.pmod(i, F.lit(5)) + 1).alias("n"), F.slice(F.col("w"), i, F.pmod(i, F.lit(5)) + 1).alias("p")))
    joined = texts.select(words.alias("w")).where(F.size("w") > 0).select(F.explode(grouped).alias("g")).select(F.array_join("g.p", "").alias("a"), F.array_join("g.p", "_").alias("b"), F.array_join("g.p", "-").alias("c"))
    plain = joined.select(F.explode(F.array("a", "a", "b", "c", F.initcap("a"), F.upper("a"))).alias("s")).select(F.lit(False).alias("random"), "s")
    return made.unionByName(plain)


def _places(text: Column) -> Column:
    """The place in ALPHABET of each character, counted from 1; 0 of any other."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def markov_ratio(samples: DataFrame) -> list[float]:
    """log(P_random / P_identifier) of each pair of neighbouring characters.

    The list has a fixed size; entry a * (n + 1) + b is that of the a-th and
    b-th character of ALPHABET, 0 standing for any other. Counts are smoothed,
    so an empty sample gives a ratio of 0 everywhere.
    """
    n = len(ALPHABET) + 1
    rows = samples.where(F.length("s") > 1).select("random", _places(F.col("s")).alias("x"))
    pairs = F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counted = rows.select("random", F.explode(pairs).alias("p")).groupBy("random", "p.a", "p.b").agg(F.count("*").alias("n")).collect()  # alphabet squared, twice, at most
    count = {True: [0.5] * (n * n), False: [0.5] * (n * n)}
    for r in counted:
        count[r["random"]][r["a"] * n + r["b"]] += r["n"]
    rows = {k: [sum(c[a * n : a * n + n]) for a in range(n)] for k, c in count.items()}
    return [math.log(count[True][i] / rows[True][i // n]) - math.log(count[False][i] / rows[False][i // n]) for i in range(n * n)]


def _likely(run: Column, ratio: list[float]) -> Column:
    """Whether a run of key characters is rather a random string."""
    table = F.split(F.lit(",".join(str(round(1000 * x)) for x in ratio)), ",").cast("array<int>")  # thousandths of a nat
    n = len(ALPHABET) + 1

    def step(state: Column, at: Column) -> Column:
        gain = F.when(state["last"] >= 0, F.element_at(table, (state["last"] * n + at + 1).cast("int"))).otherwise(0)
        return F.struct(at.alias("last"), (state["total"] + gain).alias("total"))

    begin = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("total"))
    total = F.aggregate(_places(run), begin, step, lambda s: s["total"])
    varied = F.size(F.array_distinct(F.split(run, ""))) >= LEAST_DISTINCT
    long = F.length(run) - 1
    passes = F.transform(F.array(total), lambda t: (t >= int(1000 * LEAST_TOTAL)) & (t >= int(1000 * LEAST_MEAN) * long))
    return varied & F.get(passes, F.lit(0))


def _with_spans(rows: DataFrame, text: str, ratio: list[float]) -> DataFrame:
    """``rows`` with _spans: base spans, and random runs that touch none of them.

    The other names used here start with an underscore, as do those of ``rows``.
    """
    t = F.col(text)
    rows = rows.withColumns({"_assign": _found(t, ASSIGN, 0, 2, ASSIGN_LEAST), "_access": _found(t, ACCESS, 1), "_hex": _found(t, HEX, 2), "_runs": _found(t, RUN, 3, keep=True)})
    # A run holds the whole of any access key or hexadecimal string it touches.
    # Assigned secrets are looked up by the pieces of the text they touch.
    rows = rows.withColumn("_runs", F.filter("_runs", lambda r: ~r["s"].rlike(ACCESS) & ~r["s"].rlike(HEX)))
    touching = lambda i: F.filter("_assign", lambda a: (a["start"] < (i + 1) * PIECE) & (a["end"] > i * PIECE))
    last = F.ceil(F.element_at("_assign", -1)["end"] / F.lit(PIECE)).cast("int")
    pieces = F.when((F.size("_assign") > 0) & (F.size("_runs") > 0), F.transform(F.sequence(F.lit(0), last - 1), touching))
    rows = rows.withColumn("_pieces", pieces)

    def apart(r: Column) -> Column:
        first = F.floor(r["start"] / F.lit(PIECE)).cast("int")
        near = F.flatten(F.slice("_pieces", first + 1, F.ceil(r["end"] / F.lit(PIECE)).cast("int") - first))
        return ~F.exists(near, lambda a: (a["start"] < r["end"]) & (r["start"] < a["end"]))

    free = F.when(F.col("_pieces").isNull(), F.col("_runs")).otherwise(F.filter("_runs", apart))
    added = F.transform(F.filter(free, lambda r: _likely(r["s"], ratio)), lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))
    found = F.when((F.size("_runs") == 0) & (F.size("_assign") + F.size("_access") + F.size("_hex") == 0), F.col("_hex")).otherwise(F.array_sort(F.concat("_assign", "_access", "_hex", added)))
    return rows.withColumn("_spans", found).drop("_assign", "_access", "_hex", "_runs", "_pieces")


def scan_secrets(docs: DataFrame, ratio: list[float], id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The id and found: spans (start, kind, end), sorted by start, kind, end.

    kind is a place in KINDS, offsets are code points and ends are exclusive. A
    null or empty text has no spans. Null and repeated ids keep their rows; an
    empty table gives no rows; other columns play no part. A text's work grows
    with its length, however long its runs and however many its matches.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = _with_spans(rows, "_text", ratio)
    return rows.select(F.col("_id").alias(id_col), *[F.col("_text").alias(text_col)] * keep_text, F.col("_spans").alias("found"))


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; spans that overlap share one mark.

    ``spans`` is sorted by start.
    """
    n_blocks = F.ceil(F.size(spans) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.slice(spans, i * BLOCK + 1, F.lit(BLOCK)))
    furthest = lambda part, least: F.aggregate(part, least, lambda at, s: F.greatest(at, s["end"]))
    none = F.expr("cast(array() as array<int>)")
    gaps = F.expr("cast(array() as array<struct<a:int,z:int>>)")

    def reach(state: Column, part: Column) -> Column:
        return F.struct(furthest(part, state["at"]).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def gap(state: Column, s: Column) -> Column:
        own = F.array(F.struct(state["at"].alias("a"), s["start"].alias("z")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], F.concat(state["gaps"], own)).otherwise(state["gaps"]).alias("gaps"))

    def kept(parts: Column) -> Column:
        starts = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("starts")), reach, lambda s: s["starts"])
        return F.flatten(F.zip_with(parts, starts, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), gaps.alias("gaps")), gap, lambda s: s["gaps"])))

    def cut(pieces: Column, g: Column) -> Column:
        first = F.floor(g["a"] / F.lit(PIECE)).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.ceil(g["z"] / F.lit(PIECE)).cast("int") - first), "")
        return F.when(g["z"] > g["a"], F.substring(near, g["a"] - first * PIECE + 1, g["z"] - g["a"])).otherwise("")

    # Arrays of one element, so that what the inner functions use is computed once.
    shown = F.transform(F.array(blocks), kept)
    pieces = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    parts = F.get(F.zip_with(pieces, shown, lambda ps, gs: F.transform(gs, lambda g: cut(ps, g))), F.lit(0))
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    done = F.array_join(F.concat(parts, F.array(F.substring(text, end + 1, F.length(text)))), mark)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame, ratio: list[float], text_col: str = "text") -> DataFrame:
    """``docs`` with its columns as they were, but for secrets in the text.

    A null text stays null. A column n_chars, if there is one, follows the text.
    Columns of any name keep their values.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = _with_spans(rows.withColumn("_text", F.coalesce(F.col("_row").getField(text_col), F.lit(""))), "_text", ratio)
    own = lambda c: F.col("_row").getField(c)
    rows = rows.withColumn("_new", F.when(F.size("_spans") > 0, redacted(F.col("_text"), F.col("_spans"))).otherwise(own(text_col)))
    cols = {c: own(c) for c in docs.columns} | {text_col: F.col("_new")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.size("_spans") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return rows.select(*[x.alias(c) for c, x in cols.items()])
