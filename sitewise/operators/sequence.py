"""Operators along a sequence: smoothing, runs, alignments, chain sequences."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import residue_to_letter
from .ranks import running

GAP = "-"
#: Positions that are smoothed together.
CHUNK = 1024
#: Remains of a text (with few characters taken out) by which it meets others at
#: most, and texts whose remains are made together.
VARIANTS = 600
TEXTS_AT_ONCE = 1000


def gaussian_smooth(df: DataFrame, keys: Sequence[str], pos: str, value: str, sigma: float = 5.0, truncate: float = 4.0) -> DataFrame:
    """Adds smooth: a Gaussian weighted mean around each position, 0 to n-1.

    Beyond an end the sequence is mirrored with the end value repeated. Sequences
    are smoothed in chunks of CHUNK positions with their surroundings, so a value
    is copied only near the ends of a chunk.
    """
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights)
    n = df.groupBy(*keys).agg(F.count("*").cast("long").alias("_n"))
    # A value stands at its own position and at its mirror images beyond the ends,
    # in the chunk of each and in the one beside it, if that is near.
    at, twice = F.col(pos).cast("long"), 2 * F.col("_n")
    rounds = F.sequence(-(F.lit(radius) / twice).cast("long") - 1, (F.lit(radius) / twice).cast("long") + 1)
    images = F.flatten(F.transform(rounds, lambda k: F.array(k * twice + at, k * twice - 1 - at)))
    images = F.filter(images, lambda q: (q >= -radius) & (q < F.col("_n") + radius))
    inner = (at >= radius) & (at < F.col("_n") - radius)
    placed = df.join(n, list(keys)).withColumn("_q", F.explode(F.when(inner, F.array(at)).otherwise(images)))
    chunk = lambda q: F.floor(q / CHUNK)
    chunks = F.sequence(F.greatest(chunk(F.col("_q") - radius), F.lit(0)), F.least(chunk(F.col("_q") + radius), chunk(F.col("_n") - 1)))
    placed = placed.withColumn("_c", F.explode(chunks))
    w = Window.partitionBy(*keys, "_c").orderBy("_q")
    near = [f"_w{k}" for k in range(2 * radius + 1)]
    placed = placed.withColumns({c: F.lag(F.col(value), radius - k).over(w) for k, c in enumerate(near)})
    smooth = sum((F.coalesce(F.col(c) * (x / total), F.lit(0.0)) for c, x in zip(near, weights)), F.lit(0.0))
    own = placed.where((F.col("_q") == at) & (F.col("_c") == chunk(at)))
    return own.withColumn("smooth", F.when(F.coalesce(*near).isNotNull(), smooth)).select(*df.columns, "smooth")


def high_runs(df: DataFrame, keys: Sequence[str], pos: str, value: str, least: float = 70.0, longer_than: int = 50) -> DataFrame:
    """Rows in runs of consecutive positions of at least ``least`` that are longer than a number; run_start, run_length added."""
    high = df.where(F.col(value) >= least)
    island = F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    marked = high.withColumn("_island", island)
    w = Window.partitionBy(*keys, "_island")
    marked = marked.withColumn("run_start", F.min(pos).over(w)).withColumn("run_length", F.count("*").over(w))
    return marked.where(F.col("run_length") > longer_than).drop("_island")


def alignment_cells(df: DataFrame, keys: Sequence[str], seq: str, width: Column | None = None) -> DataFrame:
    """One row per character: keys, col (from 0), ch; short rows end in gaps up to
    ``width``. Null and empty rows have no cells."""
    own = F.split(F.col(seq), "")
    if width is not None:
        own = F.slice(F.concat(own, F.array_repeat(F.lit(GAP), F.greatest(width - F.length(seq), F.lit(0)))), F.lit(1), width)
    return df.where(F.length(seq) > 0).select(*keys, F.posexplode(own).alias("col", "ch"))


def column_entropy(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shannon entropy (bits) and conservation 1 / (1 + H) of each column; gaps don't count, an all-gap column has entropy 0."""
    return entropy_of(cells.where(F.col("ch").isNotNull()).groupBy(*keys, "col", "ch").agg(F.count("*").alias("n")), keys)


def entropy_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same of counted characters: keys, col, ch, n."""
    counts = counts.withColumn("n", F.when(F.col("ch") != GAP, F.col("n")))
    sums = counts.groupBy(*keys, "col").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    h = F.greatest(F.coalesce(F.log2(F.col("t").cast("double")) - F.col("s") / F.col("t"), F.lit(0.0)), F.lit(0.0))
    return sums.select(*keys, "col", h.alias("entropy")).withColumn("conservation", 1 / (F.col("entropy") + 1))


def ungapped_positions(cells: DataFrame, row: Sequence[str]) -> DataFrame:
    """Adds seq_pos: the position without gaps, -1 on a gap."""
    w = Window.partitionBy(*row).orderBy("col")
    gaps = F.sum((F.col("ch") == GAP).cast("long")).over(w)
    return cells.withColumn("seq_pos", F.when(F.col("ch") == GAP, F.lit(-1).cast("long")).otherwise(F.col("col") - gaps))


def sequence_positions(cells: DataFrame, row: Sequence[str]) -> DataFrame:
    """Adds seq_pos: the column less the gaps and X's strictly before it."""
    w = Window.partitionBy(*row).orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    skipped = F.coalesce(F.sum(F.col("ch").isin(GAP, "X").cast("long")).over(w), F.lit(0))
    return cells.withColumn("seq_pos", F.col("col") - skipped)


def aligned_columns(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns in which no row has a gap."""
    return cells.groupBy(*keys, "col").agg(F.bool_and(F.col("ch") != GAP).alias("full")).where("full").drop("full")


def domain_bounds(cells: DataFrame, row: Sequence[str]) -> DataFrame:
    """First and last column of each row that is no gap."""
    return cells.where(F.col("ch") != GAP).groupBy(*row).agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"))


def _columns(a: Column, b: Column) -> Column:
    """The characters x, y of both rows by column; the shorter row ends in gaps."""
    gap = lambda c: F.coalesce(c, F.lit(GAP))
    chars = lambda c: F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.expr("cast(array() as array<string>)"))
    return F.zip_with(chars(a), chars(b), lambda x, y: F.struct(gap(x).alias("x"), gap(y).alias("y")))


def pair_identity(a: Column, b: Column) -> Column:
    """Share of equal characters over columns that aren't gaps in both; null without one."""
    used = F.filter(_columns(a, b), lambda c: ~((c["x"] == GAP) & (c["y"] == GAP)))
    n = F.struct(F.lit(0).alias("same"), F.lit(0).alias("all"))
    count = lambda s, c: F.struct((s["same"] + (c["x"] == c["y"]).cast("int")).alias("same"), (s["all"] + 1).alias("all"))
    return F.aggregate(used, n, count, lambda s: F.try_divide(s["same"].cast("double"), s["all"]))


def valid_pair_columns(a: Column, b: Column, letters: Sequence[str]) -> Column:
    """Columns (from 0) in which both rows have one of the letters."""
    ok = F.array(*[F.lit(x) for x in letters])
    valid = F.transform(_columns(a, b), lambda c, i: F.when(F.array_contains(ok, c["x"]) & F.array_contains(ok, c["y"]), i))
    return F.filter(valid, lambda i: i.isNotNull())


def chain_sequences(residues: DataFrame, keys: Sequence[str], order: str, resname: str = "resname", number: str = "residue") -> DataFrame:
    """Letters and residue ids of each chain in order: sequence, resids, n."""
    one = residues.select(*keys, F.col(order).alias("o"), residue_to_letter(F.col(resname)).alias("l"), F.col(number).cast("string").alias("r"))
    rows = F.array_sort(F.collect_list(F.struct("o", "l", "r")))
    grouped = one.groupBy(*keys).agg(rows.alias("rows"))
    return grouped.select(*keys, F.array_join(F.transform("rows", lambda s: s["l"]), "").alias("sequence"), F.transform("rows", lambda s: F.concat(s["l"], s["r"])).alias("resids"), F.size("rows").alias("n"))


def _grams(c: Column, n: int) -> Column:
    """The different runs of n characters of a text."""
    return F.array_distinct(F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<string>)")))


def match_records(sequences: DataFrame, records: DataFrame, key: str, record_id: str, order: str, gram: int = 4) -> DataFrame:
    """For each sequence the first record whose id contains its key, with the
    columns of both sides.

    Ids are indexed by their runs of ``gram`` characters (shorter ones too, if a
    key is shorter). A key is looked up under the run of its own that the fewest
    ids have, and what is found there is compared in full. A null key or id
    matches nothing, an empty key every id.
    """
    keys = sequences.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    sized = keys.withColumn("_size", F.least(F.length("_key"), F.lit(gram)))
    ids = records.select(F.col(record_id).alias("_rid"), F.struct(*[F.col(c) for c in records.columns]).alias("_rec"), F.col(order).alias("_ord")).where(F.col("_rid").isNotNull())
    sizes = [r["_size"] for r in sized.select("_size").distinct().collect()]  # ``gram`` + 1 numbers at most
    grams = [n for n in sizes if n] or [gram]
    listed = F.array_distinct(F.flatten(F.array(*[_grams(F.col("_rid"), n) for n in grams])))
    index = ids.select(F.explode(listed).alias("_gram"), "_rid", "_rec", "_ord")
    of_key = F.coalesce(*[F.when(F.col("_size") == n, _grams(F.col("_key"), n)) for n in grams])
    probes = sized.where("_size > 0").select("_key", F.explode(of_key).alias("_gram"))
    common = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = probes.join(common, "_gram", "left").groupBy("_key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("p"))
    chosen = rarest.where("p.n > 0").select("_key", F.col("p.gram").alias("_gram"))
    hits = chosen.join(index, "_gram").where(F.contains("_rid", "_key")).groupBy("_key").agg(F.min_by("_rec", F.struct("_ord", "_rid")).alias("_rec"))
    if 0 in sizes:
        first = ids.groupBy().agg(F.min_by("_rec", F.struct("_ord", "_rid")).alias("_rec")).where("_rec IS NOT NULL")
        hits = hits.unionByName(first.select(F.lit("").alias("_key"), "_rec"))
    return sequences.join(hits, F.col(key) == F.col("_key")).select(*[sequences[c] for c in sequences.columns], "_rec.*")


def close_records(records: DataFrame, id_col: str, seq: str, edits: int, gram: int = 3) -> DataFrame:
    """Unordered pairs a < b of records at most ``edits`` edits apart, with the
    edit distance and its share of the longer one.

    Equal texts are looked at once. Two near texts become equal if at most
    ``edits`` characters are taken out of each, so texts of at most VARIANTS such
    remains meet by a hash of each of them: how many meet does not depend on how
    common their parts are. Longer ones meet by their rarest runs. The edit
    distance decides. Null texts are near nothing.
    """
    own = records.select(F.col(id_col).alias("id"), F.col(seq).alias("s")).where(F.col("s").isNotNull()).distinct()
    # A number of tasks of its own: small texts make many times their size of remains.
    tasks = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = own.select("s").repartition(tasks, "s").distinct().withColumn("len", F.length("s"))
    longest = max((n for n in range(4 * VARIANTS) if sum(math.comb(n, k) for k in range(edits + 1)) <= VARIANTS), default=0)
    left = texts.where(F.col("len") <= longest).select("s").mapInArrow(_remains(edits), "h long, s string")
    near = left.select("h", F.col("s").alias("x")).join(left.select("h", F.col("s").alias("y")).hint("merge"), "h")
    near = near.where(F.col("x") < F.col("y")).withColumn("edits", F.levenshtein("x", "y", edits)).where(F.col("edits") >= 0).select("x", "y", "edits")
    met = _sharing_runs(texts.where(F.col("len") > longest - edits), edits, gram, longest)
    near = near.unionByName(met.withColumn("edits", F.levenshtein("x", "y", edits)).where(F.col("edits") >= 0)).distinct()
    side = lambda i, c: own.select(F.col("id").alias(f"id{i}"), F.col("s").alias(c))
    pairs = near.join(side(1, "x"), "x").join(side(2, "y"), "y")
    equal = side(1, "x").join(side(2, "y"), F.col("x") == F.col("y")).where("id1 < id2").withColumn("edits", F.lit(0))
    pairs = pairs.where("id1 <> id2").select("id1", "id2", "x", "y", "edits").unionByName(equal.select("id1", "id2", "x", "y", "edits"))
    share = F.coalesce(F.try_divide(F.col("edits").cast("double"), F.greatest(F.length("x"), F.length("y"))), F.lit(0.0))
    return pairs.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "edits", share.alias("distance"))


def _remains(edits: int):
    """Of each text the different 64-bit hashes of what is left when at most
    ``edits`` characters are taken out. Equal hashes only mean that texts meet."""
    base = 0x9E3779B97F4A7C15
    back = np.uint64(pow(base, -1, 1 << 64))

    def hashes(codes: np.ndarray) -> np.ndarray:
        n = codes.shape[1]
        powers = np.array([pow(base, i, 1 << 64) for i in range(n)], np.uint64)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        upto = np.zeros((len(codes), n + 1), np.uint64)
        np.cumsum(mixed * powers, axis=1, out=upto[:, 1:])
        found = []
        for k in range(min(edits, n) + 1):
            for out in combinations(range(n), k):
                h, shift, at = np.full(len(codes), n - k, np.uint64), np.uint64(1), 0
                for i in (*out, n):
                    h += (upto[:, i] - upto[:, at]) * shift
                    shift, at = shift * back, i + 1
                found.append(h)
        return np.sort(np.stack(found, 1), axis=1)

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            size = np.array([len(t) for t in texts])
            for n in np.unique(size).tolist():
                every = np.flatnonzero(size == n)
                for lo in range(0, len(every), TEXTS_AT_ONCE):
                    own = every[lo : lo + TEXTS_AT_ONCE]
                    codes = np.frombuffer("".join(texts[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)
                    with np.errstate(over="ignore"):
                        h = hashes(codes)
                    new = np.ones(h.shape, bool)
                    new[:, 1:] = h[:, 1:] != h[:, :-1]
                    row = pa.array(np.repeat(own, new.sum(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), b.column(0).take(row)], ["h", "s"])

    return run


def _sharing_runs(texts: DataFrame, edits: int, gram: int, longer_than: int) -> DataFrame:
    """Pairs x < y of different texts (s, len), one longer than a number, that may
    be near.

    An edit spoils ``gram`` runs of a text at most, so of any gram * edits + 1 of
    its runs (told apart by how often they came before) one is left in a near
    text: the rarest are looked up. Texts with fewer runs can be near anything
    of about their length: they meet by length. Lengths differ by ``edits`` at
    most.
    """
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.col("len") - (gram - 1), F.lit(1))), lambda i: F.substring(F.col("s"), i, F.lit(gram)))
    kept = gram * edits + 1
    long = F.col("len") - (gram - 1) >= kept
    listed = texts.where(long).select("s", "len", F.posexplode(runs).alias("_i", "_g"))
    # The second, third ... time a run stands in a text it counts as another one.
    again = Window.partitionBy("s", "_g").orderBy("_i")
    listed = listed.withColumn("_t", F.row_number().over(again)).drop("_i")
    common = listed.groupBy("_g", "_t").agg(F.count("*").alias("_n"))
    rare = Window.partitionBy("s").orderBy("_n", "_g", "_t")
    # All texts order their runs alike, so of two near ones the rarest meet.
    probes = listed.join(common, ["_g", "_t"]).withColumn("_r", F.row_number().over(rare)).where(F.col("_r") <= kept)
    side = lambda d, x: d.withColumnsRenamed({c: c + x for c in d.columns})
    one, two = (side(probes.select("s", "len", "_g", "_t"), x) for x in "12")
    met = one.join(two, (F.col("_g1") == F.col("_g2")) & (F.col("_t1") == F.col("_t2")) & (F.col("s1") < F.col("s2")) & (F.abs(F.col("len1") - F.col("len2")) <= edits))
    by_length = side(texts.withColumn("at", F.explode(F.sequence(F.col("len") - edits, F.col("len") + edits))), "2")
    few = side(texts.where(~long), "1").join(by_length, F.col("len1") == F.col("at2")).where("s1 <> s2")
    pairs = met.select("s1", "len1", "s2", "len2").unionByName(few.select("s1", "len1", "s2", "len2"))
    return pairs.where(F.greatest("len1", "len2") > longer_than).select(F.least("s1", "s2").alias("x"), F.greatest("s1", "s2").alias("y")).distinct()


def scheduled_average(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, beta: float, period: float = 5000.0) -> DataFrame:
    """An exponential average along each group whose decay changes with the steps:
    keys and state.

    The first value is the first state. At step k (from 1) the share of the new
    value is multiplied by (cos(pi k / period) + 1) / 2, from 1 - ``beta`` on, and
    the state is beta * state + (1 - beta) * value. Such steps compose, so a
    value's weight is a product of decays, which is a difference of running sums
    of logarithms: many tasks share a long group. The order must tell rows apart.
    """
    own = df.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("_v"))
    by = [f"_o{i}" for i in range(len(order))]
    steps = running(own, by, keys, {"_k": F.lit(1).cast("long")}).drop("total__k")
    factor = (F.cos(F.lit(math.pi) * F.col("_k") / F.lit(float(period))) + 1) / 2
    later_step = F.col("_k") > 0
    steps = steps.withColumn("_c", F.when(later_step & (factor > 0), F.ln(factor)).otherwise(F.lit(0.0))).withColumn("_e", (later_step & (factor <= 0)).cast("long"))
    shares = running(steps, by, keys, {"_cs": F.col("_c"), "_es": F.col("_e")})
    share = F.when(F.col("_es") + F.col("_e") > 0, F.lit(0.0)).otherwise((1 - F.lit(float(beta))) * F.exp(F.col("_cs") + F.col("_c")))
    decays = shares.select(*keys, *by, "_v", "_k", share.alias("_w")).withColumn("_b", F.when(later_step, 1 - F.col("_w")).otherwise(F.lit(1.0)))
    decays = decays.withColumn("_l", F.when(F.col("_b") > 0, F.ln("_b")).otherwise(F.lit(0.0))).withColumn("_z", (F.col("_b") <= 0).cast("long"))
    last = running(decays, by, keys, {"_ls": F.col("_l"), "_zs": F.col("_z")})
    kept = F.when(F.col("total__zs") > F.col("_zs") + F.col("_z"), F.lit(0.0)).otherwise(F.exp(F.col("total__ls") - F.col("_ls") - F.col("_l")))
    weight = F.when(later_step, F.col("_w")).otherwise(F.lit(1.0)) * kept
    return last.groupBy(*keys).agg(F.sum(weight * F.col("_v")).alias("state"))


def ordered_fold(df: DataFrame, keys: Sequence[str], order: str, value: str, start: float, step) -> DataFrame:
    """A recurrence along a group: ``step(state, value)`` over the ordered values; result in state."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(items.alias("_i")).select(*keys, F.aggregate("_i", F.lit(float(start)), lambda s, x: step(s, x["v"])).alias("state"))
