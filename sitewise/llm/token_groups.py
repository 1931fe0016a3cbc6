"""Operator 11: n-gram Jaccard join by a token-group matrix.

A document's set is that of its shingles; equal sets count once. Sets are put in
groups of similar ones, by the order of their min-hashes, and the matrix holds
each group's token union and which member has which token. A set that is similar
to a member of a group lacks few of its tokens there, so groups whose overlap
falls short are never opened; in the others members are bounded one by one, by their tokens
there and by a sketch of all of them, and the pairs that are left are compared by
their whole sets, exactly.

The matrix keeps one column in SLICE, and tells its tokens apart by 32 bits. Both
only loosen the bound: a set that may lack d tokens of a member lacks d at most
of those with a column too, and tokens that fall together count as shared.

Which groups a set is bounded against follows from its rarest tokens: similar
sets share one of those (prefix filter), and sets that share none are in no
group. Links are found twice: with the likeliest member of a set's own group and
of the first group of each of its tokens, which joins most copies, and then with
all members not joined to it yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, discard, materialize
from .components import connected_components
from .line_dedup import (
    LEAST_FILTER_BITS, LINES_AT_ONCE, MOST_FILTER_BITS, RANGE_ROWS, RANGE_SLACK, REPORTED, _RANKED,
    SKETCH_WORDS, Tokenizer, _key_filter, _mix, _places, _prefix_blobs, _runs, _shared_rows, _sketches, chunks, prefix_length,
)

SHINGLE_WORDS = 3
PERCENT = 90
#: Frequent tokens with a rank of their own, and tokens of a task among which one
#: has to stand REPORTED times to be reported for ranking. Their order decides how
#: much is compared, never what is found.
RANKED_TOKENS = 1 << 20
COUNTED_TOKENS = 1 << 22
#: Columns of the matrix: one token in so many.
SLICE = 6
#: Sets and their tokens with a column of a group at most; one set may have more.
GROUP_SETS = 64
GROUP_TOKENS = 1 << 16
#: Tokens of the groups that a task makes, on average.
TASK_TOKENS = 1 << 23
#: Sets bounded against one group in a task, and their tokens, on average.
ASKED_SETS = 512
ASKED_TOKENS = 1 << 20
#: Prefix rows to a bucket of sets, and pairs to a bucket of whole sets.
SET_BUCKET = 25_000
PAIR_BUCKET = 2_000
#: Sets of more than one document in so many are joined by broadcast.
HOT_SHARE = 4096

_OTHER = np.uint64(0x94D049BB133111EB)


class _Sets:
    """The sets of some texts' lines: line, token (sorted, rarest first), n, key, check."""

    def __init__(self, tok: Tokenizer, lines, pick: np.ndarray):
        if len(tok._hint) < 8 * len(tok._ranked):  # a hint table as large as the ranks ask for
            tok._hint = np.zeros(1 << (8 * len(tok._ranked)).bit_length(), bool)
            tok._hint[tok._ranked & np.uint64(len(tok._hint) - 1)] = True
        self.line, self.token = tok.sets(lines, pick)
        self.n = np.bincount(self.line, minlength=len(pick))
        self.first = np.cumsum(self.n) - self.n
        raw = self.token.copy()
        ranked = np.flatnonzero(raw >= _RANKED)
        hashes = np.empty_like(tok._ranked)  # by rank
        hashes[len(hashes) - 1 - tok._order] = tok._ranked
        raw[ranked] = hashes[(raw[ranked] ^ _RANKED).astype(np.int64)]
        self.key = _mix(self._sums(_mix(raw * _OTHER))).view(np.int64)
        self.check = _mix(self._sums(_mix(raw ^ _OTHER)) ^ self.n.astype(np.uint64)).view(np.int64)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return total[self.first + self.n] - total[self.first]

    def least(self, odd: int) -> np.ndarray:
        """A min-hash of each set; no set may be empty."""
        return np.minimum.reduceat(_mix(self.token * np.uint64(odd)) >> np.uint64(1), self.first).view(np.int64)


def _picks(lines):
    some = np.flatnonzero(lines.words > 0)
    for lo in range(0, len(some), LINES_AT_ONCE):
        yield some[lo : lo + LINES_AT_ONCE]


def _document_rows(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """id, n, key, check of every document, and reports (token, count): how often
    a frequent token stands in a batch and, as token -1, its prefix rows."""
    id_type = docs.schema["_id"].dataType.simpleString()
    names = ["_id", "n", "key", "check", "token", "count"]

    def reports(tokens, whole, id_type):
        token, count = _runs(np.concatenate(tokens))
        often = count >= REPORTED
        token, count = np.append(token[often].astype(np.int64), -1), np.append(count[often], whole)
        m = len(token)
        return pa.RecordBatch.from_arrays([pa.nulls(m, id_type), *[pa.nulls(m, pa.int64())] * 3, pa.array(token), pa.array(count)], names)

    def run(batches):
        tok, kind, held, size, whole = Tokenizer(width=width), None, [], 0, 0
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0)
            kind = ids.type
            bare = np.ones(len(texts), bool)
            for lines in chunks(texts):
                for pick in _picks(lines):
                    s = _Sets(tok, lines, pick)
                    doc, m = lines.doc[pick], len(pick)
                    bare[doc] = False
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(s.n.astype(np.int64)), pa.array(s.key), pa.array(s.check), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names)
                    held.append(s.token)
                    size += len(s.token)
                    whole += int(prefix_length(s.n, percent).sum())
                    if size >= COUNTED_TOKENS:
                        yield reports(held, whole, kind)
                        held, size, whole = [], 0, 0
            doc = np.flatnonzero(bare)
            m = len(doc)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(np.zeros(m, np.int64)), *[pa.nulls(m, pa.int64())] * 4], names)
        if held:
            yield reports(held, whole, kind)

    return docs.mapInArrow(run, f"_id {id_type}, n long, key long, check long, token long, count long")


def _prefixes(tok: Tokenizer, texts: list, percent: int):
    """token, key, n and pos of the prefix tokens of each different set. A set too
    small to be similar to any but its equal has none."""
    for lines in chunks(texts):
        for pick in _picks(lines):
            s = _Sets(tok, lines, pick)
            use = np.zeros(len(pick), bool)
            use[np.unique(s.key, return_index=True)[1]] = True
            use &= 100 * s.n >= percent * (s.n + 1)
            pos = np.arange(len(s.line)) - s.first[s.line]
            own = use[s.line] & (pos < prefix_length(s.n, percent)[s.line])
            line = s.line[own]
            yield s.token[own], s.key[line], s.n[line], pos[own]


def _token_sets(docs: DataFrame, ranked, keys: DataFrame, width: int, sliced: bool, buckets: int) -> DataFrame:
    """key, n and toks of the sets with the keys (and a few others); if ``sliced``
    two min-hashes and a sketch too, and of the tokens those with a column, as 32 bits.
    They lie in buckets of the key, so that joins on it never shuffle the tokens."""
    bits = min(max(1 << (16 * keys.count()).bit_length(), LEAST_FILTER_BITS), MOST_FILTER_BITS)
    maybe = docs.sparkSession.sparkContext.broadcast(_key_filter(keys, bits))
    kind = "m1 long, m2 long, sketch array<long>, toks array<int>" if sliced else "toks array<long>"

    def run(batches):
        tok, bits = Tokenizer(ranked.value, width), np.frombuffer(maybe.value, np.uint8)
        for b in batches:
            for lines in chunks(b.column(0).to_pylist()):
                for pick in _picks(lines):
                    s = _Sets(tok, lines, pick)
                    use = np.zeros(len(pick), bool)
                    use[np.unique(s.key, return_index=True)[1]] = True
                    for place in _places(s.key, 8 * len(bits)):
                        use &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    own = use[s.line]
                    sketch, cols = None, [s.key[use], s.n[use].astype(np.int64)]
                    if sliced:
                        cols += [s.least(0xD6E8FEB86659FD93)[use], s.least(0xC2B2AE3D27D4EB4F)[use]]
                        flat = _sketches(s.line, s.token, len(pick)).reshape(len(pick), SKETCH_WORDS)[use].reshape(-1)
                        sketch = pa.ListArray.from_arrays(pa.array(np.arange(use.sum() + 1) * SKETCH_WORDS, pa.int32()), pa.array(flat))
                        mixed = _mix(s.token * np.uint64(0x9E3779B97F4A7C15))
                        own &= (mixed >> np.uint64(32)) % np.uint64(SLICE) == 0
                        toks = (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)[own]
                    else:
                        toks = s.token[own].astype(np.int64)
                    size = np.bincount(s.line[own], minlength=len(pick))[use]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(toks))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *[sketch] * sliced, lists], names)

    names = ["key", "n", *["m1", "m2", "sketch"][: 3 * sliced], "toks"]
    made = docs.select("_text").mapInArrow(run, f"key long, n long, {kind}")
    return materialize(made.repartition(buckets, "key").dropDuplicates(["key"]), "key", buckets)


def _matrix(sets: DataFrame, tasks: int) -> DataFrame:
    """The groups: gid, union (their different tokens, sorted) and of each member
    its key, n, sketch, held (how many tokens it has there) and their places in
    the union, one member after the other (at)."""

    def record(gid, held):
        keys, n, sketch, toks = (list(x) for x in zip(*held))
        union, at = np.unique(np.concatenate(toks), return_inverse=True)
        return {"gid": gid, "union": union, "keys": keys, "n": n, "sketch": np.concatenate(sketch), "held": [len(t) for t in toks], "at": at.astype(np.int32)}

    def run(batches):
        from pyspark import TaskContext

        gid, held, size = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            sketch, toks = b.column(2), b.column(3)
            for i, (key, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                own = toks[i].values.to_numpy()
                if held and (len(held) == GROUP_SETS or size + len(own) > GROUP_TOKENS):
                    yield pa.RecordBatch.from_pylist([record(gid, held)], schema)
                    gid, held, size = gid + 1, [], 0
                held.append((key, n, sketch[i].values.to_numpy(), own))
                size += len(own)
        if held:
            yield pa.RecordBatch.from_pylist([record(gid, held)], schema)

    lists = {"union": pa.int32(), "keys": pa.int64(), "n": pa.int64(), "sketch": pa.int64(), "held": pa.int32(), "at": pa.int32()}
    schema = pa.schema([("gid", pa.int64()), *[(c, pa.list_(t)) for c, t in lists.items()]])
    near = sets.select("key", "n", "sketch", "toks", "m1", "m2").repartitionByRange(tasks, "m1", "m2", "key").sortWithinPartitions("m1", "m2", "key")
    return near.mapInArrow(run, "gid long, union array<int>, keys array<long>, n array<long>, sketch array<long>, held array<int>, at array<int>")


def _bounded(asked: DataFrame, sets: DataFrame, groups: DataFrame, percent: int, roots: DataFrame | None = None) -> DataFrame:
    """Pairs a, b of the sets ``asked`` (key, gid, own) and members of the group that
    the bounds leave: of each set and group the likeliest alone or, with ``roots``
    (gid, key, root of every member; ``asked`` has root too), all with different roots.

    A set that is a member itself (own) is asked without its tokens, which the group
    has; roots come to a group as rows beside those that ask, so that the groups
    are shuffled once.
    """
    sized = asked.join(sets.select("key", F.size("toks").alias("size")), "key")
    load = sized.groupBy("gid").agg(F.greatest(F.ceil(F.count("*") / ASKED_SETS), F.ceil(F.sum("size") / ASKED_TOKENS)).cast("long").alias("chunks"))
    root = F.lit(None).cast("long").alias("root") if roots is None else F.col("root")
    placed = materialize(asked.join(load, "gid").select("key", "gid", "own", F.pmod(F.xxhash64("key"), F.greatest("chunks", F.lit(1))).alias("chunk"), root))
    parts = placed.select("gid", "chunk").distinct()
    columns = ["key", "gid", "chunk", "root", "n", "sketch", "toks"]
    without = [F.lit(None).cast(sets.schema[c].dataType).alias(c) for c in columns[4:]]
    left = placed.where("NOT own").join(sets.select("key", "n", "sketch", "toks"), "key").select(*columns, F.lit(False).alias("member"))
    left = left.unionByName(placed.where("own").select(*columns[:4], *without, F.lit(False).alias("member")))
    if roots is not None:
        left = left.unionByName(roots.join(parts, "gid").select(*columns[:4], *without, F.lit(True).alias("member")))
    # One row a group, which has many sets or tokens: a small table.
    right = groups.join(F.broadcast(parts.select(F.col("gid").alias("to"), F.col("chunk").alias("part_of"))), F.col("to") == F.col("gid")).drop("gid")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    likeliest = roots is None

    def bound(asking: pa.Table, group: pa.Table) -> pa.Table:
        a, b = [], []
        if len(asking) and len(group):
            one = {c: group.column(c).combine_chunks()[0].values.to_numpy() for c in ("union", "keys", "n", "sketch", "held", "at")}
            parity = one["sketch"].reshape(len(one["n"]), SKETCH_WORDS)
            has = np.zeros((len(one["n"]), len(one["union"]) + 1), bool)
            has[np.repeat(np.arange(len(one["n"])), one["held"]), one["at"]] = True
            end = np.cumsum(one["held"])
            place = {k: i for i, k in enumerate(one["keys"].tolist())}
            members, asking = asking.filter(asking.column("member")), asking.filter(pc.invert(asking.column("member")))
            if not likeliest:
                of = dict(zip(members.column("key").to_pylist(), members.column("root").to_pylist()))
                roots = np.array([of[k] for k in place], np.int64)
            toks, sketches = (asking.column(c).combine_chunks() for c in ("toks", "sketch"))
            for i, (key, n, root) in enumerate(zip(*(asking.column(c).to_pylist() for c in ("key", "n", "root")))):
                if n is None:  # a member
                    m = place[key]
                    n, sketch, held = int(one["n"][m]), parity[m], one["held"][m]
                    at = one["at"][end[m] - held : end[m]]
                else:
                    own, sketch = toks[i].values.to_numpy(), sketches[i].values.to_numpy()
                    held = len(own)
                    at = np.searchsorted(one["union"], own)
                    at = at[np.append(one["union"], 0)[at] == own]
                    at = at[at < len(one["union"])]
                if held - len(at) > n - -(-percent * n // 100):
                    continue  # every member lacks more tokens than a similar one may
                overlap = has[:, at].sum(1)
                need = -(-percent * (n + one["n"]) // (100 + percent))
                near = np.flatnonzero((held - overlap <= n - need) & (100 * np.minimum(n, one["n"]) >= percent * np.maximum(n, one["n"])) & ((one["keys"] != key) if likeliest else (roots != root)))
                # A token flips one bit of a sketch, so as many bits differ as tokens do at most.
                differ = np.bitwise_count((parity[near] ^ sketch).view(np.uint64)).sum(1, dtype=np.int64)
                fits = n + one["n"][near] - differ >= 2 * need[near]
                near, differ = near[fits], differ[fits]
                if likeliest and len(near):
                    near = near[[np.lexsort((one["keys"][near], differ))[0]]]
                a += [key] * len(near)
                b += one["keys"][near].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    found = materialize(left.groupBy("gid", "chunk").cogroup(right.groupBy("to", "part_of")).applyInArrow(bound, "a long, b long"))
    discard(placed)
    return found


def _similar(pairs: DataFrame, docs: DataFrame, ranked, percent: int, width: int) -> DataFrame:
    """The pairs whose Jaccard similarity suffices, by their whole sets: those are
    read again for the few texts that are left in pairs."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = _token_sets(docs, ranked, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), width, sliced=False, buckets=max(8, pairs.count() // PAIR_BUCKET))
    side = lambda k, x: sets.select(F.col("key").alias(k), F.col("toks").alias(x)).hint("merge")
    both = F.size(F.array_intersect("x", "y"))
    found = materialize(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(both * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("a", "b"))
    for done in (pairs, sets):
        discard(done)
    return found


def _asked(rows: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The rows (a set with its own group, gid) and groups (to) with a common prefix
    token whose lengths and places allow a link. ``held`` has of a token's groups the least and the
    largest set and the most tokens from the token on."""
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("least")) / F.lit(100 + percent))
    fits = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") - F.col("pos") >= need) & (F.col("rest") >= need)
    return rows.join(held.hint("merge"), "token").where(fits)


def _links(found: DataFrame, docs: DataFrame, ranked, percent: int, width: int) -> DataFrame:
    """Links a, b between keys of different, similar sets, whose components are
    those of all such pairs. ``found`` has the prefix rows token, key, n, pos."""
    prefixes = found.count()
    sets = _token_sets(docs, ranked, found.select("key").distinct(), width, sliced=True, buckets=max(8, prefixes // SET_BUCKET))
    tokens = sets.agg(F.sum(F.size("toks"))).first()[0] or 0
    groups = materialize(_matrix(sets, max(docs.sparkSession.sparkContext.defaultParallelism, tokens // TASK_TOKENS)))
    home = groups.select("gid", F.explode("keys").alias("key"))
    buckets = bucket_count(prefixes)
    rows = materialize(found.join(home, "key").repartition(buckets, "token"), "token", buckets)

    def held(rows, *more):
        return rows.groupBy("token", "gid").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"), *more)

    hub = held(rows).groupBy("token").agg(F.min(F.struct("gid", "least", "most", "rest")).alias("h")).select("token", F.col("h.gid").alias("to"), "h.least", "h.most", "h.rest")
    first = _asked(rows, hub, percent).select("key", F.col("to").alias("gid"), (F.col("to") == F.col("gid")).alias("own")).unionByName(rows.select("key", "gid", F.lit(True).alias("own"))).distinct()
    near = _similar(_bounded(first, sets, groups, percent), docs, ranked, percent, width)
    roots = connected_components(near)
    rooted = rows.join(roots.withColumnRenamed("v", "key").hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = materialize(rooted.repartition(buckets, "token"), "token", buckets)
    mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    apart = materialize(placed.join(mixed.hint("merge"), "token", "left_semi").repartition(buckets, "token"), "token", buckets)
    others = held(apart, F.min("root").alias("x"), F.max("root").alias("y")).withColumnRenamed("gid", "to")
    asked = _asked(apart, others, percent).where("to <= gid AND (x <> root OR y <> root)").select("key", F.col("to").alias("gid"), (F.col("to") == F.col("gid")).alias("own"), "root").distinct()
    root = home.join(roots.withColumnRenamed("v", "key").hint("merge"), "key", "left").select("gid", "key", F.coalesce("root", "key").alias("root"))
    rest = _bounded(asked, sets, groups, percent, root)
    links = materialize(near.unionByName(_similar(rest, docs, ranked, percent, width)))
    for done in (sets, groups, rows, near, placed, apart):
        discard(done)
    return links


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """The id, n_shingles and component_id of every row.

    A row's set has the different shingles of ``width`` words (five at most) of
    its text, letters A-Z lower-cased, or its whole word sequence if that is
    shorter. Rows are linked if their sets have a Jaccard similarity of ``percent``
    or more; component_id is the smallest id reachable over links, its own included.

    Null and empty texts, and texts of blanks, have no shingle and no link, and
    their component is their own id. Equal rows and rows that share an id are
    rows like any other. A row without an id has one in the result, and the
    component of its links: null if no row there has an id. An empty table gives
    no rows; other columns play no part. A long text is one set, read in one
    piece, and may be a group by itself. Shingles are told apart by 51 bits of
    hash, sets by 128.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.replace(F.col(text_col), F.lit("\n"), F.lit(" ")).alias("_text"))
    all_rows = materialize(_document_rows(texts, percent, width))
    often = all_rows.where("token >= 0").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(RANKED_TOKENS).select("token").toArrow()
    ranked = docs.sparkSession.sparkContext.broadcast(often.column(0).to_numpy().astype(np.uint64))  # RANKED_TOKENS numbers
    expected = all_rows.where("token = -1").agg(F.sum("count")).first()[0] or 0
    own = all_rows.where("token IS NULL").select("_id", "n", "key", "check")
    ranges = min(max(64, expected // RANGE_ROWS), 1 << 20)
    blobs = _prefix_blobs(texts, "_text", ranked, percent, ranges, width, _prefixes).repartition("r").sortWithinPartitions("r")
    found = materialize(blobs.mapInArrow(_shared_rows(percent, RANGE_SLACK * max(RANGE_ROWS, expected // ranges)), "token long, key long, n long, pos long"))
    roots = connected_components(_links(found, texts, ranked, percent, width))
    first = materialize(own.where("key IS NOT NULL").groupBy("key", "check").agg(F.min("_id").alias("least"), F.count("*").alias("copies")))
    rooted = first.join(roots.withColumnRenamed("v", "key").hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    fate = rooted.join(least.hint("merge"), "root").select("key", "check", "copies", "component_id")
    # Sets of very many documents are joined where those are: HOT_SHARE rows at most.
    total = first.agg(F.sum("copies")).first()[0] or 0
    hot = materialize(fate.where(F.col("copies") * HOT_SHARE > total))
    worded = own.where("key IS NOT NULL")
    cold = worded.join(F.broadcast(hot.select("key", "check")), ["key", "check"], "left_anti").join(fate.where(F.col("copies") * HOT_SHARE <= total), ["key", "check"])
    parts = [worded.join(F.broadcast(hot), ["key", "check"]), cold]
    bare = own.where("key IS NULL").select("_id", "n", F.col("_id").alias("component_id"))
    out = bare
    for p in parts:
        out = out.unionByName(p.select("_id", "n", "component_id"))
    done = materialize(out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"))
    for x in (all_rows, found, first, hot):
        discard(x)
    return done
