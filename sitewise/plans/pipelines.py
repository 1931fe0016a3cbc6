"""Composite plans: embedding structures, building databases and benchmarks.

The encoder is a plug-in: any callable from batches of environment graphs to
vectors. ``toy_encoder`` is deterministic and meaningless; it only shows that
the plumbing carries what an encoder needs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import columns as C
from ..functions import tables
from ..operators import calibrate, rows, sampling, sequence, spatial, vectors
from ..operators.pair_scores import top_statistics
from ..operators.settle import settle

Encoder = Callable[[pd.DataFrame], list]
#: Nodes that an encoder is given at once, unless one environment has more, and
#: nodes whose distances to all others of theirs are looked at together.
GRAPH_NODES = 4096
EDGE_ROWS = 256


def toy_encoder(width: int = 512) -> Encoder:
    """NOT a model: sums of sines of the nodes' classes and places."""

    def encode(batch: pd.DataFrame) -> list:
        k = np.arange(1, width + 1)
        out = []
        for nodes in batch["nodes"]:
            rows = np.array([[n["atom_type"], n["dx"], n["dy"], n["dz"]] for n in nodes])
            s = np.sin(np.outer(rows[:, 0] + 1, k)).sum(0) + (np.cos(rows[:, 1:].sum(1)[:, None] * k)).sum(0)
            out.append((s / max(len(rows), 1)).tolist())
        return out

    return encode


#: What tells structures apart, as far as a table has it.
STRUCTURE = ("ensemble", "subunit", "structure", "model")


def structure_keys(atoms: DataFrame) -> list[str]:
    return [c for c in STRUCTURE if c in atoms.columns]


def environments(centers: DataFrame, atoms: DataFrame, radius: float = 10.0, scope: str = "chain") -> DataFrame:
    """Atoms around each center: of its own chain, or of all of its structure (``scope="all"``)."""
    return spatial.radius_join(centers, atoms, radius, structure_keys(centers) + ["chain"] * (scope == "chain"))


def _edges(nodes, radius: float) -> np.ndarray:
    """Ordered pairs (places in ``nodes``) of different nodes within the radius."""
    at = np.array([[n["dx"], n["dy"], n["dz"]] for n in nodes]).reshape(-1, 3)
    found = [np.zeros((0, 2), np.int32)]
    for lo in range(0, len(at), EDGE_ROWS):
        apart = at[lo : lo + EDGE_ROWS, None] - at
        i, j = np.nonzero((apart * apart).sum(2) <= radius * radius)
        found.append(np.stack([i + lo, j], 1)[i + lo != j].astype(np.int32))
    return np.concatenate(found)


def encode(env: DataFrame, keys: list[str], encoder: Encoder, edge_radius: float = 4.5) -> DataFrame:
    """Runs the encoder on each environment's graph: keys and embedding.

    The encoder sees the columns nodes (atom_idx, atom_type, dx, dy, dz by rising
    atom_idx) and edges (pairs of nodes within ``edge_radius``, both ways). Rows of
    an environment stand together in a task, so that it holds one environment, or
    few small ones, and never a batch of them. Null keys are keys like any other.
    """
    fields = ["atom_idx", "atom_type", "dx", "dy", "dz"]
    node = [F.col("p_atom_idx").alias("n_atom_idx"), C.element_label(F.col("p_element")).alias("n_atom_type"), *[(F.col("p_" + c) - F.col(c)).alias("n_d" + c) for c in "xyz"]]
    tasks = max(int(env.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = env.select(*[F.col(k) for k in keys], *node)
    order = [*keys, *[f"n_{c}" for c in fields]]
    dealt = rows.repartition(tasks, *keys).sortWithinPartitions(*order)
    given = StructType([*[rows.schema[k] for k in keys], StructField("embedding", ArrayType(DoubleType()))])
    schema = to_arrow_schema(given)

    def encoded(whole: list) -> pa.RecordBatch:
        frame = pd.DataFrame({k: [g.column(k)[0].as_py() for g in whole] for k in keys})
        frame["nodes"] = [[{c: x[f"n_{c}"] for c in fields} for x in g.select([f"n_{c}" for c in fields]).to_pylist()] for g in whole]
        frame["edges"] = [_edges(n, edge_radius) for n in frame["nodes"]]
        made = [None if e is None else list(e) for e in encoder(frame)]
        own = pa.concat_tables([g.slice(0, 1) for g in whole]).combine_chunks()
        return pa.RecordBatch.from_arrays([*[pa.concat_arrays(own.column(k).chunks) for k in keys], pa.array(made, pa.list_(pa.float64()))], schema=schema)

    def environments_of(batches):
        """Tables of one environment each: runs of equal keys, over batches too."""
        held: list = []
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            new = np.zeros(t.num_rows, bool)
            for k in keys:
                new[1:] |= np.diff(pa.concat_arrays(t.column(k).chunks).dictionary_encode(null_encoding="encode").indices.to_numpy()) != 0
            starts = [0, *np.flatnonzero(new).tolist(), t.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                if held and (lo or any(held[0].column(k)[0].as_py() != t.column(k)[0].as_py() for k in keys)):
                    yield pa.concat_tables(held)
                    held = []
                held.append(t.slice(lo, hi - lo))
        if held:
            yield pa.concat_tables(held)

    def run(batches):
        whole, size = [], 0
        for g in environments_of(batches):
            if whole and size + g.num_rows > GRAPH_NODES:
                yield encoded(whole)
                whole, size = [], 0
            whole.append(g)
            size += g.num_rows
        if whole:
            yield encoded(whole)

    return dealt.mapInArrow(run, given)


def encode_near(centers: DataFrame, atoms: DataFrame, keys: list[str], within: list[str], encoder: Encoder, radius: float, edge_radius: float = 4.5) -> DataFrame:
    """What ``encode`` gives for the atoms within ``radius`` of each center (of equal,
    not null ``within``), without writing these pairs: atoms are copied to the cells
    around theirs, and a task picks each center's from its cell.
    """
    side, at = radius * (1 + 1e-6), spatial.XYZ
    by = [f"_k{i}" for i in range(len(within))] + [f"_g{c}" for c in at]
    place = [F.col(k).alias(f"_k{i}") for i, k in enumerate(within)]
    cell = lambda c: F.floor(F.col(c) / F.lit(side))
    around = F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip((i, j, k), at)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    own = centers.dropna(subset=[*within, *at]).select(*[F.col(k) for k in keys], *[F.col(c).alias(f"_c{c}") for c in at], *place, *[cell(c).alias(f"_g{c}") for c in at])
    near = atoms.dropna(subset=[*within, *at]).withColumn("_o", F.explode(around))
    near = near.select(*place, *[(cell(c) + F.col(f"_o.{c}")).alias(f"_g{c}") for c in at], "atom_idx", C.element_label(F.col("element")).alias("atom_type"), *at)
    given = StructType([*[own.schema[k] for k in keys], StructField("embedding", ArrayType(DoubleType()))])
    schema = to_arrow_schema(given)

    def run(one, two):
        two = two.take(pc.sort_indices(two, [(c, "ascending") for c in ("atom_idx", "atom_type", *at)], null_placement="at_start")) if two.num_rows else two
        idx, kind = two.column("atom_idx").to_pylist(), two.column("atom_type").to_pylist()
        x, y, z = (two.column(c).to_numpy() for c in at)
        made, rows, graphs = [], [], []

        def encoded():
            frame = pd.DataFrame({k: one.column(k).take(pa.array(rows)).to_pylist() for k in keys})
            frame["nodes"], frame["edges"] = graphs, [_edges(g, edge_radius) for g in graphs]
            vectors_ = [None if e is None else list(e) for e in encoder(frame)]
            made.append(pa.Table.from_arrays([*[one.column(k).take(pa.array(rows)) for k in keys], pa.array(vectors_, schema.field("embedding").type)], schema=schema))

        for r, center in enumerate(zip(*[one.column(f"_c{c}").to_numpy() for c in at])):
            dx, dy, dz = x - center[0], y - center[1], z - center[2]
            inside = np.flatnonzero(np.sqrt(dx * dx + dy * dy + dz * dz) <= radius)
            if not len(inside):
                continue
            if graphs and sum(map(len, graphs)) + len(inside) > GRAPH_NODES:
                encoded()
                rows, graphs = [], []
            rows.append(r)
            graphs.append([{"atom_idx": idx[i], "atom_type": kind[i], "dx": a, "dy": b, "dz": c} for i, a, b, c in zip(inside.tolist(), dx[inside].tolist(), dy[inside].tolist(), dz[inside].tolist())])
        if graphs:
            encoded()
        return pa.concat_tables(made) if made else schema.empty_table()

    tasks = max(int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    deal = lambda d: d.repartition(tasks, *by).groupBy(*by)
    return deal(own).cogroup(deal(near)).applyInArrow(run, given)


def embed_protein(atoms: DataFrame, encoder: Encoder, radius: float = 10.0, edge_radius: float = 4.5, hetero_residues: bool = True, scope: str = "chain") -> DataFrame:
    """One row per standard residue: what tells its structure apart, chain, resid,
    confidence and embedding. Structures never see each other's atoms.

    Residues without a center, and centers without atoms around them, are left out.
    """
    rows = atoms if hetero_residues else atoms.where(F.col("resname").isin(tables.RESIDUES))
    known = rows.where(F.col("resname").isin(tables.STANDARD_RESIDUES))
    whole = structure_keys(atoms)
    keys = [*whole, "chain", "residue", "resname"]
    centers = spatial.functional_centers(known, keys).where("x is not null")
    confidence = known.groupBy(*keys).agg(F.min_by("bfactor", "atom_idx").alias("confidence"))
    vectors_ = encode_near(centers, rows, keys, [*whole, *["chain"] * (scope == "chain")], encoder, radius, edge_radius)
    out = vectors_.join(confidence, keys)
    resid = C.render_resid(C.residue_to_letter(F.col("resname")), F.col("residue"))
    return out.select(*whole, "chain", resid.alias("resid"), "confidence", "embedding")


def embed_residue(atoms: DataFrame, chain, resid: str, encoder: Encoder, **options) -> DataFrame:
    """The row of one residue, given its chain and letter with number."""
    return embed_protein(atoms.where(F.col("chain") == chain), encoder, **options).where(F.col("resid") == resid)


def embed_pocket(atoms: DataFrame, pocket: DataFrame, encoder: Encoder, **options) -> DataFrame:
    """The rows of residues whose chain_resid is in ``pocket``."""
    rows = embed_protein(atoms, encoder, **options).withColumn("chain_resid", F.concat_ws("_", F.col("chain").cast("string"), "resid"))
    return rows.join(pocket.select("chain_resid").distinct(), "chain_resid", "left_semi")


def build_background(db: DataFrame, draws: int = 1_000_000, group: str = "letter", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Cutoffs and moments by group and for all, of sampled pairs of each group.

    The pairs of a draw meet their vectors by joins on the row's id; their scores
    are written once, and no task holds a group's rows or scores.
    """
    pairs = sampling.random_pairs(db, draws, "id", group, seed)
    side = lambda n: db.select(F.col("id").alias(n), F.col("u").alias("u_" + n))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").select(group, C.dot(F.col("u_a"), F.col("u_b")).alias("cos"))
    cos = settle(scored)
    return calibrate.quantile_cutoffs(cos, [group], combined=True), calibrate.moments(cos, [group], combined=True)


def build_site_db(sites: DataFrame, background: DataFrame, group: str = "letter") -> DataFrame:
    """Sites with mean_cos, std_cos and quantiles (array of p, cutoff) against
    all background vectors of their residue type. Types without one are left out.
    """
    found = top_statistics(sites, background, "site_id", "id", group, [1 - p for p in calibrate.P_VALUES])
    p = F.array(*[F.lit(float(p)) for p in calibrate.P_VALUES])
    quantiles = F.array_sort(F.transform("quantiles", lambda q, i: F.struct(F.get(p, i).alias("p"), q["quantile"].alias("cutoff"))))
    return sites.join(found.select("site_id", F.col("mean").alias("mean_cos"), F.col("std").alias("std_cos"), quantiles.alias("quantiles")), "site_id")


def confident_residues(records: DataFrame, keys: list[str], pos: str = "pos", value: str = "confidence", least: float = 70.0, longer_than: int = 20) -> DataFrame:
    """Residues in long runs of high smoothed confidence."""
    smooth = sequence.gaussian_smooth(records, keys, pos, value)
    return sequence.high_runs(smooth, keys, pos, "smooth", least, longer_than)


def labelled_benchmark(positives: DataFrame, negatives: DataFrame, embeddings: DataFrame, folds: int = 10) -> DataFrame:
    """Site lists of both classes with group folds, joined to embeddings.

    Lists have pdb, chain, residue (text) and ord; embeddings have pdb_chain,
    residue (text). Rows without an embedding drop out, insertion codes too.
    """
    both = positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))
    both = both.withColumn("pdb_chain", F.concat_ws("_", F.lower("pdb"), "chain"))
    ordered = both.withColumn("_o", F.struct((1 - F.col("label")).alias("l"), "ord"))
    return sampling.group_folds(ordered, "pdb_chain", "_o", folds).drop("_o").join(embeddings, ["pdb_chain", "residue"])


def families(records: DataFrame, structures: DataFrame, family: str, least: int = 2) -> DataFrame:
    """Alignment records joined to structures by pdb_chain; families of fewer members drop out."""
    joined = records.join(structures, "pdb_chain")
    big = joined.groupBy(family).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(family)
    return joined.join(big, family, "left_semi")


def subunits(ensembles: DataFrame, keys: list[str], name: str = "subunit") -> DataFrame:
    """One row per ensemble: its ligand and receptor subunits, bound and unbound.

    Ensembles of two subunits serve as both forms; four are told apart by the
    suffixes of their names. Any other number is an error.
    """
    n = F.countDistinct(name).alias("n")
    ends = lambda s: F.min(F.when(F.col(name).endswith(s), F.col(name)))
    found = ensembles.groupBy(*keys).agg(n, F.min(name).alias("a"), F.max(name).alias("b"), *[ends(s).alias(s) for s in ("ligand_bound", "receptor_bound", "ligand_unbound", "receptor_unbound")])
    checked = found.withColumn("ok", F.when(F.col("n").isin(2, 4), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("2 or 4 subunits expected, not "), F.col("n").cast("string")))))
    pick = lambda c, other: F.when(F.col("ok") & (F.col("n") == 2), F.col(other)).otherwise(F.col(c)).alias(c)
    return checked.select(*keys, pick("ligand_bound", "a"), pick("receptor_bound", "b"), pick("ligand_unbound", "a"), pick("receptor_unbound", "b"))


def interface_labels(left: DataFrame, right: DataFrame, cutoff: float, residue: list[str], keys: list[str], n: int = 10, ratio: int = 1, seed: int = 0, pair_key: Column | None = None, start: Column | None = None) -> DataFrame:
    """Labelled residue pairs of every ensemble (keys): up to n positive ones, the
    first by hash, and ``ratio`` times as many negative ones. What is hashed can be
    given: a whole number of the pair (``pair_key``) and of the ensemble (``start``)."""
    near = settle(spatial.interface_pairs(left, right, cutoff, residue, keys=keys))
    columns = [c + s for s in "01" for c in residue]
    hashed = F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) if pair_key is None else pair_key
    pos = settle(sampling.first_hashed(near, n, hashed, [hashed, *columns], keys, seed))
    wanted = pos.groupBy(*keys).agg((F.count("*") * ratio).alias("wanted"))
    neg = sampling.drawn_negatives(left, right, near, wanted, residue, keys, seed, start, distinct=True)
    return pos.select(*keys, *columns, F.lit(1).alias("label")).unionByName(neg.select(*keys, *columns, F.lit(0).alias("label")))


def interface_examples(left: DataFrame, right: DataFrame, cutoff: float, residue: list[str], keys: list[str], n: int = 10, ratio: int = 1, radius: float = 10.0, seed: int = 0, **hashed: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The labelled pairs of every ensemble, and the environments of both sides:
    atoms of the ensemble's subunit around the CA of each residue in a pair."""
    pairs = settle(interface_labels(left, right, cutoff, residue, keys, n, ratio, seed, **hashed))
    sides = []
    for side, atoms in (("0", left), ("1", right)):
        wanted = pairs.select(*keys, *[F.col(c + side).alias(c) for c in residue]).distinct()
        centers = spatial.ca_centers(atoms.join(wanted, [*keys, *residue], "left_semi"), [*keys, *residue])
        sides.append(spatial.radius_join(centers, atoms, radius, keys))
    return pairs, sides[0], sides[1]


def site_neighbor_environments(site_atoms: DataFrame, atoms: DataFrame, residue: list[str], reach: float = 3.5, radius: float = 10.0) -> DataFrame:
    """Environments of every residue within ``reach`` of a site."""
    near = spatial.site_neighbors(site_atoms, atoms, reach, residue)
    centers = spatial.ca_centers(atoms.join(near, residue, "left_semi"), residue)
    return spatial.radius_join(centers, atoms, radius)


def labelled_sites(coords: DataFrame, atoms: DataFrame, held_out: bool) -> DataFrame:
    """The residue nearest each labelled coordinate of a structure, by class.

    ``coords`` has site, pdb, x, y, z and label (1, 0): TP and TN of a main set,
    FN and FP of a held-out one.
    """
    names = ("FN", "FP") if held_out else ("TP", "TN")
    near = spatial.nearest_point(coords, atoms, "site", "atom_idx", keys=["pdb"])
    kind = F.when(F.col("label") == 1, names[0]).otherwise(names[1])
    return near.join(coords.select("site", "pdb", "label"), ["site", "pdb"]).select("site", "pdb", "atom_idx", "dist", kind.alias("kind"))


def alignment_column_pairs(records: DataFrame, keys: list[str], row: str, seq: str, residues: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """For each alignment column every residue that stands there: keys, row, col,
    seq_pos and conservation (rounded, if ``digits`` are given), with the columns of
    ``residues`` (by row and seq_pos, those it lacks left out), if given.
    """
    conserved = sequence.entropy_of(rows.column_counts(records, keys, seq), keys).select(*keys, "col", "conservation")
    if digits is not None:  # once a column, not once a residue
        conserved = conserved.withColumn("conservation", F.round("conservation", digits))
    placed = rows.placed_in_columns(records, [*keys, row], keys, seq, conserved, "conservation")
    return placed if residues is None else placed.join(residues, [row, "seq_pos"])


def positive_pairs(records: DataFrame, family: str, rec: str, seq: str, letters: list[str], n_pairs: int = 1, seed: int = 0) -> DataFrame:
    """Residues that two records of a family have in one alignment column: family,
    col, rec0, rec1, pos0, pos1, letter0, letter1, conservation.

    Of each family two records are drawn, and of the columns where both have one
    of the ``letters``, ``n_pairs``; without replacement, the smallest hashes
    first. A position leaves out the gaps and X's before it. Families of one
    record, and pairs without a common column, give no rows.
    """
    own = records.where(F.length(seq) > 0).select(family, rec, seq)
    two = sampling.take_hashed(own, 2, rec, [family], seed)
    order = F.struct(sampling.mixed(F.col(rec), seed).alias("h"), F.col(rec).alias("r"))
    row = F.struct(F.col(rec).alias("rec"), F.col(seq).alias("seq"))
    both = two.groupBy(family).agg(F.count("*").alias("n"), F.min_by(row, order).alias("x"), F.max_by(row, order).alias("y")).where("n = 2")
    columns = sequence.valid_pair_columns(F.col("x.seq"), F.col("y.seq"), letters)
    ranked = F.array_sort(F.transform(columns, lambda c: F.struct(sampling.mixed(c, seed).alias("h"), c.alias("col"))))
    drawn = both.select(family, "x", "y", F.explode(F.slice(ranked, 1, n_pairs)).alias("c"))
    before = lambda side: F.length(F.translate(F.substring(F.col(f"{side}.seq"), F.lit(1), F.col("c.col")), "-X", ""))
    letter = lambda side: F.substring(F.col(f"{side}.seq"), F.col("c.col") + 1, F.lit(1))
    pairs = settle(drawn.select(
        family, F.col("c.col").alias("col"), F.col("x.rec").alias("rec0"), F.col("y.rec").alias("rec1"),
        before("x").alias("pos0"), before("y").alias("pos1"), letter("x").alias("letter0"), letter("y").alias("letter1"),
    ))
    cells = drawn_cells(own, pairs, family, rec, seq)
    return pairs.join(sequence.column_entropy(cells, [family]).select(family, "col", "conservation"), [family, "col"])


def drawn_cells(records: DataFrame, drawn: DataFrame, family: str, rec: str, seq: str) -> DataFrame:
    """Only the drawn columns (family, col) of all records of a family: family, col,
    ch. A family's records are spread over the tasks, however few families there are."""
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1) * 4
    asked = drawn.groupBy(family).agg(F.collect_set("col").alias("_cols")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = records.withColumn("_part", F.pmod(F.xxhash64(rec), F.lit(parts)).cast("int")).join(asked, [family, "_part"])
    each = dealt.select(family, seq, F.explode(F.filter("_cols", lambda c: c < F.length(seq))).alias("col"))
    return each.select(family, "col", F.substring(F.col(seq), F.col("col") + 1, F.lit(1)).alias("ch"))


def pair_environments(pairs: DataFrame, family: str, residues: DataFrame, atoms: DataFrame, residue: list[str], radius: float = 10.0, keys: tuple = (), choose=None) -> DataFrame:
    """The environments of both sides of such pairs: family, col, side (0 or 1) and
    the columns of a ball query around each side's functional centre.

    ``residues`` tells which residue a record has at a position: rec, pos and the
    residue's columns, the name included. With ``choose`` one group of functional
    atoms is drawn for each residue. Residues without a place have no environment.
    """
    sides = [pairs.select(family, "col", F.lit(i).alias("side"), F.col(f"rec{i}").alias("rec"), F.col(f"pos{i}").alias("pos")) for i in (0, 1)]
    wanted = settle(sides[0].unionByName(sides[1]).join(residues, ["rec", "pos"]))
    own = atoms.join(wanted.select(*residue).distinct(), residue, "left_semi")
    centers = spatial.functional_centers(own, residue, choose=choose).where("x is not null")
    return spatial.radius_join(wanted.join(centers, residue), atoms, radius, keys)
