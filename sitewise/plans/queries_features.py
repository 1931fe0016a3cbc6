"""Queries of spatial neighbourhoods, graph features and interfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import tables
from ..operators import filters, sampling, spatial
from ..operators.settle import settle
from ..registry import query
from .standins import ATOMS_SQL, aligned_rows, atoms, table

D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
#: Atoms with residue, atom name and residue name, made of the atom's number.
NAMED_SQL = f"""{ATOMS_SQL}, named AS (
    SELECT *, atom_idx // 4 AS residue, ['N', 'CA', 'CB', 'SG'][atom_idx % 4 + 1] AS name, ['CYS', 'GLY', 'ALA', 'UNK'][(atom_idx // 4) % 4 + 1] AS resname,
           ['C', 'N', 'O', 'H', 'Zn', 'Xx'][atom_idx % 6 + 1] AS element, [' ', 'W', 'H_ZN', 'H_XWZ'][atom_idx % 4 + 1] AS hetero, CAST(atom_idx % 3 AS INTEGER) AS model, CAST(chain % 2 AS VARCHAR) AS structure
    FROM atoms
)"""


def named(spark, sf_dir):
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    i = F.col("atom_idx")
    return atoms(spark, sf_dir).select(
        "*", F.expr("atom_idx div 4").alias("residue"), pick(["N", "CA", "CB", "SG"], i % 4).alias("name"), pick(["CYS", "GLY", "ALA", "UNK"], F.expr("atom_idx div 4") % 4).alias("resname"),
        pick(["C", "N", "O", "H", "Zn", "Xx"], i % 6).alias("element"), pick([" ", "W", "H_ZN", "H_XWZ"], i % 4).alias("hetero"), (i % 3).cast("int").alias("model"), (F.col("chain") % 2).cast("string").alias("structure"),
    )


def _r(*names):
    return [C.rounded(F.col(n), 6).alias(n) for n in names]


@query("radius_env", f"WITH {ATOMS_SQL} SELECT a.atom_idx AS env, b.atom_idx AS atom, round({D}, 6) AS dist FROM atoms a JOIN atoms b ON {D} <= 0.12")
def radius_env(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return spatial.radius_join(a, a, 0.12).select(F.col("atom_idx").alias("env"), F.col("p_atom_idx").alias("atom"), *_r("dist"))


@query("chain_env", f"WITH {ATOMS_SQL} SELECT a.atom_idx AS env, b.atom_idx AS atom, a.chain, round({D}, 6) AS dist FROM atoms a JOIN atoms b ON a.chain = b.chain AND {D} <= 0.2")
def chain_env(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return spatial.radius_join(a, a, 0.2, ["chain"]).select(F.col("atom_idx").alias("env"), F.col("p_atom_idx").alias("atom"), "chain", *_r("dist"))


@query("radius_graph_edges", f"""WITH {ATOMS_SQL} SELECT a.chain, a.atom_idx AS src, b.atom_idx AS dst, round({D}, 6) AS dist, round(coalesce((a.x - b.x) / nullif({D}, 0), 0), 6) AS ux, round(coalesce((a.y - b.y) / nullif({D}, 0), 0), 6) AS uy, round(coalesce((a.z - b.z) / nullif({D}, 0), 0), 6) AS uz
    FROM atoms a JOIN atoms b ON a.chain = b.chain AND a.atom_idx <> b.atom_idx AND {D} <= 0.15""")
def radius_graph_edges(spark, sf_dir):
    g = spatial.radius_graph(atoms(spark, sf_dir), 0.15, "atom_idx", ["chain"])
    return g.select("chain", "src", "dst", *_r("dist", "ux", "uy", "uz"))


@query("radius_graph_capped", f"""WITH {ATOMS_SQL}, r AS (SELECT a.atom_idx AS src, b.atom_idx AS dst, row_number() OVER (PARTITION BY a.atom_idx ORDER BY {D}, b.atom_idx) AS k FROM atoms a JOIN atoms b ON a.chain = b.chain AND a.atom_idx <> b.atom_idx AND {D} <= 0.3)
    SELECT src, dst FROM r WHERE k <= 8""")
def radius_graph_capped(spark, sf_dir):
    return spatial.radius_graph(atoms(spark, sf_dir), 0.3, "atom_idx", ["chain"], most=8).select("src", "dst")


@query("rbf_features", f"""WITH {ATOMS_SQL}, e AS (SELECT a.atom_idx AS src, b.atom_idx AS dst, {D} * 20 AS d FROM atoms a JOIN atoms b ON a.chain = b.chain AND a.atom_idx <> b.atom_idx AND {D} <= 0.15)
    SELECT src, dst, CAST(k AS INTEGER) AS k, round(exp(-pow((d - k * 0.3) / 0.28125, 2)), 6) AS rbf FROM e, range(16) t(k)""")
def rbf_features(spark, sf_dir):
    g = spatial.radius_graph(atoms(spark, sf_dir), 0.15, "atom_idx", ["chain"])
    return g.select("src", "dst", F.posexplode(C.radial_basis(F.col("dist") * 20)).alias("k", "rbf")).withColumn("rbf", C.rounded(F.col("rbf"), 6))


@query("nearest_point", f"WITH {ATOMS_SQL}, r AS (SELECT a.atom_idx AS query, b.atom_idx AS atom, {D} AS dist, row_number() OVER (PARTITION BY a.atom_idx ORDER BY {D}, b.atom_idx) AS k FROM atoms a JOIN atoms b ON b.atom_idx % 7 <> 0 WHERE a.atom_idx % 7 = 0) SELECT query, atom, round(dist, 6) AS dist FROM r WHERE k = 1")
def nearest_point(spark, sf_dir):
    a = atoms(spark, sf_dir)
    q = a.where("atom_idx % 7 = 0").withColumnRenamed("atom_idx", "query")
    return spatial.nearest_point(q, a.where("atom_idx % 7 <> 0").withColumnRenamed("atom_idx", "atom"), "query", "atom").select("query", "atom", *_r("dist"))


@query("site_neighbors", f"WITH {NAMED_SQL} SELECT DISTINCT b.chain, b.residue FROM named a JOIN named b ON {D} <= 0.1 WHERE a.residue % 25 = 0")
def site_neighbors(spark, sf_dir):
    a = named(spark, sf_dir)
    return spatial.site_neighbors(a.where("residue % 25 = 0"), a, 0.1, ["chain", "residue"])


@query("functional_center", f"""WITH {NAMED_SQL}, k AS (SELECT *, (resname = 'CYS' AND name = 'SG') OR (resname = 'GLY' AND name = 'CA') OR (resname = 'ALA' AND name = 'CB') AS is_key FROM named)
    SELECT residue, resname, round(coalesce(avg(x) FILTER (is_key), avg(x) FILTER (name = 'CA')), 6) AS x, round(coalesce(avg(y) FILTER (is_key), avg(y) FILTER (name = 'CA')), 6) AS y, round(coalesce(avg(z) FILTER (is_key), avg(z) FILTER (name = 'CA')), 6) AS z FROM k GROUP BY residue, resname""")
def functional_center(spark, sf_dir):
    return spatial.functional_centers(named(spark, sf_dir), ["residue", "resname"]).select("residue", "resname", *_r("x", "y", "z"))


@query("ca_center", f"WITH {NAMED_SQL} SELECT residue, round(arg_min(x, atom_idx), 6) AS x, round(arg_min(y, atom_idx), 6) AS y, round(arg_min(z, atom_idx), 6) AS z FROM named WHERE name = 'CA' GROUP BY residue")
def ca_center(spark, sf_dir):
    return spatial.ca_centers(named(spark, sf_dir), ["residue"]).select("residue", *_r("x", "y", "z"))


@query("first_in_group", f"WITH {NAMED_SQL} SELECT chain, residue, resname, round(arg_min(x, atom_idx), 6) AS bfactor, count(*) AS n_atoms FROM named GROUP BY chain, residue, resname")
def first_in_group(spark, sf_dir):
    g = named(spark, sf_dir).groupBy("chain", "residue", "resname").agg(F.min_by("x", "atom_idx").alias("bfactor"), F.count("*").alias("n_atoms"))
    return g.select("chain", "residue", "resname", *_r("bfactor"), "n_atoms")


@query("vector_normalize", f"WITH {ATOMS_SQL}, n AS (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM atoms) SELECT atom_idx, round(coalesce(x / nullif(n, 0), 0), 6) AS x, round(coalesce(y / nullif(n, 0), 0), 6) AS y, round(coalesce(z / nullif(n, 0), 0), 6) AS z FROM n")
def vector_normalize(spark, sf_dir):
    u = atoms(spark, sf_dir).withColumn("u", C.unit(F.array("x", "y", "z")))
    return u.select("atom_idx", *[F.round(F.col("u")[i], 6).alias(c) for i, c in enumerate("xyz")])


PPI = f"WITH {NAMED_SQL}, l AS (SELECT * FROM named WHERE chain = 1), r AS (SELECT * FROM named WHERE chain = 2)"


def _sides(spark, sf_dir):
    a = named(spark, sf_dir)
    return a.where("chain = 1"), a.where("chain = 2")


@query("interface_pairs_ca", f"{PPI} SELECT a.residue AS residue0, b.residue AS residue1 FROM l a JOIN r b ON {D} < 0.25 WHERE a.name = 'CA' AND b.name = 'CA'")
def interface_pairs_ca(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return spatial.interface_pairs(left.where("name = 'CA'"), right.where("name = 'CA'"), 0.25, ["residue"], distinct=False)


@query("interface_pairs_heavy", f"{PPI} SELECT DISTINCT a.residue AS residue0, b.residue AS residue1 FROM l a JOIN r b ON {D} < 0.15 WHERE a.element <> 'H' AND b.element <> 'H'")
def interface_pairs_heavy(spark, sf_dir):
    left, right = (filters.without_hydrogen(x) for x in _sides(spark, sf_dir))
    return spatial.interface_pairs(left, right, 0.15, ["residue"])


@query("negative_pairs", f"""{PPI}, pos AS (SELECT DISTINCT a.residue AS residue0, b.residue AS residue1 FROM l a JOIN r b ON {D} < 0.15 WHERE a.element <> 'H' AND b.element <> 'H')
    SELECT p.a AS residue0, p.b AS residue1 FROM (SELECT DISTINCT a.residue AS a, b.residue AS b FROM l a, r b) p LEFT JOIN pos ON pos.residue0 = p.a AND pos.residue1 = p.b WHERE pos.residue0 IS NULL""")
def negative_pairs(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return spatial.negative_pairs(left, right, interface_pairs_heavy(spark, sf_dir), ["residue"])


@query("remove_unmatching", f"""{PPI}, pos AS (SELECT DISTINCT a.residue AS residue0, b.residue AS residue1 FROM l a JOIN r b ON {D} < 0.15 WHERE a.element <> 'H' AND b.element <> 'H')
    SELECT * FROM pos WHERE residue0 IN (SELECT residue FROM l WHERE model = 0) AND residue1 IN (SELECT residue FROM r WHERE model = 1)""")
def remove_unmatching(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return spatial.matching_pairs(interface_pairs_heavy(spark, sf_dir), left.where("model = 0"), right.where("model = 1"), ["residue"])


@query("pair_label_sample", f"""{PPI}, pos AS (SELECT DISTINCT a.residue AS residue0, b.residue AS residue1 FROM l a JOIN r b ON {D} < 0.15 WHERE a.element <> 'H' AND b.element <> 'H'),
    neg AS (SELECT p.a AS residue0, p.b AS residue1 FROM (SELECT DISTINCT a.residue AS a, b.residue AS b FROM l a, r b) p LEFT JOIN pos ON pos.residue0 = p.a AND pos.residue1 = p.b WHERE pos.residue0 IS NULL),
    hp AS (SELECT *, residue0 * 100000 + residue1 AS k FROM pos ORDER BY ((k * 48271 + 11) % 2147483647 * 69621 + 1) % 2147483647, k LIMIT 10),
    hn AS (SELECT *, residue0 * 100000 + residue1 AS k FROM neg ORDER BY ((k * 48271 + 11) % 2147483647 * 69621 + 1) % 2147483647, k LIMIT (SELECT count(*) FROM hp))
    SELECT residue0, residue1, CAST(1 AS INTEGER) AS label FROM hp UNION ALL SELECT residue0, residue1, CAST(0 AS INTEGER) FROM hn""")
def pair_label_sample(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    pos = settle(interface_pairs_heavy(spark, sf_dir).select("residue0", "residue1", (F.col("residue0") * 100000 + F.col("residue1")).alias("k")))
    neg = sampling.hashed_negatives(left, right, pos, "residue", 100000, 10)
    return sampling.label_sample(pos, neg, "k", n=10).drop("k")


@query("clean_atoms", f"""WITH {NAMED_SQL}, m AS (SELECT *, min(model) OVER (PARTITION BY structure) AS lo FROM named)
    SELECT atom_idx FROM m WHERE model = lo AND NOT contains(hetero, 'W') AND element <> 'H' AND resname IN ('CYS', 'GLY', 'ALA', 'UNK')""")
def clean_atoms(spark, sf_dir):
    return filters.clean_atoms(named(spark, sf_dir), hetero_residues=False, structure=("structure",)).select("atom_idx")


@query("first_model", f"WITH {NAMED_SQL}, m AS (SELECT *, min(model) OVER (PARTITION BY structure) AS lo FROM named) SELECT atom_idx, model FROM m WHERE model = lo")
def first_model(spark, sf_dir):
    return filters.first_model(named(spark, sf_dir), ("structure",)).select("atom_idx", "model")


@query("water_filter", f"WITH {NAMED_SQL} SELECT atom_idx, hetero FROM named WHERE NOT contains(hetero, 'W')")
def water_filter(spark, sf_dir):
    return filters.without_water(named(spark, sf_dir)).select("atom_idx", "hetero")


@query("hydrogen_filter", f"WITH {NAMED_SQL} SELECT atom_idx, element FROM named WHERE element <> 'H'")
def hydrogen_filter(spark, sf_dir):
    return filters.without_hydrogen(named(spark, sf_dir)).select("atom_idx", "element")


@query("standard_residues", f"WITH {NAMED_SQL} SELECT atom_idx, resname FROM named WHERE resname IN ('CYS', 'GLY', 'ALA')")
def standard_residues(spark, sf_dir):
    return filters.residues_known(named(spark, sf_dir), unknown=False).select("atom_idx", "resname")


@query("chain_filter", f"WITH {NAMED_SQL} SELECT atom_idx, CAST(chain AS VARCHAR) AS chain FROM named WHERE chain IN (1, 3, 7)")
def chain_filter(spark, sf_dir):
    a = named(spark, sf_dir).select("atom_idx", F.col("chain").cast("string").alias("chain"))
    return filters.in_chains(a, "137")


@query("pocket_filter", f"WITH {NAMED_SQL} SELECT atom_idx, chain || '_' || residue AS chain_resid FROM named WHERE (chain || '_' || residue) IN (SELECT chain || '_' || residue FROM named WHERE atom_idx % 50 = 0)")
def pocket_filter(spark, sf_dir):
    a = named(spark, sf_dir).select("atom_idx", F.concat_ws("_", F.col("chain").cast("string"), F.col("residue").cast("string")).alias("chain_resid"))
    return filters.in_pocket(a, a.where("atom_idx % 50 = 0"))


@query("confidence_filter", f"WITH {ATOMS_SQL} SELECT atom_idx, round(x * 200, 6) AS confidence FROM atoms WHERE NOT (atom_idx % 2 = 0) OR x * 200 >= 10")
def confidence_filter(spark, sf_dir):
    a = atoms(spark, sf_dir).select("atom_idx", (F.col("x") * 200).alias("confidence"), (F.col("atom_idx") % 2 == 0).alias("is_predicted"))
    return filters.confident(a, 10.0).select("atom_idx", *_r("confidence"))


@query("same_chain_flag", f"WITH {NAMED_SQL} SELECT atom_idx, CAST(chain = 2 AS INTEGER) AS same_chain, split_part(split_part('s' || structure || '_A.ent', '.', 1), '_', 1) AS code FROM named")
def same_chain_flag(spark, sf_dir):
    ensemble = F.concat(F.lit("s"), F.col("structure"), F.lit("_A.ent"))
    code = F.split_part(F.split_part(ensemble, F.lit("."), F.lit(1)), F.lit("_"), F.lit(1))
    return named(spark, sf_dir).select("atom_idx", (F.col("chain") == 2).cast("int").alias("same_chain"), code.alias("code"))


@query("suffix_rename", f"WITH {NAMED_SQL} SELECT chain AS chain0, residue AS residue0, atom_idx FROM named")
def suffix_rename(spark, sf_dir):
    return filters.with_suffix(named(spark, sf_dir).select("chain", "residue", "atom_idx"), "0", ["chain", "residue"])


@query("embed_environments", f"""WITH {NAMED_SQL}, known AS (SELECT * FROM named WHERE resname <> 'UNK'),
    k AS (SELECT *, (resname = 'CYS' AND name = 'SG') OR (resname = 'GLY' AND name = 'CA') OR (resname = 'ALA' AND name = 'CB') AS is_key FROM known),
    c AS (SELECT structure, model, chain, residue, resname, coalesce(avg(x) FILTER (is_key), avg(x) FILTER (name = 'CA')) AS x, coalesce(avg(y) FILTER (is_key), avg(y) FILTER (name = 'CA')) AS y, coalesce(avg(z) FILTER (is_key), avg(z) FILTER (name = 'CA')) AS z, arg_min(x, atom_idx) AS confidence FROM k GROUP BY ALL),
    env AS (SELECT a.structure, a.model, a.chain, a.residue, a.resname, a.confidence, b.atom_idx, b.x, b.y, b.z, CASE b.element WHEN 'C' THEN 0 WHEN 'N' THEN 1 WHEN 'O' THEN 2 ELSE 9 END AS t FROM c a JOIN named b ON a.structure = b.structure AND a.model = b.model AND a.chain = b.chain AND {D} <= 0.25),
    e AS (SELECT a.structure, a.model, a.chain, a.residue, count(*) AS n FROM env a JOIN env b ON a.structure = b.structure AND a.model = b.model AND a.chain = b.chain AND a.residue = b.residue AND a.atom_idx <> b.atom_idx AND {D} <= 0.15 GROUP BY ALL)
    SELECT g.structure, g.model, g.chain, CASE resname WHEN 'CYS' THEN 'C' WHEN 'GLY' THEN 'G' ELSE 'A' END || g.residue AS resid, round(confidence, 6) AS confidence, CAST(n_nodes AS DOUBLE) AS nodes, CAST(coalesce(n, 0) AS DOUBLE) AS edges, CAST(carbons AS DOUBLE) AS carbons
    FROM (SELECT structure, model, chain, residue, resname, confidence, count(*) AS n_nodes, count(*) FILTER (t = 0) AS carbons FROM env GROUP BY ALL) g LEFT JOIN e ON e.structure = g.structure AND e.model = g.model AND e.chain = g.chain AND e.residue = g.residue""")
def embed_environments(spark, sf_dir):
    """Functional centres, their environments and graphs over several structures
    and models; the plug-in encoder counts nodes, edges and carbons."""
    from .pipelines import embed_protein

    def counts(batch):
        carbon = [sum(n["atom_type"] == 0 for n in nodes) for nodes in batch["nodes"]]
        return [[float(len(n)), float(len(e)), float(c)] for n, e, c in zip(batch["nodes"], batch["edges"], carbon)]

    out = embed_protein(named(spark, sf_dir).withColumn("bfactor", F.col("x")), counts, radius=0.25, edge_radius=0.15)
    return out.select("structure", "model", "chain", "resid", *_r("confidence"), *[F.element_at("embedding", i + 1).alias(c) for i, c in enumerate(("nodes", "edges", "carbons"))])


@query("mutation_environments", f"""WITH {NAMED_SQL}, c AS (SELECT chain, residue, arg_min(x, atom_idx) AS x, arg_min(y, atom_idx) AS y, arg_min(z, atom_idx) AS z FROM named WHERE name = 'CA' GROUP BY chain, residue)
    SELECT a.chain, a.residue, b.atom_idx AS atom FROM c a JOIN named b ON {D} <= 0.2""")
def mutation_environments(spark, sf_dir):
    """Environments around the CA of mutated residues, over all chains."""
    a = named(spark, sf_dir)
    centers = spatial.ca_centers(a, ["chain", "residue"])
    return spatial.radius_join(centers, a.select("atom_idx", "x", "y", "z"), 0.2).select("chain", "residue", F.col("p_atom_idx").alias("atom"))


@query("interface_examples", f"""{PPI}, pos AS (SELECT DISTINCT a.residue AS residue0, b.residue AS residue1 FROM l a JOIN r b ON {D} < 0.2),
    neg AS (SELECT p.a AS residue0, p.b AS residue1 FROM (SELECT DISTINCT a.residue AS a, b.residue AS b FROM l a, r b) p LEFT JOIN pos ON pos.residue0 = p.a AND pos.residue1 = p.b WHERE pos.residue0 IS NULL),
    hp AS (SELECT *, residue0 * 1000003 + residue1 AS k FROM pos ORDER BY ((k * 48271 + 11) % 2147483647 * 69621 + 1) % 2147483647, k LIMIT 10),
    hn AS (SELECT *, residue0 * 1000003 + residue1 AS k FROM neg ORDER BY ((k * 48271 + 11) % 2147483647 * 69621 + 1) % 2147483647, k LIMIT (SELECT count(*) FROM hp)),
    p AS (SELECT residue0 AS residue FROM hp UNION SELECT residue0 FROM hn),
    c AS (SELECT residue, arg_min(x, atom_idx) AS x, arg_min(y, atom_idx) AS y, arg_min(z, atom_idx) AS z FROM l WHERE name = 'CA' AND residue IN (SELECT residue FROM p) GROUP BY residue)
    SELECT a.residue, b.atom_idx AS atom FROM c a JOIN l b ON {D} <= 0.3""")
def interface_examples(spark, sf_dir):
    """Environments of the first side of sampled interface pairs."""
    left, right = _sides(spark, sf_dir)
    key = (F.col("residue0") * 1_000_003 + F.col("residue1")).alias("k")
    pos = settle(spatial.interface_pairs(left, right, 0.2, ["residue"]).select("*", key))
    pairs = settle(sampling.label_sample(pos, sampling.hashed_negatives(left, right, pos, "residue", 1_000_003, 10), "k", 10))
    centers = spatial.ca_centers(left.join(pairs.select(F.col("residue0").alias("residue")).distinct(), "residue", "left_semi"), ["residue"])
    return spatial.radius_join(centers, left, 0.3).select("residue", F.col("p_atom_idx").alias("atom"))


M = "(({k} * 48271 + 11) % 2147483647 * 69621 + 1) % 2147483647"
STREAM_SQL = f"""WITH {NAMED_SQL}, pos AS (
        SELECT DISTINCT a.model, a.chain AS chain0, a.residue AS residue0, b.chain AS chain1, b.residue AS residue1 FROM named a JOIN named b ON a.model = b.model AND a.structure = '0' AND b.structure = '1' AND {D} < 0.1
    ), kp AS (SELECT *, (residue0 * 10 + chain0) * 1000003 + residue1 * 10 + chain1 AS k, count(*) OVER (PARTITION BY model) AS c FROM pos
    ), hp AS (SELECT * FROM kp QUALIFY row_number() OVER (PARTITION BY model ORDER BY {M.format(k='k')}, k) <= 10
    ), l AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY chain, residue) - 1 AS rn, count(*) OVER (PARTITION BY model) AS n FROM (SELECT DISTINCT model, chain, residue FROM named WHERE structure = '0')
    ), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY chain, residue) - 1 AS rn, count(*) OVER (PARTITION BY model) AS n FROM (SELECT DISTINCT model, chain, residue FROM named WHERE structure = '1')
    ), size AS (SELECT h.model, max(h.c) AS c, max(l.n) AS n, max(r.n) AS m, least(count(DISTINCT h.k), max(l.n) * max(r.n) - max(h.c)) AS wanted FROM hp h JOIN l ON l.model = h.model JOIN r ON r.model = h.model GROUP BY h.model
    ), d AS (SELECT *, unnest(range(wanted + c)) AS i FROM size
    ), p AS (SELECT model, wanted, m, i, (2147483647 * i + {M.format(k='CAST(model AS BIGINT)')}) % (n * m) AS place FROM d
    ), neg AS (
        SELECT p.model, p.wanted, p.i, l.chain AS chain0, l.residue AS residue0, r.chain AS chain1, r.residue AS residue1 FROM p JOIN l ON l.model = p.model AND l.rn = p.place // p.m JOIN r ON r.model = p.model AND r.rn = p.place % p.m
        ANTI JOIN pos ON pos.model = p.model AND pos.chain0 = l.chain AND pos.residue0 = l.residue AND pos.chain1 = r.chain AND pos.residue1 = r.residue
    ), hn AS (SELECT * FROM neg QUALIFY row_number() OVER (PARTITION BY model ORDER BY i) <= wanted)"""


@query("interface_stream", f"""{STREAM_SQL}
    SELECT model AS ensemble, chain0, residue0, chain1, residue1, CAST(1 AS INTEGER) AS label FROM hp UNION ALL SELECT model, chain0, residue0, chain1, residue1, CAST(0 AS INTEGER) FROM hn""")
def interface_stream(spark, sf_dir):
    """Labelled residue pairs of the two subunits of every ensemble, all chains."""
    return _stream(spark, sf_dir)[0]


@query("interface_stream_environments", f"""{STREAM_SQL}, x AS (
        SELECT model, '0' AS structure, chain0 AS chain, residue0 AS residue FROM hp UNION SELECT model, '0', chain0, residue0 FROM hn UNION SELECT model, '1', chain1, residue1 FROM hp UNION SELECT model, '1', chain1, residue1 FROM hn
    ), c AS (SELECT model, structure, chain, residue, arg_min(x, atom_idx) AS x, arg_min(y, atom_idx) AS y, arg_min(z, atom_idx) AS z FROM named JOIN x USING (model, structure, chain, residue) WHERE name = 'CA' GROUP BY ALL)
    SELECT a.model AS ensemble, CAST(a.structure AS INTEGER) AS side, a.chain, a.residue, b.atom_idx AS atom FROM c a JOIN named b ON a.model = b.model AND a.structure = b.structure AND {D} <= 0.3""")
def interface_stream_environments(spark, sf_dir):
    """The environments of both sides of those pairs."""
    _, one, two = _stream(spark, sf_dir)
    sides = [e.select("ensemble", F.lit(i).alias("side"), "chain", "residue", F.col("p_atom_idx").alias("atom")) for i, e in enumerate((one, two))]
    return sides[0].unionByName(sides[1])


def _stream(spark, sf_dir):
    from .pipelines import interface_examples as build

    a = named(spark, sf_dir).withColumnRenamed("model", "ensemble")
    key = (F.col("residue0") * 10 + F.col("chain0")) * 1_000_003 + F.col("residue1") * 10 + F.col("chain1")
    return build(a.where("structure = '0'"), a.where("structure = '1'"), 0.1, ["chain", "residue"], ["ensemble"], radius=0.3, pair_key=key, start=F.col("ensemble"))


@query("site_neighbor_environments", f"""WITH {NAMED_SQL}, near AS (SELECT DISTINCT b.chain, b.residue FROM named a JOIN named b ON {D} <= 0.1 WHERE a.residue % 25 = 0),
    c AS (SELECT n.chain, n.residue, arg_min(x, atom_idx) AS x, arg_min(y, atom_idx) AS y, arg_min(z, atom_idx) AS z FROM named n JOIN near USING (chain, residue) WHERE name = 'CA' GROUP BY n.chain, n.residue)
    SELECT a.chain, a.residue, b.atom_idx AS atom FROM c a JOIN named b ON {D} <= 0.2""")
def site_neighbor_environments(spark, sf_dir):
    from .pipelines import site_neighbor_environments as build

    a = named(spark, sf_dir)
    return build(a.where("residue % 25 = 0"), a, ["chain", "residue"], 0.1, 0.2).select("chain", "residue", F.col("p_atom_idx").alias("atom"))


LOWER20 = [x.lower() for x in tables.LETTERS[:20]]


@query("positive_pairs", f"""WITH {NAMED_SQL}, msa AS (SELECT doc_id, lang, translate(text, ' ' || chr(10), '--') AS seq FROM documents WHERE length(text) > 0),
    two AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ((doc_id * 48271 + 11) % 2147483647 * 69621 + 1) % 2147483647, doc_id) AS k FROM msa QUALIFY k <= 2),
    p AS (SELECT x.lang, x.doc_id AS rec0, y.doc_id AS rec1, x.seq AS s, y.seq AS t FROM two x JOIN two y ON x.lang = y.lang AND x.k = 1 AND y.k = 2),
    c AS (SELECT *, unnest(range(least(length(s), length(t)))) AS col FROM p),
    v AS (SELECT *, substr(s, col + 1, 1) AS letter0, substr(t, col + 1, 1) AS letter1 FROM c),
    d AS (SELECT * FROM v WHERE letter0 IN ({', '.join(f"'{x}'" for x in LOWER20)}) AND letter1 IN ({', '.join(f"'{x}'" for x in LOWER20)})
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY ((col * 48271 + 11) % 2147483647 * 69621 + 1) % 2147483647, col) <= 20),
    q AS (SELECT lang, col, rec0, rec1, length(replace(replace(substr(s, 1, col), '-', ''), 'X', '')) AS pos0, length(replace(replace(substr(t, 1, col), '-', ''), 'X', '')) AS pos1, letter0, letter1 FROM d),
    n AS (SELECT q.lang, q.col, substr(m.seq, q.col + 1, 1) AS ch, count(*) AS n FROM q JOIN msa m ON m.lang = q.lang AND length(m.seq) > q.col GROUP BY ALL),
    h AS (SELECT lang, col, 1 / (1 + log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS conservation FROM n WHERE ch <> '-' GROUP BY lang, col),
    k AS (SELECT *, (resname = 'CYS' AND name = 'SG') OR (resname = 'GLY' AND name = 'CA') OR (resname = 'ALA' AND name = 'CB') AS is_key FROM named),
    ctr AS (SELECT residue, coalesce(avg(x) FILTER (is_key), avg(x) FILTER (name = 'CA')) AS x, coalesce(avg(y) FILTER (is_key), avg(y) FILTER (name = 'CA')) AS y, coalesce(avg(z) FILTER (is_key), avg(z) FILTER (name = 'CA')) AS z FROM k GROUP BY residue),
    env AS (SELECT a.residue, count(*) AS n FROM ctr a JOIN named b ON {D} <= 0.25 GROUP BY a.residue)
    SELECT q.lang, CAST(q.col AS INTEGER) AS col, rec0, rec1, CAST(pos0 AS INTEGER) AS pos0, CAST(pos1 AS INTEGER) AS pos1, letter0, letter1, round(conservation, 6) AS conservation, e0.n AS atoms0, e1.n AS atoms1
    FROM q JOIN h ON h.lang = q.lang AND h.col = q.col LEFT JOIN env e0 ON e0.residue = (rec0 * 7 + pos0) % 100 LEFT JOIN env e1 ON e1.residue = (rec1 * 7 + pos1) % 100""")
def positive_pairs(spark, sf_dir):
    """Twenty common columns of two records of each family, with the conservation
    of the column and the environments of both residues."""
    from .pipelines import pair_environments
    from .pipelines import positive_pairs as draw

    pairs = settle(draw(aligned_rows(spark, sf_dir), "lang", "doc_id", "seq", LOWER20, 20))
    a = named(spark, sf_dir)
    place = lambda i: pairs.select(F.col(f"rec{i}").alias("rec"), F.col(f"pos{i}").alias("pos"), ((F.col(f"rec{i}") * 7 + F.col(f"pos{i}")) % 100).alias("residue"))
    residues = place(0).unionByName(place(1)).distinct().join(a.select("residue", "resname").distinct(), "residue")
    env = pair_environments(pairs, "lang", residues, a, ["residue", "resname"], 0.25, choose=F.lit(0))
    sizes = env.groupBy("lang", "col", "side").agg(F.count("*").alias("n"))
    for i in (0, 1):
        pairs = pairs.join(sizes.where(f"side = {i}").select("lang", "col", F.col("n").alias(f"atoms{i}")), ["lang", "col"], "left")
    return pairs.withColumn("conservation", F.round("conservation", 6))


@query("labelled_sites", f"""WITH {ATOMS_SQL}, r AS (SELECT a.atom_idx AS site, a.chain AS pdb, b.atom_idx, {D} AS dist, row_number() OVER (PARTITION BY a.atom_idx ORDER BY {D}, b.atom_idx) AS k FROM atoms a JOIN atoms b ON a.chain = b.chain AND b.atom_idx % 9 <> 0 WHERE a.atom_idx % 9 = 0)
    SELECT site, pdb, atom_idx, round(dist, 6) AS dist, CASE WHEN site % 2 = 1 THEN 'TP' ELSE 'TN' END AS kind FROM r WHERE k = 1""")
def labelled_sites(spark, sf_dir):
    from .pipelines import labelled_sites as build

    a = atoms(spark, sf_dir).withColumnRenamed("chain", "pdb")
    coords = a.where("atom_idx % 9 = 0").withColumn("label", (F.col("atom_idx") % 2).cast("int")).withColumnRenamed("atom_idx", "site")
    return build(coords, a.where("atom_idx % 9 <> 0"), held_out=False).withColumn("dist", F.round("dist", 6))


@query("subunit_roles", """WITH s AS (SELECT s_suppkey // 4 AS e, ['ligand_bound', 'receptor_bound', 'ligand_unbound', 'receptor_unbound'][s_suppkey % 4 + 1] AS part, s_suppkey FROM supplier), n AS (SELECT e, count(*) AS n FROM s GROUP BY e HAVING count(*) IN (2, 4)),
    u AS (SELECT s.e, n.n, 'x' || s.e || '_' || part AS u, part FROM s JOIN n ON n.e = s.e)
    SELECT e, CASE WHEN n = 2 THEN min(u) ELSE min(u) FILTER (part = 'ligand_bound') END AS ligand_bound, CASE WHEN n = 2 THEN max(u) ELSE min(u) FILTER (part = 'receptor_bound') END AS receptor_bound,
           CASE WHEN n = 2 THEN min(u) ELSE min(u) FILTER (part = 'ligand_unbound') END AS ligand_unbound, CASE WHEN n = 2 THEN max(u) ELSE min(u) FILTER (part = 'receptor_unbound') END AS receptor_unbound FROM u GROUP BY e, n""")
def subunit_roles(spark, sf_dir):
    from .pipelines import subunits

    part = F.element_at(F.array(*[F.lit(x) for x in ("ligand_bound", "receptor_bound", "ligand_unbound", "receptor_unbound")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey div 4").alias("e"), part.alias("part"))
    whole = s.groupBy("e").count().where("count IN (2, 4)").select("e")
    return subunits(s.join(whole, "e").withColumn("subunit", F.concat(F.lit("x"), F.col("e").cast("string"), F.lit("_"), "part")), ["e"])
