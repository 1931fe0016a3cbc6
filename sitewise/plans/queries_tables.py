"""Queries of folds, unions, id parsing, lookups and labelled joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import tables
from ..operators import filters, sampling
from ..registry import query
from .standins import DB_SQL, site_db, table

H = "((({k}) * 48271 + {s}) % 2147483647 * 69621 + 1) % 2147483647"


@query("array_split_chunks", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN rn < (n % 7) * (n // 7 + 1) THEN rn // (n // 7 + 1) ELSE n % 7 + (rn - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS chunk FROM r""")
def array_split_chunks(spark, sf_dir):
    r = sampling.ranked(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return r.select("o_orderkey", sampling.array_split(F.col("rn"), F.col("total"), 7).alias("chunk"))


@query("group_folds", """WITH f AS (SELECT c_nationkey, min(c_custkey) AS first FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first, c_nationkey) - 1 AS rn, count(*) OVER () AS n FROM f)
    SELECT c.c_custkey, c.c_nationkey, CAST(CASE WHEN rn < (n % 10) * (n // 10 + 1) THEN rn // (n // 10 + 1) ELSE n % 10 + (rn - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) END AS INTEGER) AS fold FROM customer c JOIN r ON r.c_nationkey = c.c_nationkey""")
def group_folds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return sampling.group_folds(c, "c_nationkey", "c_custkey", 10).select("c_custkey", "c_nationkey", "fold")


@query("stratified_folds", f"SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {H.format(k='doc_id', s=2 * 7919 + 11)}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(table(spark, sf_dir, "labels"), "quality", "doc_id", 5).select("doc_id", "quality", "fold")


@query("leave_one_fold_out", """WITH r AS (SELECT doc_id, quality, CAST(doc_id % 5 AS INTEGER) AS fold FROM labels), f AS (SELECT DISTINCT fold FROM r)
    SELECT f.fold, count(*) FILTER (r.fold = f.fold) AS n_test, count(*) FILTER (r.fold <> f.fold) AS n_train, CAST(sum(quality) FILTER (r.fold <> f.fold) AS BIGINT) AS pos_train FROM r, f GROUP BY f.fold""")
def leave_one_fold_out(spark, sf_dir):
    r = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 5).cast("int").alias("f")).agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("p"))
    total = Window.partitionBy(F.lit(1))
    return r.select(F.col("f").alias("fold"), F.col("n").alias("n_test"), (F.sum("n").over(total) - F.col("n")).alias("n_train"), (F.sum("p").over(total) - F.col("p")).alias("pos_train"))


@query("query_sample", f"SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY {H.format(k='doc_id', s=11)}, doc_id LIMIT 8")
def query_sample(spark, sf_dir):
    return sampling.take_hashed(table(spark, sf_dir, "labels").where("toxic = 1"), 8, "doc_id").select("doc_id")


@query("subsample_positives", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {H.format(k='doc_id', s=11)}, doc_id) AS k FROM labels)
    SELECT doc_id, quality, CASE WHEN quality = 1 AND k > 50 THEN 'validation' ELSE 'train' END AS part FROM r""")
def subsample_positives(spark, sf_dir):
    """Positives beyond the first 50 by hash go to the validation part."""
    w = Window.partitionBy("quality").orderBy(sampling.mixed(F.col("doc_id")), "doc_id")
    part = F.when((F.col("quality") == 1) & (F.row_number().over(w) > 50), "validation").otherwise("train")
    return table(spark, sf_dir, "labels").select("doc_id", "quality", part.alias("part"))


@query("nested_folds", f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {H.format(k='doc_id', s=2 * 7919 + 11)}, doc_id) - 1 AS rn FROM labels), o AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS outer_fold),
    x AS (SELECT *, quality = 1 AND rn >= 100 AS extra, rn % 5 AS own FROM r, o)
    SELECT doc_id, quality, outer_fold, CASE WHEN extra THEN 'validation' WHEN own = outer_fold THEN 'test' ELSE 'train' END AS role,
           CAST(CASE WHEN NOT extra AND own <> outer_fold THEN (rn // 5 * 4 + own - CASE WHEN own > outer_fold THEN 1 ELSE 0 END) % 5 END AS INTEGER) AS inner_fold FROM x""")
def nested_folds(spark, sf_dir):
    """Outer and inner folds of one rank; positives beyond 100 join every validation."""
    out = sampling.nested_folds(table(spark, sf_dir, "labels"), "quality", "doc_id", 5, 5, held_back=100)
    return out.withColumnsRenamed({"outer": "outer_fold", "inner": "inner_fold"})


@query("residue_sample", """WITH p AS (SELECT l_orderkey % 20 AS g, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey % 20 ORDER BY l_partkey) - 1 AS rn, count(*) OVER (PARTITION BY l_orderkey % 20) AS n, min(l_partkey) OVER (PARTITION BY l_orderkey % 20) AS lo FROM (SELECT DISTINCT l_orderkey % 20 AS l_orderkey, l_partkey FROM lineitem)),
    d AS (SELECT DISTINCT g, n, lo FROM p) SELECT d.g, CAST(t.i AS INTEGER) AS draw, p.k FROM d, range(5) t(i), p WHERE p.g = d.g AND p.rn = """ + H.format(k="d.lo * 5 + t.i", s=11) + " % d.n")
def residue_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("g"), F.col("l_partkey").alias("k")).distinct()
    return sampling.draws(rows, 5, "k", ["g"]).select("g", "draw", "k")


@query("label_embedding_join", f"""WITH {DB_SQL}, s AS (SELECT 'P' || (doc_id % 60) AS pdb, CASE WHEN doc_id % 9 = 0 THEN (doc_id % 7) || 'A' ELSE CAST(doc_id % 7 AS VARCHAR) END AS residue, quality AS label, doc_id FROM labels)
    SELECT s.doc_id, lower(s.pdb) || '_' || 'A' AS pdb_chain, s.residue, s.label, db.id FROM s JOIN db ON 'p' || db.pdb = lower(s.pdb) AND CAST(db.id % 5 AS VARCHAR) = s.residue""")
def label_embedding_join(spark, sf_dir):
    """Labels meet embeddings by chain and residue text; insertion codes find none."""
    i = F.col("doc_id")
    residue = F.when(i % 9 == 0, F.concat((i % 7).cast("string"), F.lit("A"))).otherwise((i % 7).cast("string"))
    s = table(spark, sf_dir, "labels").select("doc_id", F.concat_ws("_", F.lower(F.concat(F.lit("P"), (i % 60).cast("string"))), F.lit("A")).alias("pdb_chain"), residue.alias("residue"), F.col("quality").alias("label"))
    db = site_db(spark, sf_dir).select("id", F.concat(F.lit("p"), F.col("pdb").cast("string"), F.lit("_A")).alias("pdb_chain"), (F.col("id") % 5).cast("string").alias("residue"))
    return s.join(db, ["pdb_chain", "residue"]).select("doc_id", "pdb_chain", "residue", "label", "id")


@query("benchmark_build", """WITH b AS (SELECT doc_id AS ord, source AS chain, quality AS label FROM labels JOIN documents USING (doc_id)), o AS (SELECT *, (1 - label) * 1000000000 + ord AS o FROM b),
    f AS (SELECT chain, min(o) AS first FROM o GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first, chain) - 1 AS rn, count(*) OVER () AS n FROM f)
    SELECT ord, o.chain, label, CAST(CASE WHEN rn < (n % 10) * (n // 10 + 1) THEN rn // (n // 10 + 1) ELSE n % 10 + (rn - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) END AS INTEGER) AS fold FROM o JOIN r ON r.chain = o.chain""")
def benchmark_build(spark, sf_dir):
    """Both classes in one list, positives first; groups get contiguous folds."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("chain"))
    b = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("ord"), "chain", F.col("quality").alias("label"))
    o = b.withColumn("o", (1 - F.col("label")) * F.lit(1000000000).cast("long") + F.col("ord"))
    return sampling.group_folds(o, "chain", "o", 10).select("ord", "chain", "label", "fold")


@query("family_build", """WITH m AS (SELECT l.doc_id, l.quality, d.source AS family FROM labels l JOIN documents d USING (doc_id) WHERE l.toxic = 1), n AS (SELECT family FROM m GROUP BY 1 HAVING count(*) >= 2)
    SELECT doc_id, family FROM m WHERE family IN (SELECT family FROM n)""")
def family_build(spark, sf_dir):
    from .pipelines import families

    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pdb_chain"), F.col("source").alias("family"))
    structures = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("pdb_chain"))
    return families(records, structures, "family").select(F.col("pdb_chain").alias("doc_id"), "family")


@query("keyed_union", "WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem) SELECT l_orderkey, max(l_linenumber) AS l_linenumber, arg_max(l_quantity, (l_linenumber, l_quantity)) AS l_quantity FROM u GROUP BY l_orderkey")
def keyed_union(spark, sf_dir):
    """Keyed overwrite: of rows with one key the last file (line) wins,
    and of equal lines the larger quantity."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rows.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"), F.max_by("l_quantity", F.struct("l_linenumber", "l_quantity")).alias("l_quantity"))


@query("union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")))


@query("union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, sf_dir):
    return union_all(spark, sf_dir).distinct()


@query("intersect_ids", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("except_ids", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti").distinct()


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("sorted_unique", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS place FROM (SELECT DISTINCT doc_id FROM labels)")
def sorted_unique(spark, sf_dir):
    r = sampling.ranked(table(spark, sf_dir, "labels").select("doc_id").distinct(), ["doc_id"])
    return r.select("doc_id", (F.col("rn") + 1).cast("int").alias("place"))


@query("hits_by_residue", """SELECT l_returnflag AS site, l_linestatus AS source, CAST(l_linenumber AS VARCHAR) AS residue, count(DISTINCT l_suppkey || ': ' || (l_partkey % 10)) AS n_hits, count(DISTINCT l_suppkey) AS n_pdbs FROM lineitem GROUP BY ALL""")
def hits_by_residue(spark, sf_dir):
    """The nested report, flat: distinct evidence of each site, source, residue."""
    e = F.concat_ws(": ", F.col("l_suppkey").cast("string"), (F.col("l_partkey") % 10).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("site"), F.col("l_linestatus").alias("source"), F.col("l_linenumber").cast("string").alias("residue")).agg(F.countDistinct(e).alias("n_hits"), F.countDistinct("l_suppkey").alias("n_pdbs"))


@query("dataset_sizes", "SELECT lang, count(*) AS n_rows, CAST(sum(len(string_split(source, 'r'))) AS BIGINT) AS n_locs FROM documents GROUP BY lang")
def dataset_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum(F.size(F.split("source", "r"))).alias("n_locs"))


NAMES = ["a/pdb1abc.ent.gz", "x/AF-P1-F1.pdb", "AF-P1-F1.cif", "1abc.cif", "dir/2xyz.pdb", "d/AF-Q9-F2.cif.gz"]


@query("id_parse", "WITH f AS (SELECT s_suppkey AS k, [" + ", ".join(f"'{n}'" for n in NAMES) + """][s_suppkey % 6 + 1] AS f FROM supplier)
    SELECT k, f AS path, CASE WHEN ends_with(f, '.ent.gz') THEN substr(regexp_extract(f, '[^/]*$'), 4, 4) WHEN ends_with(f, '.pdb') THEN regexp_replace(regexp_extract(f, '[^/]*$'), '....$', '') WHEN contains(f, 'AF') THEN split_part(f, '-', 2) END AS pdb,
           CASE WHEN ends_with(f, '.ent.gz') OR ends_with(f, '.pdb') THEN false WHEN contains(f, 'AF') THEN true END AS predicted FROM f""")
def id_parse(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), path.alias("path"))
    return rows.select("k", "path", C.structure_id(F.col("path")).alias("pdb"), C.is_predicted(F.col("path")).alias("predicted"))


RECORDS = ["gi|1|pdb|1ABC|B", "gi|2|pdb|2XYZ|", "gi|3|sp|P12345", "1abc_A", "gi|4|pdb||C"]


@query("record_ids", "WITH r AS (SELECT s_suppkey AS k, [" + ", ".join(f"'{n}'" for n in RECORDS) + """][s_suppkey % 5 + 1] AS r FROM supplier)
    SELECT k, CASE WHEN split_part(r, '|', 3) = 'pdb' AND split_part(r, '|', 4) <> '' THEN lower(split_part(r, '|', 4)) || '_' || CASE WHEN split_part(r, '|', 5) = '' THEN 'A' ELSE split_part(r, '|', 5) END WHEN split_part(r, '|', 3) = 'sp' THEN split_part(r, '|', 4) || '_A' END AS chain FROM r""")
def record_ids(spark, sf_dir):
    r = F.element_at(F.array(*[F.lit(n) for n in RECORDS]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), C.record_chain(r).alias("chain"))


@query("mutation_parse", "SELECT p_partkey, substr(m, 2, 1) AS chain, CAST(substr(m, 3, length(m) - 3) AS INTEGER) AS residue FROM (SELECT p_partkey, 'A' || chr(CAST(65 + p_partkey % 4 AS INTEGER)) || (p_partkey % 300) || 'G' AS m FROM part)")
def mutation_parse(spark, sf_dir):
    name = F.concat(F.lit("1abc_"), F.lit("A"), F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("p_partkey") % 4 + 1).cast("int")), (F.col("p_partkey") % 300).cast("string"), F.lit("G"))
    return table(spark, sf_dir, "part").select("p_partkey", C.mutation_site(name).alias("m")).select("p_partkey", "m.chain", "m.residue")


@query("resid_parts", "SELECT c_custkey, substr(r, 1, 1) AS letter, TRY_CAST(substr(r, 2) AS INTEGER) AS number, substr(c_name, 1, 4) AS code, replace(replace(c_name, 'Customer', 'bound'), 'bound', 'unbound') AS other FROM (SELECT *, ['H', 'A', 'X'][c_custkey % 3 + 1] || (c_custkey % 400) || CASE WHEN c_custkey % 11 = 0 THEN 'A' ELSE '' END AS r FROM customer)")
def resid_parts(spark, sf_dir):
    i = F.col("c_custkey")
    letter = F.element_at(F.array(F.lit("H"), F.lit("A"), F.lit("X")), (i % 3 + 1).cast("int"))
    resid = F.concat(C.render_resid(letter, i % 400), F.when(i % 11 == 0, "A").otherwise(""))
    other = F.replace(F.replace("c_name", F.lit("Customer"), F.lit("bound")), F.lit("bound"), F.lit("unbound"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.resid_letter(resid).alias("letter"), C.resid_number(resid).alias("number"), F.substring("c_name", 1, 4).alias("code"), other.alias("other"))


RECORD_SQL = "SELECT s_suppkey AS id_key, ['gi|12|pdb|1ABC|A', 'gi|7|sp|P69905|HBA', '1abc_A', 'P69905_A', '2xyz'][s_suppkey % 5 + 1] AS id FROM supplier"


@query("record_classes", f"WITH r AS ({RECORD_SQL}) SELECT id_key, 'structure' AS class, false AS predicted FROM r WHERE contains(id, '|pdb|') UNION ALL SELECT id_key, 'structure', true FROM r WHERE contains(id, '|pdb|') OR contains(id, '|sp|') UNION ALL SELECT id_key, 'sequence', false FROM r WHERE NOT contains(id, '|') AND length(split_part(id, '_', 1)) = 4 UNION ALL SELECT id_key, 'sequence', true FROM r WHERE NOT contains(id, '|')")
def record_classes(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("gi|12|pdb|1ABC|A", "gi|7|sp|P69905|HBA", "1abc_A", "P69905_A", "2xyz")])
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id_key"), F.element_at(names, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("id"))
    kinds = {"structure": filters.structure_records, "sequence": filters.sequence_records}
    parts = [keep(r, p).select("id_key", F.lit(k).alias("class"), F.lit(p).alias("predicted")) for k, keep in kinds.items() for p in (False, True)]
    return reduce(DataFrame.unionByName, parts)


@query("unbound_names", "SELECT p_partkey, 'l_unbound' AS subunit0, 'x' || p_partkey || '_u_1' AS structure0, 'r_unbound' AS subunit1, p_name AS structure1 FROM part")
def unbound_names(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.lit("l_bound").alias("subunit0"), F.concat(F.lit("x"), F.col("p_partkey").cast("string"), F.lit("_b_1")).alias("structure0"), F.lit("r_bound").alias("subunit1"), F.col("p_name").alias("structure1"))
    return filters.to_unbound(pairs)


def _case(col: str, mapping: dict, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


@query("residue_maps", "WITH r AS (SELECT p_partkey, [" + ", ".join(f"'{r}'" for r in tables.RESIDUES + ["HOH"]) + "][p_partkey % 22 + 1] AS resname FROM part), l AS (SELECT *, " + _case("resname", tables.residue_letters(), "'X'") + " AS letter FROM r) SELECT p_partkey, resname, letter, " + _case("letter", {x: i for i, x in enumerate(tables.LABEL_ORDER)}, "20") + " AS label, " + _case("resname", tables.residue_groups(), "NULL") + " AS grp, " + _case("letter", dict(zip(tables.LETTERS, tables.RESIDUES)), "'UNK'") + " AS back FROM l")
def residue_maps(spark, sf_dir):
    names = F.array(*[F.lit(r) for r in tables.RESIDUES + ["HOH"]])
    r = table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 22 + 1).cast("int")).alias("resname"))
    r = r.withColumn("letter", C.residue_to_letter(F.col("resname")))
    return r.select("p_partkey", "resname", "letter", C.letter_to_label(F.col("letter")).alias("label"), C.residue_group(F.col("resname")).alias("grp"), C.letter_to_residue(F.col("letter")).alias("back"))


ELEMENTS = ["C", "N", "O", "F", "S", "Cl", "CL", "P", "Se", "Fe", "ZN", "Ca", "Mg", "Xx"]


@query("element_map", "SELECT p_partkey, e AS element, " + _case("e", tables.element_labels(), "12") + " AS label FROM (SELECT p_partkey, [" + ", ".join(f"'{e}'" for e in ELEMENTS) + "][p_partkey % 14 + 1] AS e FROM part)")
def element_map(spark, sf_dir):
    e = F.element_at(F.array(*[F.lit(x) for x in ELEMENTS]), (F.col("p_partkey") % 14 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", e.alias("element"), C.element_label(e).alias("label"))


@query("class_names", "SELECT p_partkey, c AS code, " + _case("c", {k: i for i, k in enumerate(tables.SECONDARY)}, "NULL") + " AS label, " + _case("c", tables.SECONDARY, "NULL") + " AS name, " + _case("s", tables.SITE_RESIDUES, "NULL") + " AS site_residue FROM (SELECT p_partkey, ['H', 'B', 'E', 'G', 'I', 'T', 'S', '-', 'Z'][p_partkey % 9 + 1] AS c, ['EGF_1', 'INSULIN', 'OTHER'][p_partkey % 3 + 1] AS s FROM part)")
def class_names(spark, sf_dir):
    c = F.element_at(F.array(*[F.lit(x) for x in [*tables.SECONDARY, "Z"]]), (F.col("p_partkey") % 9 + 1).cast("int"))
    s = F.element_at(F.array(*[F.lit(x) for x in ("EGF_1", "INSULIN", "OTHER")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("code"), C.secondary_label(c).alias("label"), C.lookup(tables.SECONDARY, c).alias("name"), C.site_residue(s).alias("site_residue"))


@query("label_filters", "SELECT doc_id, CASE WHEN t IN ('TP', 'FN') THEN 1 ELSE 0 END AS label, t AS kind FROM (SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'FN' ELSE 'TP' END ELSE CASE WHEN toxic = 1 THEN 'FP' ELSE 'TN' END END AS t FROM labels) WHERE t IN ('TP', 'FN', 'FP')")
def label_filters(spark, sf_dir):
    kind = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "FN").otherwise("TP")).otherwise(F.when(F.col("toxic") == 1, "FP").otherwise("TN"))
    rows = table(spark, sf_dir, "labels").select("doc_id", kind.alias("kind")).where(F.col("kind").isin("TP", "FN", "FP"))
    return rows.select("doc_id", C.lookup({"TP": 1, "FN": 1, "TN": 0, "FP": 0}, F.col("kind")).alias("label"), "kind")


@query("lookup_join", "SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size = l.l_linenumber")
def lookup_join(spark, sf_dir):
    """Equi-join of rows to a table of tensors by a composite key; misses drop out."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("l_linenumber"), "p_name")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, ["l_partkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "p_name")


@query("site_list_join", f"WITH {DB_SQL}, s AS (SELECT n_nationkey AS site, unnest([n_nationkey, n_nationkey + 30, n_nationkey + 60]) AS loc FROM nation) SELECT s.site, db.id, db.letter FROM s JOIN db ON db.id = s.loc")
def site_list_join(spark, sf_dir):
    """Site lists read from text with an explicit schema, exploded and joined."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("["), k.cast("string"), F.lit(", "), (k + 30).cast("string"), F.lit(", "), (k + 60).cast("string"), F.lit("]"))
    sites = table(spark, sf_dir, "nation").select(k.alias("site"), F.explode(F.from_json(text, "array<int>")).alias("loc"))
    return sites.join(site_db(spark, sf_dir), F.col("loc") == F.col("id")).select("site", "id", "letter")


@query("existence_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def existence_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("null_filter", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'click' AND props IS NOT NULL")
def null_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'click'").dropna(subset=["props"])
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("record_pair_sample", f"WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {H.format(k='doc_id', s=11)}, doc_id) AS k FROM documents) SELECT lang, doc_id FROM r WHERE k <= 2")
def record_pair_sample(spark, sf_dir):
    return sampling.take_hashed(table(spark, sf_dir, "documents").select("lang", "doc_id"), 2, "doc_id", ["lang"])


@query("key_group_choice", f"SELECT p_partkey, CAST({H.format(k='p_partkey', s=11)} % 2 AS INTEGER) AS choice FROM part")
def key_group_choice(spark, sf_dir):
    """A seeded uniform choice between two functional groups."""
    return table(spark, sf_dir, "part").select("p_partkey", (sampling.mixed(F.col("p_partkey")) % 2).cast("int").alias("choice"))


@query("hash_shuffle", f"SELECT s_suppkey, CAST(row_number() OVER (ORDER BY {H.format(k='s_suppkey', s=11)}, s_suppkey) AS INTEGER) AS place FROM supplier")
def hash_shuffle(spark, sf_dir):
    h = table(spark, sf_dir, "supplier").select("s_suppkey", sampling.mixed(F.col("s_suppkey")).alias("h"))
    return sampling.ranked(h, ["h", "s_suppkey"]).select("s_suppkey", (F.col("rn") + 1).cast("int").alias("place"))
