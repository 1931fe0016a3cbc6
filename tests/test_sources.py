"""Readers on small inline files, and the file stream."""

from __future__ import annotations

import gzip
import json

import pytest

from sitewise.sources import structures, tables
from sitewise.streaming.ingest import stream_structures

PDB = """MODEL        1
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00 75.00           N
ATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00 75.00           C
HETATM    3  O   HOH A 101      10.000   1.000   2.000  1.00 10.00           O
HETATM    4 ZN    ZN A 201       1.000   2.000   3.000  1.00 20.00          ZN
ENDMDL
MODEL        2
ATOM      5  N   ALA A   1      11.204   6.134  -6.504  1.00 75.00           N
bad line
"""
CIF = """data_x
loop_
_atom_site.group_PDB
_atom_site.auth_atom_id
_atom_site.auth_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.type_symbol
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.B_iso_or_equiv
_atom_site.pdbx_PDB_model_num
ATOM CA GLY B 7 C 1.0 2.0 3.0 50.5 1
HETATM "O5'" LIG B 8 O 1.5 2.0 3.0 ? 1
#
"""


def test_structures(spark, tmp_path):
    (tmp_path / "pdb1abc.ent.gz").write_bytes(gzip.compress(PDB.encode()))
    (tmp_path / "x.cif").write_text(CIF)
    (tmp_path / "empty.pdb").write_text("END\n")
    rows = structures.read_structures(spark, str(tmp_path)).orderBy("ensemble", "atom_idx").collect()
    pdb = [r for r in rows if r["ensemble"] == "pdb1abc.ent"]
    assert [(r["model"], r["hetero"], r["name"], r["element"]) for r in pdb] == [(1, " ", "N", "N"), (1, " ", "CA", "C"), (1, "W", "O", "O"), (1, "H_ZN", "ZN", "ZN"), (2, " ", "N", "N")]
    cif = [r for r in rows if r["ensemble"] == "x.cif"]
    assert [(r["chain"], r["residue"], r["name"], r["bfactor"]) for r in cif] == [("B", 7, "CA", 50.5), ("B", 8, "O5'", None)]
    names = {r["pdb"]: r["is_predicted"] for r in structures.list_files(spark, str(tmp_path)).collect()}
    assert names["1abc"] is False and names["empty"] is False


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdb").write_text(PDB)
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    stream_structures(spark, *args).awaitTermination(120)
    (tmp_path / "in" / "b.pdb").write_text(PDB)
    stream_structures(spark, *args).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("ensemble").count().collect()
    assert {r["ensemble"]: r["count"] for r in got} == {"a.pdb": 5, "b.pdb": 5}


def test_lists_and_alignments(spark, tmp_path):
    (tmp_path / "x.pos").write_text("12AS\tA\t104\n1FFY\tA\t2A\n")
    assert [tuple(r) for r in tables.read_residue_list(spark, str(tmp_path / "x.pos")).collect()] == [("12AS", "A", "104"), ("1FFY", "A", "2A")]
    (tmp_path / "s.csv").write_text('site,pdb,locs,source,desc\nEGF,1abcA,"[1, 2, 3]",P,"a, b"\n')
    r = tables.read_site_list(spark, str(tmp_path / "s.csv")).first()
    assert (r["pdb"], r["chain"], r["locs"], r["desc"]) == ("1abc", "A", [1, 2, 3], "a, b")
    (tmp_path / "c.json").write_text(json.dumps({"1abc": {"coords": [[1, 2, 3], [4, 5, 6]], "labels": [1, 0]}}))
    assert sorted(tuple(x) for x in tables.read_site_coordinates(spark, str(tmp_path / "c.json")).collect()) == [("1abc", 1.0, 2.0, 3.0, 1), ("1abc", 4.0, 5.0, 6.0, 0)]
    (tmp_path / "m.fasta").write_text(">a|pdb|1ABC|A first\nAC-\nDE\n>b\nGG\n")
    assert [(x["id"], x["seq"]) for x in tables.read_fasta(spark, str(tmp_path / "m.fasta")).orderBy("ord").collect()] == [("a|pdb|1ABC|A", "AC-DE"), ("b", "GG")]


def test_feature_vectors(spark, tmp_path):
    (tmp_path / "f.ff").write_text("# PDBID_LIST p1, p2\n# other\nE1 1.0 2.0 # a b c d\nE2 3.0 4.0 # a b c d\n")
    rows = tables.read_feature_vectors(spark, str(tmp_path / "f.ff")).orderBy("ord").collect()
    assert [(r["name"], r["vector"]) for r in rows] == [("p1", [1.0, 2.0]), ("p2", [3.0, 4.0])]
    (tmp_path / "g.ff").write_text("# PDBID_LIST p1, p2\nE1 1.0 2.0 # a b c d\n")
    with pytest.raises(Exception, match="differ in number"):
        tables.read_feature_vectors(spark, str(tmp_path / "g.ff")).collect()


def test_keyed_union_and_resume(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b")], "k int, v string")
    assert sorted(tuple(r) for r in tables.keyed_union([a, b], ["k"]).collect()) == [(1, "a"), (2, "b")]
    assert [r["k"] for r in tables.new_records(a, b, ["k"]).collect()] == [1]


def test_id_lists(spark, tmp_path):
    rows = [("1abc", 1, "G2"), ("1abc", 0, "A1"), ("2xyz", 0, "H9\""), (None, 0, "A1"), ("3nul", 0, None)]
    out = str(tmp_path / "ids")
    tables.write_id_lists(spark.createDataFrame(rows, "pdb string, ord int, resid string"), out)
    want = [("1abc", 0, "A1"), ("1abc", 1, "G2"), ("2xyz", 0, "H9\"")]
    assert sorted(map(tuple, tables.read_id_lists(spark, out).collect())) == want
    (tmp_path / "more.json").write_text('{"4abc": ["A1"], "5emp": [], "6nul": null}\nno object\n\n')
    assert [tuple(r) for r in tables.read_id_lists(spark, str(tmp_path / "more.json")).collect()] == [("4abc", 0, "A1")]
    empty = spark.createDataFrame([], "pdb string, ord int, resid string")
    tables.write_id_lists(empty, str(tmp_path / "none"))
    assert tables.read_id_lists(spark, str(tmp_path / "none")).count() == 0
