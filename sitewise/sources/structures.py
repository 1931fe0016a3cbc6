"""Readers of structure files: PDB's fixed columns and mmCIF's atom loop, gzip too.

Files are read whole by Spark's binary source, so any file system it knows
works, and parsed where they are read. One file is one row's worth of memory;
more files are more tasks.
"""

from __future__ import annotations

import gzip
import shlex
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_predicted, structure_id

ATOM_SCHEMA = "path string, ensemble string, structure string, model int, chain string, hetero string, residue int, insertion string, resname string, name string, element string, x double, y double, z double, bfactor double, atom_idx long"
_FIELDS = [x.split()[0] for x in ATOM_SCHEMA.split(", ")]


def _number(text: str) -> int:
    """A whole number of PDB's columns: decimal, or hybrid-36 where it needs more
    digits than there are (a capital first, then small letters)."""
    t = text.strip()
    if len(t) != len(text) or not t.isalnum() or not t[0].isalpha() or t not in (t.upper(), t.lower()):
        return int(t)
    low, span = 10 ** len(t), 26 * 36 ** (len(t) - 1)
    return int(t, 36) - 10 * 36 ** (len(t) - 1) + low + span * t.islower()


def _hetero(record: str, resname: str) -> str:
    return " " if record == "ATOM" else "W" if resname in ("HOH", "WAT") else f"H_{resname}"


def parse_pdb(text: str) -> list[dict]:
    """Atoms of a PDB text; lines that are not atoms or lack a place are skipped."""
    out, model = [], 0
    for line in text.splitlines():
        record = line[:6].strip()
        if record == "MODEL":
            token = line[6:].split()
            model = int(token[0]) if token and token[0].isdigit() else model + 1
        if record not in ("ATOM", "HETATM"):
            continue
        try:
            x, y, z = float(line[30:38]), float(line[38:46]), float(line[46:54])
            residue = _number(line[22:26])
        except ValueError:
            continue
        name, resname = line[12:16].strip(), line[17:20].strip()
        element = line[76:78].strip() or name.lstrip("0123456789")[:1]
        b = line[60:66].strip()
        out.append({"model": model, "chain": line[21:22].strip(), "hetero": _hetero(record, resname), "residue": residue, "insertion": line[26:27].strip(), "resname": resname, "name": name, "element": element, "x": x, "y": y, "z": z, "bfactor": float(b) if b else None})
    return out


def parse_mmcif(text: str) -> list[dict]:
    """Atoms of the _atom_site loop of an mmCIF text."""
    out, names, loop = [], [], False
    for line in text.splitlines():
        s = line.strip()
        if s == "loop_":
            names, loop = [], True
        elif loop and s.startswith("_atom_site."):
            names.append(s.split(".", 1)[1].split()[0])
        elif names and (not s or s[0] in "#_"):
            if out:
                break
            names, loop = [], False
        elif names and loop:
            values = s.split() if '"' not in s and "'" not in s else shlex.split(s)
            r = dict(zip(names, values))
            get = lambda *keys: next((r[k] for k in keys if r.get(k) not in (None, "?", ".")), "")
            try:
                x, y, z, residue = float(r["Cartn_x"]), float(r["Cartn_y"]), float(r["Cartn_z"]), int(get("auth_seq_id", "label_seq_id"))
            except (KeyError, ValueError):
                continue
            resname = get("auth_comp_id", "label_comp_id")
            b = get("B_iso_or_equiv")
            out.append({"model": int(get("pdbx_PDB_model_num") or 0), "chain": get("auth_asym_id", "label_asym_id"), "hetero": _hetero(get("group_PDB"), resname), "residue": residue, "insertion": get("pdbx_PDB_ins_code"), "resname": resname, "name": get("auth_atom_id", "label_atom_id"), "element": get("type_symbol"), "x": x, "y": y, "z": z, "bfactor": float(b) if b else None})
    return out


def parse_structure(path: str, content: bytes) -> list[dict]:
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    text = raw.decode("utf8", "replace")
    base = path.rsplit("/", 1)[-1]
    atoms = parse_mmcif(text) if ".cif" in base else parse_pdb(text)
    name = base.removesuffix(".gz")
    return [a | {"path": path, "ensemble": name, "structure": name, "atom_idx": i} for i, a in enumerate(atoms)]


def _tried(path: str, content: bytes | None) -> tuple[list[dict], str | None]:
    """The atoms of a file, and why there are none if it can't be read."""
    if not content:
        return [], "empty file"
    try:
        rows = parse_structure(path, content)
    except (EOFError, OSError, ValueError, zlib.error) as e:  # a cut or damaged archive, numbers that are none
        return [], f"{type(e).__name__}: {e}"
    return rows, None if rows else "no atoms"


def atoms_of(files: DataFrame) -> DataFrame:
    """The atom table of rows path, content (binary); files that can't be read
    give no rows, and ``file_report`` names them."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, _ = _tried(path or "", content)
                if rows:
                    yield from pa.Table.from_pylist([{f: r[f] for f in _FIELDS} for r in rows], schema=_arrow()).to_batches()

    return files.select("path", "content").mapInArrow(run, ATOM_SCHEMA)


def file_report(files: DataFrame) -> DataFrame:
    """path, n_atoms and problem (null if there is none) of rows path, content."""

    def run(batches):
        for b in batches:
            tried = [_tried(p or "", c) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r, _ in tried], pa.int64()), pa.array([e for _, e in tried], pa.string())], ["path", "n_atoms", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, n_atoms long, problem string")


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ATOM_SCHEMA.split(", "))])


def structure_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and content of all files below ``path`` whose name fits."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_structures(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """The atom table of all structure files below ``path`` whose name fits."""
    return atoms_of(structure_files(spark, path, glob))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, pdb and is_predicted of all files below ``path``."""
    files = structure_files(spark, path, glob).select("path")
    return files.select("path", structure_id(F.col("path")).alias("pdb"), is_predicted(F.col("path")).alias("is_predicted"))


def _hybrid(n: Column, width: int) -> Column:
    """A whole number in ``width`` characters, hybrid-36 where decimal has no room;
    an error where that has none either."""
    low, span, base = 10**width, 26 * 36 ** (width - 1), 10 * 36 ** (width - 1)
    letters = lambda lowest: F.conv((n - lowest + base).cast("string"), 10, 36)
    too_long = F.raise_error(F.concat(n.cast("string"), F.lit(f" has no room in {width} columns of a PDB file")))
    fits = F.when((n < low) & (n > -(10 ** (width - 1))), F.lpad(n.cast("string"), width, " "))
    return fits.when((n >= low) & (n < low + span), letters(low)).when((n >= low + span) & (n < low + 2 * span), F.lower(letters(low + span))).when(n.isNotNull(), too_long)


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """Adds value: each atom as a line of PDB's fixed columns, places to three
    digits, residue numbers above 9,999 in hybrid-36 (up to 2,436,111)."""
    text = F.format_string(
        "%-6s%5d %-4s %3s %1s%4s    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s",
        F.when(F.col("hetero") == " ", "ATOM").otherwise("HETATM"), F.col("atom_idx") % 100_000, "name", "resname", F.col("chain").cast("string"),
        _hybrid(F.col("residue"), 4), "x", "y", "z", F.lit(1.0), F.coalesce("bfactor", F.lit(0.0)), "element",
    )
    return atoms.withColumn("value", text)


def write_structures(atoms: DataFrame, path: str, key: str = "structure", compression: str = "none") -> None:
    """One PDB file for each structure below ``path``, its atoms in order."""
    lines = pdb_lines(atoms).select(key, "atom_idx", "value").repartition(key).sortWithinPartitions(key, "atom_idx")
    lines.select(key, "value").write.partitionBy(key).option("compression", compression).text(path)
