"""Filters of the atom table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables


def first_model(atoms: DataFrame, structure: tuple[str, ...] = ("ensemble", "structure"), model: str = "model") -> DataFrame:
    """Rows of the lowest model of each structure."""
    w = Window.partitionBy(*structure)
    return atoms.withColumn("_m", F.min(model).over(w)).where(F.col(model) == F.col("_m")).drop("_m")


def in_chains(atoms: DataFrame, chains: str, chain: str = "chain") -> DataFrame:
    """Rows whose chain is one of the characters of ``chains``."""
    return atoms.where(F.col(chain).isin(list(chains)))


def without_water(atoms: DataFrame, hetero: str = "hetero") -> DataFrame:
    """Drops rows whose hetero flag contains a W, ligand codes with one too."""
    return atoms.where(~F.coalesce(F.col(hetero), F.lit("")).contains("W"))


def without_hydrogen(atoms: DataFrame, element: str = "element") -> DataFrame:
    return atoms.where(F.coalesce(F.col(element), F.lit("")) != "H")


def residues_known(atoms: DataFrame, resname: str = "resname", unknown: bool = True) -> DataFrame:
    """Rows of the 20 residues, and of UNK if ``unknown``."""
    return atoms.where(F.col(resname).isin(tables.RESIDUES if unknown else tables.STANDARD_RESIDUES))


def in_pocket(atoms: DataFrame, pocket: DataFrame, key: str = "chain_resid") -> DataFrame:
    """Rows whose key is one of those in ``pocket``."""
    return atoms.join(pocket.select(key).distinct(), key, "left_semi")


def confident(rows: DataFrame, least: float = 70.0, confidence: str = "confidence", predicted: str = "is_predicted") -> DataFrame:
    """Predicted structures keep rows of enough confidence; others all."""
    return rows.where(~F.col(predicted) | (F.col(confidence) >= least))


def structure_records(records: DataFrame, predicted: bool = False, record: str = "id") -> DataFrame:
    """Alignment records of a solved structure, and of a predicted one if asked for.

    A null id is no structure's.
    """
    solved = F.col(record).contains("|pdb|")
    return records.where(solved | F.col(record).contains("|sp|") if predicted else solved)


def sequence_records(records: DataFrame, predicted: bool = False, record: str = "id") -> DataFrame:
    """Alignment records named by a chain alone, without a bar in the id.

    Unless predicted structures are asked for, what stands before the first
    underscore has to be a four-character code. A null id is no chain's.
    """
    plain = ~F.col(record).contains("|")
    coded = F.length(F.split_part(F.col(record), F.lit("_"), F.lit(1))) == 4
    return records.where(plain if predicted else plain & coded)


def without_self(db: DataFrame, queries: DataFrame, db_pdb: str = "pdb", query_pdb: str = "pdb") -> DataFrame:
    """Database rows whose four-character code is no query's."""
    codes = queries.select(F.substring(query_pdb, 1, 4).alias("_code")).distinct()
    return db.join(codes, F.substring(F.col(db_pdb), 1, 4) == F.col("_code"), "left_anti")


def clean_atoms(atoms: DataFrame, chain: str | None = None, hetero_residues: bool = True, structure: tuple[str, ...] = ("ensemble", "structure")) -> DataFrame:
    """First model, chain, no water, no hydrogen and, if asked for, known residues."""
    out = without_hydrogen(without_water(first_model(atoms, structure)))
    out = out if chain is None else in_chains(out, chain)
    return out if hetero_residues else residues_known(out)


def with_suffix(df: DataFrame, suffix: str, columns: Iterable[str] | None = None) -> DataFrame:
    names = set(df.columns if columns is None else columns)
    return df.select(*[F.col(c).alias(c + suffix) if c in names else F.col(c) for c in df.columns])


def to_unbound(pairs: DataFrame, sides: Iterable[str] = ("0", "1")) -> DataFrame:
    """Pairs with the subunits and structures of both sides named as unbound ones."""
    named = {}
    for side in sides:
        named[f"subunit{side}"] = F.replace(f"subunit{side}", F.lit("bound"), F.lit("unbound"))
        named[f"structure{side}"] = F.replace(f"structure{side}", F.lit("_b_"), F.lit("_u_"))
    return pairs.withColumns(named)
