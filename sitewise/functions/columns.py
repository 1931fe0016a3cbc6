"""Scalar functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """The value of ``key`` in a literal map, or ``default``."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def residue_to_letter(name: Column) -> Column:
    return lookup(tables.residue_letters(), name, "X")


def letter_to_residue(letter: Column) -> Column:
    """Unknown letters are UNK, which is what callers test for."""
    return lookup(dict(zip(tables.LETTERS, tables.RESIDUES)), letter, "UNK")


def letter_to_label(letter: Column) -> Column:
    return lookup({x: i for i, x in enumerate(tables.LABEL_ORDER)}, letter, tables.OTHER_LABEL)


def element_label(element: Column) -> Column:
    return lookup(tables.element_labels(), element, tables.OTHER_ELEMENT)


def residue_group(name: Column) -> Column:
    return lookup(tables.residue_groups(), name)


def site_residue(site: Column) -> Column:
    return lookup(tables.SITE_RESIDUES, site)


def secondary_label(code: Column) -> Column:
    return lookup({k: i for i, k in enumerate(tables.SECONDARY)}, code)


def render_resid(letter: Column, number: Column) -> Column:
    return F.concat(letter, number.cast("string"))


def resid_letter(resid: Column) -> Column:
    return F.substring(resid, 1, 1)


def resid_number(resid: Column) -> Column:
    """The number of a residue id; null where there is an insertion code."""
    return F.substr(resid, F.lit(2)).try_cast("int")


def structure_id(path: Column) -> Column:
    """The structure's name in a file name, by the first rule that applies."""
    base = F.substring_index(path, "/", -1)
    return (
        F.when(path.endswith(".ent.gz"), F.substring(base, 4, 4))
        .when(path.endswith(".pdb"), F.substr(base, F.lit(1), F.greatest(F.length(base) - 4, F.lit(0))))
        .when(path.contains("AF"), F.split_part(path, F.lit("-"), F.lit(2)))
    )


def is_predicted(path: Column) -> Column:
    """True for predicted structures; null where no name rule applies."""
    plain = path.endswith(".ent.gz") | path.endswith(".pdb")
    return F.when(plain, F.lit(False)).when(path.contains("AF"), F.lit(True))


def record_chain(record_id: Column) -> Column:
    """lower(id)_chain of "...|pdb|ID|CHAIN" (chain A if blank), ACC_A of "...|sp|ACC"; else null."""
    part = F.split(record_id, r"\|")
    kind = F.try_element_at(part, F.lit(3))
    name = F.try_element_at(part, F.lit(4))
    chain_id = F.coalesce(F.nullif(F.try_element_at(part, F.lit(5)), F.lit("")), F.lit("A"))
    return F.when((kind == "pdb") & (name != ""), F.concat_ws("_", F.lower(name), chain_id)).when(kind == "sp", F.concat(name, F.lit("_A")))


def mutation_site(name: Column) -> Column:
    """Struct (chain, residue) of the last "_" token: wild type, chain, number, mutant."""
    code = F.element_at(F.split(name, "_"), -1)
    return F.struct(F.substring(code, 2, 1).alias("chain"), F.substr(code, F.lit(3), F.greatest(F.length(code) - 3, F.lit(0))).try_cast("int").alias("residue"))


# ---- vectors -----------------------------------------------------------------


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector of length one; a zero vector stays as it is."""
    scaled = lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))  # the length is bound once, not once a component


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(*pairs: tuple[Column, Column]) -> Column:
    total = None
    for a, b in pairs:
        term = (a - b) * (a - b)
        total = term if total is None else total + term
    return F.sqrt(total)


def rounded(c: Column, digits: int) -> Column:
    """``F.round`` of doubles, without its decimal number for each value: only near a
    tie, and beyond 1e9 units, is that made."""
    unit = float(10**digits)
    v = F.abs(c) * F.lit(unit)
    n = F.floor(v + F.lit(0.5))
    plain = (v < 1e9) & (F.abs(v - F.floor(v) - F.lit(0.5)) > 1e-3)
    return F.when(plain, F.when(c < 0, -n).otherwise(n) / F.lit(unit)).otherwise(F.round(c, digits))


def radial_basis(d: Column, most: float = 4.5, count: int = 16, least: float = 0.0) -> Column:
    """exp(-((d - mu_k) / sigma)^2) for ``count`` centres spread over [least, most]."""
    step, sigma = (most - least) / (count - 1), (most - least) / count
    off = [(d - F.lit(k * step + least)) / F.lit(sigma) for k in range(count)]
    return F.array(*[F.exp(-(x * x)) for x in off])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def distance_loss(cos: Column) -> Column:
    """The symmetric representation loss of a cosine."""
    return 2 - 2 * cos


def normalized_edits(a: Column, b: Column, gap: str = "-") -> Column:
    """Edit distance over length, columns that are gaps in both left out; null if none is left."""
    n = F.greatest(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), n), lambda i: ~((F.substring(a, i, F.lit(1)) == gap) & (F.substring(b, i, F.lit(1)) == gap)))
    at = F.when(n > 0, at).otherwise(F.expr("cast(array() as array<int>)"))
    pick = lambda s: F.array_join(F.transform(at, lambda i: F.substring(s, i, F.lit(1))), "")
    return F.try_divide(F.levenshtein(pick(a), pick(b)).cast("double"), F.size(at))
