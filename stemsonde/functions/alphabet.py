"""Fixed values of the symbol alphabets, and their normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complement substitution, transversion substitution, canonical
# pairs, symbols one row can always be read back from.
COMPLEMENT = {"A": "U", "U": "A", "C": "G", "G": "C", "T": "A"}
TRANSVERSION = {"A": "C", "U": "C", "C": "A", "G": "U", "T": "C"}
CANONICAL = ("AU", "UA", "CG", "GC")
WOBBLE = ("GU", "UG")
SAFE_SYMBOLS = "ACGTUN"


def normalise(seq: Column, alphabet: str = "rna") -> Column:
    """Upper case, with U and T unified for the given alphabet (``rna`` or ``dna``)."""
    if alphabet not in ("rna", "dna"):
        raise ValueError(f"alphabet must be 'rna' or 'dna', got {alphabet!r}")
    frm, to = ("T", "U") if alphabet == "rna" else ("U", "T")
    return F.translate(F.upper(seq), frm, to)


def fold_brackets(structure: Column) -> Column:
    """All bracket kinds to ``(`` and ``)``, everything else to ``.``."""
    folded = F.translate(structure, "<[{>]}", "((()))")
    return F.regexp_replace(folded, "[^().]", ".")


def substitution(alphabet: dict[str, str]) -> Column:
    """The alphabet as a map column."""
    return F.create_map(*[F.lit(x) for kv in alphabet.items() for x in kv])


def mapped_symbol(sym: Column, alphabet: dict[str, str]) -> Column:
    """Substitute symbol, null where the alphabet does not map it."""
    source = "".join(alphabet)
    target = "".join(alphabet.values())
    return F.when(sym.isin(*alphabet), F.translate(sym, source, target))
