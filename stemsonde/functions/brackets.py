"""Bracket structure as expressions over one row.

A unit is one record, so its brackets, pairs and stems are derived inside the
row with array functions: no exchange, no sort, whatever the number of units.
Positions are 0-based.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import CANONICAL
from .binding import let

PAIR_T = "array<struct<i:int,j:int>>"

# Bracket kinds matched independently of each other.
BRACKET_KINDS = (("<", ">"), ("(", ")"), ("[", "]"), ("{", "}"))


def symbols(text: Column) -> Column:
    """The characters of a string, as an array."""
    return F.split(text, "")


def count_of(text: Column, char: str) -> Column:
    """Occurrences of one character."""
    return F.length(text) - F.length(F.translate(text, char, ""))


def match_pairs(structure: Column, opener: str = "(", closer: str = ")") -> Column:
    """Matched pairs in order of the opening position.

    A close with an empty stack and an unclosed open give no pair.
    """
    def step(acc, char):
        k, stack, pairs = acc["k"], acc["stack"], acc["pairs"]
        can_pop = (char == closer) & (F.size(stack) > 0)
        top = F.get(stack, F.size(stack) - 1)
        return F.struct(
            (k + 1).alias("k"),
            F.when(char == opener, F.concat(stack, F.array(k)))
             .when(can_pop, F.slice(stack, F.lit(1), F.size(stack) - 1))
             .otherwise(stack).alias("stack"),
            F.when(can_pop, F.concat(pairs, F.array(F.struct(top.alias("i"), k.alias("j")))))
             .otherwise(pairs).alias("pairs"))

    start = F.struct(F.lit(0).alias("k"),
                     F.array().cast("array<int>").alias("stack"),
                     F.array().cast(PAIR_T).alias("pairs"))
    return F.sort_array(F.aggregate(symbols(structure), start, step, lambda a: a["pairs"]))


def match_all_kinds(structure: Column, letters: str = string.ascii_uppercase) -> Column:
    """Pairs of every bracket kind and letter level, each with its own stack."""
    kinds = [match_pairs(structure, o, c) for o, c in BRACKET_KINDS]
    kinds += [match_pairs(structure, up, up.lower()) for up in letters]
    return F.sort_array(F.concat(*kinds))


def depth_profile(structure: Column) -> Column:
    """struct(final, lowest): running depth at the end and its minimum."""
    def step(acc, char):
        now = acc["final"] + F.when(char == "(", 1).when(char == ")", -1).otherwise(0)
        return F.struct(now.alias("final"), F.least(acc["lowest"], now).alias("lowest"))

    start = F.struct(F.lit(0).alias("final"), F.lit(0).alias("lowest"))
    return F.aggregate(symbols(structure), start, step)


def is_balanced(structure: Column, min_pairs: int = 3) -> Column:
    """Depth never negative, zero at the end, and at least ``min_pairs`` pairs."""
    d = depth_profile(structure)
    return (d["lowest"] >= 0) & (d["final"] == 0) & (count_of(structure, ")") >= min_pairs)


def equal_counts(structure: Column) -> Column:
    """As many opens as closes, order ignored."""
    return count_of(structure, "(") == count_of(structure, ")")


def canonical(pairs: Column, chars: Column) -> Column:
    """Pairs whose two symbols are canonical; ``chars`` is the symbol array."""
    return F.filter(pairs, lambda p: F.concat(F.get(chars, p["i"]), F.get(chars, p["j"]))
                    .isin(*CANONICAL))


def stem_runs(pairs: Column) -> Column:
    """Maximal runs (i,j),(i+1,j-1),... of an i-ordered pair array.

    In i order the inner neighbour of a pair, when present, is the next element,
    so a run ends where the next element is not (i+1, j-1).
    """
    n = F.size(pairs)
    where = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    before = lambda t: F.get(pairs, t - 1)
    here = lambda t: F.get(pairs, t)
    return F.filter(where, lambda t: (t == 0) | ~(
        (here(t)["i"] == before(t)["i"] + 1) & (here(t)["j"] == before(t)["j"] - 1)))


def anatomy(sequence: Column, structure: Column) -> Column:
    """struct(pairs, canonical, stems, eligible, chars) of one unit, each part evaluated once.

    Stems are formed only where opens and closes agree in number.
    """
    none = F.array().cast(PAIR_T)

    def with_canonical(chars, pairs, canon):
        stems = let(stem_runs(canon), lambda runs: stems_from_runs(canon, runs))
        return let(stems, lambda st: F.struct(
            pairs.alias("pairs"), canon.alias("canonical"), st.alias("stems"),
            eligible(st, chars).alias("eligible"), chars.alias("chars")))

    return let(symbols(sequence), lambda chars: let(match_pairs(structure), lambda pairs: let(
        F.when(equal_counts(structure), canonical(pairs, chars)).otherwise(none),
        lambda canon: with_canonical(chars, pairs, canon))))


def pairing(sequence: Column, structure: Column) -> Column:
    """struct(canonical, chars) of the anatomy, without stems."""
    none = F.array().cast(PAIR_T)
    return let(symbols(sequence), lambda chars: let(match_pairs(structure), lambda pairs: F.struct(
        F.when(equal_counts(structure), canonical(pairs, chars)).otherwise(none).alias("canonical"), chars.alias("chars"))))


def stems_from_runs(pairs: Column, runs: Column) -> Column:
    """One entry per pair: stem_id, k (position in stem), len, i, j."""
    def one(start, m):
        length = F.coalesce(F.get(runs, m + 1), F.size(pairs)) - start
        return F.transform(F.sequence(F.lit(0), length - 1), lambda k: F.struct(
            m.alias("stem_id"), k.alias("k"), length.alias("len"),
            F.get(pairs, start + k)["i"].alias("i"), F.get(pairs, start + k)["j"].alias("j")))

    return F.flatten(F.transform(runs, one))


def eligible(stems: Column, chars: Column) -> Column:
    """Interior pairs of stems of three or more, with the neighbours on j's strand."""
    inner = F.filter(stems, lambda s: (s["len"] >= 3) & (s["k"] >= 1) & (s["k"] <= s["len"] - 2))
    return F.transform(inner, lambda s: F.struct(
        s["stem_id"].alias("stem_id"), s["k"].alias("k"), s["len"].alias("len"),
        s["i"].alias("i"), s["j"].alias("j"),
        (s["j"] + 1).alias("j_prev"), (s["j"] - 1).alias("j_next"),
        F.concat(F.get(chars, s["i"]), F.lit("-"), F.get(chars, s["j"])).alias("pair_type")))


def is_deep(k: Column, length: Column) -> Column:
    """Two or more positions from each stem end."""
    return (k >= 2) & (k <= length - 3)


def partner_array(pairs: Column, length: Column) -> Column:
    """Partner of every position, null where unpaired."""
    everywhere = F.when(length > 0, F.sequence(F.lit(0), length - 1)) \
        .otherwise(F.array().cast("array<int>"))

    def build(both):
        free = F.array_except(everywhere, F.transform(both, lambda e: e["pos"]))
        alone = F.transform(free, lambda p: F.struct(p.alias("pos"), F.lit(None).cast("int").alias("mate")))
        return F.transform(F.sort_array(F.concat(both, alone)), lambda e: e["mate"])

    return let(F.concat(
        F.transform(pairs, lambda p: F.struct(p["i"].alias("pos"), p["j"].alias("mate"))),
        F.transform(pairs, lambda p: F.struct(p["j"].alias("pos"), p["i"].alias("mate")))), build)
