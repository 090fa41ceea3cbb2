"""Column expressions on nucleotide sequences; all are JVM-side and need no shuffle.

Case is folded for ASCII only: strip other characters first where they can occur.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substitution scores of the HOXD70 matrix; pairs with N score 0.
HOXD70 = {"AA": 91, "AC": -114, "AG": -31, "AT": -123, "CC": 100, "CG": -125, "CT": -31, "GG": 100, "GT": -114, "TT": 91}
GAP_OPEN, GAP_EXTEND = -400, -30
#: Scores used for inversions (match, mismatch, gap); N scores 0 against a base.
INVERSION = (1, -2, -2)


def rna_to_dna(seq: Column) -> Column:
    return F.translate(seq, "Uu", "Tt")


def normalise(seq: Column) -> Column:
    """Upper case, U to T, and every other letter than A, C, G, T, N and the gap to N."""
    return F.regexp_replace(rna_to_dna(F.upper(seq)), "[^ACGTN-]", "N")


def degenerate_to_n(seq: Column) -> Column:
    """Everything but A, C, G and T to N, in upper case."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def strip_n(seq: Column) -> Column:
    return F.translate(seq, "Nn", "")


def strip_gaps(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def strip_space(seq: Column) -> Column:
    return F.regexp_replace(seq, r"\s+", "")


def encode(seq: Column) -> Column:
    """Digits for bases: 1 A, 2 C, 3 G, 4 T or U, 7 gap, 5 anything else."""
    return F.regexp_replace(F.translate(F.upper(seq), "ACGTU-", "123447"), "[^123467]", "5")


def decode(codes: Column) -> Column:
    return F.translate(codes, "123457", "ACGTN-")


def header(name: Column, dashes: bool = False) -> Column:
    """A header line without its mark, carriage return and outer spaces; with ``dashes``, spaces become dashes."""
    plain = F.trim(F.regexp_replace(name, r"^[>@]|\r$", ""))
    return F.replace(plain, F.lit(" "), F.lit("-")) if dashes else plain


def strand_start(start: Column, length: Column, src_size: Column) -> Column:
    """The start of an interval seen from the other strand."""
    return src_size - start - length


def inclusive_length(start: Column, stop: Column) -> Column:
    return stop - start + 1


def clean_markers(seq: Column) -> Column:
    """Removes deletion markers and turns inserted digits into bases."""
    return F.translate(seq, "1234><", "acgt")


def hoxd70(a: Column, b: Column) -> Column:
    """Score of two bases; anything but A, C, G and T scores 0."""
    pair = F.concat(F.least(a, b), F.greatest(a, b))
    out = F.when(pair == "AA", HOXD70["AA"])
    for k, v in HOXD70.items():
        if k != "AA":
            out = out.when(pair == k, v)
    return out.otherwise(0)


def continuity(gap_columns: Column, length: Column) -> Column:
    """Share of columns without a gap, in per cent."""
    return F.lit(100.0) - F.lit(100.0) * gap_columns / length


def wrap(seq: Column, width: int) -> Column:
    """Line breaks after every ``width`` characters, none at the end."""
    return F.regexp_replace(seq, "(.{%d})(?!$)" % width, "$1\n")
