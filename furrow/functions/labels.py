"""Label text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Compound labels with an agreed primary crop. Any other compound
# stays a class of its own.
COMPOUND_LABELS = {
    "bugdoy, other": "bugdoy",
    "bugdoy, paxta": "bugdoy",
    "other, bugdoy": "other",
}


# Fixed value: the white space trimmed from labels and region names.
BLANKS = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    return F.trim(col, F.lit(BLANKS))


def normalize_label(label: Column) -> Column:
    clean = F.lower(strip(label))
    out = F.when(F.lit(False), clean)
    for compound, primary in COMPOUND_LABELS.items():
        out = out.when(clean == compound, F.lit(primary))
    return out.otherwise(clean)


def is_unmapped_compound(label: Column) -> Column:
    """True for a compound label that has no agreed primary crop."""
    return F.contains(normalize_label(label), F.lit(","))
