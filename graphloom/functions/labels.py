"""Labels, ids and text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sign of each transmitter label; others are unknown.
SIGN_OF_LABEL = {"ACH": "excitatory", "GABA": "inhibitory", "GLUT": "glut", "DA": "modulatory", "SER": "modulatory", "OCT": "modulatory"}
UNKNOWN = "unknown"
#: Ids are this prefix and nine digits.
ID_PREFIX = 720575940


def sign_of(label: Column) -> Column:
    """The label's sign; unmapped and null labels are unknown."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SIGN_OF_LABEL.items() for x in kv])[label], F.lit(UNKNOWN))


def full_id(suffix: Column) -> Column:
    """The whole id from its nine-digit suffix, in 64-bit arithmetic."""
    return F.lit(ID_PREFIX).cast("long") * 1_000_000_000 + suffix.cast("long")


def is_id(col: Column) -> Column:
    return col.cast("string").rlike(f"^{ID_PREFIX}[0-9]{{9}}$")


def clean(cell: Column) -> Column:
    """A text cell without surrounding blanks and carriage returns."""
    return F.trim(F.regexp_replace(cell, r"^[\s]+|[\s]+$", ""))


def vector_cell(cell: Column) -> Column:
    """``"[x y z]"`` as an array of doubles; blanks may repeat."""
    return F.split(F.trim(F.regexp_replace(cell, r"[\[\]]", " ")), r"\s+").cast("array<double>")


def list_cell(cell: Column) -> Column:
    """A cell with a literal list of texts as an array; other texts are one element; null stays null."""
    parsed = F.from_json(cell, "array<string>", {"allowSingleQuotes": "true"})
    return F.when(cell.isNull(), None).when(F.trim(cell).startswith("["), F.coalesce(parsed, F.array(cell))).otherwise(F.array(cell))
