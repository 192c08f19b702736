"""Scalar column functions: coordinates, identifiers, labels, sidecar fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[float]]

#: Identifiers that mean "no cell", compared in upper case.
UNASSIGNED = ("", "0", "-1", "UNASSIGNED", "NONE", "NAN", "NULL")
UNANNOTATED = "None_sp"


def pixel(c: Column) -> Column:
    """Pixel index: truncation towards zero."""
    return c.cast("long")


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def affine(matrix: Matrix, axis: int, *coordinates: Column) -> Column:
    """One row of an affine matrix whose last column is the offset."""
    row = matrix[axis]
    total = F.lit(float(row[-1]))
    for m, c in zip(row, coordinates):
        total = total + F.lit(float(m)) * c
    return total


def bin_pixels(bin_size_um: float | None, bin_size: int, pixel_um: float) -> int:
    """Bin size in pixels; a size in micrometres wins."""
    return bin_size if bin_size_um is None else max(1, round(bin_size_um / pixel_um))


def bin_label(x: Column, y: Column, size: int, width: int) -> Column:
    """Row-major label of a square bin, from 1; there is no background."""
    per_row = -(-width // size)
    return F.floor(F.floor(y) / size) * per_row + F.floor(F.floor(x) / size) + 1


def cell_id_or_zero(c: Column) -> Column:
    """Identifiers in any of the unassigned spellings become 0, the others numbers."""
    text = F.upper(F.trim(c.cast("string")))
    return F.when(c.isNull() | text.isin(*UNASSIGNED), F.lit(0).cast("long")).otherwise(text.try_cast("long"))


def label_or_unannotated(c: Column) -> Column:
    return F.when(c.isNull() | F.upper(F.trim(c)).isin("", "NONE", "NAN"), F.lit(UNANNOTATED)).otherwise(c)


def composite_suffix(c: Column) -> Column:
    """The number behind the last dash of a composite id."""
    return F.element_at(F.split(c, "-"), -1).try_cast("long")


def file_label(c: Column) -> Column:
    """A label that can name a file: slashes become underscores."""
    return F.regexp_replace(c, "/", "_")


def leading_number(c: Column, prefix: str) -> Column:
    """The number behind a prefix, leading zeros dropped."""
    return F.regexp_extract(c, prefix + r"0*(\d+)", 1).try_cast("long")


def numbers(c: Column) -> Column:
    """A comma list as an array of doubles; empty entries are left out."""
    return F.transform(F.filter(F.split(c, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("double"))


def ring(xs: Column, ys: Column) -> Column:
    """Two arrays of coordinates as an array of points; null if either is."""
    return F.zip_with(xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def software_major(c: Column, field: str = "$.analysis_sw_version", default: str = "0") -> Column:
    """Major version from a JSON sidecar."""
    version = F.coalesce(F.get_json_object(c, field), F.lit(default))
    return F.coalesce(F.regexp_extract(version, r"(\d+)", 1).try_cast("int"), F.lit(0))


def hash_order(seed: int, *ids: Column) -> Column:
    """Stands in for a random number: md5 of the seed and the ids, the same on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def uniform(seed: int, *ids: Column) -> Column:
    """A number in (0, 1) from the same hash."""
    return (F.conv(F.substring(hash_order(seed, *ids), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
