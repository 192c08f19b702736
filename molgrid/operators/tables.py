"""Row and column operators on cell, gene and molecule tables: standardising, predicates, guards, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molgrid.functions.scalars import UNANNOTATED, cell_id_or_zero, clamp, composite_suffix, file_label, label_or_unannotated


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def standardize_obs(df: DataFrame, rename: dict[str, str], const: dict[str, object] | None = None) -> DataFrame:
    """New name -> old name; constants are added, all other columns go."""
    require_columns(df, *rename.values())
    return df.select(*[F.col(old).alias(new) for new, old in rename.items()], *[F.lit(v).alias(k) for k, v in (const or {}).items()])


def filter_obs(df: DataFrame, *, equal=None, isin=None, not_startswith=None, not_endswith=None) -> DataFrame:
    """Rows that satisfy every given predicate; each is a dict of column -> value(s)."""
    tests: list[Column] = [F.col(c) == v for c, v in (equal or {}).items()]
    tests += [F.col(c).isin(*v) for c, v in (isin or {}).items()]
    tests += [~F.col(c).startswith(v) for c, v in (not_startswith or {}).items()]
    tests += [~F.col(c).endswith(v) for c, v in (not_endswith or {}).items()]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def filter_groups(df: DataFrame, key: str, min_n: int) -> DataFrame:
    """Rows of groups with at least min_n rows."""
    large = df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_n).select(key)
    return df.join(large, key, "left_semi")


def filter_genes(cnt: DataFrame, min_cells: int = 1, min_counts: int = 0) -> DataFrame:
    found = cnt.where("count > 0").groupBy("gene").agg(F.count("*").alias("cells"), F.sum("count").alias("total"))
    return cnt.join(found.where((F.col("cells") >= min_cells) & (F.col("total") >= min_counts)).select("gene"), "gene", "left_semi")


def filter_cells(cnt: DataFrame, min_counts: int = 1, min_genes: int = 0) -> DataFrame:
    found = cnt.where("count > 0").groupBy("cell_id").agg(F.count("*").alias("genes"), F.sum("count").alias("total"))
    return cnt.join(found.where((F.col("genes") >= min_genes) & (F.col("total") >= min_counts)).select("cell_id"), "cell_id", "left_semi")


def filter_paired_cells(a: DataFrame, b: DataFrame, least: int = 1) -> DataFrame:
    """Cells of which both modalities have more than `least` counts."""
    totals = [x.groupBy("cell_id").agg(F.sum("count").alias(n)) for x, n in ((a, "n_a"), (b, "n_b"))]
    return totals[0].join(totals[1], "cell_id").where(F.least("n_a", "n_b") > least)


def make_unique(df: DataFrame, col: str, order: str) -> DataFrame:
    """Repeats of a name get -1, -2, ... in the given order, without the numbers that other rows have already."""
    suffix = r"^(.*)-([1-9][0-9]{0,17})$"
    named = df.where(F.col(col).rlike(suffix)).select(F.regexp_extract(col, suffix, 1).alias("__base"), F.regexp_extract(col, suffix, 2).cast("long").alias("__k"))
    taken = named.groupBy("__base").agg(F.array_sort(F.collect_set("__k")).alias("__taken"))
    nth = df.withColumn("__n", (F.row_number().over(Window.partitionBy(col).orderBy(order)) - 1).cast("long"))
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), F.col("__n"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    own = nth.join(taken, F.col(col) == F.col("__base"), "left")
    return own.withColumn(col, F.when(F.col("__n") == 0, F.col(col)).otherwise(F.concat_ws("-", F.col(col), free))).drop("__n", "__base", "__taken")


def label_names(df: DataFrame, col: str) -> DataFrame:
    """Each label and a name for it that can stand in a file name; labels that would share a name get -1, -2, ..."""
    named = df.select(F.col(col).alias("label")).where("label is not null").distinct().withColumn("name", file_label(F.col("label")))
    return make_unique(named, "name", "label")


def restore_labels(df: DataFrame, col: str, names: DataFrame) -> DataFrame:
    """The labels again that `label_names` gave names for; other values stay."""
    back = names.select(F.col("name").alias("__name"), F.col("label").alias("__label"))
    return df.join(back, F.col(col) == F.col("__name"), "left").withColumn(col, F.coalesce("__label", F.col(col))).drop("__name", "__label")


def normalize_ids(df: DataFrame, id_col: str = "cell_id", label_col: str | None = None) -> DataFrame:
    out = df.withColumn(id_col, cell_id_or_zero(F.col(id_col)))
    return out.withColumn(label_col, label_or_unannotated(F.col(label_col))) if label_col else out


def filter_confident(df: DataFrame, score: str = "similarity", threshold: str = "threshold") -> DataFrame:
    return df.where(F.col(score) >= F.col(threshold))


def clip_to_raster(pts: DataFrame, width: int, height: int, mode: str = "clamp") -> DataFrame:
    """clamp: coordinates moved to the edge pixels; drop: points outside [-0.5, size - 0.5] go."""
    if mode == "clamp":
        return pts.withColumns({"px": clamp(F.col("x").cast("long"), 0, width - 1), "py": clamp(F.col("y").cast("long"), 0, height - 1)})
    if mode != "drop":
        raise ValueError(f"mode must be clamp or drop, not {mode!r}")
    return pts.where(F.col("x").between(-0.5, width - 0.5) & F.col("y").between(-0.5, height - 0.5))


def out_of_bounds(pts: DataFrame, width: int, height: int) -> DataFrame:
    """Points outside the raster and all points; an error once it runs if all are outside."""
    out = ~(F.col("x").between(0, width - 1e-9) & F.col("y").between(0, height - 1e-9))
    n = pts.agg(F.count_if(out).alias("n_out"), F.count("*").alias("n_points"))
    fail = F.raise_error(F.lit("all points lie outside the raster"))
    return n.withColumn("n_out", F.when((F.col("n_points") > 0) & (F.col("n_out") == F.col("n_points")), fail.cast("long")).otherwise(F.col("n_out")))


def resolve_cell_id(obs: DataFrame, candidates: tuple[str, ...] = ("cell_id", "instance_id", "index")) -> DataFrame:
    """cell_id from the first of the columns that is there and filled."""
    have = [F.col(c).cast("long") for c in candidates if c in obs.columns]
    return obs.withColumn("cell_id", F.coalesce(*have))


def numbered_ids(df: DataFrame, col: str) -> DataFrame:
    """Composite ids ("CR-a-27") as the numbers behind their last dash; nulls stay, and ids that are all numbers as well.

    Fails where some ids are composite and others plain numbers, where what is behind the dash is no number, and where two
    ids would get the same one, so the count of distinct ids stays.
    """
    text = F.col(col).cast("string")
    number = F.when(text.contains("-"), composite_suffix(text)).otherwise(text.try_cast("long"))
    ids = df.where(F.col(col).isNotNull()).select(text.alias("id"), number.alias("number")).groupBy("id").agg(F.first("number").alias("number"))
    by_number = ids.groupBy("number").agg(F.count("*").alias("n"), F.count_if(F.col("id").contains("-")).alias("composite"))
    found = by_number.agg(F.sum("n").alias("ids"), F.sum("composite").alias("composite"), F.max("n").alias("most"), F.coalesce(F.sum(F.when(F.col("number").isNull(), F.col("n"))), F.lit(0)).alias("odd"))
    wrong = F.when(F.col("composite").between(1, F.col("ids") - 1), "ids are of mixed types").when(F.col("odd") > 0, "ids have no number").when(F.col("most") > 1, "ids would get the same number")
    checked = F.broadcast(found.select(F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(f": {col}"))).cast("string")).alias("__wrong")))
    return df.crossJoin(checked).withColumn(col, F.when(F.col("__wrong").isNull(), number)).drop("__wrong")


def recode(df: DataFrame, col: str, mapping: dict[str, str], to: str) -> DataFrame:
    """A new column by dictionary; null where the value is not in it."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(to, F.try_element_at(F.create_map(*pairs), F.col(col)))


def assert_labels(spans: DataFrame) -> DataFrame:
    if spans.where("label > 0").isEmpty():
        raise ValueError("the segmentation has no label above 0")
    return spans


def with_label(cells: DataFrame, key: str) -> DataFrame:
    """The annotation level `key` as cell_type."""
    return cells.withColumn("cell_type", F.col(key))


def align_layers(cnt: DataFrame, normalized: DataFrame) -> DataFrame:
    """Raw counts with an existing normalised layer beside them, on the cells and genes of both."""
    return cnt.join(normalized.select("cell_id", "gene", "normalized"), ["cell_id", "gene"])


# joins -------------------------------------------------------------------------------------------


def restrict(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns (all of `keys`) occur in `keys`."""
    return df.join(keys, keys.columns, "left_semi")


def attach(cells: DataFrame, other: DataFrame, key: str = "cell_id") -> DataFrame:
    """Left join: quality, correction or annotation columns; null where there are none."""
    return cells.join(other, key, "left")


def attach_volume(cells: DataFrame, volumes: DataFrame) -> DataFrame:
    """Inner join on cell_id; both sides must have the same cells, with volumes above 0."""
    odd = cells.select("cell_id").join(volumes, "cell_id", "left_anti").limit(1).unionByName(
        volumes.select("cell_id").join(cells, "cell_id", "left_anti").limit(1)
    )
    if not odd.isEmpty():
        raise ValueError("cells and volumes do not have the same cell ids")
    if not volumes.where("volume is null or volume <= 0").isEmpty():
        raise ValueError("volumes must be above 0")
    return cells.join(volumes.select("cell_id", "volume"), "cell_id")


def complete_cells(per_cell: DataFrame, cells: DataFrame, value: str = "count") -> DataFrame:
    """One row for each cell of the list, 0 where there was none."""
    return cells.select("cell_id").join(per_cell, "cell_id", "left").withColumn(value, F.coalesce(value, F.lit(0)))


def apply_assignment(pts: DataFrame, assigned: DataFrame, key: str = "transcript_id") -> DataFrame:
    """cell_id from a partial result on all molecules; 0 where it has none."""
    new = assigned.select(key, F.col("cell_id").alias("__new"))
    return pts.join(new, key, "left").withColumn("cell_id", F.coalesce("__new", F.lit(0).cast("long"))).drop("__new")


def with_fallback(first: DataFrame, second: DataFrame, key: str = "transcript_id") -> DataFrame:
    """cell_id of `first`, or of `second` where that is null or has no such row."""
    new = first.select(key, F.col("cell_id").alias("__new"))
    return second.join(new, key, "left").withColumn("cell_id", F.coalesce("__new", "cell_id")).drop("__new")


def merge_layer(cnt: DataFrame, patch: DataFrame, value: str = "count") -> DataFrame:
    """Values replaced where the patch has the (cell, gene) pair."""
    new = patch.select("cell_id", "gene", F.col(value).alias("__new"))
    return cnt.join(new, ["cell_id", "gene"], "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def assert_cells(pts: DataFrame, cells: DataFrame) -> DataFrame:
    """Ids among the molecules and cells of the matrix; an error once it runs if there are fewer ids."""
    a = pts.where("cell_id > 0").agg(F.count_distinct("cell_id").alias("n_ids"))
    b = cells.agg(F.count("*").alias("n_cells"))
    both = a.crossJoin(F.broadcast(b))
    return both.withColumn("n_ids", F.when(F.col("n_ids") < F.col("n_cells"), F.raise_error(F.lit("fewer ids than cells")).cast("long")).otherwise(F.col("n_ids")))


# sets --------------------------------------------------------------------------------------------


def shared_genes(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("gene").intersect(b.select("gene"))


def missing_ids(df: DataFrame, col: str, n: int) -> DataFrame:
    """Ids of 0 .. n - 1 that do not occur."""
    return df.sparkSession.range(n).select(F.col("id").alias(col)).join(df.select(F.col(col).cast("long").alias(col)), col, "left_anti")


def concat_counts(parts: list[DataFrame]) -> DataFrame:
    """Count tables one after the other, on the genes that all have."""
    genes = reduce(lambda a, b: a.intersect(b), [p.select("gene") for p in parts])
    return restrict(reduce(lambda a, b: a.unionByName(b), parts), genes)


def assert_overlap(a: DataFrame, b: DataFrame, min_types: int = 2) -> DataFrame:
    """Shared cell types; an error if they are too few or a label is missing."""
    for df in (a, b):
        if not df.where(F.col("cell_type").isNull() | (F.col("cell_type") == "None")).isEmpty():
            raise ValueError("every cell needs a cell type")
    shared = a.select("cell_type").intersect(b.select("cell_type")).where(F.col("cell_type") != UNANNOTATED)
    if shared.limit(min_types).count() < min_types:
        raise ValueError(f"fewer than {min_types} shared cell types")
    return shared
