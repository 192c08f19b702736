"""Sampling and numbering. Random choice is an order by md5 of the seed and the id: repeatable on any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molgrid.functions.scalars import hash_order, uniform
from molgrid.operators.tables import filter_cells, filter_genes
from molgrid.sources.writers import written


def with_row_id(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """Contiguous numbers from 0 in the given order: a range-partitioned sort, numbered within and then across
    partitions, so no task holds all rows.

    The sorted rows are written once with their place: a sort that ran a second time, over other columns or after
    a lost executor, could draw other bounds between its partitions.
    """
    at = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    at = written(at.select("*", F.shiftright("__id", 33).alias("__p"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__k")).drop("__id"), "row-id")
    sizes = at.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("__p", before.alias("__b"))  # a row for each partition
    return at.join(F.broadcast(base), "__p").withColumn(name, F.col("__b") + F.col("__k")).drop("__p", "__k", "__b")


def factorize(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Codes 1 .. N of the sorted distinct values."""
    codes = with_row_id(df.select(col).distinct(), col).select(F.col(col).alias("__v"), (F.col("row_id") + 1).alias(name))
    return df.join(codes, df[col] == codes["__v"]).drop("__v")


def group_quotas(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows to take of each group for a balanced sample of n: small groups whole, the others alike, odd ones first."""
    sizes = df.groupBy(key).agg(F.count("*").alias("size"))
    w = Window.orderBy("size", key)  # one row for each group
    at = sizes.withColumns({"at": F.row_number().over(w) - 1, "before": F.sum("size").over(w) - F.col("size"), "groups": F.count("*").over(Window.partitionBy())})
    whole = F.col("size") * (F.col("groups") - F.col("at")) + F.col("before") <= n
    at = at.withColumn("whole", whole)
    cut = at.where("not whole").agg(F.min("at").alias("p"), F.min("before").alias("taken"))
    both = at.crossJoin(F.broadcast(cut))
    rest, left = F.lit(n) - F.col("taken"), F.col("groups") - F.col("p")
    share = F.floor(F.try_divide(rest, left)) + F.when(F.col("at") - F.col("p") < rest % F.nullif(left, F.lit(0)), 1).otherwise(0)
    return both.select(key, "size", F.when(F.col("whole"), F.col("size")).otherwise(share).cast("long").alias("quota"))


def balanced_subsample(df: DataFrame, key: str, id_col: str, n: int, seed: int) -> DataFrame:
    """Rows of each group up to its quota, in hash order."""
    w = Window.partitionBy(key).orderBy(hash_order(seed, F.col(id_col)))
    quotas = group_quotas(df, key, n).select(key, "quota")
    return df.join(quotas, key).withColumn("__n", F.row_number().over(w)).where("__n <= quota").drop("__n", "quota")


def subsample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows, or all if there are fewer."""
    return df.withColumn("__h", hash_order(seed, F.col(id_col))).orderBy("__h").limit(n).drop("__h")


def _weighted(df: DataFrame, id_col: str, weight: Column, n: int, seed: int) -> DataFrame:
    """The n largest ln(u) / weight: sampling without replacement with the given weights."""
    return df.withColumn("__h", F.ln(uniform(seed, F.col(id_col))) / weight).orderBy(F.desc("__h"), id_col).limit(n).drop("__h")


def subsample_even(df: DataFrame, key: str, id_col: str, n: int, seed: int) -> DataFrame:
    """Each group has the same chance, whatever its size."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__s"))
    return _weighted(df.join(sizes, key), id_col, 1 / F.col("__s"), n, seed).drop("__s")


#: Weight of a row from the size of its group.
WEIGHTS = {"id": lambda s: s.cast("double"), "sqrt": F.sqrt, "log": lambda s: F.ln(s + 1)}


def subsample_weighted(df: DataFrame, key: str, id_col: str, n: int, seed: int, weight: str = "sqrt") -> DataFrame:
    """Groups in proportion to a function of their size; a row's weight is that divided by the size."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__s"))
    return _weighted(df.join(sizes, key), id_col, WEIGHTS[weight](F.col("__s")) / F.col("__s"), n, seed).drop("__s")


def subsample_features(genes: DataFrame, keep: DataFrame, n: int, seed: int) -> DataFrame:
    """The genes of `keep`, filled up to n with others."""
    kept = keep.select("gene").distinct().withColumn("__kept", F.lit(0))
    marked = genes.select("gene").distinct().join(kept, "gene", "left")
    return marked.orderBy(F.coalesce("__kept", F.lit(1)), hash_order(seed, F.col("gene"))).limit(n).select("gene")


def permute_column(df: DataFrame, col: str, id_col: str, seed: int) -> DataFrame:
    """The values of a column dealt anew to the rows."""
    own = with_row_id(df.drop(col), id_col)
    dealt = with_row_id(df.select(col, hash_order(seed, F.col(id_col)).alias("__h")), "__h").select("row_id", col)
    return own.join(dealt, "row_id").drop("row_id")


def subsample_dataset(cnt: DataFrame, cells: DataFrame, key: str, categories: list[str] | None, n: int, seed: int, min_counts: int = 1, min_cells: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cells of the given categories, evenly sampled; then empty cells and genes go. Returns counts and cells."""
    chosen = cells.where(F.col(key).isin(categories)) if categories else cells
    chosen = subsample_even(chosen, key, "cell_id", n, seed)
    left = cnt.join(chosen.select("cell_id"), "cell_id", "left_semi")
    left = filter_genes(filter_cells(left, min_counts), min_cells)
    return left, chosen.join(left.select("cell_id"), "cell_id", "left_semi")
