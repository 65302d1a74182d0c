"""Labelled matrices: wide (id, label, features) and long (id, label, j, x)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_matrix(spark: SparkSession, path: str, features: str = "X", label: str = "Y", id_col: str | None = None) -> DataFrame:
    """(id, label, features array<double>, absolute values) of a Parquet matrix; ValueError where a column is missing."""
    df = spark.read.parquet(path)
    missing = [c for c in (features, label) if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return matrix(df, id_col, label, features)


def matrix(df: DataFrame, id_col: str | None, label: str, features: str) -> DataFrame:
    """Wide form with absolute values. Without an id column a row's id is a hash of its content, and of how many equal rows go before
    it: the same in any layout of the files, so folds are too."""
    rows = df.select(F.col(id_col).cast("long").alias("id") if id_col else F.xxhash64(label, features).alias("id"), F.col(label).cast("int").alias("label"), F.transform(F.col(features), lambda v: F.abs(v.cast("double"))).alias("features"))
    if id_col:
        return rows
    equal = rows.groupBy("id", "label", "features").agg(F.count("*").alias("n"))  # repeated rows are merged before the shuffle
    return equal.select("id", "label", "features", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth")).select(F.when(F.col("nth") == 1, F.col("id")).otherwise(F.xxhash64("id", "nth")).alias("id"), "label", "features")


def matrix_of_columns(df: DataFrame, columns: list[str], label: Column, id_col: Column) -> DataFrame:
    return df.select(id_col.cast("long").alias("id"), label.cast("int").alias("label"), F.array(*[F.abs(F.col(c).cast("double")) for c in columns]).alias("features"))


def to_long(wide: DataFrame) -> DataFrame:
    """(…, j, x): a row for each cell."""
    keep = [c for c in wide.columns if c != "features"]
    return wide.select(*keep, F.posexplode("features").alias("j", "x"))


def to_wide(long: DataFrame) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct("j", "x")))
    return long.groupBy("id", "label").agg(F.transform(cells, lambda c: c["x"]).alias("features"))


def save_matrix(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").parquet(path)


def shape(wide: DataFrame) -> DataFrame:
    """One row: (n, p)."""
    return wide.agg(F.count("*").alias("n"), F.max(F.size("features")).cast("long").alias("p"))


def slice_features(wide: DataFrame, selected: list[int]) -> DataFrame:
    """Only the selected features, in that order."""
    at = F.array(*[F.lit(j) for j in selected]) if selected else F.array().cast("array<int>")
    return wide.withColumn("features", F.transform(at, lambda j: F.get("features", j)))


def slice_long(long: DataFrame, selection: DataFrame) -> DataFrame:
    """The cells of selected features: a semi-join on j."""
    return long.join(selection.select("j"), "j", "left_semi")


def rebase_labels(wide: DataFrame) -> DataFrame:
    """Labels less the least one."""
    least = wide.agg(F.min("label").alias("_least"))
    return wide.crossJoin(F.broadcast(least)).withColumn("label", F.col("label") - F.col("_least")).drop("_least")


def dense_labels(wide: DataFrame) -> DataFrame:
    """Labels numbered from 0 by ascending value; the few distinct labels are numbered, not the rows."""
    codes = wide.select("label").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("label")) - 1)
    return wide.join(codes, "label").withColumn("label", F.col("code").cast("int")).drop("code").select(*wide.columns)


def one_hot(wide: DataFrame, classes: int) -> DataFrame:
    return wide.withColumn("hot", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == F.col("label")).cast("int")))


def list_datasets(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(repository, dataset): folder and file-name stem of each matrix file under path/repository/; checkpoint folders are skipped.

    A folder named like a Parquet file is one table, whatever its part files are called.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    root = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path).strip("/")
    parts, own = F.split("path", "/"), F.split(F.element_at(F.split("path", re.escape(f"/{root}/"), 2), -1), "/")
    above = F.slice(own, 1, F.size(own) - 1)  # folders between path and the file
    table = F.coalesce(F.array_position(F.transform(above, lambda c: c.endswith(".parquet")), True), F.lit(0))  # from 1, 0 without one
    at = F.when(table > 0, F.size(parts) - F.size(own) + table).otherwise(F.size(parts)).cast("int")
    named = files.select(F.get(parts, at - 2).alias("repository"), file_stem(F.get(parts, at - 1)).alias("dataset"))
    return named.where("repository <> '.ipynb_checkpoints'").distinct()


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(mat|parquet)$", "")


# --- the matrices of the registered queries ---


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "label", "embedding")


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark: SparkSession, sf_dir: str, label: Column) -> DataFrame:
    return matrix_of_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _LINE, label, F.col("l_orderkey") * 8 + F.col("l_linenumber"))


def lines_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, (F.col("l_linestatus") == "O").cast("int"))


def lines_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return _lines(spark, sf_dir, F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2))
