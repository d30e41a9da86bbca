"""Catalogs as tables: tables, columns, keys and settings, and what is declared about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """table_schema, table_name of the session's catalog, without temporary views."""
    rows = [(".".join(t.namespace or []), t.name) for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(rows, "table_schema string, table_name string")


def columns(named: dict[str, DataFrame]) -> DataFrame:
    """table_name, position (from 1), column_name, data_type, nullable of the given tables."""
    rows = [(t, k + 1, f.name, f.dataType.simpleString(), f.nullable) for t, df in named.items() for k, f in enumerate(df.schema)]
    spark = next(iter(named.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def column_shape(cols: DataFrame) -> DataFrame:
    """table_name, shape: name:type:nullable of all columns in order, joined by commas."""
    one = F.concat_ws(":", "column_name", "data_type", F.col("nullable").cast("string"))
    return cols.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", one.alias("one"))))["one"], ",").alias("shape"))


def foreign_keys(constraints: DataFrame, key_columns: DataFrame, referenced: DataFrame) -> DataFrame:
    """One row per foreign key with both column lists in order, so composite keys stay whole.

    constraints: constraint_name, table_name, kind; key_columns and referenced: constraint_name, table_name,
    column_name, position.
    """
    listed = lambda df, p: df.groupBy("constraint_name").agg(F.min("table_name").alias(f"{p}_table"), F.array_sort(F.collect_list(F.struct("position", "column_name")))["column_name"].alias(f"{p}_columns"))
    keys = constraints.where("kind = 'FOREIGN KEY'").select("constraint_name")
    return keys.join(listed(key_columns, "child"), "constraint_name").join(listed(referenced, "parent"), "constraint_name")


def settings(spark: SparkSession, names: list[str]) -> DataFrame:
    """name, found of session settings; unset ones have no row."""
    rows = [(n, v) for n in names if (v := spark.conf.get(n, None)) is not None]
    return spark.createDataFrame(rows, "name string, found string")


def login_roles(roles: DataFrame) -> DataFrame:
    """Roles that can log in and are not the system's own."""
    return roles.where(F.col("can_login") & ~F.col("role_name").startswith("pg_"))


def invalid_indexes(indexes: DataFrame) -> DataFrame:
    """Indexes left invalid, by schema, table and name."""
    return indexes.where(~F.col("is_valid")).orderBy("schema_name", "table_name", "index_name")


def sequence_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Sequences (schema_name, sequence_name, last_value) that differ or that one side lacks; null is a value."""
    e, a = expected.withColumnRenamed("last_value", "expected_value").withColumn("e", F.lit(True)), actual.withColumnRenamed("last_value", "actual_value").withColumn("a", F.lit(True))
    both = e.join(a, ["schema_name", "sequence_name"], "full_outer")
    return both.where(F.col("e").isNull() | F.col("a").isNull() | ~F.col("expected_value").eqNullSafe(F.col("actual_value"))).drop("e", "a")
