"""Parents with ordered children, scaled quantities and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: str, columns: list[str], name: str) -> DataFrame:
    """Parents with an array of their children in order; none gives an empty array."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name)
    grouped = children.groupBy(F.col(child_key).alias(parent_key)).agg(rows)
    return parents.join(grouped, parent_key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def multiplier(servings: Column, base: Column) -> Column:
    return F.when(base > 0, servings.cast("double") / base).otherwise(F.lit(1.0))


def clamped_servings(n: Column, least: int = 1, most: int = 8) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), n))


def half_step(n: Column) -> Column:
    """Multiples of 5 from 20 on, else of a half; halves round up."""
    return F.when(n >= 20, F.floor(n / 5 + 0.5).cast("double") * 5).otherwise(F.floor(n * 2 + 0.5).cast("double") / 2)


def plain_number(n: Column) -> Column:
    """A number's text without a trailing .0."""
    return F.regexp_replace(n.cast("string"), r"\.0$", "")


def quantity_label(n: Column, unit: Column) -> Column:
    """Quantity and unit; cloves lose their s for one; without a unit the number alone."""
    shown = plain_number(n)
    return F.when(unit == "", shown).when((unit == "cloves") & (n == 1), F.concat(shown, F.lit(" clove"))).when(unit == "cloves", F.concat(shown, F.lit(" cloves"))).otherwise(F.concat(shown, F.lit(" "), unit))


def cascade_delete(children: DataFrame, child_key: str, deleted: DataFrame, parent_key: str) -> DataFrame:
    """Children that stay when the parents in ``deleted`` go."""
    return children.join(deleted.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def servings_label(n: Column) -> Column:
    return F.when(n == 1, "Scaled for one").otherwise(F.concat(F.lit("Scaled for "), plain_number(n)))


def first_letter(name: Column) -> Column:
    return F.substring(name, 1, 1)


def numbered_steps(steps: DataFrame, parent: str, order: str, timer: str) -> DataFrame:
    """Steps with ``step_number`` from 1 within their parent; an empty timer is none."""
    from pyspark.sql import Window

    at = Window.partitionBy(parent).orderBy(order)
    return steps.withColumns({"step_number": F.row_number().over(at), timer: F.nullif(F.col(timer), F.lit(""))})


def find_first(rows: DataFrame, column: str, value: str, order: str) -> DataFrame:
    """The first row with that value; none where nothing is found."""
    return rows.where(F.col(column) == value).orderBy(order).limit(1)


def backfilled(rows: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    """Rows with a new value where the condition holds; where it is unknown the old one stays."""
    return rows.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def with_defaults(rows: DataFrame, id_col: str, at_col: str) -> DataFrame:
    """Rows with an id and a creation time of their own where they have none; write them before they are read twice."""
    return rows.withColumns({id_col: F.coalesce(id_col, F.uuid()), at_col: F.coalesce(at_col, F.current_timestamp())})
