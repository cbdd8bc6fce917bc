"""Step and lane tables in text: their cells, grids, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseloom.functions import text as T

ROW = r"^\s*(Step|Row|Year)?\s*(\d{1,2})[ |.]+((?:\$?\d{1,3},\d{3}\s*)+)$"


def cells(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, kind, step, lane from 1, value, at (page and line): the cells of lines that read as a row of a step table."""
    lines = df.select(key, F.posexplode(F.split(text, "[\n\f]")).alias("at", "line")).where(F.col("line").rlike(ROW))
    values = F.regexp_extract_all(F.regexp_extract("line", ROW, 3), F.lit(r"\d{1,3},\d{3}"), F.lit(0))
    rows = lines.select(key, F.col("at").cast("long").alias("at"), F.regexp_extract("line", ROW, 1).alias("kind"), F.regexp_extract("line", ROW, 2).cast("long").alias("step"), F.posexplode(values).alias("_l", "_v"))
    return rows.select(key, "kind", "step", (F.col("_l") + 1).cast("long").alias("lane"), F.regexp_replace("_v", ",", "").cast("long").alias("value"), "at")


def grid(c: DataFrame, keys: list[str], lanes: int) -> DataFrame:
    """A row for each step, a column for each lane; the last cell of a step and lane wins, missing ones are null."""
    last = c.groupBy(*keys, "step", "lane").agg(F.max_by("value", "at").alias("value"))
    return last.groupBy(*keys, "step").agg(*[F.max(F.when(F.col("lane") == i, F.col("value"))).alias(f"lane_{i}") for i in range(1, lanes + 1)])


def missing_steps(steps: Column) -> Column:
    """Interior numbers that a table of four steps and more lacks, if they are no more than two or a quarter of its range."""
    low, high = F.array_min(steps), F.array_max(steps)
    gone = F.array_except(F.sequence(low, high), steps)
    return F.when((F.size(steps) >= 4) & (F.size(gone) <= F.greatest(F.lit(2.0), (high - low) / 4)), gone).otherwise(F.array().cast("array<bigint>"))


def progressions(c: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lane, n, uniform: whether the values of five steps and more rise by one and the same amount that is not zero."""
    last = c.groupBy(*keys, "lane", "step").agg(F.max_by("value", "at").alias("value"))
    w = Window.partitionBy(*keys, "lane").orderBy("step")
    d = last.withColumn("d", F.col("value") - F.lag("value").over(w))
    g = d.groupBy(*keys, "lane").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("a"), F.max("d").alias("b"))
    return g.select(*keys, "lane", "n", F.coalesce((F.col("n") >= 5) & (F.col("a") == F.col("b")) & (F.col("a") != 0), F.lit(False)).alias("uniform"))


def signature(value: Column) -> Column:
    """Aggregate: two hashes for a multiset of values, sums over its members, so that nothing is gathered. Nulls count."""
    total = lambda seed: F.sum(F.xxhash64(value, F.lit(seed)).cast("decimal(20,0)")).cast("string")
    return F.concat_ws("/", F.count(F.lit(1)).cast("string"), total(1), total(2))


def multiset_classes(rows: DataFrame, key: str, value: str, least: int = 4) -> DataFrame:
    """key, n_values, class_id (the smallest key with the same multiset of values), members: one row a key. Keys with less
    than `least` values are a class of their own."""
    made = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"), signature(F.col(value)).alias("_s"))
    own = F.when(F.col("n_values") < least, F.concat(F.lit("#"), F.col(key).cast("string"))).otherwise(F.col("_s"))
    made = made.withColumn("_s", own)
    facts = made.groupBy("_s").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("members"))
    return made.join(facts, "_s").select(key, "n_values", "class_id", "members")


def multiset_overlap(counts: DataFrame, keys: list[str], left: Column, right: Column, value: str) -> DataFrame:
    """keys, overlap, least (values of the smaller side): shared values (each as often as in both) over those of the larger side; nothing on a side: 0.
    counts: keys, value and the two counts. Both sides are columns of one row, so nothing is paired."""
    g = counts.groupBy(*keys).agg(F.sum(F.least(left, right)).alias("_b"), F.greatest(F.sum(left), F.sum(right)).alias("_n"), F.least(F.sum(left), F.sum(right)).alias("_m"))
    return g.where("_m > 0").select(*keys, (F.col("_b") / F.col("_n")).alias("overlap"), F.col("_m").alias("least"))


IMPLAUSIBLE = 500_000  # no pay scale has such a value


def warnings(c: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_steps, n_lanes, n_cells, warnings (sorted), escalates for tables of cells (see cells): what says that a table was not read
    as it stands. A table read otherwise is to be read again if lanes hold the same varying values or cells are missing."""
    facts = c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct("step").alias("n_steps"), F.countDistinct("lane").alias("n_lanes"), F.array_sort(F.collect_set("step")).alias("_s"), F.max("value").alias("_top"),
    )
    labels = c.groupBy(*keys, "step").agg(F.countDistinct("at").alias("n")).groupBy(*keys).agg(F.max("n").alias("_twice"))
    last = c.groupBy(*keys, "step", "lane").agg(F.max_by("value", "at").alias("value"))
    row = last.groupBy(*keys, "step").agg(F.array_sort(F.collect_list(F.struct("lane", "value"))).alias("v"))
    rows = row.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("_rows"), F.max("n").alias("_same"))
    column = last.groupBy(*keys, "lane").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("v"), F.countDistinct("value").alias("d"))
    columns = column.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).where("n > 1").groupBy(*keys).agg(F.max((F.col("d") > 1).cast("int")).alias("_copied"), F.min((F.col("d") > 1).cast("int")).alias("_flat"))
    t = facts.join(labels, keys).join(rows, keys).join(columns, keys, "left")
    expected = F.col("n_steps") * F.col("n_lanes")
    told = F.array_sort(F.array_compact(F.array(
        F.when(F.col("_twice") > 1, "duplicate_labels"), F.when(F.size(missing_steps(F.col("_s"))) > 0, "dropped_rows"), F.when((F.col("_rows") > 2) & (F.col("_same") > 0.7 * F.col("_rows")), "rows_collapsed"),
        F.when(F.col("_copied") == 1, "lanes_copied"), F.when(F.col("_flat") == 0, "lanes_constant"), F.when(F.col("n_cells") < 0.5 * expected, "cells_missing"),
        F.when((F.col("n_lanes") == 1) & (F.col("n_steps") >= 3), "single_lane"), F.when(F.col("_top") > IMPLAUSIBLE, "implausible"),
    )))
    return t.select(*keys, "n_steps", "n_lanes", "n_cells", told.alias("warnings")).withColumn("escalates", F.arrays_overlap("warnings", F.array(F.lit("lanes_copied"), F.lit("cells_missing"))))


def numeric_density(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(T.FIGURE), F.lit(0))).cast("long")
