"""Sources and sinks: text with page breaks or page marks, Markdown tables, CSV of strings, JSON lines of batches, wide
and partitioned outputs, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

ANSWER = T.StructType([T.StructField(n, T.StringType()) for n in ("question_id", "answer", "evidence", "page", "confidence", "coder_notes")])
BATCH = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("answers", T.ArrayType(ANSWER)), T.StructField("_bad", T.StringType()),
])


def union_by_position(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows one after another under the first frame's names; a frame with another number of columns is an error."""
    for o in others:
        if len(o.columns) != len(first.columns):
            raise ValueError(f"{len(first.columns)} columns against {len(o.columns)}")
        first = first.union(o)
    return first


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page_no, page of whole text files: pages by form feed, or by marks '<!-- page N -->' if a file has them. A
    number that the marks leave out is an empty page, of a number that comes twice the last page counts; what stands before
    the first mark is dropped. A file with nothing but marks without a number is one page."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return split_pages(files)


def split_pages(files: DataFrame) -> DataFrame:
    """path, page_no, page for (path, text); see read_text_pages."""
    mark = r"<!--\s*page\s+(\d+)\s*-->"
    files = files.withColumn("_kind", F.when(F.col("text").rlike(mark), "marked").when(F.contains("text", F.lit("<!-- page")), "whole").otherwise("plain"))
    marked = files.where("_kind = 'marked'")
    numbers = F.transform(F.regexp_extract_all("text", F.lit(mark), F.lit(1)), lambda x: x.cast("int"))
    bodies = F.expr("slice(split(text, '<!--\\\\s*page\\\\s+\\\\d+\\\\s*-->'), 2, greatest(1, size(split(text, '<!--\\\\s*page\\\\s+\\\\d+\\\\s*-->'))))")
    zipped = F.arrays_zip(numbers.alias("n"), F.transform(bodies, lambda x: F.trim(x)).alias("b"))
    last = F.filter(zipped, lambda x, i: ~F.exists(F.slice(numbers, i + 2, F.greatest(F.lit(1), F.size(numbers))), lambda n: n == x["n"]))
    by_number = F.map_from_entries(last)
    a = marked.select("path", by_number.alias("m"), numbers.alias("n"))
    a = a.select("path", "m", F.explode(F.sequence(F.lit(1), F.array_max("n"))).alias("page_no")).select("path", F.col("page_no").cast("long").alias("page_no"), F.coalesce(F.col("m")[F.col("page_no")], F.lit("")).alias("page"))
    pages = F.when(F.col("_kind") == "whole", F.array(F.btrim("text", F.lit(" \t\r\n")))).otherwise(F.split("text", "\f", -1))
    plain = files.where("_kind <> 'marked'").select("path", F.posexplode(pages).alias("p", "page"))
    return a.unionByName(plain.select("path", (F.col("p") + 1).cast("long").alias("page_no"), "page"))


def read_markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of a Markdown table, all strings, trimmed; a row with another number of cells is an error."""
    lines = spark.read.text(path).where(F.col("value").startswith("| ") & ~F.col("value").rlike(r"^\|[\s:|-]+$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select(cells.alias("c")).where(F.lower(F.element_at("c", 1)) != columns[0].lower())
    checked = F.when(F.size("c") == len(columns), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("cells in a row: "), F.size("c").cast("string"))).cast("array<string>"))
    return rows.select(checked.alias("c")).select(*[F.element_at("c", i).alias(n) for i, n in enumerate(columns, 1)])


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every cell a string, line breaks in quotes allowed."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_batches(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """JSON lines of batches, an answer a row. tolerant: lines that don't parse, batches with an error and those of another
    kind than a window are left out; otherwise a line that doesn't parse is an error."""
    reader = spark.read.schema(BATCH).option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
    rows = reader.json(path)
    if tolerant:
        rows = rows.where("_bad is null and error is null and coalesce(kind, 'window') = 'window'")
    return rows.select("document_id", "batch", F.explode("answers").alias("a")).select("document_id", "batch", "a.*")


def batched(answers: DataFrame, size: int = 10) -> DataFrame:
    """document_id, batch, answers: the answers of a document in batches for a sink of JSON lines, private fields (with a
    leading underscore) left out."""
    public = [c for c in answers.columns if c != "document_id" and not c.startswith("_")]
    rn = F.row_number().over(Window.partitionBy("document_id").orderBy("question_id"))
    numbered = answers.select("document_id", *public).withColumn("batch", (F.floor((rn - 1) / size) + 1).cast("long"))
    return numbered.groupBy("document_id", "batch").agg(F.sort_array(F.collect_list(F.struct("question_id", *[c for c in public if c != "question_id"]))).alias("answers"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A header and the columns in this order; control characters that table programs reject are dropped."""
    clean = [F.regexp_replace(F.col(c).cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias(c) for c in columns]
    df.select(*clean).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Files by partition; existing partitions that the frame has rows for are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_by_document(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """The old rows of documents that the new ones don't have, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pending(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Requests without a response."""
    return requests.join(responses.select(key), key, "left_anti")


def first_text(*candidates: Column) -> Column:
    """The first candidate that isn't blank: an override before the cached text before the fresh one."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, c) for c in candidates])


def manifest_status(text: Column, recorded: Column) -> Column:
    return F.when(text.isNull(), "text_missing").when(F.sha2(text, 256) == recorded, "ok").otherwise("mismatch")


def checked_lookup(rows: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """An inner join in which every row must find its partner; a row that doesn't is an error when the result is read."""
    d = dim.withColumn("_there", F.lit(True))
    joined = rows.join(d, key, "left")
    keep = [c for c in joined.columns if c != "_there"]
    test = F.coalesce(F.col("_there"), F.raise_error(F.concat(F.lit(f"no partner for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return joined.where(test).select(*keep)
