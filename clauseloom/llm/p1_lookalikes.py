"""Problem 1: visually identical text with different characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clauseloom.operators.containment import stretch_pairs
from clauseloom.llm.textform import consistent_form, script_findings, squeeze
from clauseloom.session import spread, table

LEAST = 20  # characters of the evidence in consistent form


def with_consistent_form(df: DataFrame, column: str, to: str = "consistent") -> DataFrame:
    """df with the column's text in consistent form as a further column (a column of that name is replaced). Nulls stay
    null, texts of blanks become empty; any length."""
    fields = [f for f in df.schema.fields if f.name != to]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([consistent_form(t) for t in b.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), made], [*(f.name for f in fields), to])

    return df.mapInArrow(run, schema)


def _forms(df: DataFrame, ident: str, text: str, least: int = 0) -> DataFrame:
    """ident, document_id, consistent, and stored: the text as stored with blanks made one where it differs from
    consistent, else null. Texts under `least` characters in consistent form are left out."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, made, stored = [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                form = consistent_form(t)
                if form is None or len(form) < least:
                    continue
                plain = squeeze(t)
                keep.append(i)
                made.append(form)
                stored.append(None if plain == form else plain)
            at = pa.array(keep, pa.int64())
            cols = [b.column(0).take(at), b.column(1).take(at), pa.array(made, pa.string()), pa.array(stored, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [ident, "document_id", "consistent", "stored"])

    return spread(df.select(ident, "document_id", text)).mapInArrow(
        run, f"{ident} {types[ident]}, document_id string, consistent string, stored string"
    )


def found_by_looks(attempts: DataFrame, passages: DataFrame) -> DataFrame:
    """attempt_id, passage_id of one document where the evidence (LEAST characters and more in consistent form) reads
    the same as a stretch of the passage but is not found in it as stored. Each pair once. Rows with a null id, text or
    document give nothing; neither do evidence or passages that are empty; other columns are not looked at."""
    a = attempts.where(F.length("evidence") >= 1).where("attempt_id is not null and document_id is not null")
    p = passages.where(F.length("text") >= LEAST // 2).where("passage_id is not null and document_id is not null")
    needles = _forms(a, "attempt_id", "evidence", LEAST).select("attempt_id", "document_id", F.col("consistent").alias("needle"), F.col("stored").alias("a_stored"))
    hay = _forms(p, "passage_id", "text").select("passage_id", "document_id", F.col("consistent").alias("hay"), F.col("stored").alias("p_stored"))
    sizes = (a.where(F.length("evidence") >= LEAST // 4).select("document_id"), p.select("document_id"))
    differs = F.col("a_stored").isNotNull() | F.col("p_stored").isNotNull()
    as_stored = F.contains(F.coalesce("p_stored", "hay"), F.coalesce("a_stored", "needle"))
    return (
        stretch_pairs(needles, hay, "document_id", sizes)
        .where(differs & ~as_stored)
        .select("attempt_id", "passage_id")
        .distinct()
    )


def script_report(df: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, n_mixed, n_whole, changed: tokens of mixed scripts and of look-alike letters only, and whether the consistent form
    differs from the text as stored (blanks aside). Nulls have none and don't change; equal rows give equal rows."""
    kind = dict(df.dtypes)[ident]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [script_findings(t) for t in texts]
            changed = [t is not None and consistent_form(t) != squeeze(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m for m, _ in found], pa.int32()), pa.array([w for _, w in found], pa.int32()), pa.array(changed, pa.bool_())], [ident, "n_mixed", "n_whole", "changed"])

    return spread(df.select(ident, text)).mapInArrow(run, f"{ident} {kind}, n_mixed int, n_whole int, changed boolean")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_by_looks(table(spark, sf_dir, "attempts"), table(spark, sf_dir, "passages"))


def p1_consistent_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage's text in consistent form, a passage once."""
    rows = table(spark, sf_dir, "passages").select("passage_id", "text").dropDuplicates(["passage_id"])
    return with_consistent_form(rows, "text").select("passage_id", "consistent")


def p1_script_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with its tokens of mixed scripts and of look-alike letters only, a passage once."""
    return script_report(table(spark, sf_dir, "passages"), "passage_id", "text").groupBy("passage_id").agg(*[F.max(c).alias(c) for c in ("n_mixed", "n_whole", "changed")])


def p1_consistent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt's evidence in consistent form, an attempt once."""
    rows = table(spark, sf_dir, "attempts").select("attempt_id", "evidence").dropDuplicates(["attempt_id"])
    return with_consistent_form(rows, "evidence").select("attempt_id", "consistent")
