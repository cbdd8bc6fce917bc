"""Several readings (engines) of the same pages: gates, agreement, arbitration, error rates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from clauseloom.functions import text as T

# Deflated share of a loop, least share of different lines, times the median length, agreement of figures.
LOOP, DISTINCT, LONG, AGREE = 0.10, 0.60, 2.5, 0.75


def agreement(a: Column, b: Column) -> Column:
    """Jaccard of two sets of figures; two empty sets agree."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def distinct_lines(c: Column) -> Column:
    """Share of different lines among those of more than three characters; none: 1."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 3)
    return F.when(F.size(lines) == 0, 1.0).otherwise(F.size(F.array_distinct(lines)) / F.size(lines))


def invented(c: Column) -> Column:
    """Image references and sample addresses, which no scan holds."""
    return c.rlike(r"!\[[^\]]*\]\(https?://|\bimgur\b|\bexample\.com\b")


def arbitrate(pages: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """keys, engine, agreement, disputed for pages with a column of text for each of two engines: `first` is better at
    figures, `second` at prose. A missing or blank reading doesn't count; where both are there and their figures agree, the
    second is taken, else the first, and the page is disputed."""
    has = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    a, b = has(F.col(first)), has(F.col(second))
    score = F.round(agreement(T.figures(F.coalesce(first, F.lit(""))), T.figures(F.coalesce(second, F.lit("")))), 3)
    engine = F.when(a & b, F.when(score >= AGREE, second).otherwise(first)).when(a, first).when(b, second).otherwise("")
    return pages.select(*keys, engine.alias("engine"), F.when(a & b, score).alias("agreement"), (a & b & (score < AGREE)).cast("int").alias("disputed"))


REFUSED = 0.5  # share of degenerate pages, or least share of the longest reading's pages, at which an engine is refused


def gated(readings: DataFrame, keys: list[str]) -> DataFrame:
    """readings with n_chars and the reasons why a page looks generated: few different lines (repeats), an invented reference
    (invented), far longer than the engine's upper median page of the document (long). readings: keys, page_no, engine,
    text; blank and missing pages have no reasons. The pages of one document and engine are gathered by their lengths only."""
    has = F.length(T.squeeze(F.coalesce("text", F.lit("")))) > 0
    rows = readings.withColumn("n_chars", F.when(has, F.length("text")).otherwise(0))
    sizes = rows.where("n_chars > 0").groupBy(*keys, "engine").agg(F.array_sort(F.collect_list("n_chars")).alias("_s"))
    sizes = sizes.select(*keys, "engine", F.element_at("_s", F.floor(F.size("_s") / 2).cast("int") + 1).alias("_m"))
    body = T.outer_trim(F.col("text"))
    why = F.array_compact(F.array(
        F.when(distinct_lines(body) < DISTINCT, "repeats"), F.when(F.length(body) > LONG * F.col("_m"), "long"), F.when(invented(body), "invented"),
    ))
    return rows.join(sizes, [*keys, "engine"], "left").withColumn("reasons", F.when(F.col("n_chars") > 0, why).otherwise(F.array().cast("array<string>"))).drop("_m")


def refused(gated_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, engine, why for the engines that are no use for a document: fewer than half the pages of the longest reading, or more
    than half of the pages with text degenerate."""
    n = gated_rows.groupBy(*keys, "engine").agg(F.max("page_no").alias("n"), F.sum((F.size("reasons") > 0).cast("int")).alias("bad"), F.sum((F.col("n_chars") > 0).cast("int")).alias("full"))
    most = n.groupBy(*keys).agg(F.max("n").alias("most"))
    few, poor = (F.col("most") > 1) & (F.col("n") < REFUSED * F.col("most")), F.col("bad") > REFUSED * F.greatest(F.lit(1), F.col("full"))
    return n.join(most, keys).where(few | poor).select(*keys, "engine", F.when(few, "pages").otherwise("degenerate").alias("why"))


def arbitrate_many(gated_rows: DataFrame, keys: list[str], figures: list[str], prose: list[str]) -> DataFrame:
    """keys, page_no, engine, agreement, disputed, dropped for the pages of several engines (of the engines named in both orders).

    Pages without text or with invented content don't count; clean pages go before flagged ones. If two and more engines are
    left, the best at figures and the best at prose are compared: where their figures agree the latter is taken, else the former,
    and the page is disputed. dropped: engines with text whose page was not in the choice. The engines are few: a page's
    readings are folded in its row."""
    rank = lambda order: F.coalesce(*[F.when(F.col("engine") == e, F.lit(i)) for i, e in enumerate(order)], F.lit(len(order)))
    item = F.struct("engine", rank(figures).alias("f"), rank(prose).alias("p"), T.figures(F.coalesce("text", F.lit(""))).alias("figures"), (F.size("reasons") == 0).alias("clean"), ((F.col("n_chars") > 0) & ~F.array_contains("reasons", "invented")).alias("there"))
    rows = gated_rows.groupBy(*keys, "page_no").agg(F.array_sort(F.collect_list(item)).alias("all"))
    rows = rows.withColumn("_there", F.filter("all", lambda x: x["there"])).withColumn("_clean", F.filter("_there", lambda x: x["clean"]))
    rows = rows.withColumn("_pool", F.when(F.size("_clean") > 0, F.col("_clean")).otherwise(F.col("_there")))
    first = lambda by: F.get(F.array_sort(F.transform("_pool", lambda x: F.struct(x[by].alias("r"), x["engine"].alias("engine"), x["figures"].alias("figures")))), F.lit(0))
    rows = rows.withColumn("_f", first("f")).withColumn("_p", first("p"))
    both = F.size("_pool") > 1
    score = F.round(agreement(F.col("_f.figures"), F.col("_p.figures")), 3)
    lost = F.array_except(F.transform("_there", lambda x: x["engine"]), F.transform("_pool", lambda x: x["engine"]))
    return rows.select(
        *keys, "page_no", F.coalesce(F.when(both & (score < AGREE), F.col("_f.engine")).otherwise(F.col("_p.engine")), F.lit("")).alias("engine"), F.when(both, score).alias("agreement"),
        F.coalesce((both & (score < AGREE)).cast("int"), F.lit(0)).alias("disputed"), F.array_join(F.array_sort(lost), ";").alias("dropped"),
    )


def error_rate(read: Column, truth: Column) -> Column:
    """Character error rate; a missing reading is wrong altogether."""
    t = F.coalesce(truth, F.lit(""))
    return F.when(read.isNull(), 1.0).otherwise(F.levenshtein(read, t) / F.greatest(F.lit(1), F.length(t)))


def word_errors(rows: DataFrame, key: str, read: str, truth: str) -> DataFrame:
    """key, wer: edits between the words of two texts over the words of the truth."""
    kind = dict(rows.dtypes)[key]

    def rate(a: list[str], b: list[str]) -> float:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] / max(1, len(b))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "wer": [rate((a or "").split(), (b or "").split()) for a, b in zip(f[read], f[truth])]})

    return rows.select(key, read, truth).mapInPandas(run, f"{key} {kind}, wer double")


def compression(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, ratio, loop: deflated size over the number of characters; below LOOP a page repeats itself."""
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ratio = [len(zlib.compress(t.strip().encode())) / max(1, len(t.strip())) for t in f[text]]
            yield f[keys].assign(ratio=ratio, loop=[r < LOOP for r in ratio])

    fields = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return rows.where(F.length(F.trim(text)) > 0).select(*keys, text).mapInPandas(run, f"{fields}, ratio double, loop boolean")
