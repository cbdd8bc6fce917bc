"""Lexical, dense and interleaved retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseloom.functions import text as T
from clauseloom.session import cut

K1, B = 1.2, 0.75  # of the published BM25
HEADING, TEXT = 2.0, 1.0  # weights of the columns
BLOCK = 4096  # query vectors compared at once
TERMS = 20_000  # different terms, at most, that are asked for at once


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(items: DataFrame, key: str, heading: str, text: str, queries: DataFrame, query: str) -> DataFrame:
    """query, key, rank (lower is better) of every item with a term of the query. queries: (query, terms), a codebook: its
    terms are brought to the driver, at most TERMS. Statistics are those of all items. Equal items count once.

    Each text is tokenised once; the sizes and the counts of asked terms are taken inside the row, so that neither texts nor
    other tokens are shuffled."""
    asked = queries.select(query, F.explode("terms").alias("term")).distinct()
    terms = sorted({r["term"] for r in asked.select("term").distinct().limit(TERMS + 1).collect()})
    if len(terms) > TERMS:
        raise ValueError(f"more than {TERMS} query terms: ask in parts")
    sized = items.select(key, tokens(F.col(heading)).alias("_h"), tokens(F.col(text)).alias("_t"))
    among = lambda c: F.filter(c, lambda t: t.isin(terms) if terms else F.lit(False))
    sized = sized.select(key, (F.size("_h") + F.size("_t")).cast("long").alias("size"), among("_h").alias("_h"), among("_t").alias("_t"))
    often = lambda c, t: F.size(F.filter(c, lambda x: x == t))
    counted = F.transform(F.array_distinct(F.concat("_h", "_t")), lambda t: F.struct(t.alias("term"), (often("_h", t) * HEADING + often("_t", t) * TEXT).alias("tf")))
    once = cut(sized.where("size > 0").select(key, "size", counted.alias("p")).dropDuplicates([key]))
    items_n, mean = once.agg(F.count(F.lit(1)), F.avg("size")).first()
    used = once.select(key, "size", F.explode("p").alias("p")).select(key, "size", "p.term", "p.tf")
    df = used.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(items_n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5)))
    # no more rows than the codebook has terms
    weights = F.broadcast(asked.join(df, "term").select(query, "term", idf.alias("_idf")))
    part = F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
    return used.join(weights, "term").groupBy(query, key).agg((-F.sum(part)).alias("rank"))


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int, to: str = "position") -> DataFrame:
    """The first k of each group in the order, with their position from 1. Spark keeps k rows a group before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn(to, F.row_number().over(w).cast("long")).where(F.col(to) <= k)


def interleave(ranked: DataFrame, query: str, item: str, source: str, position: str, depth: int, budget: int) -> DataFrame:
    """The lists of a query taken in turn, rank by rank and in the order of `source`, each item once where it is first
    met, `budget` items. query, item, source, place from 1."""
    lists = ranked.where(F.col(position) <= depth)
    first = lists.groupBy(query, item).agg(F.min(F.struct(position, source)).alias("_m")).select(query, item, F.col(f"_m.{position}").alias("_p"), F.col(f"_m.{source}").alias(source))
    return top_k(first, [query], [F.col("_p"), F.col(source), F.col(item)], budget, "place").drop("_p")


def cosine_top_k(queries: DataFrame, vectors: DataFrame, key: str, embedding: str, k: int, block: int = BLOCK, scope: str | None = None, itself: bool = False) -> DataFrame:
    """query_id, key, similarity (six decimals), position: the k most similar vectors, itself aside (unless asked for), ties to the
    smaller key. scope: a column (a document's id) in which a query and a vector must agree. Exact. The queries are a stated set: they are compared in blocks of bounded size, and each task keeps k for a
    query. Null and zero vectors and vectors of another length than the query are similar to nothing."""
    spark = vectors.sparkSession
    columns = [key, embedding, *([scope] if scope else [])]
    rows = vectors.select(*columns).where(F.col(embedding).isNotNull())
    out: DataFrame | None = None
    held: list[tuple] = []

    def search(block_rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block_rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size: dict[tuple, list[tuple]] = {}
            for i, v, w in shared.value:
                by_size.setdefault((len(v), w), []).append((i, v))
            asked = {}
            for group, members in by_size.items():
                x = np.array([v for _, v in members], np.float64).reshape(-1, group[0])
                norm = np.linalg.norm(x, axis=1)
                asked[group] = (np.array([i for i, _ in members])[norm > 0], x[norm > 0] / norm[norm > 0][:, None])
            for b in batches:
                ids, values = b.column(0).to_pylist(), b.column(1).to_pylist()
                scopes = b.column(2).to_pylist() if scope else [None] * len(ids)
                at: dict[tuple, list[int]] = {}
                for i, (v, w) in enumerate(zip(values, scopes)):
                    if (len(v), w) in asked and None not in v:
                        at.setdefault((len(v), w), []).append(i)
                parts = [[], [], []]
                for group, places in at.items():
                    q_ids, q = asked[group]
                    x = np.array([values[i] for i in places], np.float64)
                    norm = np.linalg.norm(x, axis=1)
                    own = np.array([ids[i] for i in places])[norm > 0]
                    x = x[norm > 0] / norm[norm > 0][:, None]
                    if not len(q) or not len(own):
                        continue
                    s = np.round(q @ x.T, 6)
                    if not itself:
                        s[q_ids[:, None] == own[None, :]] = -2.0
                    floor = np.partition(s, len(own) - min(k, len(own)), axis=1)[:, len(own) - min(k, len(own))]
                    r, c = np.nonzero((s >= floor[:, None]) & (s > -2.0))
                    order = np.lexsort((own[c], -s[r, c], r))
                    r, c = r[order], c[order]
                    first = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c = r[first], c[first]
                    parts[0] += q_ids[r].tolist()
                    parts[1] += own[c].tolist()
                    parts[2] += s[r, c].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], ["query_id", key, "similarity"])

        return rows.mapInArrow(run, f"query_id long, {key} long, similarity double")

    for row in queries.select(*columns).where(F.col(embedding).isNotNull()).toLocalIterator():
        held.append((row[0], [float(x) if x is not None else 0.0 for x in row[1]], row[2] if scope else None))
        if len(held) == block:
            out = search(held) if out is None else out.unionByName(search(held))
            held = []
    if held or out is None:
        out = search(held) if out is None else out.unionByName(search(held))
    return top_k(out, ["query_id"], [F.col("similarity").desc(), F.col(key)], k)


def with_vectors(asked: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The asked rows. One whose key has no vector is an error when the result is read: a search that had nothing to look in
    must not look like one that found nothing."""
    there = vectors.select(key).distinct().withColumn("_there", F.lit(True))
    known = F.coalesce("_there", F.raise_error(F.concat(F.lit(f"no vectors for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return asked.join(there, key, "left").where(known).drop("_there")


def support(terms: Column, text: Column) -> Column:
    """How many of the terms stand in the text."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t))).cast("long")


def densest(scored: DataFrame, by: list[str], score: str, ordinal: str, k: int) -> DataFrame:
    """The k items of a group with the highest score, ties to the earlier; all items if there are no more than k or none
    scores. The items stay in their own order (ordinal)."""
    w = Window.partitionBy(*by)
    ranked = scored.withColumn("_r", F.row_number().over(w.orderBy(F.col(score).desc(), F.col(ordinal)))).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_m", F.max(score).over(w))
    return ranked.where((F.col("_r") <= k) | (F.col("_n") <= k) | (F.col("_m") <= 0)).drop("_r", "_n", "_m")


def snippet(text: str, terms: str, before: int = 60, most: int = 240) -> Column:
    """A window of the text column around the first of the terms that it holds; its beginning if it holds none."""
    at = F.expr(f"coalesce(array_min(filter(transform({terms}, t -> locate(t, lower({text}))), p -> p > 0)), 1)")
    return F.substring(F.col(text), F.greatest(F.lit(1), at - before), F.lit(most))


def query_terms(text: Column) -> Column:
    return T.search_terms(text)
