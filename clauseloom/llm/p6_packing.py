"""Problem 6: filling containers of fixed capacity with texts.

Best-fit decreasing over sizes in tokens. Texts of one size are interchangeable, so the packing is solved on the counts
of the sizes, of which there are no more than the capacity: a segment tree over remaining capacities finds the tightest
open container in logarithmic time, and runs of containers in the same state are treated at once. Every text then gets
its container from its rank among the texts of its size; pieces that fill a container need none. The result is exactly that of best-fit decreasing text by text,
but neither the driver nor a task holds more than the sizes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clauseloom.session import cut, spread, table

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer splits text before it merges bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART = 200_000  # texts of one size, about, that are ranked in one task


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of the documents with text; null, empty and blank texts and rows without an id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for b in batches:
            texts = b.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if t.strip()]
            sizes = pa.array([len(encode(texts[i])) for i in keep], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), sizes], ["doc_id", "n_tokens"])

    return spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long")


class OpenContainers:
    """Runs of containers in the same state by remaining capacity, under a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.filled = [False] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def add(self, remaining: int, first: int, count: int) -> None:
        if count <= 0:
            return
        self.runs[remaining].append((first, count))
        i = self.leaves + remaining
        while i and not self.filled[i]:
            self.filled[i] = True
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least `least` that an open container has."""
        i = self.leaves + least
        if not self.filled[i]:
            while i > 1 and (i % 2 or not self.filled[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.filled[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        i = self.leaves + remaining
        if not self.runs[remaining]:
            self.filled[i] = False
            while (i := i // 2) and not (self.filled[2 * i] or self.filled[2 * i + 1]):
                self.filled[i] = False
        return run


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (size, first_rank, n, first_container, each): of the items of that size those from first_rank on, n of them,
    lie in containers from first_container on, `each` of them in one. And the number of containers."""
    open_, rows, made = OpenContainers(capacity), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            remaining = open_.tightest(size)
            if remaining is None:
                remaining, first = capacity, made
                count = -(-left // (capacity // size))
                made += count
            else:
                first, count = open_.take(remaining)
            each = remaining // size
            full = min(count, left // each)  # containers that get `each` items; then one may get fewer
            if full:
                rows.append((size, rank, full * each, first, each))
                open_.add(remaining - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            rest = count - full
            if rest and left and left < each:
                rows.append((size, rank, left, first + full, left))
                open_.add(remaining - left * size, first + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            open_.add(remaining, first + full, rest)
    return rows, made


def ranked(items: DataFrame, key: list[str], most: int, weight: str | None = None) -> DataFrame:
    """items with `rank` from 0 among those of one size: how many come before in the order of the key inside a part of the
    key's hash. most: items of the commonest size; no part holds more than about PART of them. weight: a column that says
    for how many items a row stands."""
    salts = max(1, -(-most // PART))
    one = F.col(weight) if weight else F.lit(1)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = salted.withColumn("_row", F.coalesce(F.sum(one).over(before("size", "_salt").orderBy(*key)), F.lit(0)))
    if salts == 1:
        return inside.withColumn("rank", F.col("_row")).drop("_salt", "_row")
    counts = salted.groupBy("size", "_salt").agg(F.sum(one).alias("_n"))  # no more rows than sizes times salts
    offsets = counts.select("size", "_salt", F.coalesce(F.sum("_n").over(before("size").orderBy("_salt")), F.lit(0)).alias("_before"))
    return inside.join(offsets, ["size", "_salt"]).withColumn("rank", F.col("_before") + F.col("_row")).drop("_salt", "_before", "_row")


def containers(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, n_tokens, container for (doc_id, n_tokens): a text within the capacity is piece 0, a longer one
    is cut into full containers and a last piece that is packed with the others. Texts without tokens are left out;
    ties are broken by doc_id. The containers of full pieces are numbered after the packed ones, those of one text one after another."""
    rest = F.pmod("n_tokens", F.lit(capacity))
    texts = sizes.where("n_tokens > 0").select("doc_id", rest.cast("long").alias("size"), F.floor(F.col("n_tokens") / capacity).alias("full"))
    counted = texts.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("full") > 0).cast("long")).alias("long")).collect()
    counts = {r["size"]: r["n"] for r in counted if r["size"]}
    rows, made = best_fit_decreasing(counts, capacity)
    schema = "size long, first_rank long, n long, first_container long, each long"
    places = F.broadcast(sizes.sparkSession.createDataFrame(rows, schema))  # no more rows than a few for each size up to the capacity
    at = F.col("rank") - F.col("first_rank")
    packed = (
        ranked(texts.where("size > 0").withColumn("piece", F.col("full").cast("int")), ["doc_id"], max(counts.values(), default=0))
        .join(places, "size")
        .where((at >= 0) & (at < F.col("n")))
        .select("doc_id", "piece", F.col("size").alias("n_tokens"), (F.col("first_container") + F.floor(at / F.col("each"))).alias("container"))
    )
    long = ranked(texts.where("full > 0").withColumn("size", F.lit(0)), ["doc_id"], sum(r["long"] for r in counted), "full")
    whole = long.select("doc_id", "rank", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
    return packed.unionByName(whole.select("doc_id", "piece", F.lit(capacity).cast("long").alias("n_tokens"), (F.col("rank") + F.col("piece") + made).alias("container")))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(cut(token_counts(table(spark, sf_dir, "documents"))))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers hold how many texts, and what share of their room is used."""
    each = p6_containers(spark, sf_dir).groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("used"))
    return each.groupBy("n_pieces").agg(F.count(F.lit(1)).alias("n_containers"), F.round(F.avg("used") / CAPACITY, 6).alias("fill"))
