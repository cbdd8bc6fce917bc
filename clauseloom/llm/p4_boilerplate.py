"""Problem 4: lines repeated across the documents of one district.

The lines of a district are the nodes of a graph and pairs of consecutive lines its edges, both weighted by the documents
they occur in (blank lines don't come between two lines). Nodes and edges of high support stay, and the connected components
are the district's boilerplate blocks: a line that always stands alone is a block of its own. Occurrences of a block are
runs of its lines in a passage that kept edges hold together, and these are deleted.

A node needs a tenth of its district's documents, so a district has no more than ten times as many nodes as its
documents have lines on average, and as many edges: the components of a district are found in one task however many
documents it has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clauseloom.session import cut, table

DOCUMENTS = 4  # least documents of a line or an edge
SHARE = 0.1  # least share of the district's documents with passages
WORDS = 4  # least words of a line

NODE, NEXT = ["k1", "k2"], ["b1", "b2"]


def line_key(line: str = "line") -> str:
    """SQL: the words that the letters of a line form, without case, blanks, digits and punctuation."""
    return f"trim(regexp_replace(lower({line}), '[^\\\\p{{L}}\\\\p{{M}}]+', ' '))"


def districts_of(documents: DataFrame) -> DataFrame:
    """document_id, district without case and outer blanks; of several the first. Without a district: left out."""
    district = F.lower(F.regexp_replace("district", r"(?U)^\s+|\s+$", ""))
    return (
        documents.select("document_id", district.alias("district"))
        .where("document_id is not null and district is not null and district <> ''")
        .groupBy("document_id")
        .agg(F.min("district").alias("district"))
    )


def lines_of(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """passage_id, district, doc, lines of the passages whose document has a district, null texts without lines. doc is a
    hash of the document's id; lines: n (from 1) and (k1, k2), hashes of the words, of all lines with a letter; those of
    fewer than WORDS words have null hashes. Only these numbers are shuffled, no text."""
    numbered = f"transform(split(text, '\\n'), (line, i) -> struct(i + 1 as n, {line_key()} as key))"
    keyed = "filter(_l, x -> x.key <> '')"
    hashes = f"""transform({keyed}, x -> if(size(split(x.key, ' ')) >= {WORDS},
        struct(cast(x.n as int) as n, xxhash64(x.key) as k1, xxhash64(reverse(x.key), 1) as k2), struct(cast(x.n as int) as n, cast(null as bigint) as k1, cast(null as bigint) as k2)))"""
    made = passages.where("passage_id is not null and document_id is not null").select("passage_id", "document_id", F.expr(numbered).alias("_l"))
    made = made.select("passage_id", "document_id", F.expr(hashes).alias("lines"))
    return made.join(districts_of(documents), "document_id").select("passage_id", "district", F.xxhash64("document_id").alias("doc"), "lines")


def _with_next(rows: DataFrame) -> DataFrame:
    """A row for each line of WORDS words, with the hashes of the line after it (null, if that is short or there is none)."""
    pairs = F.expr("transform(lines, (x, i) -> struct(x.n as line_no, x.k1 as k1, x.k2 as k2, get(lines, i + 1).k1 as b1, get(lines, i + 1).k2 as b2, get(lines, i - 1).n as before))")
    return rows.select("passage_id", "district", "doc", F.explode(F.filter(pairs, lambda p: p["k1"].isNotNull())).alias("p")).select("passage_id", "district", "doc", "p.*")


def _supported(rows: DataFrame, key: list[str], sizes: DataFrame) -> DataFrame:
    """district, key, n: what occurs in n documents of the district, enough of them. Documents are counted once before
    anything is gathered by the key alone."""
    n = rows.groupBy("district", *key, "doc").agg(F.lit(1).alias("_1")).groupBy("district", *key).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= DOCUMENTS).join(sizes, "district").where(F.col("n") >= SHARE * F.col("docs")).select("district", *key, "n")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Connected components of one district's nodes and edges, as node and number of the block."""
    nodes = list(zip(pdf.k1.tolist(), pdf.k2.tolist()))
    parent = {x: x for x in nodes}

    def root(x: tuple) -> tuple:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, ends in zip(nodes, pdf.ends):
        for e in ends if ends is not None else ():
            a, b = root(x), root((int(e["b1"]), int(e["b2"])))
            parent[max(a, b)] = min(a, b)
    roots = [root(x) for x in nodes]
    number = {r: i for i, r in enumerate(sorted(set(roots)))}
    return pd.DataFrame({"district": pdf.district, "k1": pdf.k1, "k2": pdf.k2, "block": [number[r] for r in roots]})


def block_lines(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """passage_id, line_no, district, block, occurrence (the line of the passage with which the block's run begins) of the lines
    that belong to a boilerplate block of their district; each line once.

    Null texts have no lines, passages of unknown documents and documents without a district no repeated ones; equal
    rows count once, and of different texts under one id a line is repeated if it is in any of them."""
    rows = cut(lines_of(passages, documents))
    sizes = rows.groupBy("district", "doc").agg(F.lit(1).alias("_1")).groupBy("district").agg(F.count(F.lit(1)).alias("docs"))
    lines = _with_next(rows)
    nodes = _supported(lines, NODE, sizes).select("district", *NODE)
    seen = cut(lines.join(nodes, ["district", *NODE]))
    edges = _supported(seen.where("b1 is not null"), [*NODE, *NEXT], sizes).drop("n")
    kept = seen.select("district", *NODE).distinct()
    ends = edges.groupBy("district", *NODE).agg(F.collect_list(F.struct(*NEXT)).alias("ends"))
    graph = kept.join(ends, ["district", *NODE], "left")
    blocks = graph.groupBy("district").applyInPandas(_components, "district string, k1 long, k2 long, block long")
    # a line and the next one hang together if their edge was kept: runs of such lines are the occurrences
    on = ["district", *NODE, *NEXT]
    held = seen.join(edges.withColumn("_held", F.lit(True)), on, "left")
    placed = held.join(blocks, ["district", *NODE]).select("passage_id", "line_no", "district", "block", "before", F.coalesce("_held", F.lit(False)).alias("held"))
    once = placed.repartition("passage_id").groupBy("passage_id", "line_no").agg(F.min(F.struct("district", "block", "before", "held")).alias("m")).select("passage_id", "line_no", "m.*")
    w = Window.partitionBy("passage_id").orderBy("line_no")
    goes_on = F.coalesce(F.lag("held").over(w) & (F.lag("line_no").over(w) == F.col("before")), F.lit(False))
    first = F.max(F.when(~F.col("_on"), F.col("line_no"))).over(w)
    return once.withColumn("_on", goes_on).select("passage_id", F.col("line_no").cast("long").alias("line_no"), "district", "block", first.cast("long").alias("occurrence"))


def repeated_lines(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """passage_id, line_no of all occurrences of blocks; see block_lines."""
    return block_lines(passages, documents).select("passage_id", "line_no")


def without_lines(passages: DataFrame, removed: DataFrame) -> DataFrame:
    """passages with `text` without the removed (passage_id, line_no); other rows as they are."""
    gone = removed.groupBy("passage_id").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(_gone, cast(i + 1 as bigint))), '\\n')")
    return passages.join(gone, "passage_id", "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)).drop("_gone")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "passages"), table(spark, sf_dir, "documents"))


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage once, with its text without repeated lines."""
    passages = table(spark, sf_dir, "passages")
    removed = repeated_lines(passages, table(spark, sf_dir, "documents"))
    return without_lines(passages.select("passage_id", "text").dropDuplicates(["passage_id"]), removed)


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block of each district how many occurrences, lines and passages it has, and its longest occurrence in lines."""
    rows = block_lines(table(spark, sf_dir, "passages"), table(spark, sf_dir, "documents"))
    runs = rows.groupBy("district", "block", "passage_id", "occurrence").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("district", "block").agg(
        F.count(F.lit(1)).alias("n_occurrences"), F.sum("n").alias("n_lines"), F.countDistinct("passage_id").alias("n_passages"), F.max("n").alias("longest")
    )
