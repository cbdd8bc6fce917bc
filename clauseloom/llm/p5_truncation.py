"""Problem 5: evidence cut off by field limits or broken transfers.

For every source the discrete hazard of each length (how many texts that reach it end there), in characters and in
bytes, is tested against the hazard of the neighbouring lengths; the false-discovery rate of each source's tests is controlled.
An incomplete ending at a significant length is a cut: at once if it lies in or behind a word in lower case, otherwise, and shortly before
such a length (fields cut between words), unless the passages contradict.

Transfers that break at any place leave no such length, so the method alone can't give them: incomplete endings at all
other lengths are looked up in the passages of their document. They are cuts if the sentence goes on there, and none if a
line or sentence ends there; where the passages do not hold the ending, a mark of omission or an unfinished sentence
decides. `how` tells which of the ways found a cut: limit, passages or ending.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clauseloom.functions.text import MISSING
from clauseloom.operators.containment import stretch_pairs
from clauseloom.llm.textform import consistent_form
from clauseloom.session import cut, spread, table

NEIGHBOURS = 10  # lengths on either side that a hazard is tested against
FALSE_DISCOVERIES = 0.01
LEAST = 5  # texts that end at a significant length
TIMES = 3.0  # by which its hazard exceeds the neighbours'
GOES_ON = 0.5  # share of the texts reaching a limit that at most are longer
WORD = 24  # characters or bytes before a limit at which a text cut between words may end
LEAST_WORDS = 2  # shorter evidence is a code word, not a quotation; of scripts without blanks each character is one
NO_EVIDENCE = ["none found"]  # said beside the code words where there is nothing to quote
LONG_TAIL, SHORT_TAIL = 60, 24  # characters of an ending that are looked up

_CLOSERS = "\"'”’»)\\]"
_MARK = r"(?:\.\.\.|…|\[\.\.\.\]|\[…\])"
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_LEADER = r"(?:\.{4,}|…{2,}|(?:\. ){2,}\.?|_{2,})$"
_ABBREVIATION = r"(?:[\d０-９]|\b(?:Art|Sec|No|Nos|p|pp|St|Dr|Mr|Mrs|Ms|vs|cf|e\.g|i\.e|etc))\.$"


def _ending(e: Column) -> dict[str, Column]:
    """What can be told of an evidence by its last characters (it has no outer blanks)."""
    leader = e.rlike(_LEADER)
    mark = e.rlike(_MARK + f"[{_CLOSERS}]*$") & ~leader
    bare = F.regexp_replace(e, f"[{_CLOSERS}\\s]+$", "")
    return {"mark": mark, "terminal": bare.rlike("[.?!。．？！]$") & ~mark & ~leader, "open_stop": bare.rlike(_ABBREVIATION), "leader": leader}


def evidence_rows(attempts: DataFrame) -> DataFrame:
    """attempt_id, source, document_id, e (evidence without blanks at the end), chars, bytes and what the ending tells, for
    evidence of LEAST_WORDS words and more that is no code word. Attempts of no source are a source of their own ('').
    Equal rows stay; whoever counts takes them once."""
    rows = attempts.where("attempt_id is not null and evidence is not null").select(
        "attempt_id", "document_id", F.coalesce("source", F.lit("")).alias("source"), F.regexp_replace("evidence", r"(?U)\s+$", "").alias("e"),
        F.length("evidence").cast("long").alias("chars"), F.octet_length("evidence").cast("long").alias("bytes"),
    )
    rows = rows.where((F.size(F.split(F.trim("e"), r"(?U)\s+")) >= LEAST_WORDS) | F.col("e").rlike(f"(?s)(?:{_UNSPACED}.*){{{LEAST_WORDS}}}"))
    return rows.where(~F.lower(F.trim("e")).isin(*MISSING, *NO_EVIDENCE))


def length_hazards(rows: DataFrame) -> DataFrame:
    """source, unit, length, n, reach, hazard, expected (the neighbours' hazard), p (an upper bound of the probability
    of so many by chance), significant, and limit: significant, and hardly a text goes on. rows: attempt_id, source, chars,
    bytes; equal ones count once."""
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u")
    counts = rows.select("attempt_id", "source", "chars", "bytes").distinct().select("source", units).select("source", "u.unit", "u.length").groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("length")
    k = NEIGHBOURS
    low, high = w.rangeBetween(-k, -1), w.rangeBetween(0, k - 1)
    n, at, zero = F.col("n"), F.col("length"), F.lit(0)
    t = counts.withColumn("reach", F.sum("n").over(w.rangeBetween(0, Window.unboundedFollowing)))
    below, below_at = F.coalesce(F.sum(n).over(low), zero), F.coalesce(F.sum(n * at).over(low), zero)
    above, above_at = F.sum(n).over(high), F.sum(n * at).over(high)
    neighbours = below + F.coalesce(F.sum(n).over(w.rangeBetween(1, k)), zero)
    # texts that reach the lengths below, summed, and those that reach the lengths above
    reach_below = k * F.col("reach") + (k + 1 - at) * below + below_at
    reach_above = k * F.col("reach") - ((k + at) * above - above_at)
    t = t.withColumn("expected", F.least(F.lit(0.999), (neighbours + 0.5) / (reach_below + reach_above + 1.0)))
    t = t.withColumn("hazard", n / F.col("reach"))
    a, h = F.col("hazard"), F.col("expected")
    other = F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - h))).otherwise(0.0)
    t = t.withColumn("p", F.when(a > h, F.exp(-F.col("reach") * (a * F.log(a / h) + other))).otherwise(1.0))
    # Benjamini and Hochberg for the tests of each source: the largest p that its rank allows
    every = Window.partitionBy("source")
    t = t.withColumn("_rank", F.row_number().over(every.orderBy("p", "unit", "length"))).withColumn("_all", F.count(F.lit(1)).over(every))
    passes = F.when(F.col("p") <= FALSE_DISCOVERIES * F.col("_rank") / F.col("_all"), F.col("p"))
    t = t.withColumn("_most", F.max(passes).over(every))
    significant = F.coalesce(F.col("p") <= F.col("_most"), F.lit(False)) & (n >= LEAST) & (a >= TIMES * h)
    limit = significant & (F.col("reach") - n <= GOES_ON * F.col("reach"))
    return t.select("source", "unit", "length", "n", "reach", "hazard", "expected", "p", significant.alias("significant"), limit.alias("limit"))


def _tails(rows: DataFrame) -> DataFrame:
    """attempt_id, document_id, needle (the last SHORT_TAIL characters of the evidence in consistent form, without a mark
    of omission), long (the last LONG_TAIL)."""
    import re

    mark = re.compile(r"\s*" + _MARK + "[\"'”’»)]*$")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [mark.sub("", consistent_form(t)) if m else consistent_form(t) for t, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            made = [pa.array([f[-n:].strip() for f in forms], pa.string()) for n in (SHORT_TAIL, LONG_TAIL)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["attempt_id", "document_id", "needle", "long"])

    return rows.select("attempt_id", "document_id", "e", "mark").mapInArrow(run, "attempt_id long, document_id string, needle string, long string")


def _lined(passages: DataFrame) -> DataFrame:
    """document_id, hay: passages in consistent form with their line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([consistent_form(t, keep_lines=True) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["document_id", "hay"])

    return spread(passages.select("document_id", "text")).mapInArrow(run, "document_id string, hay string")


def cut_evidence(attempts: DataFrame, passages: DataFrame) -> DataFrame:
    """attempt_id, source, cut, at_limit (a significant length), how (see above; null if not cut) for all attempts with evidence
    (see evidence_rows): whether the evidence breaks off inside a word or a sentence. An attempt whose rows differ is cut if one of them is."""
    rows = evidence_rows(attempts)
    # no more rows than significant lengths times WORD
    spikes = length_hazards(rows).where("significant").select("source", "unit", F.col("length").alias("_of"), F.explode(F.sequence(F.col("length") - WORD, F.col("length") + 1)).alias("_length"))
    near = spikes.groupBy("source", "unit", "_length").agg(F.max((F.col("_length").between(F.col("_of") - F.when(F.col("unit") == "bytes", 3).otherwise(0), F.col("_of"))).cast("int")).alias("_at"))
    at = rows
    for u in ("chars", "bytes"):
        lengths = near.where(F.col("unit") == u).select("source", F.col("_length").alias(u), F.col("_at").alias(f"_{u}"))
        at = at.join(lengths, ["source", u], "left")
    ends = _ending(F.col("e"))
    at = at.withColumn("spike", F.greatest("_chars", "_bytes")).withColumns(ends)  # 1: a significant length, 0: shortly before one
    letter = F.col("e").rlike(r"[\p{L},;–-]$")
    inside = F.col("e").rlike(r"(?U)(?:^|[\s(“\"'‘-])\p{Ll}[^\s]*$") & letter  # headings and names end in capitalised words: they are looked up
    unfinished = F.col("e").rlike(r"(?:\p{Ll}|,|[–-])$") & F.col("e").rlike(r"(?U)(?:\S+\s+){5}")
    open_ = ~F.col("terminal") & ~F.col("leader")
    at = at.withColumns({
        "limit": F.coalesce(F.col("spike") == 1, F.lit(False)) & open_ & inside,
        "told": open_ & (F.col("spike").isNotNull() & letter | unfinished) | F.col("mark"),
        "asked": ~F.col("terminal") | F.col("mark") | F.col("open_stop") | F.col("spike").isNotNull(),
    })
    at = cut(at.select("attempt_id", "document_id", "source", F.when(F.col("asked") & ~F.col("limit"), F.col("e")).alias("e"), "mark", F.coalesce(F.col("spike") == 1, F.lit(False)).alias("at_limit"), F.col("spike").isNotNull().alias("near"), "limit", "told", "asked"))
    asked = at.where("e is not null and document_id is not null")

    known = passages.where(F.length("text") > 0).where("document_id is not null")
    needles = _tails(asked).where(F.length("needle") >= SHORT_TAIL // 3)
    sizes = (asked.select("document_id"), known.select("document_id"))
    pairs = stretch_pairs(needles, _lined(known), "document_id", sizes, view="translate(hay, '\\n', ' ')")
    long_at, short_at = F.expr("locate(long, translate(hay, '\\n', ' '))"), F.expr("locate(needle, translate(hay, '\\n', ' '))")
    ends = F.when(long_at > 0, long_at + F.length("long")).otherwise(short_at + F.length("needle"))
    rest = pairs.select("attempt_id", (long_at > 0).alias("whole"), F.right("needle", F.lit(3)).alias("last"), F.substring("hay", ends, F.lit(48)).alias("rest"))
    line = F.substring_index("rest", "\n", 1)
    stopped = F.regexp_replace("last", f"[{_CLOSERS}]+$", "").rlike("[.?!。．？！]$")
    over = (line == "") | line.rlike(r"^[\s.…_]{2,}$") | (stopped & line.rlike(f"^[{_CLOSERS}]*(?:\\s|$)"))
    # the longer tail tells more; among equal ones an end somewhere outweighs
    seen = rest.groupBy("attempt_id").agg(F.max(F.struct("whole", over.alias("over"))).alias("m")).select("attempt_id", F.col("m.over").alias("over"))
    how = (
        F.when(F.col("limit"), "limit").when(~F.col("asked"), None).when(F.col("over"), None)
        .when(~F.col("over"), F.when(F.col("near"), "limit").otherwise("passages")).when(F.col("told"), F.when(F.col("near"), "limit").otherwise("ending"))
    )
    told = at.drop("e").join(seen, "attempt_id", "left").select("attempt_id", "source", "at_limit", how.alias("how"))
    return told.groupBy("attempt_id", "source").agg(F.min("how").alias("how"), F.max("at_limit").alias("at_limit")).select("attempt_id", "source", F.col("how").isNotNull().alias("cut"), "at_limit", "how")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_evidence(table(spark, sf_dir, "attempts"), table(spark, sf_dir, "passages")).where("cut").select("attempt_id").distinct()


def p5_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source how much evidence it has, and the share that is cut: at a significant length or shortly before it, and
    elsewhere, as a broken transfer leaves it."""
    rows = cut_evidence(table(spark, sf_dir, "attempts"), table(spark, sf_dir, "passages"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    limit = F.coalesce(F.col("how") == "limit", F.lit(False))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_evidence"), share(F.col("cut")).alias("share_cut"), share(limit).alias("share_cut_at_limit"), share(F.col("cut") & ~limit).alias("share_cut_elsewhere")
    )


def p5_length_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The significant lengths of each source."""
    rows = length_hazards(evidence_rows(table(spark, sf_dir, "attempts")))
    return rows.where("significant").select("source", "unit", "length", "n", "reach", F.round("hazard", 6).alias("hazard"), F.round("expected", 6).alias("expected"), "limit")
