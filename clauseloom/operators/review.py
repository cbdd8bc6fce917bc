"""Blinded review of two systems: packets, the verdicts on them, and how often each system was right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

VERDICTS = ["yes", "no", "na", ""]


def review_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def packet(baseline: DataFrame, candidate: DataFrame, fields: list[str], keys: tuple[str, ...] = ("document_id", "question_id"), seed: int = 0) -> DataFrame:
    """review_id, keys, a_system, a_<field> and b_<field> for the keys that both have, nulls as empty. Which system is a is dealt by a
    hash of seed and keys, so a packet can be made again; reviewers get it without a_system. No common key gives no rows."""
    ids = [F.col(k) for k in keys]
    straight = F.sha2(F.concat_ws("\0", F.lit(str(seed)), *ids), 256) < "8"
    pack = lambda prefix: F.struct(*[F.coalesce(f, F.lit("")).alias(f) for f in fields]).alias(prefix)
    both = baseline.select(*keys, pack("_x")).join(candidate.select(*keys, pack("_y")), list(keys)).withColumn("_straight", straight)
    sides = [F.when(F.col("_straight"), F.col(f"{p}.{f}")).otherwise(F.col(f"{q}.{f}")).alias(f"{n}_{f}") for n, p, q in (("a", "_x", "_y"), ("b", "_y", "_x")) for f in fields]
    return both.select(review_id(*ids).alias("review_id"), *keys, F.when(F.col("_straight"), "baseline").otherwise("candidate").alias("a_system"), *sides)


def collected(packet: DataFrame, responses: DataFrame, fields: list[str]) -> DataFrame:
    """The packet with the verdicts of the responses (review_id, a_<field>_correct, b_<field>_correct, reviewer_notes); without a response they
    are empty. A verdict of another kind, or none for a field in a response, is an error when the result is read."""
    names = [f"{n}_{f}_correct" for n in "ab" for f in fields]
    checked = [F.when(F.col(c).isin(VERDICTS[:3]), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"not a verdict in {c}: "), F.coalesce(F.col(c), F.lit("null"))))).alias(c) for c in names]
    told = responses.select("review_id", *checked, F.coalesce("reviewer_notes", F.lit("")).alias("reviewer_notes"))
    joined = packet.drop(*names, "reviewer_notes").join(told, "review_id", "left")
    return joined.fillna("", [*names, "reviewer_notes"])


def accuracy(packet: DataFrame, key: DataFrame, fields: list[str]) -> DataFrame:
    """field, system, correct, incorrect, accuracy: verdicts yes and no count, na and blank don't; without any the accuracy is 0. A packet
    row without its key, or a verdict of another kind, is an error when the result is read."""
    rows = packet.drop("a_system").join(key.select("review_id", "a_system").withColumn("_there", F.lit(True)), "review_id", "left")
    known = F.coalesce("_there", F.raise_error(F.concat(F.lit("no key for "), F.col("review_id"))).cast("boolean"))
    sides = F.array(*[
        F.struct(F.lit(f).alias("field"), F.when((F.col("a_system") == "baseline") == F.lit(n == "a"), "baseline").otherwise("candidate").alias("system"), F.coalesce(f"{n}_{f}_correct", F.lit("")).alias("verdict"))
        for f in fields for n in "ab"
    ])
    long = rows.where(known).select(F.explode(sides).alias("s")).select("s.*")
    valid = F.when(F.col("verdict").isin(VERDICTS), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("not a verdict: "), F.col("verdict"))))
    n = lambda v: F.sum((valid == v).cast("long"))
    counted = long.groupBy("field", "system").agg(n("yes").alias("correct"), n("no").alias("incorrect"))
    return counted.withColumn("accuracy", F.round(F.col("correct") / F.greatest(F.lit(1), F.col("correct") + F.col("incorrect")), 6))
