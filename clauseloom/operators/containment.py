"""Finding short texts (needles) as stretches of longer texts (hay) that share a key, without forming all pairs.

Keys with few pairs are joined on the key. A hot key (more than PAIRS pairs) is joined on the key and on an anchor: of
the runs of whole words inside the needle, the one that is rarest in the key's hay. Both ways are exact. Words are what
single blanks delimit. Only anchors and hashes of rows are shuffled before the matching texts are fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAIRS = 4096  # pairs of one key that the plain join may form
HOT_LISTED = 20_000  # so many hot keys are broadcast; beyond that every key takes the anchored way
RUNS = (4, 2, 1)  # words of an anchor: the longest run that a needle has inside


def _runs(text: str, size: int, inner: bool) -> str:
    """SQL: the distinct runs of `size` words of the text; inner: without the first and last word, which may be parts of
    words of the hay."""
    words = f"split({text}, ' ')"
    words = f"slice({words}, 2, greatest(0, size({words}) - 2))" if inner else words
    return f"array_distinct(transform(sequence(1, greatest(1, size({words}) - {size - 1})), i -> array_join(slice({words}, i, {size}), ' ')))"


def stretch_pairs(
    needles: DataFrame, hay: DataFrame, key: str, sizes: tuple[DataFrame, DataFrame], view: str = "hay", pairs: int = PAIRS
) -> DataFrame:
    """Rows of needles joined with rows of hay where hay's text contains needles.needle and the keys are equal. view: SQL
    of the text in which to look, if it is not hay itself.

    needles: key, needle and other columns; hay: key, hay and other columns, none of the same name. Rows whose key,
    needle or hay is null give nothing; an empty needle is in every hay of its key. sizes: for the needles and the hay
    a frame with the key only, one row for each row (cheap to read), by which hot keys are found. Equal rows may count once."""
    counts = [s.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, s in enumerate(sizes)]
    hot = counts[0].join(counts[1], key).where(F.col("n0") * F.col("n1") > pairs).select(key)
    listed = [r[0] for r in hot.limit(HOT_LISTED + 1).collect()]
    inside = F.contains(F.expr(view), F.col("needle"))
    if not listed:
        return needles.join(hay, key).where(inside)
    if len(listed) <= HOT_LISTED:
        marks = F.broadcast(needles.sparkSession.createDataFrame([(k,) for k in listed], f"{key} string"))
        plain = needles.join(marks, key, "left_anti").join(hay.join(marks, key, "left_anti"), key).where(inside)
        needles, hay = needles.join(marks, key, "left_semi"), hay.join(marks, key, "left_semi")
    else:
        plain = None
    anchored = _anchored(needles, hay, key, view).where(inside)
    return anchored if plain is None else plain.unionByName(anchored)


def _anchored(needles: DataFrame, hay: DataFrame, key: str, view: str) -> DataFrame:
    own = [c for c in needles.columns if c != key]
    inside = F.greatest(F.lit(0), F.size(F.split("needle", " ")) - 2)
    texts = hay.where(F.col(key).isNotNull() & F.expr(view).isNotNull()).distinct()
    texts = texts.withColumn("_hay", F.xxhash64(*texts.columns))
    rows = needles.where(F.col(key).isNotNull() & F.col("needle").isNotNull()).withColumn("_words", inside)
    bounds = [(n, RUNS[i - 1] if i else None) for i, n in enumerate(RUNS)]
    parts = [rows.where(F.col("_words") < RUNS[-1]).drop("_words").join(texts.drop("_hay"), key)]  # one or two words: joined on the key
    for size, over in bounds:
        some = rows.where((F.col("_words") >= size) & (F.col("_words") < over if over else F.lit(True))).drop("_words")
        asked = some.select("*", F.xxhash64(key, *own).alias("_row"), F.explode(F.expr(_runs("needle", size, True))).alias("_anchor"))
        grams = texts.select(key, "_hay", F.explode(F.expr(_runs(view, size, False))).alias("_anchor"))
        grams = grams.join(asked.select(key, "_anchor").distinct(), [key, "_anchor"], "left_semi")
        often = grams.groupBy(key, "_anchor").agg(F.count(F.lit(1)).alias("_often"))
        rarest = (
            asked.join(often, [key, "_anchor"])
            .groupBy(key, "_row")
            .agg(F.min_by(F.struct("_anchor", *[F.col(c).alias(f"_o_{c}") for c in own]), F.struct("_often", "_anchor")).alias("_b"))
            .select(key, F.col("_b._anchor").alias("_anchor"), *[F.col(f"_b._o_{c}").alias(c) for c in own])
        )
        parts.append(rarest.join(grams, [key, "_anchor"]).drop("_anchor").join(texts, [key, "_hay"]).drop("_hay"))
    out = parts[0].select(key, *own, *[c for c in hay.columns if c != key])
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
