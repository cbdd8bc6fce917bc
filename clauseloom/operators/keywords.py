"""Answers by keywords: terms of a question, the best place for them in a document, and what that place says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clauseloom.functions import numbers as N, text as T

MOST_TERMS, LEAST_CHARS, MOST_CHARS = 28, 3, 80
BEFORE, AFTER = 180, 220  # characters of a snippet around a term
ON_A_PAGE = 12  # places of a term that are looked at on one page, the first ones
# What makes a place better or worse, and words by which a denial is told.
UNITS = "(^|[^a-z0-9_])(days?|years?|hours?|minutes?|periods?|steps?|lanes?|weeks?)($|[^a-z0-9_])"
BINDING = "(^|[^a-z0-9_])(shall|will|must|entitled|granted|provided|required|eligible|receive|assigned)($|[^a-z0-9_])"
CONTENTS = r"\.{5,}|table of contents"
DENIALS = r"(^|[^a-z0-9_])(does +not +provide|not +available|not +eligible|no +(health|dental|vision|life|disability|salary|benefit|insurance|leave|parking|arbitration|grievance))($|[^a-z0-9_])"
NO_DENIAL = "no strike|no work stoppage"
QUESTION_WORDS = "does|the|what|how|is|are|extract|code|state|states"
BONUS = {"dollar": 100, "percentage": 100, "numeric": 80}


def question_terms(raw: Column) -> Column:
    """The pieces of a question's wording between commas, slashes, brackets, 'or' and 'and', without leading question words:
    different ones of 3 to 80 characters, at most 28, in their order."""
    pieces = F.split(F.regexp_replace(F.lower(raw), r"[,;/()]|(?<![a-z0-9_])(?:or|and)(?![a-z0-9_])", "\u001f"), "\u001f")
    bare = F.transform(pieces, lambda p: F.regexp_replace(T.squeeze(p), f"^({QUESTION_WORDS}) +", ""))
    kept = F.filter(bare, lambda p: F.length(p) >= LEAST_CHARS)
    trimmed = F.filter(F.transform(kept, lambda p: F.btrim(p, F.lit(" .?*`"))), lambda p: (F.length(p) > 0) & (F.length(p) <= MOST_CHARS))
    return F.slice(F.array_distinct(trimmed), 1, MOST_TERMS)


def places(pages: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """keys, page_no, term, nth, snippet: the first ON_A_PAGE places of each term on each page, with the text around them.
    pages: keys, page_no, page. The terms are a codebook's, in lower case; they are looked for inside the row."""
    low = pages.withColumn("_low", F.lower("page"))
    found = F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(F.col("_low"), t))
    rows = low.withColumn("term", F.explode(found))
    pieces = F.expr(f"slice(split(_low, concat('\\\\Q', term, '\\\\E')), 1, {ON_A_PAGE + 1})")
    rows = rows.withColumn("_p", F.transform(pieces, lambda p: F.length(p))).withColumn("nth", F.explode(F.expr(f"sequence(1, least({ON_A_PAGE}, size(_p) - 1))")))
    at = F.expr("aggregate(slice(_p, 1, nth), 0, (a, n) -> a + n) + (nth - 1) * length(term)")
    start = F.greatest(F.lit(0), at - BEFORE)
    end = F.least(F.length("page"), at + F.length("term") + AFTER)
    return rows.withColumn("snippet", T.squeeze(F.substring(F.col("page"), start + 1, end - start))).select(*keys, "page_no", "term", F.col("nth").cast("long").alias("nth"), "snippet")


def _whole(words: str) -> str:
    """A pattern like UNITS with what stands around the words looked at and not taken, which is quicker."""
    return words.replace("(^|[^a-z0-9_])(", "(?<![a-z0-9_])(?:").replace(")($|[^a-z0-9_])", ")(?![a-z0-9_])")


def _marks(snippet: Column, low: Column) -> Column:
    tests = {"percentage": "%|percent", "numeric": _whole(UNITS), "binding": _whole(BINDING), "contents": CONTENTS}
    return F.struct(F.contains(snippet, F.lit("$")).alias("dollar"), *[low.rlike(p).alias(k) for k, p in tests.items()])


def place_marks(rows: DataFrame) -> DataFrame:
    """rows with what the score needs to know of a snippet: looked at once for each place, before the place meets its questions."""
    return rows.withColumn("_low", F.lower("snippet")).withColumn("marks", _marks(F.col("snippet"), F.col("_low"))).drop("_low")


def marked_score(term: Column, marks: Column, kind: Column) -> Column:
    """As place_score, from the marks of the snippet."""
    bonus = [F.when(kind.contains(k) & marks[k], n).otherwise(0) for k, n in BONUS.items()]
    return (F.length(term) + sum(bonus[1:], bonus[0]) + F.when(marks["binding"], 25).otherwise(0) - F.when(marks["contents"], 25).otherwise(0)).cast("long")


def place_score(term: Column, snippet: Column, kind: Column) -> Column:
    """How good a place is for a question of the kind (its type of answer): the term's length, more if the place holds a value
    of that kind or binding words, less if it looks like contents."""
    return marked_score(term, _marks(snippet, F.lower(snippet)), kind)


def denied(snippet: Column) -> Column:
    low = F.lower(snippet)
    return low.rlike(_whole(DENIALS)) & ~low.rlike(NO_DENIAL)


def answer_of(snippet: Column, kind: Column) -> Column:
    """What a place answers to a question of the kind; discussed_unclear if it holds no such value."""
    made = (
        F.when(kind.contains("dollar"), N.dollars(snippet)).when(kind.contains("percentage"), N.percentage(snippet)).when(kind.contains("numeric"), N.quantity(snippet)).when(kind.contains("date"), N.date_value(snippet))
        .when(kind.contains("yes/no"), F.when(denied(snippet), "no").otherwise("yes")).when(kind.contains("categorical"), T.squeeze(F.substring(snippet, 1, 180)))
        .when(kind.contains("quote") | kind.contains("short text"), T.squeeze(F.substring(snippet, 1, 220))).otherwise("yes")
    )
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("discussed_unclear"))
