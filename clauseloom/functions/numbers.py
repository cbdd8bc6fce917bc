"""Values in text: the first amount, share, quantity or date, and numbers that contradict one another."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clauseloom.functions.text import NUMBER_WORDS, year4

# Units and months that quantities and dates are told by.
UNITS = "days?|hours?|minutes?|periods?|steps?|lanes?|years?|weeks?"
# The written-out numbers that a quantity is told by.
QUANTITY_WORDS = {w: n for w, n in NUMBER_WORDS.items() if n <= 20 or n in (30, 40, 60, 90)} | {"forty-five": 45}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
WORD_DIGITS = r"(?i)\b(" + "|".join(NUMBER_WORDS) + r")\s*\(\s*(\d{1,9})\s*\)"
SUMS = r"(?i)(\d[\d,]{0,8})\s*days?\s*\(\s*(\d[\d,]{0,8})\s*days?\s*([+-])\s*(\d[\d,]{0,8})"


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def dollars(c: Column) -> Column:
    """The first dollar amount, without separators; null if there is none."""
    return F.regexp_replace(_first(c, r"\$\s*([0-9][0-9,]*(?:\.\d+)?)"), ",", "")


def percentage(c: Column) -> Column:
    return _first(c, r"(?i)([0-9]+(?:\.\d+)?)\s*(?:%|percent)")


def quantity(c: Column) -> Column:
    """The first number with a unit of time or schedule, as 'number unit'; a written-out number where no figure has one."""
    figure = rf"(?i)\b([0-9]+(?:\.\d+)?)\s*({UNITS})\b"
    word = rf"(?i)\b({'|'.join(QUANTITY_WORDS)})\s*({UNITS})\b"
    table = F.create_map(*[F.lit(x) for k, v in QUANTITY_WORDS.items() for x in (k, str(v))])
    written = F.concat_ws(" ", F.element_at(table, F.lower(_first(c, word))), _first(c, word, 2))
    return F.coalesce(F.when(_first(c, figure).isNotNull(), F.concat_ws(" ", _first(c, figure), _first(c, figure, 2))), F.when(_first(c, word).isNotNull(), written))


def date_value(c: Column) -> Column:
    """The first span of years, both with four digits, else the first date with a month's name."""
    span = r"\b((?:20|19)\d{2})\s*[-–]\s*((?:20|19)\d{2}|\d{2})\b"
    years = F.concat(_first(c, span), F.lit("-"), year4(_first(c, span, 2)).cast("string"))
    return F.coalesce(years, _first(c, rf"(?i)\b((?:{MONTHS})\s+\d{{1,2}},?\s+(?:20|19)\d{{2}})\b"))


def word_digit_conflicts(c: Column) -> Column:
    """How many written-out numbers differ from the figure in parentheses behind them."""
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(WORD_DIGITS), F.lit(1)).alias("w"), F.regexp_extract_all(c, F.lit(WORD_DIGITS), F.lit(2)).alias("d"))
    return F.size(F.filter(pairs, lambda p: F.element_at(table, F.lower(p["w"])) != p["d"].cast("int"))).cast("long")


def sum_conflicts(c: Column) -> Column:
    """How many sums in parentheses ('12 days (10 days + 3') don't give the number before them."""
    side = lambda i: F.regexp_extract_all(c, F.lit(SUMS), F.lit(i)).alias(f"g{i}")
    n = lambda x: F.regexp_replace(x, ",", "").cast("long")
    parts = F.arrays_zip(side(1), side(2), side(3), side(4))
    return F.size(F.filter(parts, lambda p: n(p["g1"]) != n(p["g2"]) + F.when(p["g3"] == "+", n(p["g4"])).otherwise(-n(p["g4"])))).cast("long")


# The numbers that count as there if they are written out.
SPELLED = dict(zip(
    "1 2 3 4 5 6 7 8 9 10 12 15 20 30 45 50 85 90 95 120".split(),
    [*"one two three four five six seven eight nine ten twelve fifteen twenty thirty forty-five fifty eighty-five ninety ninety-five".split(), "one hundred and twenty"],
))


def token_present(token: Column, text: Column) -> Column:
    """If the text holds the token; a number not inside another number, or written out. Both in lower case."""
    table = F.create_map(*[F.lit(x) for kv in SPELLED.items() for x in kv])
    number = token.rlike(r"^\d+(\.\d+)?$")
    alone = F.regexp_like(text, F.concat(F.lit(r"(?<![\d.])"), F.regexp_replace(token, r"\.", r"\\."), F.lit(r"(?!\d)")))
    return F.when(F.length(token) == 0, True).when(number, alone | F.coalesce(F.contains(text, F.element_at(table, token)), F.lit(False))).otherwise(F.contains(text, token))
