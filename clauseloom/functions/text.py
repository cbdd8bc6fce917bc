"""Column functions for text: normal forms, tokens, numbers, page references, answer classes.

White space means every Unicode blank (WS), as the same character class for Java and RE2. All functions give null for null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Words that carry no meaning in a search.
STOP_WORDS = "a an and are as at be by does for from how if in is it of on or the this to what when which with".split()
# Answers that stand for a missing one, and the spellings seen for them.
MISSING = {
    "nd": "not_discussed", "not discussed": "not_discussed", "not_discussed": "not_discussed",
    "du": "discussed_unclear", "discussed unclear": "discussed_unclear", "discussed_unclear": "discussed_unclear",
    "na": "not_applicable", "n/a": "not_applicable", "not applicable": "not_applicable", "not_applicable": "not_applicable",
    "ocr needed": "ocr_needed", "ocrneeded": "ocr_needed",
}
# Numbers that are written out.
NUMBER_WORDS = dict(
    zip(
        "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred".split(),
        [*range(1, 21), 30, 40, 50, 60, 70, 80, 90, 100],
    )
)
FIGURE = r"\d[\d,]*\.?\d*"


def squeeze(c: Column) -> Column:
    """Runs of white space made one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def outer_trim(c: Column) -> Column:
    """Without blanks, tabs and line breaks at the ends."""
    return F.btrim(c, F.lit(" \t\r\n"))


def norm_words(c: Column) -> Column:
    """Lower-case letters a-z and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def norm_quotes(c: Column) -> Column:
    """Typographic quotation marks and dashes made plain, lower case, squeezed."""
    return squeeze(F.lower(F.translate(c, "’‘“”–—", "''\"\"--")))


def norm_score(c: Column) -> Column:
    """As norm_quotes, but only the marks ’ “ ” are made plain."""
    return squeeze(F.lower(F.translate(c, "’“”", "'\"\"")))


def slug(c: Column, most: int) -> Column:
    """Letters a-z and digits joined by underscores, cut to `most` characters, no underscore at either end."""
    joined = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(F.lower(joined), 1, most), "^_+|_+$", "")


def surrogate_id(district: Column, stem: Column, path: Column) -> Column:
    return F.concat_ws("__", slug(district, 45), slug(stem, 55), F.substring(F.sha1(path), 1, 8))


def dense_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"{WS}+", "")).cast("long")


def pages(c: Column) -> Column:
    """The form-feed delimited pages; empty pages keep their place."""
    return F.split(c, "\f", -1)


def search_terms(c: Column, most: int = 24) -> Column:
    """Distinct terms of three letters and more that are no stop words, in order, at most `most`."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def figures(c: Column) -> Column:
    """Distinct numbers, without thousands separators and a stop at the end."""
    found = F.regexp_extract_all(c, F.lit(FIGURE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, ",", ""), r"\.$", "")))


# Content words that tell no two provisions apart.
COMMON_WORDS = (
    "shall will must that this with from have been which teacher teachers board district agreement article section document provision provisions stated states "
    "under such also than when each any other their they there school schools year years shall_not does discussed"
).split()


def numeric_tokens(c: Column) -> Column:
    """The distinct figures that an answer turns on, as they are written; a percentage without its sign."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0)), lambda x: F.regexp_replace(x, "%", "")))


def content_words(c: Column) -> Column:
    """The distinct words of four letters and more that are not common."""
    return F.array_distinct(F.filter(F.regexp_extract_all(norm_quotes(c), F.lit("[a-z][a-z'/-]{3,}"), F.lit(0)), lambda w: ~w.isin(COMMON_WORDS)))


def support_tokens(c: Column) -> Column:
    """Figures and content words, by which a quotation is told to support an answer."""
    return F.array_union(numeric_tokens(c), content_words(c))


def page_numbers(c: Column) -> Column:
    """All integers of a page reference, as they come."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def first_page(c: Column) -> Column:
    """The first integer of a page reference, null if it has none."""
    return F.nullif(F.regexp_extract(c, "[0-9]+", 0), F.lit("")).try_cast("int")


def page_list(c: Column, longest: int = 30) -> Column:
    """All integers of a page reference, ascending; where there are two and more within `longest` pages, all from the first to the last."""
    ints = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    low, high = F.array_min(ints), F.array_max(ints)
    is_range = (F.size(ints) >= 2) & (high - low <= longest)
    return F.when(is_range, F.sequence(low, high)).otherwise(F.array_sort(F.array_distinct(F.filter(ints, lambda x: x.isNotNull()))))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def answer_alias(c: Column) -> Column:
    """A spelling of a missing answer as its code word, other answers trimmed."""
    table = F.create_map(*[F.lit(x) for pair in MISSING.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.trim(c))), F.trim(c))


def status_for_score(c: Column) -> Column:
    """Class of an answer as the scorer sees it: a reasoned 'no, ...' is a no; an empty answer is not discussed."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    low = F.regexp_replace(F.lower(raw), f"{WS}+", "_")
    return (
        F.when(low.isin("not_discussed", "not_discussed."), "not_discussed")
        .when(low.startswith("discussed_unclear"), "discussed_unclear")
        .when(low.startswith("not_applicable"), "not_applicable")
        .when(low.isin("no", "no.", "none", "none_specifically_cited"), "no")
        .when(F.lower(raw).rlike(r"^no\s*[,.;:—-]"), "no")
        .when(low == "", "not_discussed")
        .otherwise("substantive")
    )


def status_for_verify(c: Column) -> Column:
    """Class of an answer as the verifier sees it: empty is a class of its own, stops at the ends are ignored."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    low = F.regexp_replace(F.regexp_replace(F.lower(raw), f"{WS}+", "_"), "^[._]+|[._]+$", "")
    return (
        F.when(raw == "", "empty")
        .when(low.startswith("not_discussed"), "not_discussed")
        .when(low.startswith("discussed_unclear"), "discussed_unclear")
        .when(low.startswith("not_applicable"), "not_applicable")
        .when(low.isin("no", "none", "none_specifically_cited", "no_provision"), "no")
        .otherwise("substantive")
    )


def quote_present(quote: Column, text: Column, least: int = 12) -> Column:
    """If the quote's words stand in the text, together or, from six words on, three in five of its runs of four words
    (two at least). Both are taken as norm_words gives them."""
    words = F.split(quote, " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 3)), lambda i: F.array_join(F.slice(words, i, 4), " "))
    hits = F.size(F.filter(runs, lambda r: F.contains(text, r)))
    enough = F.greatest(F.lit(2), F.floor(F.lit(0.6) * F.size(runs)).cast("int"))
    return (F.length(quote) >= least) & (F.contains(text, quote) | ((F.size(words) >= 6) & (hits >= enough)))


# Words are delimited by what is no letter, mark, digit or underscore: \b differs between Java and RE2.
MODALS = "must|shall|will|should|ought|need|may|can|could|might"


def modal(c: Column) -> Column:
    """The first modal verb of a sentence, outside parentheses; '' if it has none."""
    bare = F.regexp_replace(F.lower(c), r"\([^)]*\)", " ")
    return F.regexp_extract(bare, rf"(^|[^\p{{L}}\p{{M}}\p{{N}}_])({MODALS})($|[^\p{{L}}\p{{M}}\p{{N}}_])", 2)


def negated_modal(c: Column) -> Column:
    return F.lower(c).rlike(rf"(^|[^\p{{L}}\p{{M}}\p{{N}}_])({MODALS})\s+not($|[^\p{{L}}\p{{M}}\p{{N}}_])")


def compressed(c: Column) -> Column:
    """A page without layout padding: lines without blanks at the end, four blanks and more as three, one empty line in a row, none at the ends."""
    lines = F.regexp_replace(F.regexp_replace(c, r"[ \t\r\f\x0B]+(?=\n|\z)", ""), " {4,}", "   ")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def clean_controls(c: Column) -> Column:
    """Without the control characters that table sinks reject."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def strip_code_fence(c: Column) -> Column:
    """The body of a fenced reply; other replies as they are."""
    return F.trim(F.regexp_replace(c, r"^\s*```[a-zA-Z]*\s*\n?|\n?```\s*$", ""))


def estimated_tokens(c: Column) -> Column:
    return (F.floor(F.length(c) / 3) + 1).cast("long")


def year4(c: Column) -> Column:
    """A year of two or four digits as four; two digits below 50 are of this century."""
    y = c.try_cast("int")
    return F.when(F.length(c) == 4, y).when(y < 50, y + 2000).otherwise(y + 1900)
