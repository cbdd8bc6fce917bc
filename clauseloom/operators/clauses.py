"""What clauses state, how strongly, and whose rights and duties they are; which pages of a document count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clauseloom.functions import text as T

# How strongly each modal verb binds, and statements without one.
WEIGHTS = {"must": 1.0, "shall": 1.0, "will": 0.9, "should": 0.7, "ought": 0.7, "need": 0.7, "may": 0.3, "can": 0.3, "could": 0.2, "might": 0.1}
NO_MODAL = 0.85
PERMISSIVE = ["may", "can", "could", "might"]
# Words by which a side of the contract, an impersonal subject and the kind of a verb are told.
WORKERS = "teachers?|faculty|employees?|unions?|association|bargaining unit|staff|educators?|members?|nurses?|paraprofessionals?|aides?|counselors?"
MANAGEMENT = "districts?|board|principals?|superintendent|administration|administrators?|management|employer|committee|department|supervisors?|schools?|state|company"
IMPERSONAL = "schedule|agreement|section|article|paragraph|policy|contract|provision|plan|memorandum|mou|appendix|clause|table"
VERBS = {"obligation_verb": "required|obligated|obliged", "prohibition_verb": "prohibited|forbidden|barred", "permission_verb": "permitted|allowed|authorized", "rights_passive": "entitled|granted|guaranteed"}
# Fixed values: (statement if not negated, if negated) by the kind of verb; plain verbs go by their modal.
STATEMENTS = {"obligation_verb": ("obligation", "right"), "prohibition_verb": ("prohibition", "permission"), "permission_verb": ("permission", "prohibition"), "rights_passive": ("right", "other")}
ORDINALS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty"

APPENDIX = r"(^|\n)[ \t\n]*(APPENDIX|Appendix|EXHIBIT|Exhibit|ADDENDUM|Addendum)([^A-Za-z0-9_]|$)"
ARTICLE = rf"(^|\n)[ \t\n]*[Aa][Rr][Tt][Ii][Cc][Ll][Ee][ \t\n]+([IVXLCivxlc0-9]+|(?i:{ORDINALS}))([^A-Za-z0-9_]|$)"
KEEP = 0.4  # share of a text that must be left, or the headings have misfired and all of it counts
NEGATED_SUBJECT, QUANTITY = "^ (no|nothing|neither|nor) ", "^ no (later|fewer|more|greater|less|earlier|sooner|longer) than "
PASSIVE = " (is|are|be|been|being|was|were) [a-z]+(ed|en) "
AGENT = "[^a-z]by (?:the |a |an )?([a-z][a-z '-]{2,40})"
SUBJECT = r"^(.*?)[^a-z](?:must|shall|will|should|ought|need|may|can|could|might)[^a-z]"


def as_word(words: str) -> str:
    """A pattern for one of the words as a whole."""
    return f"(^|[^a-z])({words})($|[^a-z])"


def counted_pages(pages: Column) -> Column:
    """pages with those of appendices and exhibits as '': from such a heading to the next article, page by page. If less than KEEP of
    the characters would be left, all pages count."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, page: Column) -> Column:
        inside = F.when(page.rlike(APPENDIX), True).when(page.rlike(ARTICLE), False).otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), F.concat(acc["kept"], F.array(F.when(inside, "").otherwise(page))).alias("kept"))

    kept = F.aggregate(pages, start, step)["kept"]
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + F.length(p))
    return F.when(size(kept) < KEEP * size(pages), pages).otherwise(kept)


def statements(df: DataFrame, quote: str) -> DataFrame:
    """df with modal, negated, verb, acting, protected, statement and weight of the clause in the column `quote`.

    The modal verb is the first outside parentheses; a subject such as 'no teacher' negates, 'no later than' doesn't. Who
    acts is told by the agent of a passive, by an impersonal subject, else by the words before the modal verb; the other side is
    protected. A clause that states nothing weighs nothing. Null quotes state nothing."""
    low = F.lower(F.coalesce(F.col(quote), F.lit("")))
    df = df.withColumn("_w", F.concat(F.lit(" "), T.norm_words(low), F.lit(" "))).withColumn("_l", F.concat(F.lit("."), F.regexp_replace(low, "[^a-z' -]", "."), F.lit(".")))
    df = df.withColumn("modal", T.modal(low)).withColumn("negated", T.negated_modal(low) | (F.col("_w").rlike(NEGATED_SUBJECT) & ~F.col("_w").rlike(QUANTITY)))
    verb = F.coalesce(*[F.when(F.col("_w").rlike(f" ({words}) "), F.lit(k)) for k, words in VERBS.items()], F.lit("plain"))
    df = df.withColumn("verb", verb)
    side = lambda c: F.when(c.rlike(as_word(WORKERS)), "worker").when(c.rlike(as_word(MANAGEMENT)), "management")
    agents = F.filter(F.transform(F.regexp_extract_all("_l", F.lit(AGENT), F.lit(1)), side), lambda s: s.isNotNull())
    subject = side(F.regexp_extract("_l", SUBJECT, 1))
    acting = F.coalesce(F.when(F.col("_w").rlike(PASSIVE), F.get(agents, F.lit(0))), F.when(F.col("_w").rlike(f"^ (this|that|the) ({IMPERSONAL}) "), "other"), subject, F.lit("other"))
    df = df.withColumn("acting", acting).withColumn("protected", F.when(F.col("acting") == "worker", "management").when(F.col("acting") == "management", "worker").otherwise("other"))
    plain = F.when(F.col("negated"), "prohibition").when(F.col("modal") == "", "other").when(F.col("modal").isin(PERMISSIVE), "permission").otherwise("obligation")
    statement = plain
    for k, (yes, no) in STATEMENTS.items():
        statement = F.when(F.col("verb") == k, F.when(F.col("negated"), no).otherwise(yes)).otherwise(statement)
    strength = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("modal")), F.when(F.col("verb") != "plain", NO_MODAL), F.lit(0.0))
    df = df.withColumn("statement", statement)
    return df.withColumn("weight", F.when(F.col("statement") == "other", 0.0).otherwise(strength)).drop("_w", "_l")


def buckets(clauses: DataFrame, key: str) -> DataFrame:
    """key, rights and responsibilities of both sides, total, n_clauses and shares: duties count for the side that acts, rights and
    permissions for the side they protect; other sides count in the total only. Keys without weight have no row."""
    rows = clauses.where("weight > 0").withColumn("weight", F.col("weight").cast("decimal(12,6)"))  # exact sums, whatever the order of the rows
    duty = F.col("statement").isin("obligation", "prohibition")
    part = lambda side, c, own: F.sum(F.when(c & (F.col(own) == side), F.col("weight")).otherwise(F.lit(0).cast("decimal(12,6)"))).cast("double")
    sums = {f"{s}_responsibilities": part(s, duty, "acting") for s in ("worker", "management")} | {f"{s}_rights": part(s, ~duty, "protected") for s in ("worker", "management")}
    g = rows.groupBy(key).agg(*[c.alias(n) for n, c in sums.items()], F.sum("weight").cast("double").alias("total"), F.count(F.lit(1)).alias("n_clauses"))
    return g.select(key, *[F.round(n, 4).alias(n) for n in sums], F.round("total", 4).alias("total"), "n_clauses", *[F.round(F.col(n) / F.col("total"), 6).alias(f"{n}_share") for n in sums])
