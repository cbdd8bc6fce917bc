"""Queries on the clauses of documents: what counts, what they state, and how rights and duties add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseloom.functions import text as T
from clauseloom.operators import clauses as C, pages as P
from clauseloom.plans import SQL_LATEST, query

_EDGE = r"[^\p{L}\p{M}\p{N}_]"
_PAGES = f"""{SQL_LATEST}, pg AS (SELECT document_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM latest WHERE text IS NOT NULL),
    fl AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(page, '{C.APPENDIX}') THEN true WHEN regexp_matches(page, '{C.ARTICLE}') THEN false END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_no ROWS UNBOUNDED PRECEDING), false) AS inside FROM pg),
    gd AS (SELECT document_id, sum(CASE WHEN inside THEN 0 ELSE length(page) END) < {C.KEEP} * sum(length(page)) AS misfired FROM fl GROUP BY document_id),
    kp AS (SELECT document_id, page_no, inside, misfired, CASE WHEN inside AND NOT misfired THEN '' ELSE page END AS page FROM fl JOIN gd USING (document_id))"""


def _counted(read) -> DataFrame:
    """document_id, pages (all), kept (those that count, the others empty) of the documents' latest version."""
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"]).where("text is not null")
    return docs.select("document_id", T.pages(F.col("text")).alias("pages")).withColumn("kept", C.counted_pages(F.col("pages")))


@query(f"""
    WITH {_PAGES} SELECT document_id, count(*) AS n_pages, sum((inside AND NOT misfired)::INT)::BIGINT AS n_excluded, any_value(misfired) AS misfired, sum(length(page))::BIGINT AS n_chars FROM kp GROUP BY document_id
""")
def appendix_fill(read) -> DataFrame:
    """How many pages of each document belong to appendices, carried from heading to heading, and how many characters are left."""
    rows = _counted(read)
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + F.length(p))
    inside = F.aggregate("pages", F.struct(F.lit(False).alias("i"), F.lit(0).alias("n")), lambda a, p: F.struct(
        F.when(p.rlike(C.APPENDIX), True).when(p.rlike(C.ARTICLE), False).otherwise(a["i"]).alias("i"), (a["n"] + F.when(p.rlike(C.APPENDIX), 1).when(p.rlike(C.ARTICLE), 0).otherwise(a["i"].cast("int"))).alias("n")
    ))["n"]
    made = rows.select("document_id", "pages", "kept", (F.col("kept") == F.col("pages")).alias("_same"), inside.alias("_n"))
    lost = F.aggregate(F.zip_with("pages", "kept", lambda p, k: F.when(p == k, 0).otherwise(1)), F.lit(0), lambda n, x: n + x)
    misfired = F.col("_same") & (F.col("_n") > 0) & (size("pages") > 0) & (lost == 0) & ~F.forall(F.zip_with("pages", F.transform("pages", lambda p: F.length(p)), lambda p, n: n == 0), lambda z: z)
    return made.select("document_id", F.size("pages").cast("long").alias("n_pages"), F.when(misfired, 0).otherwise(F.col("_n")).cast("long").alias("n_excluded"), misfired.alias("misfired"), size("kept").cast("long").alias("n_chars"))


_SIDE = lambda c: f"CASE WHEN regexp_matches({c}, '{C.as_word(C.WORKERS)}') THEN 'worker' WHEN regexp_matches({c}, '{C.as_word(C.MANAGEMENT)}') THEN 'management' END"
_AGENT = C.AGENT.replace("'", "''")
_PLAIN = f"CASE WHEN negated THEN 'prohibition' WHEN modal = '' THEN 'other' WHEN modal IN ({', '.join(map(repr, C.PERMISSIVE))}) THEN 'permission' ELSE 'obligation' END"
_STATEMENT = "CASE " + " ".join(f"WHEN verb = '{k}' THEN CASE WHEN negated THEN '{no}' ELSE '{yes}' END" for k, (yes, no) in C.STATEMENTS.items()) + f" ELSE {_PLAIN} END"
_CLAUSES = rf"""{_PAGES}, st AS (SELECT DISTINCT document_id, quote FROM (SELECT document_id, unnest(list_filter(string_split(regexp_replace(page, '([.;:!?]){T.WS}+', '\1' || chr(31), 'g'), chr(31)), lambda x: length(x) >= 25)) AS quote FROM kp)),
    w AS (SELECT *, ' ' || trim(regexp_replace(lower(quote), '[^a-z0-9]+', ' ', 'g')) || ' ' AS w, '.' || regexp_replace(lower(quote), '[^a-z'' -]', '.', 'g') || '.' AS l FROM st),
    m AS (SELECT *, regexp_extract(regexp_replace(lower(quote), '\([^)]*\)', ' ', 'g'), '(^|{_EDGE})({T.MODALS})($|{_EDGE})', 2) AS modal, regexp_matches(lower(quote), '(^|{_EDGE})({T.MODALS})\s+not($|{_EDGE})') OR (regexp_matches(w, '{C.NEGATED_SUBJECT}') AND NOT regexp_matches(w, '{C.QUANTITY}')) AS negated,
      CASE {" ".join(f"WHEN regexp_matches(w, ' ({v}) ') THEN '{k}'" for k, v in C.VERBS.items())} ELSE 'plain' END AS verb,
      coalesce(CASE WHEN regexp_matches(w, '{C.PASSIVE}') THEN list_filter(list_transform(regexp_extract_all(l, '{_AGENT}', 1), lambda a: {_SIDE("a")}), lambda a: a IS NOT NULL)[1] END, CASE WHEN regexp_matches(w, '^ (this|that|the) ({C.IMPERSONAL}) ') THEN 'other' END, {_SIDE(f"regexp_extract(l, '{C.SUBJECT}', 1)")}, 'other') AS acting FROM w),
    c AS (SELECT *, {_STATEMENT} AS statement FROM m),
    cl AS (SELECT *, CASE acting WHEN 'worker' THEN 'management' WHEN 'management' THEN 'worker' ELSE 'other' END AS protected,
      CASE WHEN statement = 'other' THEN 0.0 ELSE coalesce(MAP {{{", ".join(f"'{k}': {v}" for k, v in C.WEIGHTS.items())}}}[modal], CASE WHEN verb <> 'plain' THEN {C.NO_MODAL} END, 0.0) END::DOUBLE AS weight FROM c)"""


def _clauses(read) -> DataFrame:
    """The clauses (sentences) of the pages that count, each wording of a document once, with what they state."""
    pages = _counted(read).select("document_id", F.explode("kept").alias("page"))
    quotes = P.sentences(pages, "page").select("document_id", F.col("sentence").alias("quote")).distinct()
    return C.statements(quotes, "quote")


@query(f"WITH {_CLAUSES} SELECT statement, verb, modal, negated, acting, count(*) AS n, round(sum(weight), 4) AS weight FROM cl GROUP BY ALL")
def statement_types(read) -> DataFrame:
    """How many clauses state what, by verb, modal verb, negation and acting side."""
    return _clauses(read).groupBy("statement", "verb", "modal", "negated", "acting").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


_SUMS = {f"{s}_{k}": f"sum(CASE WHEN statement {op} ('obligation', 'prohibition') AND {own} = '{s}' THEN weight ELSE 0.0 END)" for k, op, own in (("responsibilities", "IN", "acting"), ("rights", "NOT IN", "protected")) for s in ("worker", "management")}


@query(f"""
    WITH {_CLAUSES} SELECT document_id, {", ".join(f"round({c}, 4) AS {n}" for n, c in _SUMS.items())}, round(sum(weight), 4) AS total, count(*) AS n_clauses, {", ".join(f"round({c} / sum(weight), 6) AS {n}_share" for n, c in _SUMS.items())} FROM cl WHERE weight > 0 GROUP BY document_id
""")
def weighted_buckets(read) -> DataFrame:
    """The rights and responsibilities of both sides in each document, weighted by how strongly its clauses bind."""
    return C.buckets(_clauses(read), "document_id")
