"""Queries on values in text, runs of pages and the codebook's own relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseloom.functions import numbers as N, text as T
from clauseloom.operators import answers as A, pages as P
from clauseloom.plans import SQL_ATTEMPTS, query
from clauseloom.plans.answers import _BEST, _attempts

_WORDS = "|".join(T.NUMBER_WORDS)
_SPAN = r"\b((?:20|19)\d{2})\s*[-–]\s*((?:20|19)\d{2}|\d{2})\b"
_QTY = "|".join(N.QUANTITY_WORDS)
_QMAP = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in N.QUANTITY_WORDS.items()) + "}"
_MAP = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in T.NUMBER_WORDS.items()) + "}"


@query(rf"""
    WITH {SQL_ATTEMPTS}, e AS (SELECT attempt_id, evidence, nullif(regexp_extract(evidence, '(?i)\b([0-9]+(?:\.\d+)?)\s*({N.UNITS})\b', 1), '') AS f, nullif(regexp_extract(evidence, '(?i)\b({_QTY})\s*({N.UNITS})\b', 1), '') AS w, nullif(regexp_extract(evidence, '{_SPAN}', 1), '') AS y1, regexp_extract(evidence, '{_SPAN}', 2) AS y2 FROM att WHERE evidence IS NOT NULL)
    SELECT attempt_id, replace(nullif(regexp_extract(evidence, '\$\s*([0-9][0-9,]*(?:\.\d+)?)', 1), ''), ',', '') AS dollars, nullif(regexp_extract(evidence, '(?i)([0-9]+(?:\.\d+)?)\s*(?:%|percent)', 1), '') AS percentage,
      CASE WHEN f IS NOT NULL THEN f || ' ' || regexp_extract(evidence, '(?i)\b([0-9]+(?:\.\d+)?)\s*({N.UNITS})\b', 2) WHEN w IS NOT NULL THEN {_QMAP}[lower(w)] || ' ' || regexp_extract(evidence, '(?i)\b({_QTY})\s*({N.UNITS})\b', 2) END AS quantity,
      coalesce(y1 || '-' || CASE WHEN length(y2) = 4 THEN y2 WHEN y2 < '50' THEN '20' || y2 ELSE '19' || y2 END, nullif(regexp_extract(evidence, '(?i)\b((?:{N.MONTHS})\s+\d{{1,2}},?\s+(?:20|19)\d{{2}})\b', 1), '')) AS date_value FROM e
""")
def value_extraction(read) -> DataFrame:
    """The first amount, share, quantity and date of each quotation."""
    e = F.col("evidence")
    rows = _attempts(read, "evidence").where("evidence is not null")
    return rows.select("attempt_id", N.dollars(e).alias("dollars"), N.percentage(e).alias("percentage"), N.quantity(e).alias("quantity"), N.date_value(e).alias("date_value"))


_part = lambda g: f"replace(regexp_extract_all(text, '{N.SUMS}', {g})[i], ',', '')::BIGINT"


@query(rf"""
    SELECT doc_id, len(list_filter(list_zip(regexp_extract_all(text, '(?i)\b({_WORDS})\s*\(\s*(\d{{1,9}})\s*\)', 1), regexp_extract_all(text, '(?i)\b({_WORDS})\s*\(\s*(\d{{1,9}})\s*\)', 2)), lambda p: {_MAP}[lower(p[1])] <> p[2]::INTEGER)) AS n_word_digit,
      len(list_filter(range(1, len(regexp_extract_all(text, '{N.SUMS}')) + 1), lambda i: {_part(1)} <> {_part(2)} + CASE WHEN regexp_extract_all(text, '{N.SUMS}', 3)[i] = '+' THEN {_part(4)} ELSE -{_part(4)} END)) AS n_sums FROM documents WHERE text IS NOT NULL
""")
def number_conflicts(read) -> DataFrame:
    """How many written-out numbers contradict their figures, and how many sums given in parentheses are wrong."""
    t = F.col("text")
    sums = N.sum_conflicts(t)
    return read("documents").where("text is not null").select("doc_id", N.word_digit_conflicts(t).alias("n_word_digit"), sums.alias("n_sums"))


@query("""
    WITH q AS (SELECT qid, topic, CASE WHEN len(string_split(qid, '_')) >= 3 THEN string_split(qid, '_')[2] END AS middle FROM questions)
    SELECT a.qid, b.qid AS sibling, a.topic = b.topic AS same_topic FROM q a JOIN q b ON a.qid <> b.qid AND (a.topic = b.topic OR a.middle = b.middle)
""")
def sibling_questions(read) -> DataFrame:
    """Questions of the same topic or with the same middle part of the id: two equality joins of the fixed codebook."""
    parts = F.split("qid", "_")
    q = read("questions").select("qid", "topic", F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).alias("middle"))
    r = q.select(F.col("qid").alias("sibling"), F.col("topic").alias("t2"), F.col("middle").alias("m2"))
    either = q.join(r, F.col("topic") == F.col("t2")).unionByName(q.join(r, F.col("middle") == F.col("m2"))).where("qid <> sibling")
    return either.select("qid", "sibling", (F.col("topic") == F.col("t2")).alias("same_topic")).distinct()


@query(f"""
    WITH {SQL_ATTEMPTS}, i AS (SELECT attempt_id, list_sort(list_distinct(list_transform(regexp_extract_all(page, '[0-9]+'), lambda x: x::INTEGER))) AS i FROM att WHERE page IS NOT NULL),
    r AS (SELECT attempt_id, i, list_filter(i, lambda x: x - i[1] + 1 = list_position(i, x)) AS run FROM i WHERE len(i) > 0)
    SELECT attempt_id, i[1] AS first_page, run[-1] AS last_page, len(i) - len(run) AS n_after FROM r
""")
def consecutive_pages(read) -> DataFrame:
    """The run of consecutive pages that an attempt's references begin with, and how many lie after its first gap."""
    ints = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("page", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))))
    rows = _attempts(read, "page").where("page is not null").select("attempt_id", ints.alias("i")).where(F.size("i") > 0)
    run = F.filter("i", lambda x: x - F.array_min("i") + 1 == F.array_position("i", x))
    return rows.select("attempt_id", F.array_min("i").alias("first_page"), F.array_max(run).alias("last_page"), (F.size("i") - F.size(run)).cast("long").alias("n_after"))


_PATTERNS = ["grievance", "salary", "sick leave", "insurance", "seniority"]


@query(f"""
    WITH p AS (SELECT doc_id, unnest(string_split(lower(text), chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM documents WHERE text IS NOT NULL),
    w AS (SELECT unnest({_PATTERNS}) AS pattern, unnest(range(1, 6)) AS place)
    SELECT doc_id, pattern, page_no FROM p JOIN w ON contains(page, pattern) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, page_no) = 1
""")
def first_pattern_page(read) -> DataFrame:
    """For each document the first of some patterns that it holds, and the first page that holds it."""
    pages = F.transform(T.pages(F.lower("text")), lambda p, i: F.struct(p.alias("p"), (i + 1).cast("long").alias("n")))
    rows = read("documents").where("text is not null").select("doc_id", pages.alias("pages"))
    found = [F.struct(F.lit(w).alias("pattern"), F.get(F.transform(F.filter("pages", lambda x: F.contains(x["p"], F.lit(w))), lambda x: x["n"]), F.lit(0)).alias("page_no")) for w in _PATTERNS]
    first = F.get(F.filter(F.array(*found), lambda f: f["page_no"].isNotNull()), F.lit(0))
    return rows.select("doc_id", first.alias("f")).where("f is not null").select("doc_id", "f.pattern", "f.page_no")


@query("SELECT doc_id, md5(text) AS digest, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def page_concat(read) -> DataFrame:
    """Documents put together again from their pages, in order: the same text."""
    p = P.explode_pages(read("documents").select("doc_id", "text"))
    whole = p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "page"))), lambda x: x["page"]), "\f").alias("text"))
    return whole.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query(f"""
    WITH {SQL_ATTEMPTS}, {_BEST}, r AS (SELECT question_id, avg((status = 'substantive')::INT) AS rate, count(*) AS n FROM best GROUP BY question_id)
    SELECT document_id, question_id, round(rate, 6) AS rate FROM best JOIN r USING (question_id) WHERE status IN ('no', 'not_discussed') AND rate >= 0.5 AND n >= 3
""")
def suspect_absences(read) -> DataFrame:
    """Absences reported for questions that most documents answer."""
    rows = _attempts(read, "document_id", "question_id", "answer", "evidence", "confidence")
    best = A.best_answers(rows, ["document_id", "question_id"], ["attempt_id"]).select("document_id", "question_id", T.status_for_score(F.col("answer")).alias("status"))
    rates = best.groupBy("question_id").agg(F.avg((F.col("status") == "substantive").cast("int")).alias("rate"), F.count(F.lit(1)).alias("n")).where("rate >= 0.5 and n >= 3")
    return best.where(F.col("status").isin("no", "not_discussed")).join(rates, "question_id").select("document_id", "question_id", F.round("rate", 6).alias("rate"))
