"""Answering the codebook's questions by keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseloom.functions import numbers as N, text as T
from clauseloom.operators import keywords as K, pages as P
from clauseloom.plans import SQL_LATEST, SQL_WS, query, sql_squeeze
from clauseloom.plans.answers import _book
from clauseloom.plans.values import _QMAP, _QTY

_TERMS = rf"""raw AS (SELECT qid, coalesce(answer_type, '') AS kind, lower(concat_ws(' ', keywords, question, extract_note)) AS raw FROM questions),
    pc AS (SELECT qid, kind, string_split(regexp_replace(regexp_replace(raw, '[,;/()]', chr(31), 'g'), '\b(or|and)\b', chr(31), 'g'), chr(31)) AS p FROM raw),
    tr AS (SELECT qid, kind, list_filter(list_transform(list_filter(list_transform(p, lambda x: regexp_replace({sql_squeeze("x")}, '^({K.QUESTION_WORDS}) +', '')), lambda x: length(x) >= {K.LEAST_CHARS}), lambda x: trim(x, ' .?*`')), lambda x: length(x) BETWEEN 1 AND {K.MOST_CHARS}) AS t FROM pc),
    qt AS (SELECT qid, kind, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1])[1:{K.MOST_TERMS}] AS terms FROM tr)"""


def _questions(read) -> DataFrame:
    return read("questions").select("qid", F.coalesce("answer_type", F.lit("")).alias("kind"), K.question_terms(F.concat_ws(" ", "keywords", "question", "extract_note")).alias("terms"))


@query(f"WITH {_TERMS} SELECT qid, generate_subscripts(terms, 1) AS place, unnest(terms) AS term FROM qt")
def question_terms(read) -> DataFrame:
    """The search terms of each question, in their order."""
    rows = _questions(read).select("qid", F.posexplode("terms").alias("place", "term"))
    return rows.select("qid", (F.col("place") + 1).cast("long").alias("place"), "term")


_BEST = rf"""{_TERMS}, {SQL_LATEST}, pg AS (SELECT document_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM latest WHERE text IS NOT NULL),
    ut AS (SELECT DISTINCT unnest(terms) AS term FROM qt), fo AS (SELECT document_id, page_no, page, term, string_split(lower(page), term)[1:{K.ON_A_PAGE + 1}] AS p FROM pg JOIN ut ON contains(lower(page), term)),
    oc AS (SELECT document_id, page_no, page, term, unnest(range(1, least({K.ON_A_PAGE}, len(p) - 1) + 1)) AS nth, p FROM fo),
    po AS (SELECT *, list_sum(list_transform(p[1:nth], lambda x: length(x)))::BIGINT + (nth - 1) * length(term) AS a FROM oc),
    sn AS (SELECT document_id, page_no, term, nth, {sql_squeeze(f"substr(page, (greatest(0, a - {K.BEFORE}) + 1)::BIGINT, (least(length(page), a + length(term) + {K.AFTER}) - greatest(0, a - {K.BEFORE}))::BIGINT)")} AS snippet FROM po),
    tq AS (SELECT qid, kind, unnest(terms) AS term, generate_subscripts(terms, 1) AS place FROM qt),
    sc AS (SELECT document_id, qid, kind, page_no, place, nth, snippet, length(term) + CASE WHEN contains(kind, 'dollar') AND contains(snippet, '$') THEN 100 ELSE 0 END + CASE WHEN contains(kind, 'percentage') AND regexp_matches(lower(snippet), '%|percent') THEN 100 ELSE 0 END
      + CASE WHEN contains(kind, 'numeric') AND regexp_matches(lower(snippet), '{K.UNITS}') THEN 80 ELSE 0 END + CASE WHEN regexp_matches(lower(snippet), '{K.BINDING}') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(lower(snippet), '{K.CONTENTS}') THEN 25 ELSE 0 END AS score FROM sn JOIN tq USING (term)),
    be AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY document_id, qid ORDER BY score DESC, place, page_no, nth) = 1)"""


def _best(read) -> DataFrame:
    """document_id, qid, kind, page_no, score, snippet: the best place of each document for each question it has one for."""
    questions = _questions(read)
    book = questions.select("qid", "kind", F.posexplode("terms").alias("place", "term"))
    terms = sorted({t for r in questions.select("terms").collect() for t in r["terms"]})  # the codebook has a fixed size
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"]).drop("doc_id")
    found = K.place_marks(K.places(P.explode_pages(docs), ["document_id"], terms)).join(F.broadcast(book), "term")
    scored = found.withColumn("score", K.marked_score(F.col("term"), F.col("marks"), F.col("kind"))).where("score > 0")
    first = F.struct(-F.col("score"), "place", "page_no", "nth")
    return scored.groupBy("document_id", "qid").agg(F.min_by(F.struct("kind", "page_no", "score", "snippet"), first).alias("b")).select("document_id", "qid", "b.*")


@query(f"WITH {_BEST} SELECT document_id, qid, page_no, score, md5(snippet) AS digest FROM be")
def keyword_evidence(read) -> DataFrame:
    """The best place of each document for each question: page, score and digest of the text around it."""
    return _best(read).select("document_id", "qid", "page_no", "score", F.md5("snippet").alias("digest"))


_FIG = rf"nullif(regexp_extract(snippet, '(?i)\b([0-9]+(?:\.\d+)?)\s*({N.UNITS})\b', 1), '')"
_WORD = rf"nullif(regexp_extract(snippet, '(?i)\b({_QTY})\s*({N.UNITS})\b', 1), '')"


@query(rf"""
    WITH {_BEST}, st AS (SELECT document_id, len(string_split(text, chr(12))) AS n, length(regexp_replace(text, '{SQL_WS}+', '', 'g')) AS dense FROM latest),
    an AS (SELECT *, coalesce(nullif(CASE WHEN contains(kind, 'numeric') THEN CASE WHEN {_FIG} IS NOT NULL THEN {_FIG} || ' ' || regexp_extract(snippet, '(?i)\b([0-9]+(?:\.\d+)?)\s*({N.UNITS})\b', 2) WHEN {_WORD} IS NOT NULL THEN {_QMAP}[lower({_WORD})] || ' ' || regexp_extract(snippet, '(?i)\b({_QTY})\s*({N.UNITS})\b', 2) END
      WHEN contains(kind, 'yes/no') THEN CASE WHEN regexp_matches(lower(snippet), '{K.DENIALS}') AND NOT regexp_matches(lower(snippet), '{K.NO_DENIAL}') THEN 'no' ELSE 'yes' END ELSE {sql_squeeze("substr(snippet, 1, 220)")} END, ''), 'discussed_unclear') AS answer FROM be)
    SELECT s.document_id, q.qid AS question_id, CASE WHEN n > 0 AND dense < greatest(1000, n * 20) THEN 'discussed_unclear' ELSE coalesce(a.answer, 'not_discussed') END AS answer,
      CASE WHEN n > 0 AND dense < greatest(1000, n * 20) THEN 'not_available' WHEN a.answer IS NULL THEN 'not_applicable' ELSE page_no::VARCHAR END AS page,
      CASE WHEN n > 0 AND dense < greatest(1000, n * 20) THEN 'low' WHEN a.answer IS NULL THEN 'medium' WHEN a.answer <> 'discussed_unclear' THEN 'high' WHEN contains(snippet, '$') OR regexp_matches(snippet, '\d') THEN 'medium' ELSE 'low' END AS confidence
    FROM st s CROSS JOIN questions q LEFT JOIN an a ON s.document_id = a.document_id AND q.qid = a.qid
""")
def keyword_answers(read) -> DataFrame:
    """Every question answered for every document by its best place: a value of the question's kind, with page and confidence;
    documents with too little text are unclear, questions without a place not discussed."""
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"])
    n = F.when(F.col("text").isNull(), None).otherwise(F.size(T.pages(F.col("text"))))
    state = docs.select("document_id", F.coalesce((n > 0) & (T.dense_length(F.col("text")) < F.greatest(F.lit(1000), n * 20)), F.lit(False)).alias("_thin"))
    sure = F.when(F.col("_a") != "discussed_unclear", "high").when(F.col("snippet").contains("$") | F.col("snippet").rlike(r"\d"), "medium").otherwise("low")
    best = _best(read).where("qid is not null").withColumn("_a", K.answer_of(F.col("snippet"), F.col("kind")))
    # one row for each document holds what it answers, at most an entry for each question: nothing is shuffled by question
    held = best.select("document_id", F.struct("qid", F.struct("_a", "page_no", sure.alias("sure"))).alias("e")).groupBy("document_id").agg(F.map_from_entries(F.collect_list("e")).alias("_held"))
    full = state.join(held, "document_id", "left").select("document_id", "_thin", "_held", F.explode(F.array(*[F.lit(q) for q in _book(read)])).alias("question_id"))
    full = full.select("document_id", "_thin", "question_id", F.element_at("_held", F.col("question_id")).alias("_b")).select("document_id", "_thin", "question_id", "_b.*")
    return full.select(
        "document_id", "question_id", F.when(F.col("_thin"), "discussed_unclear").otherwise(F.coalesce("_a", F.lit("not_discussed"))).alias("answer"),
        F.when(F.col("_thin"), "not_available").otherwise(F.coalesce(F.col("page_no").cast("string"), F.lit("not_applicable"))).alias("page"),
        F.when(F.col("_thin"), "low").when(F.col("_a").isNull(), "medium").otherwise(F.col("sure")).alias("confidence"),
    )
