"""Queries that bring coded answers together: reconciliation of all programs, scores against a key, review of two programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clauseloom.functions import numbers as N, text as T
from clauseloom.operators import answers as A, pages as P, review as V
from clauseloom.plans import SQL_LATEST, SQL_WS, query, sql_squeeze
from clauseloom.plans.answers import _SCORE, _attempts
from clauseloom.plans.retrieval import _GROUND, _located

PRECEDENCE = ["sweep", "verify", "subset", "contrast", "remote_worker", "legacy_import"]  # the programs, the most trusted first
KEY = "reviewer"  # whose answers are the key

_STITCHED = r"\.\.\.|…"
_NUM = lambda c: rf"list_distinct(list_transform(regexp_extract_all({c}, '\d+(?:\.\d+)?%?'), lambda x: replace(x, '%', '')))"
_FOLD = lambda c: sql_squeeze(f"lower(translate({c}, '’‘“”–—', '''''\"\"--'))")
_COMMON = ", ".join(f"'{w}'" for w in T.COMMON_WORDS)
_CONTENT = lambda c: f"list_distinct(list_filter(regexp_extract_all({_FOLD(c)}, '[a-z][a-z''/-]{{3,}}'), lambda w: w NOT IN ({_COMMON})))"
_SUPPORT = lambda c: f"list_distinct(list_concat({_NUM(c)}, {_CONTENT(c)}))"
_INTS = lambda c: f"list_transform(regexp_extract_all({c}, '[0-9]+'), lambda x: x::INTEGER)"


def _grounded(read, *columns: str) -> DataFrame:
    """attempt_id, columns, grounded: the quotation stands whole on one page of its document and is not stitched."""
    rows = _attempts(read, "document_id", "question_id", *columns)
    return rows.join(_located(read), "attempt_id", "left").withColumn("grounded", F.col("page_no").isNotNull() & ~F.coalesce(F.col("evidence").rlike(_STITCHED), F.lit(False)))


@query(f"""
    WITH RECURSIVE {_GROUND}, prec AS (SELECT unnest({PRECEDENCE}) AS source, unnest(range({len(PRECEDENCE)})) AS place),
    r AS (SELECT a.document_id, a.question_id, a.source, place, trim(coalesce(answer, ''), ' ') AS answer, coalesce(evidence, '') AS e, coalesce(a.page, '') AS p, coalesce(confidence, '') AS c, g.page_no IS NOT NULL AND NOT coalesce(regexp_matches(evidence, '{_STITCHED}'), false) AS ok
      FROM att a JOIN prec ON a.source = prec.source LEFT JOIN g ON a.attempt_id = g.attempt_id QUALIFY row_number() OVER (PARTITION BY a.document_id, a.question_id, a.source ORDER BY a.attempt_id DESC) = 1),
    c AS (SELECT *, {_SCORE} AS status, {_NUM("answer")} AS f, {_SCORE} = 'substantive' AND length(trim(e, ' ')) > 0 AS solid FROM r),
    s AS (SELECT document_id, question_id, list({{'s': source, 'a': answer, 'e': e, 'p': p, 'c': c, 'ok': ok, 'f': f}} ORDER BY place) FILTER (WHERE solid) AS l, arg_min(answer, place) FILTER (WHERE status = 'no') AS no, arg_min(answer, place) AS head FROM c GROUP BY ALL),
    fold AS (SELECT document_id, question_id, l, no, head, 1 AS i, l[1].a AS answer, l[1].f AS have, [l[1].p] AS pages, 0 AS n FROM s
      UNION ALL SELECT document_id, question_id, l, no, head, i + 1, CASE WHEN takes THEN answer || '; also (' || x.s || '): ' || x.a ELSE answer END, CASE WHEN takes THEN list_distinct(list_concat(have, x.f)) ELSE have END, CASE WHEN takes THEN list_append(pages, x.p) ELSE pages END, n + takes::INT
      FROM (SELECT *, l[i + 1] AS x, l[i + 1].ok AND len(list_filter(l[i + 1].f, lambda v: NOT list_contains(have, v))) > 0 AS takes FROM fold WHERE i < len(l))),
    z AS (SELECT *, CASE WHEN l IS NULL THEN NULL ELSE {_SUPPORT("answer")} END AS want FROM fold WHERE l IS NULL OR i = len(l)),
    k AS (SELECT document_id, question_id, unnest(l) AS x, generate_subscripts(l, 1) AS j, want FROM z),
    b AS (SELECT document_id, question_id, arg_min(x, (-(len(list_intersect(want, {_SUPPORT("x.e")})) + (j = 1)::INT)) * 100 + j) AS x FROM k WHERE x.ok GROUP BY ALL),
    y AS (SELECT z.*, coalesce(b.x, z.l[1]) AS best FROM z LEFT JOIN b ON z.document_id = b.document_id AND z.question_id = b.question_id),
    w AS (SELECT *, list_sort(list_distinct(flatten(list_transform(list_append(pages, best.p), lambda t: {_INTS("t")})))) AS nums FROM y)
    SELECT document_id, question_id, CASE WHEN l IS NULL THEN coalesce(nullif(coalesce(no, head), ''), 'not_discussed') ELSE answer END AS answer, CASE WHEN l IS NULL THEN '' ELSE best.e END AS evidence,
      CASE WHEN l IS NOT NULL AND len(nums) > 0 THEN array_to_string(nums, ';') ELSE 'not_applicable' END AS page, CASE WHEN l IS NULL THEN 'low' ELSE l[1].c END AS confidence, CASE WHEN l IS NULL THEN '' ELSE l[1].s END AS base,
      CASE WHEN l IS NULL THEN '' ELSE best.s END AS evidence_from, CASE WHEN l IS NULL THEN 0 ELSE n END AS n_added FROM w
""")
def reconcile_sources(read) -> DataFrame:
    """The latest answers of all programs made one, in the order of their precedence."""
    rows = _grounded(read, "source", "answer", "evidence", "page", "confidence").where(F.col("source").isin(PRECEDENCE)).drop("page_no")
    last = P.latest(rows, ["document_id", "question_id", "source"], ["attempt_id"])
    return A.reconcile(last, ["document_id", "question_id"], PRECEDENCE)


_NS = lambda c: sql_squeeze(f"lower(translate({c}, '’“”', '''\"\"'))")
_SPELL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.SPELLED.items()) + "}"
_THERE = lambda t: rf"CASE WHEN regexp_full_match({t}, '\d+(\.\d+)?') THEN regexp_matches(hay, '(^|[^0-9.])' || replace({t}, '.', '\.') || '($|[^0-9])') OR coalesce(contains(hay, {_SPELL}[{t}]), false) ELSE contains(hay, {t}) END"


@query(f"""
    WITH {_GROUND}, s AS (SELECT att.attempt_id, document_id, question_id, coalesce(source, '') AS source, answer, evidence, {_SCORE} AS status, {_INTS("coalesce(page, '')")} AS pages, g.page_no IS NOT NULL AS located FROM att LEFT JOIN g USING (attempt_id)),
    gold AS (SELECT document_id, question_id, max_by({{'s': status, 'r': CASE WHEN status = 'substantive' THEN {_NUM("coalesce(answer, '')")} ELSE [] END, 'o': CASE WHEN status = 'substantive' THEN {_CONTENT("coalesce(answer, '')")} ELSE [] END, 'p': pages}}, attempt_id) AS k FROM s WHERE source = '{KEY}' GROUP BY ALL),
    j AS (SELECT s.*, k, {_NS("coalesce(answer, '')")} || ' ' || {_NS("coalesce(evidence, '')")} AS hay FROM s JOIN gold ON s.document_id = gold.document_id AND s.question_id = gold.question_id WHERE s.source <> '{KEY}'),
    f AS (SELECT source, (status = k.s)::INT AS st, CASE WHEN status = k.s AND status = 'substantive' THEN (len(list_filter(k.r, lambda t: {_THERE("t")})) = len(k.r))::INT ELSE (status = k.s AND len(k.r) = 0)::INT END AS rq,
      CASE WHEN len(k.o) = 0 THEN 1.0 WHEN status = k.s AND status = 'substantive' THEN round(len(list_filter(k.o, lambda t: {_THERE("t")})) / len(k.o), 3) ELSE 0.0 END AS co, (k.s = 'not_discussed' OR list_has_any(pages, k.p))::INT AS pg,
      (status <> 'substantive' OR (length({_NS("coalesce(evidence, '')")}) >= 15 AND located))::INT AS ev FROM j)
    SELECT source, count(*) AS n, round(avg(st), 4) AS status, round(avg(rq), 4) AS required, round(avg(co), 4) AS completeness, round(avg(pg), 4) AS page, round(avg(ev), 4) AS evidence, round(avg(st * rq * pg * ev), 4) AS overall FROM f GROUP BY source
""")
def score_flags(read) -> DataFrame:
    """The answers of each program scored by the reviewers' as a key: status, required figures, completeness of the content
    words, page, evidence, and all but completeness together."""
    rows = _grounded(read, "source", "answer", "evidence", "page").withColumn("source", F.coalesce("source", F.lit(""))).withColumn("pages", T.page_numbers(F.coalesce("page", F.lit(""))))
    rows = rows.withColumn("located", F.col("page_no").isNotNull())
    status, answer = T.status_for_score(F.col("answer")), F.coalesce("answer", F.lit(""))
    if_told = lambda c: F.when(status == "substantive", c).otherwise(F.array().cast("array<string>"))
    told = F.struct(status.alias("s"), if_told(T.numeric_tokens(answer)).alias("r"), if_told(T.content_words(answer)).alias("o"), "pages")
    key = rows.where(F.col("source") == KEY).groupBy("document_id", "question_id").agg(F.max_by(told, "attempt_id").alias("k"))
    key = key.select("document_id", "question_id", F.col("k.s").alias("k_status"), F.col("k.r").alias("k_required"), F.col("k.o").alias("k_optional"), F.col("k.pages").alias("k_pages"))
    scored = A.score(rows.where(F.col("source") != KEY).select("source", "document_id", "question_id", "answer", "evidence", "pages", "located"), key, ["document_id", "question_id"])
    mean = lambda c: F.round(F.avg(c), 4)
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[mean(c).alias(c) for c in ("status", "required")], mean("complete").alias("completeness"), *[mean(c).alias(c) for c in ("page", "evidence", "overall")])


# --- review of two programs ------------------------------------------------------------------------------------------------

_SIDES = """two AS (SELECT document_id, question_id, max_by({'a': coalesce(answer, ''), 'e': coalesce(evidence, ''), 'p': coalesce(page, ''), 'c': coalesce(confidence, '')}, attempt_id) AS x FROM att WHERE source = 'sweep' GROUP BY ALL),
    alt AS (SELECT document_id, question_id, max_by({'a': coalesce(answer, ''), 'e': coalesce(evidence, ''), 'p': coalesce(page, ''), 'c': coalesce(confidence, '')}, attempt_id) AS y FROM att WHERE source = 'verify' GROUP BY ALL),
    pk AS (SELECT two.document_id, two.question_id, x, y, substr(sha256(two.document_id || chr(0) || two.question_id), 1, 16) AS review_id, sha256('7' || chr(0) || two.document_id || chr(0) || two.question_id) < '8' AS straight FROM two JOIN alt ON two.document_id = alt.document_id AND two.question_id = alt.question_id)"""


def _packet(read) -> DataFrame:
    rows = _attempts(read, "document_id", "question_id", "source", "answer", "evidence", "page", "confidence")
    last = lambda s: P.latest(rows.where(F.col("source") == s).drop("source"), ["document_id", "question_id"], ["attempt_id"]).drop("attempt_id")
    return V.packet(last("sweep"), last("verify"), ["answer", "evidence", "page", "confidence"], seed=7)


@query(f"""
    WITH att AS (SELECT DISTINCT * FROM attempts), {_SIDES}
    SELECT review_id, document_id, question_id, CASE WHEN straight THEN 'baseline' ELSE 'candidate' END AS a_system, {", ".join(f"CASE WHEN straight THEN {s}.{k} ELSE {t}.{k} END AS {n}_{f}" for n, s, t in (("a", "x", "y"), ("b", "y", "x")) for k, f in (("a", "answer"), ("e", "evidence"), ("p", "page"), ("c", "confidence")))} FROM pk
""")
def blinded_packet(read) -> DataFrame:
    """The answers of two programs side by side, the sides dealt by a hash of the id; a_system is the key, to be kept apart."""
    return _packet(read)


@query(f"""
    WITH att AS (SELECT DISTINCT * FROM attempts), {_SIDES}, gold AS (SELECT document_id, question_id, max_by({_SCORE}, attempt_id) AS s, max_by({_INTS("coalesce(page, '')")}, attempt_id) AS p FROM att WHERE source = '{KEY}' GROUP BY ALL),
    v AS (SELECT 'baseline' AS system, (SELECT {_SCORE} FROM (SELECT x.a AS answer)) AS st, {_INTS("x.p")} AS pages, s, p FROM pk LEFT JOIN gold ON pk.document_id = gold.document_id AND pk.question_id = gold.question_id
      UNION ALL SELECT 'candidate', (SELECT {_SCORE} FROM (SELECT y.a AS answer)), {_INTS("y.p")}, s, p FROM pk LEFT JOIN gold ON pk.document_id = gold.document_id AND pk.question_id = gold.question_id),
    u AS (SELECT system, 'status' AS field, CASE WHEN s IS NULL THEN 'na' WHEN st = s THEN 'yes' ELSE 'no' END AS verdict FROM v UNION ALL SELECT system, 'page', CASE WHEN s IS NULL OR s = 'not_discussed' THEN 'na' WHEN list_has_any(pages, p) THEN 'yes' ELSE 'no' END FROM v)
    SELECT field, system, sum((verdict = 'yes')::INT)::BIGINT AS correct, sum((verdict = 'no')::INT)::BIGINT AS incorrect, round(sum((verdict = 'yes')::INT) / greatest(1, sum((verdict <> 'na')::INT)), 6) AS accuracy FROM u GROUP BY ALL
""")
def review_accuracy(read) -> DataFrame:
    """How often each of two programs was right by the reviewers' verdicts on a blinded packet, field by field; what the
    reviewers did not judge doesn't count."""
    packet = _packet(read)
    rows = _attempts(read, "document_id", "question_id", "source", "answer", "page").where(F.col("source") == KEY)
    gold = rows.groupBy("document_id", "question_id").agg(F.max_by(F.struct(T.status_for_score(F.col("answer")).alias("s"), T.page_numbers(F.coalesce("page", F.lit(""))).alias("p")), "attempt_id").alias("g"))
    told = lambda yes, judged: F.when(judged, F.when(yes, "yes").otherwise("no")).otherwise("na")

    def verdict(side: str) -> list[Column]:
        judged = F.col("g").isNotNull()
        same = T.status_for_score(F.col(f"{side}_answer")) == F.col("g.s")
        there = F.arrays_overlap(T.page_numbers(F.col(f"{side}_page")), F.col("g.p"))
        return [told(same, judged).alias(f"{side}_status_correct"), told(F.coalesce(there, F.lit(False)), judged & (F.col("g.s") != "not_discussed")).alias(f"{side}_page_correct")]

    judged = packet.join(gold, ["document_id", "question_id"], "left").select("review_id", "a_system", *verdict("a"), *verdict("b"))
    return V.accuracy(judged.drop("a_system"), judged.select("review_id", "a_system"), ["status", "page"])
