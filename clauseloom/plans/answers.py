"""Queries on the attempts: deduplication, joins with the codebook, best answers, scores, reconciliation, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clauseloom.functions import text as T
from clauseloom.operators import answers as A, pages as P
from clauseloom.plans import SQL_ATTEMPTS, SQL_WS, query

_WSU = f"regexp_replace(lower(trim(coalesce(answer, ''))), '{SQL_WS}+', '_', 'g')"
_SCORE = f"""CASE WHEN {_WSU} IN ('not_discussed', 'not_discussed.') THEN 'not_discussed' WHEN starts_with({_WSU}, 'discussed_unclear') THEN 'discussed_unclear' WHEN starts_with({_WSU}, 'not_applicable') THEN 'not_applicable'
    WHEN {_WSU} IN ('no', 'no.', 'none', 'none_specifically_cited') THEN 'no' WHEN regexp_matches(lower(trim(coalesce(answer, ''))), '^no\\s*[,.;:—-]') THEN 'no' WHEN {_WSU} = '' THEN 'not_discussed' ELSE 'substantive' END"""
_VU = f"regexp_replace({_WSU}, '^[._]+|[._]+$', '', 'g')"
_VERIFY = f"""CASE WHEN trim(coalesce(answer, '')) = '' THEN 'empty' WHEN starts_with({_VU}, 'not_discussed') THEN 'not_discussed' WHEN starts_with({_VU}, 'discussed_unclear') THEN 'discussed_unclear'
    WHEN starts_with({_VU}, 'not_applicable') THEN 'not_applicable' WHEN {_VU} IN ('no', 'none', 'none_specifically_cited', 'no_provision') THEN 'no' ELSE 'substantive' END"""
_CONF = "CASE lower(trim(coalesce(confidence, ''))) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_BEST = f"""scored AS (SELECT *, {_SCORE} AS status FROM att), ranked AS (SELECT *, CASE WHEN status = 'substantive' THEN 10 + CASE WHEN length(trim(coalesce(evidence, ''))) > 0 THEN 5 ELSE 0 END ELSE 0 END + {_CONF} AS score FROM scored),
    best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY document_id, question_id ORDER BY score DESC, attempt_id) = 1)"""


def _attempts(read, *columns: str) -> DataFrame:
    return read("attempts").select("attempt_id", *columns).dropDuplicates(["attempt_id"])


def _book(read) -> list[str]:
    return sorted(r[0] for r in read("questions").select("qid").collect())


@query(f"WITH {SQL_ATTEMPTS} SELECT {_SCORE} AS scorer, {_VERIFY} AS verifier, coalesce(source, '') AS source, count(*) AS n FROM att GROUP BY ALL")
def classify_answers(read) -> DataFrame:
    a = F.col("answer")
    rows = _attempts(read, "answer", "source").select(T.status_for_score(a).alias("scorer"), T.status_for_verify(a).alias("verifier"), F.coalesce("source", F.lit("")).alias("source"))
    return rows.groupBy("scorer", "verifier", "source").agg(F.count(F.lit(1)).alias("n"))


_ALIASES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.MISSING.items()) + "}"


@query(f"WITH {SQL_ATTEMPTS} SELECT coalesce({_ALIASES}[lower(trim(answer))], trim(answer)) AS answer, count(*) AS n FROM att GROUP BY 1")
def answer_aliases(read) -> DataFrame:
    return _attempts(read, "answer").groupBy(T.answer_alias(F.col("answer")).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT document_id, question_id, source, max(attempt_id) AS attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, question_id, source ORDER BY loaded_at DESC, attempt_id DESC) AS rn FROM attempts) WHERE rn = 1 GROUP BY ALL")
def dedup_last(read) -> DataFrame:
    """The attempt of each document, question and source that was loaded last."""
    rows = read("attempts").select("document_id", "question_id", "source", "loaded_at", "attempt_id")
    return P.latest(rows, ["document_id", "question_id", "source"], ["loaded_at", "attempt_id"]).select("document_id", "question_id", "source", "attempt_id")


@query("SELECT coalesce(trim(evidence, ' '), '') AS evidence, min(attempt_id) AS attempt_id, count(DISTINCT attempt_id) AS n FROM attempts GROUP BY coalesce(trim(evidence, ' '), ''), CASE WHEN length(trim(evidence, ' ')) > 0 THEN 0 ELSE attempt_id END")
def dedup_first(read) -> DataFrame:
    """Equal quotations once, by their first attempt; every attempt without a quotation stays."""
    rows = _attempts(read, "evidence").withColumn("evidence", F.coalesce(F.trim("evidence"), F.lit("")))
    own = F.when(F.col("evidence") == "", F.col("attempt_id")).otherwise(0)
    return rows.groupBy("evidence", own.alias("_own")).agg(F.min("attempt_id").alias("attempt_id"), F.count(F.lit(1)).alias("n")).drop("_own")


@query(f"WITH {SQL_ATTEMPTS}, {_BEST} SELECT document_id, question_id, attempt_id, score, status FROM best")
def argmax_rank(read) -> DataFrame:
    rows = _attempts(read, "document_id", "question_id", "answer", "evidence", "confidence")
    best = A.best_answers(rows, ["document_id", "question_id"], ["attempt_id"])
    return best.select("document_id", "question_id", "attempt_id", "score", T.status_for_score(F.col("answer")).alias("status"))


@query(f"""
    WITH {SQL_ATTEMPTS}, {_BEST}, d AS (SELECT DISTINCT document_id FROM documents), t AS (SELECT document_id, qid AS question_id FROM d, questions)
    SELECT t.document_id, t.question_id, coalesce(nullif(trim(answer), ''), 'not_discussed') AS answer, coalesce(nullif(trim(confidence), ''), 'unclear') AS confidence, attempt_id IS NOT NULL AS coded
    FROM t LEFT JOIN best b ON t.document_id = b.document_id AND t.question_id = b.question_id
""")
def left_defaults(read) -> DataFrame:
    """Every document with every question and its best answer, defaults where there is none."""
    rows = _attempts(read, "document_id", "question_id", "answer", "evidence", "confidence")
    best = A.best_answers(rows, ["document_id", "question_id"], ["attempt_id"])
    grid = A.template(read("documents").select("document_id").distinct(), _book(read))
    full = grid.join(best, ["document_id", "question_id"], "left")
    return full.select(
        "document_id", "question_id", A.with_defaults(F.col("answer"), "not_discussed").alias("answer"), A.with_defaults(F.col("confidence"), "unclear").alias("confidence"), F.col("attempt_id").isNotNull().alias("coded")
    )


@query("""
    WITH d AS (SELECT DISTINCT document_id FROM documents) SELECT document_id, count(*) AS n_pending FROM d, questions q
    WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.document_id = d.document_id AND a.question_id = q.qid) GROUP BY document_id
""")
def pending_anti(read) -> DataFrame:
    """How many questions of each document no attempt has answered."""
    grid = A.template(read("documents").select("document_id").distinct(), _book(read))
    done = read("attempts").select("document_id", "question_id").distinct()
    return grid.join(done, ["document_id", "question_id"], "left_anti").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pending"))


@query("SELECT doc_id, document_id FROM documents d WHERE EXISTS (SELECT 1 FROM attempts a WHERE a.document_id = d.document_id AND a.grounded)")
def exists_semi(read) -> DataFrame:
    """Documents with a grounded attempt."""
    return read("documents").select("doc_id", "document_id").join(read("attempts").where("grounded").select("document_id"), "document_id", "left_semi").select("doc_id", "document_id")


@query("""
    WITH b AS (SELECT DISTINCT question_id, document_id, evidence FROM attempts WHERE length(evidence) >= 60), n AS (SELECT question_id, document_id, count(*) AS own FROM b GROUP BY ALL)
    SELECT question_id, document_id, own, (sum(own) OVER (PARTITION BY question_id) - own)::BIGINT AS n_other FROM n
""")
def cross_doc_exemplar(read) -> DataFrame:
    """For each question and document the exemplar quotations of the document and of all others, without pairing them."""
    own = read("attempts").where(F.length("evidence") >= 60).select("question_id", "document_id", "evidence").distinct().groupBy("question_id", "document_id").agg(F.count(F.lit(1)).alias("own"))
    every = own.groupBy("question_id").agg(F.sum("own").alias("_all"))
    return own.join(every, "question_id").select("question_id", "document_id", "own", (F.col("_all") - F.col("own")).alias("n_other"))


@query(f"""
    WITH {SQL_ATTEMPTS}, {_BEST}, d AS (SELECT document_id FROM best GROUP BY document_id HAVING count(*) >= 5)
    SELECT question_id, count(*) AS n_documents, round(avg((status = 'substantive')::INT), 6) AS rate FROM best WHERE document_id IN (SELECT document_id FROM d) GROUP BY question_id HAVING count(*) >= 3
""")
def base_rate(read) -> DataFrame:
    """How often each question is answered in documents with five answers and more, if three of them have it."""
    rows = _attempts(read, "document_id", "question_id", "answer", "evidence", "confidence")
    best = A.best_answers(rows, ["document_id", "question_id"], ["attempt_id"]).select("document_id", "question_id", (T.status_for_score(F.col("answer")) == "substantive").cast("int").alias("sub"))
    known = best.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("document_id")
    return best.join(known, "document_id", "left_semi").groupBy("question_id").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("sub"), 6).alias("rate")).where("n_documents >= 3")


@query(f"""
    WITH {SQL_ATTEMPTS}, s AS (SELECT document_id, question_id, source, max_by({_SCORE}, attempt_id) AS status FROM att WHERE source IS NOT NULL GROUP BY ALL)
    SELECT a.source AS baseline, b.source AS candidate, a.status AS baseline_status, b.status AS candidate_status, count(*) AS n FROM s a JOIN s b ON a.document_id = b.document_id AND a.question_id = b.question_id AND a.source < b.source GROUP BY ALL
""")
def paired_crosstab(read) -> DataFrame:
    """How the statuses of every two programs go together where both answered. The programs are few: their pairs are made
    inside the row of a document and question."""
    rows = _attempts(read, "document_id", "question_id", "source", "answer").where("source is not null").withColumn("status", T.status_for_score(F.col("answer")))
    last = rows.groupBy("document_id", "question_id", "source").agg(F.max_by("status", "attempt_id").alias("status"))
    each = last.groupBy("document_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("source", "status"))).alias("s")).where(F.size("s") > 1)
    pairs = F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a.source as baseline, b.source as candidate, a.status as baseline_status, b.status as candidate_status))))")
    return each.select(F.explode(pairs).alias("p")).groupBy("p.baseline", "p.candidate", "p.baseline_status", "p.candidate_status").agg(F.count(F.lit(1)).alias("n"))


# The questions of the codebook that the tables come with, for the SQL of the wide form.
CODEBOOK = """
    ben_dental_plan_002 ben_health_share_001 ben_life_cover_003 ben_retiree_plan_005 ben_tuition_aid_004 cls_caseload_cap_003 cls_overage_pay_002
    cls_pupil_cap_001 evl_improvement_plan_004 evl_rating_scale_002 evl_rebuttal_right_003 evl_visit_count_001 gri_arbitration_002 gri_file_access_004
    gri_grievance_steps_001 gri_just_cause_003 gri_release_time_005 lve_bereavement_span_003 lve_jury_pay_006 lve_leave_bank_005 lve_parental_time_004
    lve_personal_days_002 lve_sick_days_001 met_binding_force_004 met_term_dates_002 met_title_kind_001 met_unit_covered_003 pay_grid_shown_001
    pay_grid_year_002 pay_hourly_rate_006 pay_lane_change_004 pay_longevity_sum_005 pay_signing_sum_008 pay_step_movement_003 pay_stipend_table_007
    saf_assault_leave_001 saf_first_aid_003 saf_room_heat_002 saf_threat_report_004 sec_layoff_order_001 sec_recall_term_002 sec_seniority_list_003
    sec_transfer_notice_004 wrk_day_length_001 wrk_duty_free_meal_003 wrk_meeting_cap_004 wrk_planning_minutes_002 wrk_travel_time_005
""".split()
FIELDS = {"answer": "not_discussed", "evidence": "", "page": "not_applicable", "confidence": "low"}  # and what stands for a missing one


@query(f"""
    WITH {SQL_ATTEMPTS}, {_BEST}, b AS (SELECT document_id, question_id, {", ".join(f"coalesce(nullif(trim({f}, ' '), ''), '{d}') AS {f}" for f, d in FIELDS.items())} FROM best),
    d AS (SELECT DISTINCT document_id FROM documents)
    SELECT d.document_id, {", ".join(f"coalesce(max(CASE WHEN question_id = '{q}' THEN {f} END), '{v}') AS {q}_{f}" for q in CODEBOOK for f, v in FIELDS.items())} FROM d LEFT JOIN b ON d.document_id = b.document_id GROUP BY d.document_id
""")
def wide_pivot(read) -> DataFrame:
    """Every document by the codebook's questions, four columns a question: the best answer, its evidence, page and confidence,
    defaults where there is none."""
    rows = _attempts(read, "document_id", "question_id", *FIELDS)
    best = A.best_answers(rows, ["document_id", "question_id"], ["attempt_id"]).select("document_id", "question_id", *[A.with_defaults(F.col(f), d).alias(f) for f, d in FIELDS.items()])
    wide = best.groupBy("document_id").pivot("question_id", _book(read)).agg(*[F.first(f).alias(f) for f in FIELDS])
    full = read("documents").select("document_id").distinct().join(wide, "document_id", "left")
    return full.select("document_id", *[F.coalesce(c, F.lit(next(d for f, d in FIELDS.items() if c.endswith("_" + f)))).alias(c) for c in full.columns if c != "document_id"])


@query(f"""
    WITH {SQL_ATTEMPTS}, {_BEST}, d AS (SELECT document_id, min(district) AS district FROM documents GROUP BY document_id)
    SELECT d.document_id, district, q.qid AS question_id, topic, {", ".join(f"coalesce(nullif(trim({f}, ' '), ''), '{v}') AS {f}" for f, v in FIELDS.items())}, b.attempt_id IS NOT NULL AS coded
    FROM d CROSS JOIN questions q LEFT JOIN best b ON d.document_id = b.document_id AND q.qid = b.question_id
""")
def long_dataset(read) -> DataFrame:
    """Every document with every question, its topic and the four fields of the best answer: the long form of the data set.

    The best answers meet their document as one map, and the questions (a codebook, of fixed size) are unfolded last, as rows
    leave: nothing is shuffled or sorted by document and question but the answers themselves. Copies of an attempt need not
    be dropped, for the best one stays the same."""
    book = read("questions").select(F.col("qid").alias("question_id"), "topic")
    rows = read("attempts").select("attempt_id", "document_id", "question_id", *FIELDS).join(F.broadcast(book), "question_id", "left_semi")
    best = A.best_answers(rows, ["document_id", "question_id"], ["attempt_id"])
    item = F.struct(*[A.with_defaults(F.col(f), d).alias(f) for f, d in FIELDS.items()], F.col("attempt_id").isNotNull().alias("coded"))
    coded = best.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("question_id", item))).alias("_all"))
    docs = read("documents").groupBy("document_id").agg(F.min("district").alias("district"))
    full = docs.join(coded.hint("merge"), "document_id", "left").crossJoin(F.broadcast(book))  # only the codebook is broadcast, whatever the sizes are taken for
    one = F.col("_all")[F.col("question_id")]
    return full.select("document_id", "district", "question_id", "topic", *[F.coalesce(one[f], F.lit(d)).alias(f) for f, d in FIELDS.items()], F.coalesce(one["coded"], F.lit(False)).alias("coded"))


@query(f"""
    WITH {SQL_ATTEMPTS}, u AS (SELECT attempt_id, unnest(['answer', 'evidence', 'page', 'confidence', 'coder_notes']) AS field, unnest([answer, evidence, page, confidence, coder_notes]) AS value FROM att)
    SELECT field, count(*) AS n, sum((value IS NULL OR trim(value) = '')::INT)::BIGINT AS n_blank, sum((field = 'confidence' AND lower(trim(coalesce(value, ''))) NOT IN ('high', 'medium', 'low'))::INT)::BIGINT AS n_invalid, count(DISTINCT value) AS n_distinct FROM u GROUP BY field
""")
def unpivot_validate(read) -> DataFrame:
    """The text fields of the attempts one below the other, and what is wrong with each."""
    fields = ["answer", "evidence", "page", "confidence", "coder_notes"]
    long = _attempts(read, *fields).unpivot("attempt_id", fields, "field", "value")
    blank = F.col("value").isNull() | (F.trim("value") == "")
    invalid = (F.col("field") == "confidence") & ~F.lower(F.trim(F.coalesce("value", F.lit("")))).isin("high", "medium", "low")
    n = lambda c: F.sum(c.cast("long"))
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), n(blank).alias("n_blank"), n(invalid).alias("n_invalid"), F.countDistinct("value").alias("n_distinct"))


@query(f"""
    WITH {SQL_ATTEMPTS} SELECT coalesce(source, '') AS source, lower(trim(coalesce(confidence, ''))) AS confidence, count(*) AS n, count(DISTINCT document_id) AS n_documents, grouping(source, confidence) AS level
    FROM (SELECT coalesce(source, '') AS source, lower(trim(coalesce(confidence, ''))) AS confidence, document_id FROM att) GROUP BY ROLLUP (source, confidence)
""")
def confidence_rollup(read) -> DataFrame:
    rows = _attempts(read, "source", "confidence", "document_id").select(F.coalesce("source", F.lit("")).alias("source"), F.lower(F.trim(F.coalesce("confidence", F.lit("")))).alias("confidence"), "document_id")
    rolled = rows.rollup("source", "confidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("n_documents"), F.grouping_id().alias("level"))
    return rolled.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("confidence", F.lit("")).alias("confidence"), "n", "n_documents", "level")


@query(f"""
    WITH {SQL_ATTEMPTS} SELECT coalesce(source, '') AS source, pass_no, count(*) AS n, sum((coalesce(grounding_error, '') <> '')::INT)::BIGINT AS n_error, round(avg((coalesce(grounding_error, '') <> '')::INT), 6) AS share, avg((coalesce(grounding_error, '') <> '')::INT) > 0.05 AS damaged FROM att GROUP BY ALL
""")
def error_share(read) -> DataFrame:
    """Runs (source and pass) with more than one error in twenty."""
    bad = (F.coalesce("grounding_error", F.lit("")) != "").cast("int")
    rows = _attempts(read, "source", "pass_no", "grounding_error").groupBy(F.coalesce("source", F.lit("")).alias("source"), "pass_no")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("n_error"), F.round(F.avg(bad), 6).alias("share"), (F.avg(bad) > 0.05).alias("damaged"))


@query()
def variant_fold(read) -> DataFrame:
    """For each document and question the different substantive answers joined."""
    rows = _attempts(read, "document_id", "question_id", "answer").where(T.status_for_score(F.col("answer")) == "substantive")
    return A.fold_variants(rows, ["document_id", "question_id"], ["attempt_id"])


@query(f"""
    WITH {SQL_ATTEMPTS}, r AS (SELECT question_id, attempt_id, page, row_number() OVER (PARTITION BY document_id ORDER BY attempt_id) AS n FROM att)
    SELECT attempt_id, CASE WHEN len(i) >= 2 AND list_max(i) - list_min(i) <= 30 THEN range(list_min(i), list_max(i) + 1) ELSE list_sort(list_distinct(i)) END AS pages
    FROM (SELECT attempt_id, page, list_transform(regexp_extract_all(page, '[0-9]+'), lambda x: x::INTEGER) AS i FROM r WHERE page IS NOT NULL)
""")
def page_references(read) -> DataFrame:
    return _attempts(read, "page").where("page is not null").select("attempt_id", T.page_list(F.col("page")).alias("pages"))


@query(f"""
    WITH {SQL_ATTEMPTS}, g AS (SELECT question_id, split_part(question_id, '_', 1) AS category, row_number() OVER (PARTITION BY split_part(question_id, '_', 1) ORDER BY question_id) AS rn FROM (SELECT DISTINCT question_id FROM att WHERE question_id IS NOT NULL))
    SELECT question_id, category, (rn - 1) // 6 + 1 AS batch FROM g
""")
def question_batches(read) -> DataFrame:
    """Questions in batches of six within their category."""
    asked = read("attempts").select("question_id").where("question_id is not null").distinct().withColumn("category", F.split("question_id", "_")[0])
    rn = F.row_number().over(Window.partitionBy("category").orderBy("question_id"))
    return asked.select("question_id", "category", (F.floor((rn - 1) / 6) + 1).alias("batch"))
