"""Queries on several readings of the same pages: gates, refusals, arbitration, figures that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseloom.functions import text as T
from clauseloom.operators import pages as P, readings as D
from clauseloom.plans import SQL_ATTEMPTS, SQL_LATEST, SQL_PASSAGES, query, sql_squeeze

FIGURES, PROSE = ["page", "passages", "evidence"], ["passages", "page", "evidence"]  # engines, the best first

_BODY = "trim(text, ' ' || chr(9) || chr(13) || chr(10))"
_LINES = f"list_filter(list_transform(string_split({_BODY}, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 3)"
_FIG = lambda c: rf"list_distinct(list_transform(regexp_extract_all({c}, '\d[\d,]*\.?\d*'), lambda x: regexp_replace(replace(x, ',', ''), '\.$', '')))"
_GATED = rf"""{SQL_ATTEMPTS}, {SQL_LATEST}, {SQL_PASSAGES},
    rd AS (SELECT document_id, page_no, 'page' AS engine, text FROM (SELECT document_id, unnest(string_split(text, chr(12))) AS text, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM latest WHERE text IS NOT NULL)
      UNION ALL SELECT document_id, page_start, 'passages', string_agg(text, chr(10) ORDER BY passage_id) FROM pas WHERE text IS NOT NULL AND page_start IS NOT NULL GROUP BY document_id, page_start
      UNION ALL SELECT document_id, p, 'evidence', string_agg(evidence, chr(10) ORDER BY attempt_id) FROM (SELECT *, try_cast(nullif(regexp_extract(page, '[0-9]+'), '') AS INTEGER) AS p FROM att) WHERE evidence IS NOT NULL AND p IS NOT NULL GROUP BY document_id, p),
    sz AS (SELECT *, CASE WHEN length({sql_squeeze("coalesce(text, '')")}) > 0 THEN length(text) ELSE 0 END AS n_chars FROM rd),
    md AS (SELECT document_id, engine, list_sort(list(n_chars))[count(*) // 2 + 1] AS m FROM sz WHERE n_chars > 0 GROUP BY ALL),
    gt AS (SELECT sz.*, n_chars > 0 AND CASE WHEN len({_LINES}) = 0 THEN false ELSE len(list_distinct({_LINES})) / len({_LINES}) < 0.6 END AS repeats, n_chars > 0 AND length({_BODY}) > 2.5 * m AS long, n_chars > 0 AND regexp_matches({_BODY}, '!\[[^\]]*\]\(https?://|\bimgur\b|\bexample\.com\b') AS invented
      FROM sz LEFT JOIN md USING (document_id, engine))"""


def _readings(read) -> DataFrame:
    """document_id, page_no, engine, text: pages of documents, of passages and of quoted evidence."""
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"]).drop("doc_id")
    pages = P.explode_pages(docs).select("document_id", "page_no", F.lit("page").alias("engine"), F.col("page").alias("text"))

    def joined(rows: DataFrame, ident: str, text: str, engine: str) -> DataFrame:  # what belongs to one page of one document
        g = rows.where(f"{text} is not null and page_no is not null").groupBy("document_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(ident, text))).alias("a"))
        return g.select("document_id", "page_no", F.lit(engine).alias("engine"), F.array_join(F.transform("a", lambda x: x[text]), "\n").alias("text"))

    pas = read("passages").select("passage_id", "document_id", F.col("page_start").cast("long").alias("page_no"), "text").dropDuplicates(["passage_id"])
    att = read("attempts").select("attempt_id", "document_id", T.first_page(F.col("page")).cast("long").alias("page_no"), "evidence").dropDuplicates(["attempt_id"])
    return pages.unionByName(joined(pas, "passage_id", "text", "passages")).unionByName(joined(att, "attempt_id", "evidence", "evidence"))


@query(f"""
    WITH {_GATED} SELECT document_id, page_no, engine, n_chars, array_to_string(list_filter([CASE WHEN repeats THEN 'repeats' END, CASE WHEN long THEN 'long' END, CASE WHEN invented THEN 'invented' END], lambda x: x IS NOT NULL), ';') AS reasons FROM gt WHERE repeats OR long OR invented
""")
def degenerate_pages(read) -> DataFrame:
    """Pages of every engine that look generated, with the reasons."""
    rows = D.gated(_readings(read), ["document_id"]).where(F.size("reasons") > 0)
    return rows.select("document_id", "page_no", "engine", "n_chars", F.array_join("reasons", ";").alias("reasons"))


_REFUSED = """nn AS (SELECT document_id, engine, max(page_no) AS n, sum((repeats OR long OR invented)::INT) AS bad, sum((n_chars > 0)::INT) AS full FROM gt GROUP BY ALL),
    mo AS (SELECT document_id, max(n) AS most FROM nn GROUP BY ALL), rf AS (SELECT document_id, engine, CASE WHEN most > 1 AND n < 0.5 * most THEN 'pages' ELSE 'degenerate' END AS why FROM nn JOIN mo USING (document_id) WHERE (most > 1 AND n < 0.5 * most) OR bad > 0.5 * greatest(1, "full"))"""


@query(f"WITH {_GATED}, {_REFUSED.replace(' AS full FROM', ' AS \"full\" FROM')} SELECT engine, why, count(*) AS n FROM rf GROUP BY ALL")
def refused_engines(read) -> DataFrame:
    """For how many documents each engine is refused, and why."""
    return D.refused(D.gated(_readings(read), ["document_id"]), ["document_id"]).groupBy("engine", "why").agg(F.count(F.lit(1)).alias("n"))


_RANK = lambda order: "CASE engine " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(order)) + " END"


@query(f"""
    WITH {_GATED}, {_REFUSED.replace(' AS full FROM', ' AS \"full\" FROM')}, ok AS (SELECT gt.* FROM gt ANTI JOIN rf ON gt.document_id = rf.document_id AND gt.engine = rf.engine),
    th AS (SELECT *, NOT (repeats OR long OR invented) AS clean, n_chars > 0 AND NOT invented AS there, {_FIG("coalesce(text, '')")} AS fig FROM ok),
    pl AS (SELECT *, there AND (clean OR NOT bool_or(there AND clean) OVER (PARTITION BY document_id, page_no)) AS pool FROM th),
    pp AS (SELECT document_id, page_no, count(*) FILTER (WHERE pool) AS n, arg_min(engine, {_RANK(FIGURES)}) FILTER (WHERE pool) AS fe, arg_min(fig, {_RANK(FIGURES)}) FILTER (WHERE pool) AS ff, arg_min(engine, {_RANK(PROSE)}) FILTER (WHERE pool) AS pe, arg_min(fig, {_RANK(PROSE)}) FILTER (WHERE pool) AS pf,
      coalesce(string_agg(engine, ';' ORDER BY engine) FILTER (WHERE there AND NOT pool), '') AS dropped FROM pl GROUP BY ALL),
    sc AS (SELECT *, CASE WHEN n > 1 THEN CASE WHEN len(list_distinct(list_concat(ff, pf))) = 0 THEN 1.0 ELSE round(len(list_intersect(ff, pf)) / len(list_distinct(list_concat(ff, pf))), 3) END END AS agreement FROM pp)
    SELECT document_id, page_no, CASE WHEN agreement < 0.75 THEN fe ELSE coalesce(pe, '') END AS engine, agreement, coalesce(agreement < 0.75, false)::INT AS disputed, dropped FROM sc
""")
def engine_arbitration(read) -> DataFrame:
    """One reading for each page out of three, refused engines aside."""
    rows = D.gated(_readings(read), ["document_id"])
    kept = rows.join(D.refused(rows, ["document_id"]), ["document_id", "engine"], "left_anti")
    return D.arbitrate_many(kept, ["document_id"], FIGURES, PROSE)


@query(rf"""
    WITH {_GATED}, a AS (SELECT * FROM rd WHERE engine = 'page'), b AS (SELECT * FROM rd WHERE engine = 'passages'), j AS (SELECT document_id, page_no, {_FIG("a.text")} AS x, {_FIG("b.text")} AS y FROM a JOIN b USING (document_id, page_no))
    SELECT document_id, page_no, len(list_intersect(x, y)) AS shared, len(list_filter(x, lambda v: NOT list_contains(y, v))) AS only_page, len(list_filter(y, lambda v: NOT list_contains(x, v))) AS only_passages, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 3) AS agreement FROM j WHERE len(x) + len(y) > 0
""")
def figure_disagreement(read) -> DataFrame:
    """For the pages that two engines both have, the figures that they share and that only one of them reads."""
    rows = _readings(read)
    side = lambda e, n: rows.where(F.col("engine") == e).select("document_id", "page_no", T.figures(F.coalesce("text", F.lit(""))).alias(n))
    both = side("page", "x").join(side("passages", "y"), ["document_id", "page_no"]).where(F.size("x") + F.size("y") > 0)
    n = lambda c: F.size(c).cast("long")
    return both.select("document_id", "page_no", n(F.array_intersect("x", "y")).alias("shared"), n(F.array_except("x", "y")).alias("only_page"), n(F.array_except("y", "x")).alias("only_passages"), F.round(D.agreement(F.col("x"), F.col("y")), 3).alias("agreement"))
