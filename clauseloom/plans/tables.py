"""Queries on step tables, readings, clauses and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clauseloom.functions import text as T
from clauseloom.operators import pages as P, readings as D, repair as X, tables as G
from clauseloom.plans import SQL_ATTEMPTS, SQL_LATEST, SQL_PASSAGES, query, sql_squeeze

_ROW = G.ROW
_CELLS = rf"""ln AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(replace(text, chr(12), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
    rw AS (SELECT doc_id, pos, regexp_extract(line, '{_ROW}', 1) AS kind, regexp_extract(line, '{_ROW}', 2)::BIGINT AS step, regexp_extract_all(regexp_extract(line, '{_ROW}', 3), '\d{{1,3}},\d{{3}}') AS v FROM ln WHERE regexp_matches(line, '{_ROW}')),
    cells AS (SELECT doc_id, kind, step, pos, generate_subscripts(v, 1) AS lane, replace(unnest(v), ',', '')::BIGINT AS value FROM rw)"""


def _cells(read) -> DataFrame:
    return G.cells(read("documents").where("text is not null").select("doc_id", "text"), "doc_id")


@query(f"WITH {_CELLS} SELECT doc_id, kind, count(*) AS n_cells, count(DISTINCT pos) AS n_rows, count(DISTINCT step) AS n_steps, max(lane) AS n_lanes, sum(value)::BIGINT AS total FROM cells GROUP BY ALL")
def grid_cells(read) -> DataFrame:
    c = _cells(read).groupBy("doc_id", "kind")
    return c.agg(F.count(F.lit(1)).alias("n_cells"), F.countDistinct("at").alias("n_rows"), F.countDistinct("step").alias("n_steps"), F.max("lane").alias("n_lanes"), F.sum("value").alias("total"))


@query(f"""
    WITH {_CELLS}, l AS (SELECT doc_id, kind, step, lane, max_by(value, pos) AS value FROM cells GROUP BY ALL)
    SELECT doc_id, kind, step, {", ".join(f"max(CASE WHEN lane = {i} THEN value END) AS lane_{i}" for i in range(1, 6))} FROM l GROUP BY doc_id, kind, step
""")
def grid_pivot(read) -> DataFrame:
    """All lanes that a table has: five columns, more where a row is wider."""
    c = _cells(read)
    return G.grid(c, ["doc_id", "kind"], max(5, c.agg(F.max("lane")).first()[0] or 0))


@query(f"""
    WITH {_CELLS}, s AS (SELECT doc_id, kind, list_sort(list(DISTINCT step)) AS s FROM cells GROUP BY ALL), g AS (SELECT *, list_filter(range(s[1], s[-1] + 1), lambda x: NOT list_contains(s, x)) AS gone FROM s)
    SELECT doc_id, kind, len(s) AS n_steps, CASE WHEN len(s) >= 4 AND len(gone) <= greatest(2.0, (s[-1] - s[1]) / 4) THEN gone ELSE [] END AS missing FROM g
""")
def gap_detect(read) -> DataFrame:
    steps = _cells(read).groupBy("doc_id", "kind").agg(F.array_sort(F.collect_set("step")).alias("s"))
    return steps.select("doc_id", "kind", F.size("s").cast("long").alias("n_steps"), F.array_sort(G.missing_steps(F.col("s"))).alias("missing"))


@query(f"WITH {_CELLS} SELECT doc_id, kind, step, count(DISTINCT pos) AS n FROM cells GROUP BY ALL HAVING count(DISTINCT pos) > 1")
def duplicate_labels(read) -> DataFrame:
    return _cells(read).groupBy("doc_id", "kind", "step").agg(F.countDistinct("at").alias("n")).where("n > 1")


@query(f"""
    WITH {_CELLS}, l AS (SELECT doc_id, kind, lane, step, max_by(value, pos) AS value FROM cells GROUP BY ALL), d AS (SELECT *, value - lag(value) OVER (PARTITION BY doc_id, kind, lane ORDER BY step) AS d FROM l)
    SELECT doc_id, kind, lane, count(*) AS n, coalesce(count(*) >= 5 AND min(d) = max(d) AND min(d) <> 0, false) AS uniform FROM d GROUP BY ALL
""")
def uniform_progression(read) -> DataFrame:
    return G.progressions(_cells(read), ["doc_id", "kind"])


@query(f"""
    WITH {_CELLS}, r AS (SELECT doc_id, kind, pos, list(value ORDER BY lane) AS v FROM cells GROUP BY ALL), g AS (SELECT doc_id, kind, v, count(*) AS n FROM r GROUP BY ALL)
    SELECT doc_id, kind, sum(n)::BIGINT AS n_rows, max(n) AS most, sum(n) > 2 AND max(n) > 0.7 * sum(n) AS collapsed FROM g GROUP BY doc_id, kind
""")
def row_collapse(read) -> DataFrame:
    """Tables most of whose rows are the same."""
    rows = _cells(read).groupBy("doc_id", "kind", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("lane", "value"))), lambda x: x["value"]).alias("v"))
    same = rows.groupBy("doc_id", "kind", "v").agg(F.count(F.lit(1)).alias("n"))
    return same.groupBy("doc_id", "kind").agg(F.sum("n").alias("n_rows"), F.max("n").alias("most"), ((F.sum("n") > 2) & (F.max("n") > 0.7 * F.sum("n"))).alias("collapsed"))


@query(f"""
    WITH {_CELLS}, fa AS (SELECT doc_id, kind, count(*) AS n_cells, count(DISTINCT step) AS n_steps, count(DISTINCT lane) AS n_lanes, list_sort(list(DISTINCT step)) AS s, max(value) AS top FROM cells GROUP BY ALL),
    la AS (SELECT doc_id, kind, max(n) AS twice FROM (SELECT doc_id, kind, step, count(DISTINCT pos) AS n FROM cells GROUP BY ALL) GROUP BY ALL),
    l AS (SELECT doc_id, kind, step, lane, max_by(value, pos) AS value FROM cells GROUP BY ALL),
    ro AS (SELECT doc_id, kind, sum(n) AS n_rows, max(n) AS same FROM (SELECT doc_id, kind, v, count(*) AS n FROM (SELECT doc_id, kind, step, list({{'l': lane, 'v': value}} ORDER BY lane) AS v FROM l GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
    co AS (SELECT doc_id, kind, max(d > 1) AS copied, min(d > 1) AS varying FROM (SELECT doc_id, kind, v, count(*) AS n, max(d) AS d FROM (SELECT doc_id, kind, lane, list({{'s': step, 'v': value}} ORDER BY step) AS v, count(DISTINCT value) AS d FROM l GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL),
    g AS (SELECT *, list_filter(range(s[1], s[-1] + 1), lambda x: NOT list_contains(s, x)) AS gone FROM fa),
    w AS (SELECT doc_id, kind, n_steps, n_lanes, n_cells, list_sort(list_filter([CASE WHEN twice > 1 THEN 'duplicate_labels' END, CASE WHEN len(s) >= 4 AND len(gone) > 0 AND len(gone) <= greatest(2.0, (s[-1] - s[1]) / 4) THEN 'dropped_rows' END, CASE WHEN n_rows > 2 AND same > 0.7 * n_rows THEN 'rows_collapsed' END,
      CASE WHEN copied THEN 'lanes_copied' END, CASE WHEN NOT varying THEN 'lanes_constant' END, CASE WHEN n_cells < 0.5 * n_steps * n_lanes THEN 'cells_missing' END, CASE WHEN n_lanes = 1 AND n_steps >= 3 THEN 'single_lane' END, CASE WHEN top > {G.IMPLAUSIBLE} THEN 'implausible' END], lambda x: x IS NOT NULL)) AS warnings
      FROM g JOIN la USING (doc_id, kind) JOIN ro USING (doc_id, kind) LEFT JOIN co USING (doc_id, kind))
    SELECT doc_id, kind, n_steps, n_lanes, n_cells, array_to_string(warnings, ';') AS warnings, list_has_any(warnings, ['lanes_copied', 'cells_missing']) AS escalates FROM w
""")
def table_warnings(read) -> DataFrame:
    """All that says of a step table that it was not read as it stands."""
    return G.warnings(_cells(read), ["doc_id", "kind"]).withColumn("warnings", F.array_join("warnings", ";"))


@query(f"""
    WITH {_CELLS}, c AS (SELECT doc_id, value, count(*) FILTER (WHERE kind = 'Step') AS a, count(*) FILTER (WHERE kind = 'Year') AS b FROM cells GROUP BY ALL)
    SELECT doc_id, round(sum(least(a, b)) / greatest(sum(a), sum(b)), 6) AS overlap, sum(least(a, b)) >= 0.95 * greatest(sum(a), sum(b)) AND sum(a) >= 6 AND sum(b) >= 6 AS duplicate FROM c GROUP BY doc_id HAVING sum(a) > 0 AND sum(b) > 0
""")
def grid_overlap(read) -> DataFrame:
    """How far the step table and the year table of a document hold the same values, and whether one is the other once more:
    95 % of six values and more."""
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    counts = _cells(read).groupBy("doc_id", "value").agg(n("Step").alias("a"), n("Year").alias("b"))
    return G.multiset_overlap(counts, ["doc_id"], F.col("a"), F.col("b"), "value").select("doc_id", F.round("overlap", 6).alias("overlap"), ((F.col("overlap") >= 0.95) & (F.col("least") >= 6)).alias("duplicate"))


@query("""
    WITH s AS (SELECT l_orderkey, count(*) AS n_values, CASE WHEN count(*) < 4 THEN '#' || l_orderkey ELSE md5(array_to_string(list_sort(list(l_partkey)), ',')) END AS s FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, n_values, min(l_orderkey) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS members FROM s
""")
def multiset_classes(read) -> DataFrame:
    """Orders with the same multiset of parts: one row an order with its class."""
    return G.multiset_classes(read("lineitem"), "l_orderkey", "l_partkey")


@query("""
    WITH s AS (SELECT l_orderkey, l_returnflag, list_sort(list(DISTINCT l_suppkey)) AS v, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT len(v) AS n_values, count(*) AS n_columns, sum(n)::BIGINT AS n_rows FROM s GROUP BY v
""")
def identical_columns(read) -> DataFrame:
    """Columns (an order's lines of one return flag) that hold the same distinct suppliers: a row for each set of suppliers;
    identical_column_classes says which columns they are."""
    once = read("lineitem").groupBy("l_orderkey", "l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    cols = once.groupBy("l_orderkey", "l_returnflag").agg(G.signature(F.col("l_suppkey")).alias("s"), F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n"))
    same = cols.groupBy("s", "n_values").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n_rows"))
    return same.select("n_values", "n_columns", "n_rows")


@query("""
    WITH s AS (SELECT l_orderkey, l_returnflag, list_sort(list(DISTINCT l_suppkey)) AS v, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, l_returnflag, len(v) AS n_values, n AS n_rows, min(l_orderkey || '/' || l_returnflag) OVER (PARTITION BY v) AS class_id, count(*) OVER (PARTITION BY v) AS members FROM s
""")
def identical_column_classes(read) -> DataFrame:
    """The columns of identical_columns, each with its class (the member whose text order/flag sorts first) and how many it has."""
    once = read("lineitem").groupBy("l_orderkey", "l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    cols = once.groupBy("l_orderkey", "l_returnflag").agg(G.signature(F.col("l_suppkey")).alias("s"), F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_rows"))
    same = cols.groupBy("s").agg(F.min(F.concat_ws("/", F.col("l_orderkey").cast("string"), "l_returnflag")).alias("class_id"), F.count(F.lit(1)).alias("members"))
    return cols.join(same, "s").select("l_orderkey", "l_returnflag", "n_values", "n_rows", "class_id", "members")


# --- readings -----------------------------------------------------------------------------------------------------------

_FIG = lambda c: rf"list_distinct(list_transform(regexp_extract_all({c}, '\d[\d,]*\.?\d*'), lambda x: regexp_replace(replace(x, ',', ''), '\.$', '')))"


@query(f"""
    WITH {SQL_LATEST}, {SQL_PASSAGES}, a AS (SELECT document_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM latest WHERE text IS NOT NULL),
    b AS (SELECT document_id, page_start AS page_no, string_agg(text, chr(10) ORDER BY passage_id) AS passages FROM pas WHERE text IS NOT NULL AND page_start IS NOT NULL GROUP BY ALL),
    j AS (SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.page_no, b.page_no) AS page_no, coalesce(page, '') AS page, coalesce(passages, '') AS passages FROM a FULL JOIN b ON a.document_id = b.document_id AND a.page_no = b.page_no),
    s AS (SELECT *, length(trim(page)) > 0 AS x, length(trim(passages)) > 0 AS y, {_FIG("page")} AS fa, {_FIG("passages")} AS fb FROM j),
    t AS (SELECT *, CASE WHEN len(list_distinct(list_concat(fa, fb))) = 0 THEN 1.0 ELSE round(len(list_intersect(fa, fb)) / len(list_distinct(list_concat(fa, fb))), 3) END AS sc FROM s)
    SELECT document_id, page_no, CASE WHEN x AND y THEN CASE WHEN sc >= 0.75 THEN 'passages' ELSE 'page' END WHEN x THEN 'page' WHEN y THEN 'passages' ELSE '' END AS engine, CASE WHEN x AND y THEN sc END AS agreement, (x AND y AND sc < 0.75)::INT AS disputed FROM t
""")
def jaccard_arbitration(read) -> DataFrame:
    """Two readings of each page, the document's and the passages', brought to one by the agreement of their figures."""
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"]).drop("doc_id")
    a = P.explode_pages(docs)
    pas = read("passages").where("text is not null and page_start is not null").select("passage_id", "document_id", F.col("page_start").cast("long").alias("page_no"), "text").dropDuplicates(["passage_id"])
    # the passages of one page of one document: no more than a page holds
    b = pas.groupBy("document_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_id", "text"))), lambda x: x["text"]), "\n").alias("passages"))
    return D.arbitrate(a.join(b, ["document_id", "page_no"], "full"), ["document_id", "page_no"], "page", "passages")


@query(r"""
    WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM documents WHERE text IS NOT NULL),
    l AS (SELECT *, list_filter(list_transform(string_split(page, chr(10)), lambda x: trim(x)), lambda x: length(x) > 3) AS lines FROM p WHERE length(trim(page)) > 0)
    SELECT doc_id, page_no, CASE WHEN len(lines) = 0 THEN 1.0 ELSE round(len(list_distinct(lines)) / len(lines), 6) END AS distinct_lines, CASE WHEN len(lines) = 0 THEN false ELSE len(list_distinct(lines)) / len(lines) < 0.6 END AS repeats,
      regexp_matches(page, '!\[[^\]]*\]\(https?://|\bimgur\b|\bexample\.com\b') AS invented FROM l
""")
def page_gate(read) -> DataFrame:
    """Pages that look generated: repeated lines, references no scan has."""
    p = P.explode_pages(read("documents").select("doc_id", "text")).where(F.length(F.trim("page")) > 0)
    share = D.distinct_lines(F.col("page"))
    return p.select("doc_id", "page_no", F.round(share, 6).alias("distinct_lines"), (share < D.DISTINCT).alias("repeats"), D.invented(F.col("page")).alias("invented"))


@query()
def page_compression(read) -> DataFrame:
    """How far each page deflates; far means a repetition loop."""
    p = P.explode_pages(read("documents").select("doc_id", "text"))
    return D.compression(p, ["doc_id", "page_no"], "page").select("doc_id", "page_no", F.round("ratio", 6).alias("ratio"), "loop")


def _alternatives(read) -> DataFrame:
    rows = read("attempts").select("attempt_id", "evidence", "alt_evidence").dropDuplicates(["attempt_id"])
    return rows.where("evidence is not null and length(evidence) > 0 and length(trim(alt_evidence)) > 0")


@query()
def edit_distance(read) -> DataFrame:
    """Character error rate of the evidence against the alternative one; no SQL, for DuckDB's levenshtein counts bytes."""
    return _alternatives(read).select("attempt_id", F.round(D.error_rate(F.col("evidence"), F.col("alt_evidence")), 6).alias("cer"))


@query()
def word_error_rate(read) -> DataFrame:
    """Word error rate of the evidence against the alternative one."""
    return D.word_errors(_alternatives(read), "attempt_id", "evidence", "alt_evidence")


# --- clauses --------------------------------------------------------------------------------------------------------------

_CITE = r"(?:Article [IVXLC]+|Section \d+[–-]\d+|§ \d+\.\d+|Sec\. \d+)"


@query(rf"""
    WITH c AS (SELECT doc_id, regexp_extract_all(text, '{_CITE}') AS all_c FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(all_c) AS n, list_transform(list_filter(list_zip(all_c, range(len(all_c))), lambda z: list_position(all_c, z[1]) = z[2] + 1), lambda z: z[1])[1:12] AS first_citations FROM c WHERE len(all_c) > 0
""")
def law_citations(read) -> DataFrame:
    """References to articles and sections: how many, and the first twelve different ones."""
    c = F.regexp_extract_all("text", F.lit(_CITE), F.lit(0))
    rows = read("documents").where("text is not null").select("doc_id", c.alias("c")).where(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.slice(F.array_distinct("c"), 1, 12).alias("first_citations"))


@query()
def keyword_windows(read) -> DataFrame:
    """Places of dollar signs in a document, each more than 400 characters after the last one taken, the first three."""
    pieces = F.transform(F.split("text", r"\$"), lambda x: F.length(x))
    rows = read("documents").where("length(text) > 0").select("doc_id", F.slice(pieces, 1, F.size(pieces) - 1).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("kept"))

    def step(acc, n):
        at = acc["at"] + n + 1  # where the sign stands
        takes = (F.size(acc["kept"]) < 3) & ((F.size(acc["kept"]) == 0) | (at - F.coalesce(F.array_max(acc["kept"]), F.lit(0)) > 400))
        return F.struct(at.alias("at"), F.when(takes, F.concat(acc["kept"], F.array(at))).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate("p", start, step)["kept"]
    return rows.select("doc_id", kept.alias("places")).where(F.size("places") > 0)


@query()
def quote_repair(read) -> DataFrame:
    """Quotations that no passage of their document holds as they are, with the stretch of a passage that they come from: of
    the passage that shares the longest piece with them, of several the first."""
    quotes = read("attempts").where(F.length("evidence") >= X.ANCHOR).select("attempt_id", "document_id", F.col("evidence").alias("quote"))
    pas = read("passages").where("text is not null").select("passage_id", "document_id", F.col("text").alias("page"))
    rows = X.candidates(quotes, pas, "attempt_id", "passage_id", "document_id")
    best = X.repair(rows.withColumn("pair", F.struct("attempt_id", "passage_id")).select(F.to_json("pair").alias("pair"), "quote", "page"), "pair")
    ids = F.from_json("pair", "attempt_id long, passage_id long")
    return best.select(ids["attempt_id"].alias("attempt_id"), ids["passage_id"].alias("passage_id"), "size", "repaired").groupBy("attempt_id").agg(
        F.max_by(F.struct("passage_id", "repaired"), F.struct("size", -F.col("passage_id"))).alias("r")
    ).select("attempt_id", "r.passage_id", "r.repaired").where("repaired <> ''")


# --- star schema ----------------------------------------------------------------------------------------------------------


@query("SELECT r_regionkey AS key, r_name AS name, 'region' AS source FROM region UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation")
def union_positional(read) -> DataFrame:
    from clauseloom.sources.files import union_by_position

    a = read("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("source"))
    b = read("nation").select("n_nationkey", "n_name", F.lit("nation").alias("source"))
    return union_by_position(a, b)


@query("""
    SELECT n_name, o_orderpriority, count(*) AS n_orders, round(sum((l_extendedprice * (1 - l_discount))::DECIMAL(20, 4))::DOUBLE, 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
""")
def revenue_by_nation(read) -> DataFrame:
    """A star join with an aggregate: the dimensions are broadcast by their size, the facts shuffled on the order."""
    rows = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(20,4)")).cast("double"), 2).alias("revenue"))


@query("""
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*) AS n_events, round(sum(value), 4) AS value FROM s GROUP BY ALL
""")
def event_sessions(read) -> DataFrame:
    """Events of a user in sessions that a pause of 30 minutes ends (beyond the reference)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes"))
    rows = read("events").withColumn("new", gap.cast("long")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("value"))
