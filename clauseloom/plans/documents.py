"""Queries on documents: pages, status, identifiers, normal forms, sections, chunks, passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clauseloom.functions import text as T
from clauseloom.operators import pages as P
from clauseloom.plans import SQL_ATTEMPTS, SQL_LATEST, SQL_PASSAGES, SQL_WS, query, sql_squeeze


@query("""
    WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, page_no, length(page) AS n_chars, len(string_split(page, chr(10))) AS n_lines FROM p
""")
def page_explode(read) -> DataFrame:
    rows = P.explode_pages(read("documents").select("doc_id", "text"))
    return rows.select("doc_id", "page_no", F.length("page").cast("long").alias("n_chars"), F.size(F.split("page", "\n")).cast("long").alias("n_lines"))


@query(f"""
    WITH d AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '{SQL_WS}+', '', 'g')) AS dense, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(12))) END AS n_pages FROM documents)
    SELECT doc_id, dense, n_pages,
      CASE WHEN n_pages > 0 AND dense < greatest(1000, n_pages * 20) THEN 'ocr_needed' WHEN dense < 1000 THEN 'partial_or_ocr_needed' ELSE 'usable' END AS status,
      CASE WHEN n_pages <= 10 THEN 'short' WHEN n_pages <= 100 THEN 'medium' ELSE 'long' END AS bucket FROM d
""")
def text_status(read) -> DataFrame:
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(T.pages(F.col("text")))).cast("long")
    rows = read("documents").select("doc_id", T.dense_length(F.coalesce("text", F.lit(""))).alias("dense"), n.alias("n_pages"))
    return rows.select("*", P.text_status(F.col("dense"), F.col("n_pages")).alias("status"), P.size_bucket(F.col("n_pages")).alias("bucket"))


@query("""
    SELECT text_status AS status, coalesce(source, '') AS source, count(*) AS n, count(text) AS n_text FROM documents GROUP BY GROUPING SETS ((text_status, coalesce(source, '')), (text_status))
""")
def status_counts(read) -> DataFrame:
    rows = read("documents").select(F.col("text_status").alias("status"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counted = rows.groupingSets([[F.col("status"), F.col("source")], [F.col("status")]], F.col("status"), F.col("source"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"))


_SLUG = "regexp_replace(substr(lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, {1}), '^_+|_+$', '', 'g')"


@query(f"""
    SELECT doc_id, concat_ws('__', {_SLUG.format("district", 45)}, {_SLUG.format("regexp_replace(file_name, '[.]pdf$', '')", 55)}, substr(sha1(path), 1, 8)) AS made_id,
      concat_ws('__', {_SLUG.format("district", 45)}, {_SLUG.format("regexp_replace(file_name, '[.]pdf$', '')", 55)}, substr(sha1(path), 1, 8)) = document_id AS agrees
    FROM documents WHERE district IS NOT NULL AND file_name IS NOT NULL AND path IS NOT NULL
""")
def doc_id_hash(read) -> DataFrame:
    rows = read("documents").where("district is not null and file_name is not null and path is not null")
    made = T.surrogate_id(F.col("district"), F.regexp_replace("file_name", "[.]pdf$", ""), F.col("path"))
    return rows.select("doc_id", made.alias("made_id"), (made == F.col("document_id")).alias("agrees"))


@query(f"""
    WITH {SQL_ATTEMPTS}
    SELECT attempt_id, trim(regexp_replace(lower(evidence), '[^a-z0-9]+', ' ', 'g')) AS words,
      {sql_squeeze("lower(translate(evidence, '’‘“”–—', '''''\"\"--'))")} AS quotes, {sql_squeeze("lower(translate(evidence, '’“”', '''\"\"'))")} AS scored
    FROM att WHERE evidence IS NOT NULL
""")
def evidence_norms(read) -> DataFrame:
    rows = read("attempts").where("evidence is not null").select("attempt_id", "evidence").dropDuplicates(["attempt_id"])
    e = F.col("evidence")
    return rows.select("attempt_id", T.norm_words(e).alias("words"), T.norm_quotes(e).alias("quotes"), T.norm_score(e).alias("scored"))


@query("""
    WITH hay AS (SELECT doc_id, file_name, regexp_replace(lower(coalesce(file_name, '') || chr(10) || substr(coalesce(text, ''), 1, 5000)), '[_-]+', ' ', 'g') AS h, lower(substr(coalesce(text, ''), 1, 20000)) AS u FROM documents),
    t AS (SELECT doc_id, u, CASE WHEN contains(h, 'employee handbook') OR contains(h, 'personnel handbook') OR contains(h, 'teacher handbook') THEN 'employee handbook'
      WHEN contains(h, 'policy manual') OR contains(h, 'board policies') OR contains(h, 'selected policies') THEN 'board policy'
      WHEN contains(h, 'benefits guide') OR contains(h, 'benefit guide') THEN 'benefits guide'
      WHEN contains(h, 'salary schedule') AND NOT regexp_matches(h, 'collective bargaining|agreement|contract') THEN 'salary schedule'
      WHEN contains(h, 'policy statement') THEN 'policy statement'
      WHEN contains(regexp_replace(lower(coalesce(file_name, '')), '[_-]+', ' ', 'g'), 'tentative agreement') OR regexp_matches(coalesce(file_name, ''), '\\bTA\\b') THEN 'other'
      WHEN contains(h, 'agreement') OR contains(h, 'contract') THEN 'collective bargaining agreement' ELSE 'other' END AS doc_type FROM hay)
    SELECT doc_id, doc_type, CASE WHEN contains(u, 'all employees') AND doc_type = 'employee handbook' THEN 'all employees' WHEN contains(u, 'instructional employees') THEN 'teachers'
      WHEN contains(u, 'certificated') OR contains(u, 'certified') THEN 'certified staff' WHEN contains(u, 'teacher') THEN 'teachers' WHEN doc_type = 'employee handbook' THEN 'all employees' ELSE 'unclear' END AS unit FROM t
""")
def doc_type_rules(read) -> DataFrame:
    name, text = F.coalesce("file_name", F.lit("")), F.coalesce("text", F.lit(""))
    hay = F.regexp_replace(F.lower(F.concat(name, F.lit("\n"), F.substring(text, 1, 5000))), "[_-]+", " ")
    rows = read("documents").select("doc_id", hay.alias("h"), F.lower(F.substring(text, 1, 20000)).alias("u"), F.regexp_replace(F.lower(name), "[_-]+", " ").alias("f"), name.alias("n"))
    has = lambda c, *words: F.expr(" or ".join(f"contains({c}, '{w}')" for w in words))
    doc_type = (
        F.when(has("h", "employee handbook", "personnel handbook", "teacher handbook"), "employee handbook")
        .when(has("h", "policy manual", "board policies", "selected policies"), "board policy")
        .when(has("h", "benefits guide", "benefit guide"), "benefits guide")
        .when(has("h", "salary schedule") & ~has("h", "collective bargaining", "agreement", "contract"), "salary schedule")
        .when(has("h", "policy statement"), "policy statement")
        .when(has("f", "tentative agreement") | F.col("n").rlike(r"\bTA\b"), "other")
        .when(has("h", "agreement", "contract"), "collective bargaining agreement")
        .otherwise("other")
    )
    handbook = F.col("doc_type") == "employee handbook"
    unit = (
        F.when(has("u", "all employees") & handbook, "all employees").when(has("u", "instructional employees"), "teachers").when(has("u", "certificated", "certified"), "certified staff")
        .when(has("u", "teacher"), "teachers").when(handbook, "all employees").otherwise("unclear")
    )
    return rows.withColumn("doc_type", doc_type).select("doc_id", "doc_type", unit.alias("unit"))


@query(r"""
    WITH y AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(coalesce(text, ''), '\b(20\d{2}|19\d{2})\s*[-–]\s*(?:20\d{2}|19\d{2})\b', 1), [])) AS a,
      unnest(regexp_extract_all(coalesce(text, ''), '\b(?:20\d{2}|19\d{2})\s*[-–]\s*(20\d{2}|19\d{2})\b', 1)) AS b FROM documents),
    f AS (SELECT doc_id, try_cast(nullif(regexp_extract(file_name, '(20\d{2}|19\d{2})', 1), '') AS INTEGER) AS file_year FROM documents),
    s AS (SELECT doc_id, min(a::INTEGER) AS first_year, max(b::INTEGER) AS last_year, count(*) AS n_spans FROM y WHERE b::INTEGER >= a::INTEGER GROUP BY doc_id)
    SELECT f.doc_id, file_year, first_year, last_year, coalesce(n_spans, 0) AS n_spans FROM f LEFT JOIN s ON f.doc_id = s.doc_id
""")
def year_spans(read) -> DataFrame:
    pattern = r"\b(20\d{2}|19\d{2})\s*[-–]\s*(20\d{2}|19\d{2})\b"
    side = lambda i: F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(i)), lambda x: x.cast("int"))
    spans = F.filter(F.arrays_zip(side(1).alias("a"), side(2).alias("b")), lambda s: s["b"] >= s["a"])
    rows = read("documents").select("doc_id", F.nullif(F.regexp_extract("file_name", r"(20\d{2}|19\d{2})", 1), F.lit("")).try_cast("int").alias("file_year"), spans.alias("s"))
    return rows.select("doc_id", "file_year", F.array_min("s.a").alias("first_year"), F.array_max("s.b").alias("last_year"), F.size("s").cast("long").alias("n_spans"))


@query(f"""
    WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, page_no, unnest(string_split(page, chr(10))) AS line, generate_subscripts(string_split(page, chr(10)), 1) - 1 AS line_no FROM p),
    h AS (SELECT doc_id, page_no, line_no, line, {sql_squeeze("line")} AS s FROM l WHERE length(trim(line)) > 0),
    k AS (SELECT *, length(s) > 0 AND length(s) <= 160 AND (regexp_matches(upper(s), '^(ARTICLE|APPENDIX|SECTION)\\b') OR (length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) >= 5
      AND length(regexp_replace(s, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) >= 0.8)) AS head FROM h),
    f AS (SELECT doc_id, page_no, line_no, head, coalesce(last_value(CASE WHEN head THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no, line_no ROWS UNBOUNDED PRECEDING), 'DOCUMENT PREAMBLE') AS heading, length(line) AS n FROM k)
    SELECT doc_id, heading, min(page_no) AS first_page, max(page_no) AS last_page, count(*) AS n_lines, sum(n)::BIGINT AS n_chars FROM f WHERE NOT head GROUP BY doc_id, heading
""".replace("\\\\", "\\"))
def heading_fill(read) -> DataFrame:
    rows = P.lines_with_heading(read("documents").select("doc_id", "text"), "doc_id")
    return rows.groupBy("doc_id", "heading").agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )


@query("""
    WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
    c AS (SELECT doc_id, text, n, unnest(range(0, greatest(0, ceil((n - 3000) / 2600.0))::BIGINT + 1)) AS i FROM d)
    SELECT doc_id, i + 1 AS chunk_no, i * 2600 AS start, length(substr(text, i * 2600 + 1, 3000)) AS n_chars, md5(substr(text, i * 2600 + 1, 3000)) AS digest FROM c
""")
def fixed_chunks(read) -> DataFrame:
    rows = P.fixed_chunks(read("documents").select("doc_id", "text"), 3000, 400)
    return rows.select("doc_id", "chunk_no", "start", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


@query(rf"""
    WITH {SQL_PASSAGES}, s AS (SELECT passage_id, list_filter(string_split(regexp_replace(text, '([.;:!?]){SQL_WS}+', '\1' || chr(31), 'g'), chr(31)), lambda x: length(x) >= 25)[1:120] AS l FROM pas WHERE text IS NOT NULL)
    SELECT passage_id, generate_subscripts(l, 1) AS sid, length(unnest(l)) AS n_chars, md5(unnest(l)) AS digest FROM s
""")
def sentence_menu(read) -> DataFrame:
    rows = P.sentences(read("passages").where("text is not null").select("passage_id", "text").dropDuplicates(["passage_id"]), "text", most=120)
    return rows.select("passage_id", "sid", F.length("sentence").cast("long").alias("n_chars"), F.md5("sentence").alias("digest"))


@query()
def passage_pack(read) -> DataFrame:
    """Passages of every document, built from its text."""
    return P.build_passages(read("documents"), "doc_id")


@query()
def page_windows(read) -> DataFrame:
    return P.page_windows(read("documents"), "doc_id")


@query("""
    WITH b AS (SELECT doc_id, CASE WHEN coalesce(page_count, 0) <= 2 THEN 'few' WHEN page_count <= 5 THEN 'some' ELSE 'many' END AS bucket, (doc_id * 7919) % 1009 AS o FROM documents WHERE text_status = 'usable'),
    r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o, doc_id) AS rn FROM b)
    SELECT doc_id, bucket, rn FROM r ORDER BY rn, bucket LIMIT 60
""")
def stratified_sample(read) -> DataFrame:
    """60 usable documents taken from the size buckets in turn (a sampling operator; the order is fixed by the ids)."""
    bucket = F.when(F.coalesce("page_count", F.lit(0)) <= 2, "few").when(F.col("page_count") <= 5, "some").otherwise("many")
    rows = read("documents").where("text_status = 'usable'").select("doc_id", bucket.alias("bucket"), ((F.col("doc_id") * 7919) % 1009).alias("o"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("o", "doc_id")).cast("long")).where(F.col("rn") <= 60)
    return ranked.select("doc_id", "bucket", "rn").orderBy("rn", "bucket").limit(60)


@query("""
    WITH p AS (SELECT DISTINCT passage_id, text, text_sha256 FROM passages)
    SELECT CASE WHEN text IS NULL THEN 'text_missing' WHEN text_sha256 IS NULL THEN 'hash_missing' WHEN sha256(text) = text_sha256 THEN 'ok' ELSE 'mismatch' END AS status, count(*) AS n FROM p GROUP BY 1
""")
def verify_hashes(read) -> DataFrame:
    status = F.when(F.col("text").isNull(), "text_missing").when(F.col("text_sha256").isNull(), "hash_missing").when(F.sha2("text", 256) == F.col("text_sha256"), "ok").otherwise("mismatch")
    return read("passages").select("passage_id", "text", "text_sha256").distinct().groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|forty|fifty|sixty|ninety)\s*\(\s*\d+\s*\)')) AS m FROM documents WHERE text IS NOT NULL),
    d AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
    SELECT d0.doc_id, coalesce(n, 0) AS n_word_digits, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '\d[\d,]*\.?\d*'), lambda x: regexp_replace(replace(x, ',', ''), '\.$', '')))) AS n_figures,
      len(regexp_extract_all(coalesce(text, ''), '\$\s*[0-9]')) AS n_dollars
    FROM documents d0 LEFT JOIN d ON d0.doc_id = d.doc_id
""")
def numeric_profile(read) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|forty|fifty|sixty|ninety)\s*\(\s*\d+\s*\)"
    n = lambda c: F.size(c).cast("long")
    return read("documents").select(
        "doc_id", n(F.regexp_extract_all(text, F.lit(words), F.lit(0))).alias("n_word_digits"), n(T.figures(text)).alias("n_figures"), n(F.regexp_extract_all(text, F.lit(r"\$\s*[0-9]"), F.lit(0))).alias("n_dollars")
    )


@query(f"""
    WITH {SQL_LATEST}, p AS (SELECT document_id, unnest(string_split(text, chr(12))) AS page FROM latest WHERE text IS NOT NULL),
    l AS (SELECT document_id, length(page) AS n FROM p WHERE length(trim(page, ' ' || chr(9) || chr(10) || chr(13))) > 0),
    m AS (SELECT document_id, list_sort(list(n)) AS s, max(n) AS longest, count(*) AS n_pages FROM l GROUP BY document_id)
    SELECT document_id, n_pages, s[len(s) // 2 + 1] AS upper_median, longest > 2.5 * s[len(s) // 2 + 1] AS suspect FROM m
""")
def upper_median_pages(read) -> DataFrame:
    """The upper median of a document's page lengths, and whether a page is far longer. A document's pages are in its row."""
    rows = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"]).where("text is not null")
    n = F.array_sort(F.transform(F.filter(T.pages(F.col("text")), lambda p: F.length(F.btrim(p, F.lit(" \t\n\r"))) > 0), lambda p: F.length(p)))
    sized = rows.select("document_id", n.alias("s")).where(F.size("s") > 0)
    middle = F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1)
    return sized.select("document_id", F.size("s").cast("long").alias("n_pages"), middle.cast("long").alias("upper_median"), (F.array_max("s") > 2.5 * middle).alias("suspect"))


@query("""
    SELECT doc_id, concat_ws('; ', 'text_status=' || coalesce(text_status, ''), CASE WHEN page_count > 0 THEN 'pages=' || page_count END, CASE WHEN coalesce(text_status, '') <> 'usable' THEN 'full coding requires OCR or visual PDF review' END,
      CASE WHEN contains(lower(file_name), 'tentative') OR contains(lower(file_name), '_ta') THEN 'appears to be a tentative agreement or summary rather than a complete contract' END,
      CASE WHEN regexp_matches(lower(file_name), 'flyer|summary|highlights') THEN 'appears to be a short settlement summary' END) AS notes FROM documents
""")
def document_notes(read) -> DataFrame:
    """What is to be known of a document before it is coded, from its status, pages and file name; conditions that don't hold leave nothing."""
    status, low = F.coalesce("text_status", F.lit("")), F.lower("file_name")
    parts = [
        F.concat(F.lit("text_status="), status), F.when(F.col("page_count") > 0, F.concat(F.lit("pages="), F.col("page_count").cast("string"))), F.when(status != "usable", "full coding requires OCR or visual PDF review"),
        F.when(low.contains("tentative") | low.contains("_ta"), "appears to be a tentative agreement or summary rather than a complete contract"), F.when(low.rlike("flyer|summary|highlights"), "appears to be a short settlement summary"),
    ]
    return read("documents").select("doc_id", F.concat_ws("; ", *parts).alias("notes"))
