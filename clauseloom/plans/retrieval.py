"""Queries that rank passages and vectors, and that ground quotations in their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from clauseloom.functions import text as T
from clauseloom.operators import pages as P, retrieval as R
from clauseloom.operators.containment import stretch_pairs
from clauseloom.session import cut
from clauseloom.plans import SQL_ATTEMPTS, SQL_LATEST, SQL_PASSAGES, SQL_WS, query, sql_squeeze

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_BM25 = f"""
    {SQL_PASSAGES}, tok AS (SELECT passage_id, unnest(list_concat(list_transform(h, lambda x: {{'term': x, 'w': 2.0}}), list_transform(t, lambda x: {{'term': x, 'w': 1.0}}))) AS p, len(h) + len(t) AS size
      FROM (SELECT passage_id, regexp_extract_all(lower(coalesce(heading, '')), '[a-z0-9]+') AS h, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM pas)),
    post AS (SELECT passage_id, size, p.term AS term, sum(p.w) AS tf FROM tok GROUP BY ALL),
    facts AS (SELECT count(*) AS n, avg(size) AS mean FROM (SELECT DISTINCT passage_id, size FROM post)),
    asked AS (SELECT qid, unnest((list_distinct_in_order)[1:24]) AS term FROM (SELECT qid, list_transform(list_filter(list_zip(w, range(len(w))), lambda z: length(z[1]) >= 3 AND z[1] NOT IN ({_STOP}) AND list_position(w, z[1]) = z[2] + 1), lambda z: z[1]) AS list_distinct_in_order
      FROM (SELECT qid, regexp_extract_all(lower(concat_ws(' ', keywords, question)), '[a-z0-9]+') AS w FROM questions))),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    scored AS (SELECT qid, passage_id, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS rank
      FROM post JOIN asked USING (term) JOIN dfs USING (term) CROSS JOIN facts GROUP BY qid, passage_id)"""


def _scored(read) -> DataFrame:
    items = read("passages").select("passage_id", "heading", "text")
    queries = read("questions").select("qid", T.search_terms(F.concat_ws(" ", "keywords", "question")).alias("terms"))
    return R.bm25(items, "passage_id", "heading", "text", queries, "qid")


@query(f"""
    WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rank, 9), passage_id) AS position FROM scored)
    SELECT qid, passage_id, document_id, page_start, page_end, round(rank, 5) AS rank, position FROM r JOIN (SELECT DISTINCT passage_id, document_id, page_start, page_end FROM passages) USING (passage_id) WHERE position <= 10
""")
def bm25_topk(read) -> DataFrame:
    """The ten best passages of the whole collection for each question."""
    best = R.top_k(_scored(read), ["qid"], [F.round("rank", 9), F.col("passage_id")], 10)
    facts = read("passages").select("passage_id", "document_id", "page_start", "page_end").dropDuplicates(["passage_id"])
    return best.join(facts, "passage_id").select("qid", "passage_id", "document_id", "page_start", "page_end", F.round("rank", 5).alias("rank"), "position")


@query(f"""
    WITH {_BM25}, d AS (SELECT s.*, document_id FROM scored s JOIN (SELECT DISTINCT passage_id, document_id FROM passages) USING (passage_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id, qid ORDER BY round(rank, 9), passage_id) AS position FROM d)
    SELECT document_id, qid, passage_id, position FROM r WHERE position <= 3
""")
def bm25_document_topk(read) -> DataFrame:
    """The three best passages of each document for each question; statistics are those of the whole collection."""
    scoped = _scored(read).join(read("passages").select("passage_id", "document_id").dropDuplicates(["passage_id"]), "passage_id")
    return R.top_k(scoped, ["document_id", "qid"], [F.round("rank", 9), F.col("passage_id")], 3).select("document_id", "qid", "passage_id", "position")


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, round(list_dot_product(a::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS similarity FROM q, embeddings WHERE vec_id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS position FROM s)
    SELECT query_id, vec_id, round(similarity, 4) AS similarity, position FROM r WHERE position <= 10
""")
def cosine_topk(read) -> DataFrame:
    v = read("embeddings")
    best = R.cosine_top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 10)
    return best.select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"), "position")


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, round(list_dot_product(a::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS similarity FROM q, embeddings WHERE vec_id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS position FROM s)
    SELECT query_id, round(max(similarity), 4) AS max_similarity, round(avg(similarity), 4) AS mean_top5 FROM r WHERE position <= 5 GROUP BY query_id
""")
def support_max_mean5(read) -> DataFrame:
    """The highest similarity of each query to any other vector, and the mean of the five highest."""
    v = read("embeddings")
    best = R.cosine_top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5)
    return best.groupBy("query_id").agg(F.round(F.max("similarity"), 4).alias("max_similarity"), F.round(F.avg("similarity"), 4).alias("mean_top5"))


_KEYWORDS = "list_filter(list_transform(string_split(lower(keywords), ','), lambda x: trim(x)), lambda x: length(x) >= 3)"
_SUPPORT = f"""sup AS (SELECT qid, passage_id, len(list_filter({_KEYWORDS}, lambda k: contains(lower(coalesce(text, '')), k))) AS hits FROM pas, questions)"""


def _support(read) -> DataFrame:
    """qid, passage_id, hits: how many keywords of the question the passage holds. The codebook has a fixed size: it is an
    array in every row, not a join."""
    book = read("questions").select("qid", F.filter(F.transform(F.split(F.lower("keywords"), ","), lambda x: F.trim(x)), lambda x: F.length(x) >= 3).alias("words")).collect()
    qs = F.array(*[F.struct(F.lit(r["qid"]).alias("qid"), F.array(*[F.lit(w) for w in r["words"]]).cast("array<string>").alias("words")) for r in book])
    rows = read("passages").select("passage_id", "text").dropDuplicates(["passage_id"]).select("passage_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    scored = F.transform(qs, lambda q: F.struct(q["qid"].alias("qid"), R.support(q["words"], F.col("t")).alias("hits")))
    return rows.select("passage_id", F.explode(F.filter(scored, lambda s: s["hits"] > 0)).alias("s")).select("s.qid", "passage_id", "s.hits")


@query(f"""
    WITH {SQL_PASSAGES}, {_SUPPORT} SELECT qid, count(*) AS n_passages, sum(hits)::BIGINT AS hits, max(hits) AS most FROM sup WHERE hits > 0 GROUP BY qid
""")
def keyword_support(read) -> DataFrame:
    return _support(read).groupBy("qid").agg(F.count(F.lit(1)).alias("n_passages"), F.sum("hits").alias("hits"), F.max("hits").alias("most"))


# --- dense and hybrid retrieval -----------------------------------------------------------------------------------------

MODEL, DIMENSIONS = "clausevec-384-r2", 384
_VECTORS = f"""vec AS (SELECT passage_id, min(embedding)::DOUBLE[] AS e FROM passage_vectors WHERE model = '{MODEL}' AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY passage_id),
    unit AS (SELECT passage_id, document_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM vec JOIN (SELECT DISTINCT passage_id, document_id FROM passages) USING (passage_id))"""


def _vectors(read) -> DataFrame:
    """passage_id, embedding of the usable vectors, one a passage (of several the smallest)."""
    rows = read("passage_vectors").where((F.col("model") == MODEL) & (F.size("embedding") == DIMENSIONS) & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("passage_id").agg(F.min("embedding").alias("embedding"))


def _located_vectors(read) -> DataFrame:
    return _vectors(read).join(read("passages").select("passage_id", "document_id").distinct(), "passage_id")


@query(f"""
    WITH {_VECTORS}, s AS (SELECT a.passage_id AS query_id, b.passage_id, round(list_dot_product(a.u, b.u), 6) AS similarity FROM unit a JOIN unit b ON a.document_id = b.document_id AND a.passage_id <> b.passage_id WHERE a.passage_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, passage_id) AS position FROM s)
    SELECT query_id, passage_id, similarity, position FROM r WHERE position <= 6
""")
def dense_document_topk(read) -> DataFrame:
    """The six passages of the same document that are most similar to each passage of the query set (ids divisible by 20)."""
    v = _located_vectors(read)
    queries = R.with_vectors(v.where("passage_id % 20 = 0"), v, "document_id")
    best = R.cosine_top_k(queries, v, "passage_id", "embedding", 6, scope="document_id")
    return best.select("query_id", "passage_id", "similarity", "position")


_DENSE = f"""{_VECTORS}, lex AS (SELECT qid, passage_id, row_number() OVER (PARTITION BY qid ORDER BY round(rank, 9), passage_id) AS position FROM scored),
    seed AS (SELECT qid, u FROM lex JOIN unit USING (passage_id) WHERE position <= 20 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY position) = 1),
    dense AS (SELECT qid, passage_id, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(seed.u, unit.u), 6) DESC, passage_id) AS position FROM seed, unit)"""


def _lists(read, depth: int) -> tuple[DataFrame, DataFrame]:
    """qid, passage_id, position: the lexical and the dense ranking of each question. No question has a vector of its own
    here, so the best lexical hit that has one stands for it."""
    lex = cut(R.top_k(_scored(read), ["qid"], [F.round("rank", 9), F.col("passage_id")], depth).select("qid", "passage_id", "position"))
    v = _located_vectors(read).select("passage_id", "embedding")
    book = read("questions").select("qid", F.row_number().over(Window.orderBy("qid")).cast("long").alias("number"))  # the codebook has a fixed size
    seed = lex.join(v, "passage_id").groupBy("qid").agg(F.min_by("embedding", "position").alias("embedding"))
    asked = seed.join(book, "qid").select(F.col("number").alias("passage_id"), "embedding")
    dense = R.cosine_top_k(asked, v, "passage_id", "embedding", depth, itself=True).join(book, F.col("query_id") == F.col("number"))
    return lex, dense.select("qid", "passage_id", "position")


@query(f"""
    WITH {_BM25}, {_DENSE}, u AS (SELECT qid, passage_id, position, 1 AS source FROM lex WHERE position <= 20 UNION ALL SELECT qid, passage_id, position, 2 FROM dense WHERE position <= 20),
    f AS (SELECT *, row_number() OVER (PARTITION BY qid, passage_id ORDER BY position, source) AS first FROM u),
    p AS (SELECT qid, passage_id, source, row_number() OVER (PARTITION BY qid ORDER BY position, source, passage_id) AS place FROM f WHERE first = 1)
    SELECT * FROM p WHERE place <= 10
""")
def hybrid_interleave(read) -> DataFrame:
    """Two rankings of passages for each question, BM25 and cosine, taken in turn, the lexical one first; ten passages."""
    lex, dense = _lists(read, 20)
    both = lex.withColumn("source", F.lit(1)).unionByName(dense.withColumn("source", F.lit(2)))
    return R.interleave(both, "qid", "passage_id", "source", "position", 20, 10)


@query(f"""
    WITH {_BM25}, {_SUPPORT}, {_DENSE}, kw AS (SELECT qid, passage_id, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, passage_id) AS position FROM sup WHERE hits > 0),
    u AS (SELECT qid, passage_id, position, 1 AS source FROM dense WHERE position <= 12 UNION ALL SELECT qid, passage_id, position, 2 FROM lex WHERE position <= 12 UNION ALL SELECT qid, passage_id, position, 3 FROM kw WHERE position <= 12),
    n AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM lex WHERE lex.qid = u.qid AND lex.passage_id = u.passage_id AND lex.position <= 4)),
    f AS (SELECT *, row_number() OVER (PARTITION BY qid, passage_id ORDER BY position, source) AS first FROM n),
    p AS (SELECT qid, passage_id, source, row_number() OVER (PARTITION BY qid ORDER BY position, source, passage_id) AS place FROM f WHERE first = 1)
    SELECT * FROM p WHERE place <= 12
""")
def round_robin_collect(read) -> DataFrame:
    """Further passages for each question: three rankings in turn, without the four that were shown before."""
    lex, dense = _lists(read, 12)
    kw = R.top_k(_support(read), ["qid"], [F.col("hits").desc(), F.col("passage_id")], 12).select("qid", "passage_id", "position")
    every = dense.withColumn("source", F.lit(1)).unionByName(lex.withColumn("source", F.lit(2))).unionByName(kw.withColumn("source", F.lit(3)))
    fresh = every.join(lex.where("position <= 4").select("qid", "passage_id"), ["qid", "passage_id"], "left_anti")
    return R.interleave(fresh, "qid", "passage_id", "source", "position", 12, 12)


@query(f"""
    WITH {SQL_PASSAGES}, {_SUPPORT}, r AS (SELECT sup.qid, passage_id, hits, row_number() OVER (PARTITION BY sup.qid ORDER BY hits DESC, passage_id) AS position FROM sup WHERE hits > 0)
    SELECT qid, passage_id, position, (position - 1) // 6 AS depth FROM r WHERE position BETWEEN 7 AND 18
""")
def depth_slices(read) -> DataFrame:
    """The second and third six passages of each question's ranking: further depths of a search."""
    ranked = R.top_k(_support(read), ["qid"], [F.col("hits").desc(), F.col("passage_id")], 18).where("position >= 7")
    return ranked.select("qid", "passage_id", "position", F.floor((F.col("position") - 1) / 6).alias("depth"))


@query(f"""
    WITH {SQL_PASSAGES}, q AS (SELECT list_distinct(flatten(list({_KEYWORDS}))) AS words FROM questions),
    s AS (SELECT document_id, passage_id, page_start, len(list_filter(words, lambda k: contains(lower(coalesce(text, '')), k))) AS hits FROM pas, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY hits DESC, passage_id) AS rn, count(*) OVER (PARTITION BY document_id) AS n, max(hits) OVER (PARTITION BY document_id) AS m FROM s)
    SELECT document_id, passage_id, hits FROM r WHERE rn <= 4 OR n <= 4 OR m <= 0
""")
def topk_sections_fallback(read) -> DataFrame:
    """The four passages of a document with most of the codebook's keywords, all if it has no more or none has any."""
    words = sorted({w for r in read("questions").select(F.split(F.lower("keywords"), ",").alias("k")).collect() for w in (x.strip(" ") for x in r["k"] or []) if len(w) >= 3})
    rows = read("passages").select("document_id", "passage_id", "text").dropDuplicates(["passage_id"])
    scored = rows.select("document_id", "passage_id", R.support(F.array(*[F.lit(w) for w in words]), F.lower(F.coalesce("text", F.lit("")))).alias("hits"))
    return R.densest(scored, ["document_id"], "hits", "passage_id", 4)


# --- grounding --------------------------------------------------------------------------------------------------------


def _quotes(read) -> DataFrame:
    """attempt_id, document_id, source, page, needle (norm_quotes of the evidence), of 15 characters and more."""
    rows = read("attempts").select("attempt_id", "document_id", "source", "page", "evidence").dropDuplicates(["attempt_id"])
    return rows.withColumn("needle", T.norm_quotes(F.col("evidence"))).where(F.length("needle") >= 15).drop("evidence")


def _located(read) -> DataFrame:
    """attempt_id, page_no: the first page of the document that holds the quotation whole."""
    quotes = _quotes(read).select("attempt_id", "document_id", "needle")
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"]).drop("doc_id")
    pages = P.explode_pages(docs).select("document_id", "page_no", T.norm_quotes(F.col("page")).alias("hay"))
    sizes = (read("attempts").where(F.length("evidence") >= 15).select("document_id"), pages.select("document_id"))
    return stretch_pairs(quotes, pages, "document_id", sizes).groupBy("attempt_id").agg(F.min("page_no").alias("page_no"))


_NQ = lambda c: sql_squeeze(f"lower(translate({c}, '’‘“”–—', '''''\"\"--'))")
_GROUND = f"""
    {SQL_ATTEMPTS}, {SQL_LATEST}, q AS (SELECT attempt_id, document_id, coalesce(source, '') AS source, page, {_NQ("evidence")} AS needle FROM att WHERE evidence IS NOT NULL),
    pg AS (SELECT document_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM latest WHERE text IS NOT NULL),
    np AS (SELECT document_id, page_no, {_NQ("page")} AS hay FROM pg),
    g AS (SELECT attempt_id, min(page_no) AS page_no FROM q JOIN np ON q.document_id = np.document_id AND contains(hay, needle) WHERE length(needle) >= 15 GROUP BY attempt_id)"""


@query(f"WITH {_GROUND} SELECT attempt_id, page_no FROM g")
def quote_first_page(read) -> DataFrame:
    return _located(read)


@query(rf"""
    WITH {_GROUND}, wh AS (SELECT document_id, {_NQ("text")} AS hay FROM latest WHERE text IS NOT NULL),
    v AS (SELECT q.*, g.page_no, coalesce(contains(wh.hay, needle), false) AS verbatim, regexp_matches(needle, '\.\.\.|…') AS stitched, try_cast(nullif(regexp_extract(page, '[0-9]+'), '') AS INTEGER) AS cited
      FROM q LEFT JOIN g ON q.attempt_id = g.attempt_id LEFT JOIN wh ON q.document_id = wh.document_id WHERE length(needle) >= 15)
    SELECT source, count(*) AS n_quotes, sum(verbatim::INT)::BIGINT AS n_verbatim, sum((page_no IS NOT NULL AND NOT stitched)::INT)::BIGINT AS n_contiguous, sum(coalesce(page_no = cited, false)::INT)::BIGINT AS n_on_page,
      round(avg(verbatim::INT), 6) AS share_verbatim FROM v GROUP BY source
""")
def citation_audit(read) -> DataFrame:
    """Per source how many quotations stand in their document at all, whole on one page, and on the page they cite."""
    quotes = _quotes(read).withColumn("source", F.coalesce("source", F.lit("")))
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"])
    whole = docs.select("document_id", T.norm_quotes(F.col("text")).alias("hay"))
    rows = quotes.join(_located(read), "attempt_id", "left").join(whole, "document_id", "left")
    verbatim = F.coalesce(F.contains("hay", "needle"), F.lit(False))
    stitched = F.col("needle").rlike(r"\.\.\.|…")
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_quotes"), n(verbatim).alias("n_verbatim"), n(F.col("page_no").isNotNull() & ~stitched).alias("n_contiguous"),
        n(F.coalesce(F.col("page_no") == T.first_page(F.col("page")), F.lit(False))).alias("n_on_page"), F.round(F.avg(verbatim.cast("int")), 6).alias("share_verbatim"),
    )


@query(f"""
    WITH {SQL_ATTEMPTS}, {SQL_LATEST}, q AS (SELECT attempt_id, document_id, trim(regexp_replace(lower(evidence), '[^a-z0-9]+', ' ', 'g')) AS q FROM att WHERE evidence IS NOT NULL),
    d AS (SELECT document_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM latest WHERE text IS NOT NULL),
    w AS (SELECT attempt_id, q, t, string_split(q, ' ') AS w FROM q JOIN d USING (document_id)),
    r AS (SELECT attempt_id, q, t, w, list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i:i + 3], ' ')) AS runs FROM w)
    SELECT attempt_id, length(q) >= 12 AND (contains(t, q) OR (len(w) >= 6 AND len(list_filter(runs, lambda x: contains(t, x))) >= greatest(2, floor(0.6 * len(runs))))) AS present FROM r
""")
def quote_shingle_present(read) -> DataFrame:
    """Whether a quotation is supported by its document, spliced ones included."""
    quotes = read("attempts").where("evidence is not null").select("attempt_id", "document_id", "evidence").dropDuplicates(["attempt_id"])
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"]).where("text is not null")
    rows = quotes.select("attempt_id", "document_id", T.norm_words(F.col("evidence")).alias("q")).join(docs.select("document_id", T.norm_words(F.col("text")).alias("t")), "document_id")
    return rows.select("attempt_id", T.quote_present(F.col("q"), F.col("t")).alias("present"))


@query(f"""
    WITH {SQL_ATTEMPTS}, {SQL_LATEST}, e AS (SELECT attempt_id, instr(text, evidence) AS a, length(evidence) AS n, string_split(text, chr(12)) AS pages FROM att JOIN latest USING (document_id) WHERE evidence IS NOT NULL AND length(evidence) >= 15 AND text IS NOT NULL),
    s AS (SELECT attempt_id, a, n, generate_subscripts(pages, 1) AS page_no, pages FROM e WHERE a > 0),
    b AS (SELECT attempt_id, a, a + n AS z, page_no, 1 + (page_no - 1) + coalesce(list_sum(list_transform(pages[1:page_no - 1], lambda x: length(x))), 0) AS low, length(pages[page_no]) AS len FROM s)
    SELECT attempt_id, min(page_no) AS first_page, max(page_no) AS last_page FROM b WHERE a < low + len AND z > low GROUP BY attempt_id
""")
def range_overlap_pages(read) -> DataFrame:
    """The pages that a quotation's span in its document overlaps, by the pages' bounds."""
    quotes = read("attempts").where(F.length("evidence") >= 15).select("attempt_id", "document_id", "evidence").dropDuplicates(["attempt_id"])
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"]).where("text is not null")
    found = quotes.join(docs, "document_id").select("attempt_id", F.expr("locate(evidence, text)").alias("a"), F.length("evidence").alias("n"), F.transform(T.pages(F.col("text")), lambda p: F.length(p)).alias("len")).where("a > 0")
    bounds = F.expr("transform(sequence(1, size(len)), i -> struct(i as page_no, 1 + (i - 1) + aggregate(slice(len, 1, i - 1), 0, (x, y) -> x + y) as low, len[i - 1] as len))")
    over = found.select("attempt_id", F.filter(bounds, lambda p: (F.col("a") < p["low"] + p["len"]) & (F.col("a") + F.col("n") > p["low"])).alias("p")).where(F.size("p") > 0)
    return over.select("attempt_id", F.array_min("p.page_no").cast("long").alias("first_page"), F.array_max("p.page_no").cast("long").alias("last_page"))


@query(f"""
    WITH {SQL_ATTEMPTS}, {SQL_LATEST}, c AS (SELECT attempt_id, document_id, try_cast(nullif(regexp_extract(page, '[0-9]+'), '') AS INTEGER) AS cited FROM att),
    pg AS (SELECT document_id, unnest(string_split(text, chr(12))) AS page, generate_subscripts(string_split(text, chr(12)), 1) AS page_no FROM latest WHERE text IS NOT NULL)
    SELECT attempt_id, page_no, length(page) AS n_chars FROM c JOIN pg ON c.document_id = pg.document_id AND page_no BETWEEN cited - 1 AND cited + 1
""")
def neighbour_pages(read) -> DataFrame:
    """The cited page of each attempt and those beside it: a band join made an equality join on document and page."""
    cited = read("attempts").select("attempt_id", "document_id", T.first_page(F.col("page")).alias("cited")).dropDuplicates(["attempt_id"]).where("cited is not null")
    wanted = cited.select("attempt_id", "document_id", F.explode(F.sequence(F.col("cited").cast("long") - 1, F.col("cited") + F.lit(1).cast("long"))).alias("page_no"))
    docs = P.latest(read("documents").select("document_id", "doc_id", "text"), ["document_id"], ["doc_id"]).drop("doc_id")
    pages = P.explode_pages(docs).select("document_id", "page_no", F.length("page").cast("long").alias("n_chars"))
    return wanted.join(pages, ["document_id", "page_no"]).select("attempt_id", "page_no", "n_chars")
