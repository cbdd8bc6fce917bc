import pytest
from pyspark.sql import functions as F

from clauseloom.operators import clauses as C, keywords as K, readings as D, review as V, tables as G


def test_statements(spark):
    cases = {
        "The Board shall pay the premium of teachers.": ("shall", False, "obligation", 1.0, "management"),
        "No teacher may leave the building early.": ("may", True, "prohibition", 0.3, "worker"),
        "No later than June 1 the district will publish the list.": ("will", False, "obligation", 0.9, "management"),
        "Each teacher shall be entitled to ten days.": ("shall", False, "right", 1.0, "worker"),
        "Teachers shall not be required to attend.": ("shall", True, "right", 1.0, "worker"),
        "The roster shall be prepared by the principal.": ("shall", False, "obligation", 1.0, "management"),
        "This schedule must not exceed the limits.": ("must", True, "prohibition", 1.0, "other"),
        "Teachers are permitted to leave.": ("", False, "permission", 0.85, "other"),
        "Staff (who may ask) report on Monday.": ("", False, "other", 0.0, "worker"),
        None: ("", False, "other", 0.0, "other"),
    }
    df = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, quote string")
    got = {r.quote: (r.modal, r.negated, r.statement, r.weight, r.acting) for r in C.statements(df, "quote").collect()}
    assert got == cases
    b = C.buckets(C.statements(df.withColumn("k", F.lit(1)), "quote"), "k").first()
    assert (b.management_responsibilities, b.worker_responsibilities, b.management_rights, b.worker_rights, b.n_clauses) == (2.9, 0.3, 2.0, 0.0, 8)


def test_buckets_do_not_depend_on_the_order_of_rows(spark):
    weights = [0.3, 0.7, 0.7, 0.7, 0.7, 0.7, 0.7, 0.85, 0.85, 0.9, 0.9, 0.9, 0.9, 1.0, 1.0, 1.0]  # 0.3 of 12.8 lies between two sixth decimals
    shares = set()
    for ws in (weights, weights[::-1]):
        rows = [("k", w, "right" if w == 0.3 else "obligation", "management", "worker") for w in ws]
        df = spark.createDataFrame(rows, "k string, weight double, statement string, acting string, protected string").coalesce(1)
        b = C.buckets(df, "k").first()
        assert (b["worker_rights"], b["management_responsibilities"], b["total"], b["n_clauses"]) == (0.3, 12.5, 12.8, 16)
        shares.add((b["worker_rights_share"], b["management_responsibilities_share"]))
    assert len(shares) == 1


def test_appendices_and_their_guard(spark):
    pages = [["ARTICLE I\nfirst text", "Appendix A\nx", "more", "ARTICLE Two\nlast text of it"], ["ARTICLE I", "EXHIBIT 1 " + "y" * 500], [], ["plain"]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p array<string>")
    got = {r.i: r.k for r in df.select("i", C.counted_pages(F.col("p")).alias("k")).collect()}
    assert got == {0: [pages[0][0], "", "", pages[0][3]], 1: pages[1], 2: [], 3: ["plain"]}


def test_keyword_places(spark):
    q = spark.createDataFrame([("Sick leave, what is the sick leave or days/steps; " + "z" * 90,)], "q string")
    assert q.select(K.question_terms(F.col("q"))).first()[0] == ["sick leave", "is the sick leave", "days", "steps"]
    pages = spark.createDataFrame([(1, 1, "leave " * 20), (1, 2, "Teachers receive ten days of sick leave."), (2, 1, None), (3, 1, "")], "d long, page_no long, page string")
    rows = K.places(pages, ["d"], ["leave", "sick leave"]).collect()
    assert sorted((r.page_no, r.term, r.nth) for r in rows) == [(1, "leave", i) for i in range(1, 13)] + [(2, "leave", 1), (2, "sick leave", 1)]
    s = lambda text, kind: spark.range(1).select(K.place_score(F.lit("sick leave"), F.lit(text), F.lit(kind))).first()[0]
    assert (s("shall have ten days", "numeric"), s("shall have ten days", "yes/no"), s("Leave ...... 4", "yes/no")) == (115, 35, -15)
    a = lambda text, kind: spark.range(1).select(K.answer_of(F.lit(text), F.lit(kind))).first()[0]
    assert (a("no health plan", "yes/no"), a("no strike, no health plan", "yes/no"), a("ten days", "numeric"), a("none", "numeric"), a("$1,200", "dollar amount")) == ("no", "yes", "10 days", "discussed_unclear", "1200")


def test_many_readings(spark):
    rows = [("d", n, e, t) for e, ts in {"x": ["pay 10 here", "pay 20 here", None, "one 1"], "y": ["pay 10 there", "pay 99 there", "", "see https://example.com one 1"], "z": ["pay 10", "same line\nsame line\nsame line", "only z", "one 1"]}.items() for n, t in enumerate(ts, 1)]
    g = D.gated(spark.createDataFrame(rows, "d string, page_no long, engine string, text string"), ["d"])
    assert {(r.page_no, r.engine): r.reasons for r in g.where(F.size("reasons") > 0).collect()} == {(4, "y"): ["invented"], (2, "z"): ["repeats", "long"]}
    got = {r.page_no: (r.engine, r.agreement, r.disputed, r.dropped) for r in D.arbitrate_many(g, ["d"], ["x", "y", "z"], ["z", "y", "x"]).collect()}
    assert got == {1: ("z", 1.0, 0, ""), 2: ("x", 0.0, 1, "z"), 3: ("z", None, 0, ""), 4: ("z", 1.0, 0, "")}
    short = [("d", n, "x", "text of page") for n in range(1, 6)] + [("d", 1, "y", "text"), ("d", 1, "z", "a b c d\n" * 9), ("d", 5, "z", "last page")]
    gated = D.gated(spark.createDataFrame(short, "d string, page_no long, engine string, text string"), ["d"])
    assert {(r.engine, r.why) for r in D.refused(gated, ["d"]).collect()} == {("y", "pages")}


def test_table_warnings(spark):
    def cells(rows):
        return [(s, l, v, at) for at, (s, vs) in enumerate(rows) for l, v in enumerate(vs, 1) if v]

    tables = {
        "good": [(i, [100 * i + 7 * i * i, 200 * i]) for i in range(1, 7)],
        "copied": [(i, [100 * i + i * i, 100 * i + i * i]) for i in range(1, 7)],
        "flat": [(i, [500, 500, 7 * i]) for i in range(1, 7)],
        "gap": [(i, [i * i, 2 * i + 1]) for i in (1, 2, 4, 5, 5)],
        "odd": [(i, [5]) for i in range(1, 5)] + [(9, [900_000])],
    }
    rows = [(t, *c) for t, r in tables.items() for c in cells(r)]
    got = {r.t: (r.warnings, r.escalates) for r in G.warnings(spark.createDataFrame(rows, "t string, step long, lane long, value long, at long"), ["t"]).collect()}
    assert got == {"good": ([], False), "copied": (["lanes_copied"], True), "flat": (["lanes_constant"], False), "gap": (["dropped_rows", "duplicate_labels"], False), "odd": (["implausible", "rows_collapsed", "single_lane"], False)}


def test_blinded_review(spark):
    fields = ["answer"]
    side = lambda v: spark.createDataFrame([("d", f"q{i}", f"{v}{i}") for i in range(40)] + [(v, "only", "x")], "document_id string, question_id string, answer string")
    packet = V.packet(side("b"), side("c"), fields, seed=1)
    rows = packet.collect()
    assert len(rows) == 40 and {r.a_system for r in rows} == {"baseline", "candidate"}
    assert all({r.a_answer[0], r.b_answer[0]} == {"b", "c"} and (r.a_answer[0] == "b") == (r.a_system == "baseline") for r in rows)
    verdicts = spark.createDataFrame([(r.review_id, "yes" if r.a_system == "baseline" else "no", "yes" if r.a_system == "candidate" else "na", "") for r in rows[:30]], "review_id string, a_ok_correct string, b_ok_correct string, reviewer_notes string")
    full = V.collected(packet, verdicts, ["ok"])
    key = packet.select("review_id", "a_system")
    got = {r.system: (r.correct, r.incorrect, r.accuracy) for r in V.accuracy(full, key, ["ok"]).collect()}
    n = sum(r.a_system == "baseline" for r in rows[:30])
    assert got == {"baseline": (30, 0, 1.0), "candidate": (0, 30 - n, 0.0)}
    bad = verdicts.limit(1).withColumn("a_ok_correct", F.lit("maybe"))
    with pytest.raises(Exception, match="not a verdict"):
        V.collected(packet, bad, ["ok"]).collect()
    with pytest.raises(Exception, match="no key for"):
        V.accuracy(full, key.where("false"), ["ok"]).collect()


def test_keyword_answers_shuffle_texts_only_by_document(spark, data):
    from clauseloom.plans import QUERIES, keywords  # noqa: F401

    plan = QUERIES["keyword_answers"](spark, data)._jdf.queryExecution().sparkPlan().toString() + QUERIES["keyword_answers"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(document_id" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning" in x and ("qid" in x.split("hashpartitioning")[1] or "question_id" in x.split("hashpartitioning")[1])]


def test_place_patterns_that_look_around_match_the_same(spark):
    words = ["ten days", "days", "holidays", "_days", "Xdays.", "day's", "teachers shall", "marshall", "shall", "does  not provide", "is not available_", "no health, no", "no healthy", "", "é days é", "will1"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for p in (K.UNITS, K.BINDING, K.DENIALS):
        rows = df.select(F.col("t").rlike(p).alias("a"), F.col("t").rlike(K._whole(p)).alias("b")).collect()
        assert K._whole(p) != p and any(r.a for r in rows) and all(r.a == r.b for r in rows)
