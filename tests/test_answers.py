from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from clauseloom.operators import answers as A, readings as D, repair as X, tables as G


def test_best_answer_order(spark):
    rows = [("d", "q", 1, "not_discussed", "", "high"), ("d", "q", 2, "yes", "", "high"), ("d", "q", 3, "yes", "quote", "low"), ("d", "q", 4, "yes", "quote", "low"), ("d", "r", 5, None, None, None)]
    df = spark.createDataFrame(rows, "document_id string, question_id string, attempt_id long, answer string, evidence string, confidence string")
    got = {r.question_id: (r.attempt_id, r.score) for r in A.best_answers(df, ["document_id", "question_id"], ["attempt_id"]).collect()}
    assert got == {"q": (3, 16), "r": (5, 0)}


def test_reconcile_rules(spark):
    def run(*sources):
        df = spark.createDataFrame([("d", s, a, e, f"p. {i + 4}", "high", g) for i, (s, a, e, g) in enumerate(sources)], "k string, source string, answer string, evidence string, page string, confidence string, grounded boolean")
        return A.reconcile(df, ["k"], ["a", "b", "c"]).first()

    assert run(("a", "not_discussed", "", False), ("b", "no", "", False)).answer == "no"
    assert run(("b", "12 days", "quote", True), ("a", "not_discussed", "", True)).base == "b"
    r = run(("a", "10 days", "quote", True), ("b", "10 or 12 days", "other", True), ("c", "99 days", "x", False))
    assert r.answer == "10 days; also (b): 10 or 12 days" and r.n_added == 1
    assert run(("a", "", "", None)).answer == "not_discussed" and run(("a", "", "", None)).page == "not_applicable"
    r = run(("a", "10 days of jury leave", "unrelated wording", True), ("b", "10 days", "jury leave of 10 days", True), ("c", "10 days", "jury leave of 10 days", False))
    assert (r.evidence_from, r.page, r.base) == ("b", "4;5", "a")
    assert run(("a", "10 days", "one", False), ("z", "12 days", "other 12", True)).answer == "10 days; also (z): 12 days"


def test_score_has_five_tests(spark):
    key = spark.createDataFrame([("q", "substantive", ["12"], ["jury", "leave"], [4]), ("n", "not_discussed", [], [], [])], "k string, k_status string, k_required array<string>, k_optional array<string>, k_pages array<int>")
    rows = [("q", 1, "twelve days", "jury duty of teachers", [4], True), ("q", 2, "112 days", "jury duty of teachers", [9], True), ("q", 3, "not discussed", "", [], False), ("q", 4, "12", "too short", [4], True), ("n", 5, "not_discussed", "", [], False), ("n", 6, "yes", "some words of evidence", [4], False), ("x", 7, "", "", [], False)]
    a = spark.createDataFrame(rows, "k string, n int, answer string, evidence string, pages array<int>, located boolean")
    got = {r.n: (r.status, r.required, r.complete, r.page, r.evidence, r.overall) for r in A.score(a, key, ["k"]).collect()}
    assert got == {1: (1, 1, 0.5, 1, 1, 1), 2: (1, 0, 0.5, 0, 1, 0), 3: (0, 0, 0.0, 0, 1, 0), 4: (1, 1, 0.0, 1, 0, 0), 5: (1, 1, 1.0, 1, 1, 1), 6: (0, 0, 1.0, 1, 0, 0)}


def test_variants(spark):
    assert A.join_variants(["Yes, covers travel", "yes covers travel and meals", "No stipend at all here", ""]) == "yes covers travel and meals; No stipend at all here"
    assert A.join_variants(["alpha one two three", "beta four five six"], most=20).endswith("[+1 further variant(s)]")
    df = spark.createDataFrame([("d", 1, "x y z"), ("d", 2, "x y z"), ("d", 3, "other words here"), ("d", 4, None)], "k string, n long, answer string")
    r = A.fold_variants(df, ["k"], ["n"]).first()
    assert r.variants == "x y z; other words here" and r.n == 3
    many = spark.createDataFrame([("d", i, f"answer{i} alone{i} unlike{i}") for i in range(30)], "k string, n long, answer string")
    assert A.fold_variants(many, ["k"], ["n"], chunk=7).first().variants == A.join_variants([f"answer{i} alone{i} unlike{i}" for i in range(30)])


@given(st.lists(st.text("abc ", max_size=12), max_size=6))
def test_variants_never_fail(parts):
    out = A.join_variants(parts, 15)
    assert isinstance(out, str)


def test_caps_and_defaults(spark):
    df = spark.createDataFrame([("high", " "), ("low", "x"), (None, None)], "c string, v string")
    assert [r[0] for r in df.select(A.cap_confidence(F.col("c"), "medium")).collect()] == ["medium", "low", None]
    assert [r[0] for r in df.select(A.with_defaults(F.col("v"), "?")).collect()] == ["?", "x", "?"]


def test_grids(spark):
    text = "Step 1 40,100 41,200\nStep 2 | 40,200 41,300\nStep 2 40,250 41,350\nStep 4 40,400 41,500\nStep 5 40,500\nno row 12\n7 $1,000 $2,000"
    c = G.cells(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), "doc_id")
    assert c.where("doc_id <> 1").count() == 0
    g = {(r.kind, r.step): (r.lane_1, r.lane_2) for r in G.grid(c, ["doc_id", "kind"], 2).collect()}
    assert g["Step", 2] == (40250, 41350) and g["Step", 5] == (40500, None) and g["", 7] == (1000, 2000)
    steps = spark.createDataFrame([([1, 2, 4, 5],), ([1, 9],)], "s array<bigint>")
    assert [r[0] for r in steps.select(G.missing_steps(F.col("s"))).collect()] == [[3], []]


def test_progressions_and_classes(spark):
    rows = [(1, "s", i, 1, 100 * i, i) for i in range(1, 7)] + [(1, "s", i, 2, 5, i) for i in range(1, 7)] + [(1, "s", i, 3, i * i, i) for i in range(1, 7)]
    c = spark.createDataFrame(rows, "k int, kind string, step long, lane long, value long, at long")
    assert {r.lane: r.uniform for r in G.progressions(c, ["k", "kind"]).collect()} == {1: True, 2: False, 3: False}
    m = spark.createDataFrame([(k, v) for k, vs in {1: [1, 2, 3, 4], 2: [4, 3, 2, 1], 3: [1, 2, 3, 4, 4], 4: [1], 5: [1]}.items() for v in vs], "k long, v long")
    assert {r.k: (r.class_id, r.members) for r in G.multiset_classes(m, "k", "v").collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}


def test_readings(spark):
    df = spark.createDataFrame([(1, "pay 10 and 20", "pay 10 and 20!"), (2, "pay 10", "pay 99"), (3, None, "x"), (4, "", None), (5, "no figures", "none here")], "n int, a string, b string")
    got = {r.n: (r.engine, r.disputed) for r in D.arbitrate(df, ["n"], "a", "b").collect()}
    assert got == {1: ("b", 0), 2: ("a", 1), 3: ("b", 0), 4: ("", 0), 5: ("b", 0)}
    loops = spark.createDataFrame([(1, "same line of text\n" * 80), (2, "A short page."), (3, " ")], "n int, t string")
    assert {r.n: r.loop for r in D.compression(loops, ["n"], "t").collect()} == {1: True, 2: False}
    assert {r.n: round(r.wer, 3) for r in D.word_errors(spark.createDataFrame([(1, "a b c", "a x c"), (2, None, "a")], "n int, r string, t string"), "n", "r", "t").collect()} == {1: 0.333, 2: 1.0}


def test_repair():
    page = "First sentence here. The Board’s designee shall approve the travel request of each teacher within ten days. Last one."
    quote = "the board's designee shall  approve the travel request of each teacher in ten days"
    assert X.realigned(quote, page, anchor=40).startswith("The Board’s designee shall approve")
    assert X.realigned(quote, page, anchor=40, most=50) == ""  # too long a clause is no quotation
    assert X.realigned("short", page) == "" and X.realigned(quote, "") == ""


def test_repair_candidates_lose_no_shared_piece(spark):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    pages = [(i, "d", " ".join(rng.choices(words, k=80))) for i in range(20)]
    quotes = []
    for i, (_, _, t) in enumerate(pages):
        at = rng.randrange(0, 150)
        quotes.append((i, "d", "other beginning here " + t[at : at + 70] + " and another end of it"))
    q = spark.createDataFrame(quotes, "q long, d string, quote string")
    p = spark.createDataFrame([*pages, (50, "d", None)], "p long, d string, page string")
    got = {(r.q, r.p) for r in X.candidates(q, p, "q", "p", "d").collect()}
    want = {(i, j) for i, _, a in quotes for j, _, b in pages if X.shared_stretch(a, b)[0] >= X.ANCHOR}
    assert want and want <= got


def test_repair_finds_the_piece_that_a_full_comparison_finds():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(7)
    for _ in range(300):
        base = "".join(rng.choices("ab ", k=150))
        p, q = ("".join(c if rng.random() > 0.02 else "x" for c in rng.choice([base, base[40:] + base[20:90]])) for _ in range(2))
        m = SequenceMatcher(None, p, q, autojunk=False).find_longest_match()
        assert X.longest_shared(p, q, 30) == ((m.a, m.size) if m.size >= 30 else (0, 0))
    for text in ("  The “Board’s” Plan – x\n\ny ", "İstanbul ΣΣ Straße", "", "a" * 50):
        assert X.normal(text) == X.normal_with_places(text)[0]


def test_repair_marks_are_few_and_shared():
    import random

    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh ", k=rng.randrange(0, 400))) for _ in range(50)]
    texts += [rng.choice("xyz") * 7 + t[30:90] + "--" for t in texts if len(t) > 100]
    owner, h = X.marks(texts)
    held = {i: set(h[owner == i].tolist()) for i in range(len(texts))}
    for i, a in enumerate(texts):
        assert len(held[i]) <= max(0, len(a) / 8) and bool(held[i]) == (len(a) >= X.ANCHOR)
        for j, b in enumerate(texts[50:], 50):
            assert held[i] & held[j] or not any(a[k : k + X.ANCHOR] in b for k in range(len(a) - X.ANCHOR + 1))
    assert len(X.marks([])[0]) == 0 and len(X.marks(["", "short"])[0]) == 0
