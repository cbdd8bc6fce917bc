from pyspark.sql import functions as F

from clauseloom.operators import pages as P

TWO = "ARTICLE VI INSURANCE\n\nThe Board shall pay health insurance premiums.\fARTICLE VII LEAVE\n\nTeachers receive ten sick leave days."


def test_passages_keep_pages():
    assert P.passages_of(TWO) == [(1, 1, "ARTICLE VI INSURANCE", "The Board shall pay health insurance premiums."), (2, 2, "ARTICLE VII LEAVE", "Teachers receive ten sick leave days.")]


def test_heading_beats_packing_and_empty_headings():
    assert len(P.passages_of(TWO.replace("\f", "\n\n"))) == 2
    assert P.passages_of("ARTICLE I TITLE") == [(1, 1, "ARTICLE I TITLE", "ARTICLE I TITLE")]
    assert P.passages_of("ARTICLE I\n\ntext here\n\nARTICLE II") == [(1, 1, "ARTICLE I", "text here")]
    assert P.passages_of("") == [] and P.passages_of("\f\f") == []


def test_packing_and_long_paragraphs():
    text = "\n\n".join(["a" * 1000, "b" * 700, "c" * 200])
    assert [len(p[3]) for p in P.passages_of(text)] == [1702, 200]
    long = " ".join(["Sentence number one is here." * 5] * 40)
    assert all(len(p[3]) <= P.TARGET for p in P.passages_of(long))
    assert P.passages_of("x" * 5000)[0][3] == "x" * 5000


def test_an_empty_first_heading_stays_on_its_page():
    assert P.passages_of("MASTER AGREEMENT\n\nARTICLE ONE\n\nbody\fMASTER AGREEMENT\n\nmore") == [(1, 1, "MASTER AGREEMENT", "MASTER AGREEMENT"), (1, 1, "ARTICLE ONE", "body"), (2, 2, "MASTER AGREEMENT", "more")]


def model_passages(text, target=1800):
    """The rule once more, by paragraphs: sections, then units, then packing."""
    import re

    units, heading, order = [], "DOCUMENT PREAMBLE", 0
    seen = []
    for number, page in enumerate(text.split("\f"), 1):
        for raw in re.split(r"\n\s*\n", page.strip()):
            p = re.sub(r"[ \t]+", " ", raw).strip()
            if not p:
                continue
            letters = [c for c in p if c.isalpha()]
            if len(p) <= 160 and (re.match(r"(article|appendix|section)\b", p, re.I) or len(letters) >= 5 and sum(map(str.isupper, letters)) / len(letters) >= 0.8):
                order, heading = order + 1, p
                seen.append((order, number, p))
                continue
            if len(p) <= target:
                units.append((order, heading, number, p))
            else:
                part = ""
                for s in re.split(r"(?<=[.!?;:])\s+", p):
                    if part and len(part) + 1 + len(s) > target:
                        units.append((order, heading, number, part))
                        part = s
                    else:
                        part = f"{part} {s}" if part else s
                units.append((order, heading, number, part))
    if seen and not any(u[0] in (0, seen[0][0]) for u in units):
        units.insert(0, (seen[0][0], seen[0][2], seen[0][1], seen[0][2]))
    out = []
    for o, h, n, p in units:
        if out and out[-1][0] == o and len(out[-1][4]) + 2 + len(p) <= target:
            out[-1] = (o, h, out[-1][2], n, out[-1][4] + "\n\n" + p)
        else:
            out.append((o, h, n, n, p))
    return [(a, b, h, p) for _, h, a, b, p in out]


def test_passages_equal_a_plain_model(data):
    import pandas as pd

    for text in pd.read_parquet(f"{data}/documents.parquet", columns=["text"]).text.dropna():
        assert P.passages_of(text) == model_passages(text)


def test_frames_with_nulls_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, TWO, 5), (2, None, 6), (3, "", 7), (3, "", 7)], "doc_id long, text string, page long")
    assert P.build_passages(df, "doc_id").count() == 2
    assert [r.page_no for r in P.explode_pages(df.select("doc_id", "text")).where("doc_id = 1").orderBy("page_no").collect()] == [1, 2]
    assert P.build_passages(df.where("false"), "doc_id").count() == 0
    w = {(r.doc_id, r.window): (r.first_page, r.last_page) for r in P.page_windows(df, "doc_id").collect()}
    assert w[1, 1] == (1, 2)


def test_windows_overlap_and_advance(spark):
    text = "\f".join("x" * 400 for _ in range(10))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.first_page, r.last_page) for r in P.page_windows(df, "doc_id", 1204, 2).orderBy("window").collect()]
    assert got[0] == (1, 3) and got[-1][1] == 10  # two characters between pages: 1,204 for three
    assert P.page_windows(df, "doc_id", 1203, 2).first().last_page == 2
    padded = spark.createDataFrame([(1, "\f".join("x" * 100 + " " * 300 + "\n\n\n\n" for _ in range(4)))], "doc_id long, text string")
    assert P.page_windows(padded, "doc_id", 406, 2).count() == 1  # without their padding
    assert all(b[0] > a[0] for a, b in zip(got, got[1:]))


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "0123456789" * 7), (2, "ab"), (3, ""), (4, None)], "id long, text string")
    got = P.fixed_chunks(df, 30, 10).orderBy("id", "chunk_no").collect()
    assert [(r.id, r.start, len(r.chunk)) for r in got] == [(1, 0, 30), (1, 20, 30), (1, 40, 30), (2, 0, 2)]


def test_latest_and_earliest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "k string, n int, v string")
    assert {(r.k, r.v) for r in P.latest(df, ["k"], ["n"]).collect()} == {("a", "y"), (None, "z")}
    assert {(r.k, r.v) for r in P.earliest(df, ["k"], ["n"]).collect()} == {("a", "x"), (None, "z")}


def test_status_and_headings(spark):
    df = spark.createDataFrame([(500, 1), (1500, 100), (990, 0), (3000, 2)], "d long, n long")
    assert [r[0] for r in df.select(P.text_status(F.col("d"), F.col("n"))).collect()] == ["ocr_needed", "ocr_needed", "partial_or_ocr_needed", "usable"]
    h = spark.createDataFrame([("ARTICLE V",), ("SALARIES AND WAGES",), ("Teachers go",), ("",), ("A" * 200,)], "s string")
    assert [r[0] for r in h.select(P.is_heading(F.col("s"))).collect()] == [True, True, False, False, False]


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "One sentence that is long enough.", 7, 8, 9, 10)], "id int, text string, page int, page_no int, chunk int, sid int")
    assert P.explode_pages(df).first().page_no == 1
    assert P.fixed_chunks(df, 10, 2).count() == 4
    assert P.sentences(df, "text").first().sid == 1
