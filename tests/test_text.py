from pyspark.sql import functions as F

from clauseloom.functions import numbers as N, text as T


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_normal_forms(spark):
    assert one(spark, T.norm_words, "Twelve (12) Days—paid") == "twelve 12 days paid"
    assert one(spark, T.norm_quotes, "The  “Board’s” pay – 3") == "the \"board's\" pay - 3"
    assert one(spark, T.norm_score, "a – ‘b’") == "a – ‘b'"
    assert one(spark, T.squeeze, "  a \n b ") == "a b"
    assert one(spark, T.norm_words, None) is None


def test_slug_and_id(spark):
    assert one(spark, lambda c: T.slug(c, 8), "--Old Town, Schools") == "old_town"
    assert one(spark, T.surrogate_id, "A B", "x", "p").startswith("a_b__x__")


def test_pages_of_references(spark):
    assert one(spark, T.page_list, "12-14") == [12, 13, 14]
    assert one(spark, T.page_list, "pp. 9; 3") == [3, 4, 5, 6, 7, 8, 9]  # any two numbers close by
    assert one(spark, T.page_list, "1-90") == [1, 90]
    assert one(spark, T.page_list, "none") == []
    assert one(spark, T.first_page, "see p. 7") == 7
    assert one(spark, T.first_page, "none") is None


def test_two_classifiers_differ(spark):
    for raw, scorer, verifier in [("", "not_discussed", "empty"), (None, "not_discussed", "empty"), ("No, unpaid only", "no", "substantive"), ("no provision", "substantive", "no"), ("No more than 26", "substantive", "substantive"), ("Not Discussed.", "not_discussed", "not_discussed")]:
        assert one(spark, T.status_for_score, raw) == scorer
        assert one(spark, T.status_for_verify, raw) == verifier


def test_quote_present(spark):
    text = "the board shall pay premiums for each teacher and the teachers receive ten sick leave days each year"
    assert one(spark, T.quote_present, "board shall pay premiums", text)
    assert not one(spark, T.quote_present, "board", text)
    assert one(spark, T.quote_present, "shall pay premiums for each teacher receive ten sick leave days each year", text)
    assert not one(spark, T.quote_present, "nothing of this kind stands anywhere in the text here", text)


def test_years_modals_and_fences(spark):
    assert [one(spark, T.year4, y) for y in ("49", "50", "1999")] == [2049, 1950, 1999]
    assert one(spark, T.modal, "Teachers (may) and must stay") == "must"
    assert one(spark, T.modal, "la canción") == ""
    assert one(spark, T.negated_modal, "They shall not go") is True
    assert one(spark, T.strip_code_fence, "```json\n{}\n```") == "{}"
    assert one(spark, T.clean_controls, "a\x01b") == "ab"
    assert one(spark, T.answer_alias, " N/A ") == "not_applicable" and one(spark, T.answer_alias, "OCR needed") == "ocr_needed" and one(spark, T.answer_alias, "none found") == "none found"
    assert one(spark, T.figures, "1,200. and 3.5 and 1200") == ["1200", "3.5"]
    assert one(spark, T.search_terms, "What is the pay of a teacher, pay?") == ["pay", "teacher"]


def test_values_and_conflicts(spark):
    assert one(spark, N.dollars, "pays $ 1,250.50 or $3") == "1250.50" and one(spark, N.dollars, "none") is None
    assert one(spark, N.percentage, "of 7.5 percent") == "7.5"
    assert one(spark, N.quantity, "within ten days") == "10 days" and one(spark, N.quantity, "ten or 12 weeks") == "12 weeks" and one(spark, N.quantity, "Forty-five days") == "45 days"
    assert one(spark, N.date_value, "July 4, 2020 for 2019-21") == "2019-2021"
    assert one(spark, N.word_digit_conflicts, "eighty (8) and ten (10)") == 1
    assert one(spark, N.sum_conflicts, "202 days (192 days + 10) and 5 days (3 days + 1") == 1
    for token, text, there in [("12", "112 or 12.", True), ("12", "112", False), ("12", "twelve days", True), ("pay", "the pay", True), ("", "x", True), ("3.5", "13.5", False)]:
        assert one(spark, N.token_present, token, text) is there
