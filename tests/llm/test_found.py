"""The operators on small inputs: planted cases, nulls, empty and long texts, repeated rows, extra columns, empty tables."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import p1_lookalikes as p1, p2_neighbours as p2, p3_encoding as p3, p4_boilerplate as p4, p5_truncation as p5, p6_packing as p6, p7_leaks as p7, p8_spam as p8
from clauseloom.llm.textform import consistent_form, script_findings, squeeze

ATT = "attempt_id long, document_id string, source string, evidence string, needle string, hay string"
PAS = "passage_id long, document_id string, text string, needle string, hay string, stored string"
DOC = "doc_id long, document_id string, district string, text string, item_id long, size int"


def attempts(spark, rows):
    return spark.createDataFrame([(i, d, "sweep", e, "x", "y") for i, d, e in rows], ATT)


def passages(spark, rows):
    return spark.createDataFrame([(i, d, t, "x", "y", "z") for i, d, t in rows], PAS)


def documents(spark, rows):
    return spark.createDataFrame([(i, f"d{i}", dis, t, 9, 9) for i, dis, t in rows], DOC)


# --- 1


def test_consistent_form_is_one_for_looks_and_keeps_real_differences():
    same = ["writer of the premium", "wrіtеr of the рremium", "ｗｒｉｔｅｒ of the  premium", "wri​ter of the pre­mium"]
    assert len({consistent_form(s) for s in same}) == 1
    assert consistent_form("café") == "café" != consistent_form("cafe")
    assert consistent_form("Отдел") == "Отдел" and consistent_form("В") == "B"
    assert consistent_form("non‑stop") == "non-stop" and consistent_form("a–b") == "a–b"
    assert consistent_form("‘a’") != consistent_form("'a'") and consistent_form("A") != consistent_form("a")
    assert consistent_form(None) is None and consistent_form("") == "" and consistent_form(" \t\n") == ""
    assert squeeze(" a\t\n b  ") == "a b "
    assert consistent_form("a \n b", keep_lines=True) == "a\nb"


def test_scripts_of_tokens_are_told():
    assert consistent_form("ꓓꓰꓗ") == "DEK" and consistent_form("ᎳᎪᏟ") == "WAC" and consistent_form("pαy") == "pay" and consistent_form("ｶﾞ") == "ガ" and consistent_form("ﺏ") == "ب"
    assert consistent_form("Ελλάδα και") == "Ελλάδα και".replace("και", "kai")  # wholly of look-alikes
    assert script_findings("рay рау Отдел pay ꓓꓰꓗ") == (1, 2) and script_findings(None) == (0, 0) == script_findings("")


def test_p1_script_report(spark):
    rows = passages(spark, [(1, "d", "plain text"), (2, "d", "рay the рау"), (3, "d", None), (4, "d", ""), (2, "d", "рay the рау"), (5, "d", "non\u2011stop")])
    got = {r.passage_id: (r.n_mixed, r.n_whole, r.changed) for r in p1.script_report(rows, "passage_id", "text").collect()}
    assert got == {1: (0, 0, False), 2: (1, 1, True), 3: (0, 0, False), 4: (0, 0, False), 5: (0, 0, True)}


def test_consistent_form_is_stable():
    rng = random.Random(5)
    pool = "abcdeхаԁорТНé́​ＡＢ　- ‐ﬁⅢэжΩ’“"
    for _ in range(500):
        s = "".join(rng.choices(pool, k=30))
        assert consistent_form(consistent_form(s)) == consistent_form(s)


@pytest.mark.parametrize("limit", [4096, 0])
def test_p1_found(spark, monkeypatch, limit):
    monkeypatch.setattr("clauseloom.operators.containment.stretch_pairs.__defaults__", ("hay", limit))
    text = "The Board shall pay the monthly premium share of every teacher. Another sentence stands here."
    p = passages(spark, [(1, "a", text), (2, "b", text.replace("monthly premium", "mоnthly рremium")), (3, "a", None), (4, "a", ""), (1, "a", text), (5, None, text), (6, "a", text * 400)])
    a = attempts(spark, [
        (1, "a", "pay the monthly premium share of"), (2, "a", "pay the mоnthly premium share of"), (3, "b", "pay the monthly premium share of"), (4, "a", "the mоnthly"), (5, "a", None), (6, "a", "pay  the\nmonthly premium share of"),
        (7, "a", "pay the Monthly premium share of"), (2, "a", "pay the mоnthly premium share of"), (8, "c", "pay the mоnthly premium share of"), (9, None, "pay the mоnthly premium share of"), (10, "a", "  "),
    ])
    assert {tuple(r) for r in p1.found_by_looks(a, p).collect()} == {(2, 1), (2, 6), (3, 2)}
    assert p1.found_by_looks(a.where("false"), p).count() == 0 == p1.found_by_looks(a, p.where("false")).count()


def test_p1_column(spark):
    df = spark.createDataFrame([(1, "рay", "old"), (2, None, "old")], "consistent_id int, text string, consistent string")
    assert {r.consistent_id: r.consistent for r in p1.with_consistent_form(df, "text").collect()} == {1: "pay", 2: None}


# --- 2


def vectors(spark, rows):
    return spark.createDataFrame([(i, m, 384, v) for i, m, v in rows], "passage_id long, model string, dimensions int, embedding array<float>")


def clustered(n, seed=0, size=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // size), 384))
    return (centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, 384))).astype(np.float32)


def brute_pairs(ids, x, k=10):
    e = x.astype(np.float64)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    s = np.round(e @ e.T, 6)
    out = set()
    for i in range(len(ids)):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def test_p2_recall_against_brute_force(spark, monkeypatch):
    x = clustered(1500)
    rows = [(i, p2.MODEL, v.tolist()) for i, v in enumerate(x)]
    got = {tuple(r) for r in p2.most_similar(vectors(spark, rows)).collect()}
    want = brute_pairs(np.arange(len(x)), x)
    assert len(got & want) >= 0.95 * len(want)
    monkeypatch.setattr(p2, "HOT", 100)  # with cells that get an index of their own
    got = {tuple(r) for r in p2.most_similar(vectors(spark, rows)).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_p2_hot_cells_meet_the_cells_beside_them(spark, monkeypatch):
    rng = np.random.default_rng(1)
    crowd = rng.normal(size=384) + rng.normal(size=(700, 4)) @ rng.normal(size=(4, 384)) + 0.02 * rng.normal(size=(700, 384))
    x = np.concatenate([clustered(800), crowd]).astype(np.float32)
    monkeypatch.setattr(p2, "HOT", 30)
    got = {tuple(r) for r in p2.most_similar(vectors(spark, [(i, p2.MODEL, v.tolist()) for i, v in enumerate(x)])).collect()}
    want = brute_pairs(np.arange(len(x)), x)
    assert len(got & want) >= 0.95 * max(len(want), len(got))


def test_p2_leaves_too_large_for_one_task(spark, monkeypatch):
    x = clustered(600, 4, size=300)
    monkeypatch.setattr(p2, "HOT", 20)
    monkeypatch.setattr(p2, "LEVELS", 1)
    got = {tuple(r) for r in p2.most_similar(vectors(spark, [(i, p2.MODEL, v.tolist()) for i, v in enumerate(x)])).collect()}
    want = brute_pairs(np.arange(len(x)), x)
    assert len(got & want) >= 0.95 * max(len(want), len(got))


def test_p2_neighbours_across_borders_of_crowded_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    families = rng.normal(size=384) * 0.5 + 0.7 * rng.normal(size=(333, 384))  # many more than the codebooks can tell apart
    x = (families[rng.integers(len(families), size=5000)] + 0.25 * rng.normal(size=(5000, 384))).astype(np.float32)
    for name, value in {"HOT": 400, "REGION": 300, "CENTROIDS": 8, "INNER_CENTROIDS": 6, "SAMPLE": 300, "INNER_SAMPLE": 100}.items():
        monkeypatch.setattr(p2, name, value)
    got = {tuple(r) for r in p2.most_similar(vectors(spark, [(i, p2.MODEL, v.tolist()) for i, v in enumerate(x)]), candidates=12).collect()}
    want = brute_pairs(np.arange(len(x)), x)
    assert len(got & want) >= 0.95 * max(len(want), len(got))


def test_p2_packed_vectors_lose_nothing():
    rng = np.random.default_rng(0)
    whole = np.round(rng.normal(size=(20, 384)) * 60) / 1024
    whole[3, :5] = [30, -31, 0, 127 / 1024, -129 / 1024]
    whole[4] *= 40  # most values beyond a byte
    for x in (whole, rng.normal(size=(20, 384)), rng.normal(size=(20, 384)).astype(np.float16), np.full((2, 384), 1e30), np.concatenate([whole[:2], rng.normal(size=(2, 384))])):
        x = x.astype(np.float32)
        assert (p2._unpacked(p2._packed(x)) == x).all()
    assert len(p2._packed(whole[:1].astype(np.float32))[0].as_py()) < 500


def test_p2_numbers_of_leaves():
    for path in ((0,), (65535,), (3, 1023), (7, 0, 5), (1, 2, 3, 4, 1023)):
        assert p2.path_of(p2.key(path)) == path and p2.key(path) < 2**63
        if len(path) < p2.LEVELS:
            assert p2.key(path) < p2.key((*path, 0)) < p2.key((*path, 1023)) < p2.end(p2.key(path))


def test_p2_unusable_ties_and_copies(spark, monkeypatch):
    x = clustered(30, 1)
    rows = [(i, p2.MODEL, v.tolist()) for i, v in enumerate(x)]
    copies = [(100 + i, p2.MODEL, (x[0] * (2 if i > 37 else 1)).tolist()) for i in range(40)]
    bad = [(900, "old", x[0].tolist()), (901, p2.MODEL, None), (902, p2.MODEL, [0.0] * 384), (903, p2.MODEL, [1.0] * 20), (None, p2.MODEL, x[0].tolist()), (904, p2.MODEL, [float("nan")] * 384), rows[0], rows[0]]
    df = vectors(spark, rows + copies + bad)
    ids = np.array([r[0] for r in rows + copies])
    want = brute_pairs(ids, np.array([r[2] for r in rows + copies], np.float32))
    assert {tuple(r) for r in p2.most_similar(df).collect()} == want
    monkeypatch.setattr(p2, "COPIES", 15)
    got = {tuple(r) for r in p2.most_similar(df).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert p2.most_similar(df.where("false")).count() == 0 == p2.most_similar(df.where("passage_id = 3")).count()


def test_p2_traversal_is_in_order_of_distance():
    rng = np.random.default_rng(3)
    index = p2.Index(rng.normal(size=(6, 4)).astype(np.float32), rng.normal(size=(5, 4)).astype(np.float32))
    counts = {int(c): int(rng.integers(1, 4)) for c in rng.choice(30, 20, replace=False)}
    for cell, listed in p2.traversals(index, counts, 1000).items():
        assert sorted(listed) == sorted(counts) and listed[0] == cell
        d = [float(((index.first[c // 5] - index.first[cell // 5]) ** 2).sum() + ((index.second[c % 5] - index.second[cell % 5]) ** 2).sum()) for c in listed]
        assert all(a <= b + 1e-4 for a, b in zip(d, d[1:]))


# --- 3


def damaged(text, written, read):
    """Read as some programs do: a byte that the encoding lacks becomes the control character of its number."""
    b = text.encode(written)
    return b.decode(read, "replace") if read != "cp1252" else "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in b)


def corpus():
    rng = random.Random(2)
    words = "the board shall pay a teacher’s café allowance and the façade report résumé “just cause” minutes § niño mañana el comité conjunto podrá".split()
    return [" ".join(rng.choices(words, k=40)) + "." for _ in range(600)]


def test_p3_finds_and_restores(spark):
    clean = corpus()
    rows = [(i, "d", t) for i, t in enumerate(clean)]
    cases = {1000: ("utf-8", "cp1252"), 1001: ("utf-8", "latin-1"), 1002: ("utf-8", "cp437"), 1003: ("utf-8", "mac_roman"), 1004: ("utf-8", "cp1251"), 1005: ("cp1252", "mac_roman"), 1006: ("cp1252", "utf-8")}
    for i, (w, r) in cases.items():
        rows.append((i, "d", damaged(clean[i - 1000] + " café “just cause” résumé", w, r)))
    twice = damaged(damaged("the café’s résumé", "utf-8", "cp1252"), "utf-8", "cp1252")
    rows += [(1010, "d", clean[3] + twice), (1011, "d", "The letters Ã, Â and â stand for lanes 6, 2 and 84."), (1012, "d", None), (1013, "d", ""), (1014, "d", "plain"), (1000, "d", rows[600][2]), (1015, "d", "Group Γ meets in hall ║ 9 ║ and group В")]
    got = {r.passage_id: (r.restored, r.incomplete) for r in p3.damaged_passages(passages(spark, rows)).collect()}
    assert set(got) == {*cases, 1010}
    for i in (1000, 1001, 1002, 1003, 1004):
        assert got[i] == (clean[i - 1000] + " café “just cause” résumé", False)
    assert got[1006][1] is True
    assert got[1010][0].endswith("the café’s résumé")
    assert p3.damaged_passages(passages(spark, rows).where("false")).count() == 0


def test_p3_letters_that_the_corpus_never_holds(spark):
    clean = corpus()
    lost = {2000: "Rada szkoły będzie płacić składkę i każdy nauczyciel się zgłosi", 2001: "Příliš žluťoučký kůň pěl", 2002: "A bizottság felülvizsgálja a működési időt és erről dönt", 2003: "Совет платит взнос", 2004: "Το συμβούλιο πληρώνει", 2005: "był"}
    genuine = ["UNDER THE “CAFÉ”, “COMITÉ” AND ‘CANADÁ’ RULES", "LE COMITÉ’S “DÉFINI” É»", "The PÅ” rule and “Å” stands", "ÑANDÚ” ÜBER” Ö” Ó’", "CAFÉ™ and NESTLÉ® and Ä™ Ö° É± 9Ñ°"]
    rows = [(i, "d", t) for i, t in enumerate(clean)] + [(3000 + i, "d", t) for i, t in enumerate(genuine)] + [(i, "d", damaged(t, "utf-8", "cp1252")) for i, t in lost.items()]
    got = {r.passage_id: (r.restored, r.incomplete) for r in p3.damaged_passages(passages(spark, rows)).collect()}
    assert got == {i: (t, False) for i, t in lost.items()}


def test_p3_segments_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.uniform(-3, 3) for _ in range(rng.randint(1, 12))]
        got = p3.maximal_segments(list(range(len(s))), s, 1.0)
        best = max((sum(s[i : j + 1]), i, j) for i in range(len(s)) for j in range(i, len(s)))
        if best[0] > 0:
            assert any(abs(sum(s[a : b + 1]) - best[0]) < 1e-9 for a, b in got)
        else:
            assert not got
        assert all(a2 > b1 for (_, b1), (a2, _) in zip(got, got[1:]))


# --- 4


def test_p4_found_blocks_and_cleaning(spark):
    share = "Share this page with a colleague | page {}"
    rights = "All rights reserved by the district office"
    rows, docs = [], []
    for i in range(20):
        docs.append((i, " North District " if i % 2 else "NORTH district", None))
        text = f"Unique words number {'abcdefghijklmnopqrst'[i] * 4} stand in here\n" + (share.format(i) + "\n" + rights.upper() + "\n" if i < 6 else "") + "too short line\nlast different words " + "uvwxyzuvwxyzuvwxyzuv"[i] * (i + 3)
        rows.append((i, f"d{i}", text))
    docs += [(50, None, None), (51, "south", None)]
    rows += [(60, "d50", share), (61, "unknown", share), (62, "d51", share), (63, "d1", None), (64, "d1", ""), rows[0]]
    p, d = passages(spark, rows), documents(spark, docs)
    got = p4.block_lines(p, d).collect()
    assert {(r.passage_id, r.line_no) for r in got} == {(i, n) for i in range(6) for n in (2, 3)}
    assert len({r.block for r in got}) == 1
    clean = {r.passage_id: r.text for r in p4.without_lines(p.select("passage_id", "text").distinct(), p4.repeated_lines(p, d).select("passage_id", "line_no")).collect()}
    assert "Share" not in clean[0] and clean[0].startswith("Unique") and clean[7] == rows[7][2] and clean[63] is None
    assert p4.repeated_lines(p.where("false"), d).count() == 0 == p4.repeated_lines(p, d.where("false")).count()


def test_p4_edges_make_blocks_and_occurrences(spark):
    a, b, c, alone = "Share this page with a colleague", "All rights reserved by the office", "Printed from the district web site", "Questions go to the board secretary"
    texts = [f"{a}\n\n{b}\n{c}\nOwn words of document {'abcdefgh'[i] * 5} here" for i in range(5)]
    texts += [f"{alone}\nother text with no twin {x * 6}\n{a}" for x in "qrstu"]  # a alone, too: its edge to b is not there
    rows = [(i, f"d{i}", t) for i, t in enumerate(texts)] + [(20, "d0", f"{c}\n{a}\n{b}\n9\n{c}")]  # c before a: an edge in one document
    docs = [(i, "x", None) for i in range(10)]
    got = {(r.passage_id, r.line_no): (r.block, r.occurrence) for r in p4.block_lines(passages(spark, rows), documents(spark, docs)).collect()}
    block, other = got[0, 1][0], got[5, 1][0]
    assert block != other and {v[0] for v in got.values()} == {block, other}
    assert {k: v for k, v in got.items() if k[0] == 0} == {(0, 1): (block, 1), (0, 3): (block, 1), (0, 4): (block, 1)}
    assert {k: v for k, v in got.items() if k[0] == 5} == {(5, 1): (other, 1), (5, 3): (block, 3)}
    assert {k[1]: v[1] for k, v in got.items() if k[0] == 20} == {1: 1, 2: 2, 3: 2, 5: 2}  # the edge from b to c holds over a line without letters
    few = p4._components(pd.DataFrame({"district": "x", "k1": [1, 2, 3], "k2": 0, "ends": [[{"b1": 2, "b2": 0}], None, None]}))
    assert few.block.tolist() == [0, 0, 1]  # without edges each line is a block


# --- 5


def test_p5_hazards_and_cuts(spark):
    rng = random.Random(4)
    nouns = "premium roster notice allowance report calendar schedule agreement procedure committee".split()
    made = lambda: " ".join(["The board", rng.choice(["shall", "may", "must"]), "review the", *rng.choices(nouns, k=rng.randint(3, 30))]) + "."
    rows, texts, want = [], [], set()
    for i in range(900):
        s = made()
        texts.append((i, f"d{i}", f"A first sentence stands here. {s} Another one follows it."))
        cut = s[:120]
        rows.append((i, f"d{i}", cut))
        if len(s) > 120:
            want.add(i)
    rows += [(2000, "d1", None), (2001, "d1", ""), (2002, "d1", "not_discussed"), (2003, None, "three words without an end to it and"), (2004, "d2", "x" * 100000), rows[0]]
    s3 = texts[3][2].split(". ")[1] + "."
    rows.append((2005, "d3", s3[:37]))  # a broken transfer
    a = attempts(spark, rows)
    got = {r.attempt_id: r.cut for r in p5.cut_evidence(a, passages(spark, texts)).collect()}
    assert {i for i in range(900) if got.get(i)} == want
    assert got[2005] and not {2000, 2001, 2002, 2004} & got.keys()
    limits = p5.length_hazards(p5.evidence_rows(a)).where("limit").collect()
    assert {(r.unit, r.length) for r in limits} >= {("chars", 120)}
    assert p5.cut_evidence(a.where("false"), passages(spark, texts)).count() == 0


def test_p5_length_that_only_one_writer_is_held_to(spark, monkeypatch):
    rng = random.Random(8)
    words = "PREMIUM ROSTER NOTICE ALLOWANCE REPORT CALENDAR SCHEDULE AGREEMENT".split()
    made = lambda n: " ".join(rng.choices(words, k=60))[: n - 1]
    rows = [(i, f"d{i}", made(rng.randint(80, 300)).strip() + ".") for i in range(700)] + [(1000 + i, f"d{i}", made(60) + "X") for i in range(150)]
    a = attempts(spark, rows)
    assert {(r.length, r.limit) for r in p5.length_hazards(p5.evidence_rows(a)).where("significant and unit = 'chars'").collect()} == {(60, False)}
    got = p5.cut_evidence(a, passages(spark, [(1, "d1", "Another text stands here.")])).where("cut").collect()
    assert {r.attempt_id for r in got} == {1000 + i for i in range(150)} and {r.how for r in got} == {"limit"}
    monkeypatch.setattr(p5, "LEAST", 10**9)  # the method switched off: no length is significant
    assert p5.cut_evidence(a, passages(spark, [(1, "d1", "Another text stands here.")])).where("cut").count() == 0


def test_p5_significant_lengths_need_no_passage_and_heed_none(spark, monkeypatch):
    rng = random.Random(6)
    made = lambda n: " ".join(rng.choices("premium roster notice allowance report calendar".split(), k=80))[: n - 1]
    rows = [(i, f"d{i}", made(rng.randint(80, 300)).strip() + ".") for i in range(700)] + [(1000 + i, f"d{i}", made(60) + "x") for i in range(150)]
    rows.append((5000, "d1", "The board shall review the ros"))  # a broken transfer
    a, p = attempts(spark, rows), passages(spark, [(1, "d1", "The board shall review the roster of the calendar committee. " + rows[701][2] + "\n")])
    how = {r.attempt_id: r.how for r in p5.cut_evidence(a, p).where("cut").collect()}
    assert how == {1000 + i: "limit" for i in range(150)} | {5000: "passages"}
    monkeypatch.setattr(p5, "LEAST", 10**9)
    how = {r.attempt_id: r.how for r in p5.cut_evidence(a, p).where("cut").collect()}
    assert how.get(1001) is None and how[5000] == "passages" and set(how.values()) == {"passages", "ending"}


def test_p5_complete_things_are_no_cuts(spark):
    text = "SECTION 2 LEAVE\n• Coach, library hours: $7,023\nStep 5 49,085 52,435\nApproved by the coach: ________\nThe board shall meet. It reads: “Apply to the coach.”"
    lines = [*text.split("\n")[:4], "The board shall meet.", "It reads: “Apply to the coach.”", "shall meet. It reads: “Apply to the coach.”"]
    a = attempts(spark, [(i, "a", x) for i, x in enumerate(lines)] + [(100, "a", "The board shall me"), (101, "a", "The board shall me..."), (102, "a", "Step 5 49,085 52,4")])
    got = {r.attempt_id: r.cut for r in p5.cut_evidence(a, passages(spark, [(1, "a", text)])).collect()}
    assert {i for i, c in got.items() if c} == {100, 101, 102}


def test_p5_short_and_unspaced_evidence(spark):
    text = "董事会应当在每年九月之前支付教师的保险费用。委员会负责审查。\nUnconditional reinstatement follows the hearing."
    rows = [(1, "a", text[:14]), (2, "a", text[:22]), (3, "a", "Unconditional reinsta"), (4, "a", "not discussed"), (5, "a", "None found"), (6, "a", " "), (7, "a", "not_discussed")]
    got = {r.attempt_id: r.cut for r in p5.cut_evidence(attempts(spark, rows), passages(spark, [(1, "a", text)])).collect()}
    assert got == {1: True, 2: False, 3: True}


# --- 6


@pytest.mark.parametrize("part", [200_000, 7])
def test_p6_equals_item_by_item(spark, monkeypatch, part):
    monkeypatch.setattr(p6, "PART", part)
    rng = random.Random(7)
    sizes = [(i, rng.choice([rng.randint(1, 60), rng.randint(1, 250), 17])) for i in range(400)]
    rows = p6.containers(spark.createDataFrame([*sizes, (1000, 0)], "doc_id long, n_tokens long"), 100).collect()
    used, pieces = {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.n_tokens))
    assert max(used.values()) <= 100
    assert all(sum(n for _, n in pieces[i]) == n for i, n in sizes) and 1000 not in pieces
    assert all(len(pieces[i]) == -(-n // 100) for i, n in sizes)
    items = sorted((n for ps in pieces.values() for _, n in ps), reverse=True)
    bins = []
    for n in items:
        fit = [i for i, left in enumerate(bins) if left >= n]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= n
        else:
            bins.append(100 - n)
    assert sorted(used.values()) == sorted(100 - left for left in bins)
    assert p6.containers(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_p6_tokens(spark):
    rows = [(1, "n", "hello world"), (2, "n", None), (3, "n", " \n"), (4, "n", "<|endoftext|> " * 3), (5, "n", "word " * 50_000)]
    got = {r.doc_id: r.n_tokens for r in p6.token_counts(documents(spark, rows)).collect()}
    assert got[1] == 2 and got.keys() == {1, 4, 5} and got[5] >= 50_000


# --- 7


def test_p7_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "of", "and"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 13, 30])))) for i in range(40)] + [(90, None), (91, "")]
    items.append((92, items[2][1]))
    docs = []
    for i in range(150):
        w = rng.choices(vocabulary, k=rng.choice([0, 5, 40, 200]))
        if i % 3 == 0:
            own = items[rng.randrange(40)][1].split()
            k = rng.choice([12, 13, 20])
            w[3:3] = [x.upper() + rng.choice(["", ",", " — "]) for x in own[:k]]
        docs.append((i, "n", " ".join(w)))
    docs += [(500, "n", None), (501, "n", ""), (None, "n", items[1][1])]
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    runs = lambda t: {tuple(w[k : k + 13]) for w in [words(t)] for k in range(len(w) - 12)}
    want = {(d, i) for d, _, t in docs if d is not None for i, x in items if runs(t) & runs(x)}
    it = spark.createDataFrame([(i, "s", x) for i, x in items], "item_id long, suite string, text string")
    for block in (500_000, 100):
        assert {tuple(r) for r in p7.leaks(documents(spark, docs), it, block).collect()} == want
    assert p7.leaks(documents(spark, docs), it.where("false")).count() == 0


# --- 8


def test_p8_tells_spam_from_entries(spark, monkeypatch):
    rng = random.Random(3)
    roles = "teacher coach counselor nurse steward aide".split()
    prose = [" ".join(f"The {rng.choice(roles)} shall {rng.choice(['file', 'keep', 'review'])} the {rng.choice(['roster', 'notice', 'report'])} of the {rng.choice(roles)} within {rng.randint(2, 90)} days." for _ in range(9)) for _ in range(300)]
    # the model must have seen such lists: every tenth text of prose is one
    prose[::10] = ["\n".join(f"“{rng.choice(roles).title()}” means a person who {rng.choice(['files', 'keeps'])} the {rng.choice(['roster', 'report', 'notice'])}." for _ in range(12)) for _ in prose[::10]]
    phrases = ["pay scale", "school jobs", "tutor near me", "lesson plan bundle", "grievance template"]
    spam = {1: ", ".join(rng.choices(phrases, k=60)), 2: "\n".join(f"https://www.x{rng.randint(1, 99)}.test/{rng.choice(phrases).replace(' ', '-')}" for _ in range(30)), 3: " ".join("#" + rng.choice(phrases).title().replace(" ", "") for _ in range(60)), 4: prose[0][:150] + "\n" + " | ".join(rng.choices(phrases, k=70))}
    fine = {11: "\n".join(f"{i} $4{i:02},300 $5{i:02},400" for i in range(10, 40)), 12: "\n".join(f"Old{i} School, room {i}, head coach, ext. {7000 + i}" for i in range(30)), 13: "\n".join(f"November {i} No school" for i in range(1, 30)), 14: prose[1] * 3 + "\nhttps://www.a.test/b\nhttps://www.c.test/d", 15: "", 16: None, 17: "\n".join(f"“Coach” means a person who files the {rng.choice(['roster', 'report'])}." for _ in range(20))}
    rows = [(i + 100, "n", t) for i, t in enumerate(prose)] + [(i, "n", t) for i, t in {**spam, **fine}.items()]
    got = {r.doc_id: r.share for r in p8.spam_shares(documents(spark, rows), passages(spark, [(i, "d", t) for i, t in enumerate(prose)])).collect()}
    assert {i for i, s in got.items() if s > 0.5} == set(spam)
    assert 16 not in got
    empty = documents(spark, rows).where("false")
    assert p8.spam_shares(empty, passages(spark, [])).count() == 0
    monkeypatch.setattr(p8, "thresholds", lambda texts, bits: (np.zeros(3, np.int64), np.full(3, p8.BINS * p8.TOP)))  # perplexity switched off
    assert {r.share for r in p8.spam_shares(documents(spark, rows), passages(spark, [(i, "d", t) for i, t in enumerate(prose)])).collect()} == {0.0}


def test_p8_roles_and_blocks():
    text, role, chars = p8.roles_of(["lesson plan kit, the lesson plan 9 room 4", "", "#Tag https://a.test/x"])
    names = [p8._ROLES[r] if r < p8.K else "-" for r in role]
    assert text.tolist() == [0] * 9 + [2] * 2 and chars.sum() == 52
    assert names == ["-"] * 9 + ["tag", "link"]  # fewer than SENTENCE words are entries
    _, role, _ = p8.roles_of(["lesson plan kit, the lesson plan is a good one"])
    assert [p8._ROLES[r] for r in role] == ["content", "again", "content", "function", "content", "again", "function", "function", "content", "content"]
    bits = np.ones(p8.K**p8.ORDER, np.float32)
    for n, want in ((3, [3]), (25, [25]), (37, [37]), (38, [25, 13]), (62, [25, 37])):
        _, words, cost, _, _ = p8.scored_blocks(["x " * 0, "#t " * n], bits)
        assert words.tolist() == want and (cost == 1).all()


# --- all of them on the driver's smallest tables


def test_queries_run_and_agree_with_sql(spark, data):
    from compare import connection, same

    from clauseloom.llm.registry import ORACLE_SQL, QUERIES

    con = connection(data)
    columns = {"p1_found": ["attempt_id", "passage_id"], "p2_found": ["passage_id_a", "passage_id_b"], "p3_found": ["passage_id"], "p4_found": ["passage_id", "line_no"], "p5_found": ["attempt_id"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}
    for name, make in QUERIES.items():
        df = make(spark, data)
        if name in columns:
            assert df.columns == columns[name] and {t for _, t in df.dtypes} == {"bigint"}
        if name in ORACLE_SQL:
            same(df, con, ORACLE_SQL[name])
        else:
            assert df.count() == df.distinct().count()
