from clauseloom.plans import QUERIES, tables  # noqa: F401


def reader(frames):
    return lambda name: frames[name]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_of_all_scripts(spark):
    pairs = [("abc", "abd"), ("el comité podrá", "el comite podra"), ("“just cause”", '"just cause"'), ("Отдел", "Отдела"), ("a😀b", "ab"), ("x", "日本語"), ("same é", "same é")]
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)] + [(90, None, "é"), (91, "é", None), (92, "é", " "), (93, "", "é"), (1, *pairs[1])]
    got = {r.attempt_id: r.cer for r in tables.edit_distance(reader({"attempts": spark.createDataFrame(rows, "attempt_id long, evidence string, alt_evidence string")})).collect()}
    assert got == {i: round(distance(a, b) / len(b), 6) for i, (a, b) in enumerate(pairs)}
    assert "edit_distance" in QUERIES


def test_grid_keeps_every_lane(spark):
    wide = "Step 1 " + " ".join(f"4{i},000" for i in range(7))
    docs = spark.createDataFrame([(1, wide), (2, "Step 1 50,000 51,000"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r.asDict() for r in tables.grid_pivot(reader({"documents": docs})).collect()}
    assert [rows[1][f"lane_{i}"] for i in range(1, 8)] == [40_000 + 1000 * i for i in range(7)]
    assert rows[2]["lane_2"] == 51_000 and rows[2]["lane_7"] is None
    for few in (docs.where("doc_id = 2"), docs.where("false")):
        assert tables.grid_pivot(reader({"documents": few})).columns == ["doc_id", "kind", "step", *(f"lane_{i}" for i in range(1, 6))]


def test_identical_columns_are_named(spark):
    lines = [(1, "A", 7), (1, "A", 8), (1, "A", 8), (2, "R", 8), (2, "R", 7), (2, "A", 7), (10, "A", 7), (3, "N", 9)]
    got = tables.identical_column_classes(reader({"lineitem": spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_suppkey long")})).collect()
    assert {(r.l_orderkey, r.l_returnflag): (r.class_id, r.members, r.n_values, r.n_rows) for r in got} == {
        (1, "A"): ("1/A", 2, 2, 3), (2, "R"): ("1/A", 2, 2, 2), (2, "A"): ("10/A", 2, 1, 1), (10, "A"): ("10/A", 2, 1, 1), (3, "N"): ("3/N", 1, 1, 1)
    }
