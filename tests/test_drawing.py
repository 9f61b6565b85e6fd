import pytest
from pyspark.sql import functions as F

from quire.operators import assemble, drawing


def test_tokens_of_a_stream():
    data = b"q 1 0 0 1 5 6.5 cm /F1 12 Tf (a\\)(b) c) Tj [(x) -20 (y)] TJ /P <</MCID 0>> BDC 0.5 w % note\nBI /W 1 ID \x00\xffEI EI Q /Cs1 cs 0.1 0.2 sc"
    got = list(drawing.operators(data, {"Cs1": 2}))
    assert got[0] == ("q", []) and got[1] == ("cm", ["1", "0", "0", "1", "5", "6.5"]) and got[3] == ("Tj", ["(a\\)(b) c)"])
    assert ("TJ", ["[(x) -20 (y)]"]) in got and ("BDC", ["/P", "<</MCID 0>>"]) in got and ("w", ["0.5"]) in got
    assert got[-2:] == [("cs", ["/Cs1"]), ("sc", ["0.1", "0.2"])]


def test_operands_as_written():
    assert [drawing.written_operand(x) for x in ("5", "6.5", ".25", "/Na'me")] == ["5", "6.500000", "0.250000", "/Name"]


@pytest.mark.parametrize(("space", "n"), [("DeviceRGB", 3), (["ICCBased", {"N": 4}], 4), (["DeviceN", ["a", "b"]], 2), ("Unknown", None)])
def test_color_spaces(space, n):
    assert drawing.color_components(space) == n


def test_base_stream(spark):
    rows = [(1, 1, k, op, ["1", "2"], 2, kept) for k, (op, kept) in enumerate([("re", False), ("Tj", False), ("zz", False), ("S", True), ("EMC", False), ("f", False)])]
    got = drawing.base_stream(spark.createDataFrame(rows, "doc_id long, obj_id long, seq int, op string, args array<string>, nargs int, kept boolean")).first()
    assert got.ops == "1 2 re n S 1 2 f "


def test_form_tree_cuts_cycles(spark):
    one = [1.0, 0.0, 0.0, 1.0]
    shape = "doc_id long, parent long, form long, matrix array<double>"
    forms = spark.createDataFrame([(1, 1, 2, [*one, 5.0, 0.0]), (1, 2, 3, [*one, 1.0, 0.0]), (1, 3, 1, [*one, 0.0, 0.0])], shape)
    roots = spark.createDataFrame([(1, 9, 1, [*one, 10.0, 0.0])], "doc_id long, page long, form long, matrix array<double>")
    got = sorted((r.form, r.depth, r.matrix[4]) for r in drawing.form_tree(forms, roots).collect())
    assert got == [(1, 0, 10.0), (2, 1, 15.0), (3, 2, 16.0)]


def test_patches(spark):
    objects = spark.createDataFrame([(1, 1, "old1"), (1, 2, "old2"), (1, 3, "old3")], "doc_id long, obj_id long, ops string")
    patches = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2)], "doc_id long, obj_id long, ops string, seq long").union(assemble.blanked(spark.createDataFrame([(1, 2, 1)], "doc_id long, obj_id long, seq long")))
    got = {r.obj_id: (r.ops, r.patched) for r in assemble.apply_patches(objects, patches).collect()}
    assert got == {1: ("b", True), 2: ("", True), 3: ("old3", False)}


def test_patch_texts(spark):
    got = spark.range(1).select(drawing.page_patch(F.lit(None).cast("string"), F.lit(0), F.lit(5), F.lit("BT ET ")).alias("page"), drawing.form_patch(F.lit("re "), F.array(*[F.lit(x) for x in (2.0, 0.0, 0.0, 2.0, 4.0, 6.0)]), F.lit("BT ET ")).alias("form")).first()
    assert got.page == "q Q 1 0 0 1 0 5 cm BT ET "
    assert got.form == "q re Q 0.5 -0.0 -0.0 0.5 -2.0 -3.0 cm BT ET "


def test_interleaved(spark):
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, pageno int, ops string")
    got = assemble.interleaved(pages, pages.withColumn("ops", F.upper("ops"))).orderBy("position").collect()
    assert [(r.position, r.side, r.ops) for r in got] == [(0, "original", "a"), (1, "translated", "A"), (2, "original", "b"), (3, "translated", "B")]
    doc = assemble.document_pages(assemble.interleaved(pages, pages)).first()
    assert [p.position for p in doc.pages] == [0, 1, 2, 3]


def test_form_tree_of_any_depth(spark):
    from quire.operators import drawing

    unit = [1.0, 0.0, 0.0, 1.0, 1.0, 0.0]
    forms = spark.createDataFrame([(1, k, k + 1, unit) for k in range(40)], "doc_id long, parent long, form long, matrix array<double>")
    roots = spark.createDataFrame([(1, 0, 0, unit)], "doc_id long, page int, form long, matrix array<double>")
    got = sorted((r.depth, r.form, r.matrix[4]) for r in drawing.form_tree(forms, roots).collect())
    assert got == [(k, k, k + 1.0) for k in range(41)]
