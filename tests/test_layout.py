"""Layouts: lines are dealt by page before anything is done to them."""

from taxloom.operators import layout
from taxloom.plans import documents, texts

LINE = "doc_id int, line int, x0 double, x1 double, y0 double, y1 double, text string, region string"


def test_lines_are_dealt_by_page(spark):
    lines = spark.createDataFrame([(1, 0, 10.0, 40.0, 5.0, 15.0, "RUC: 1790011674001", "top_left")], LINE)
    for found in (layout.checked_values(lines, ["doc_id"], {"rucEmisor": ["RUC"]}), layout.layout_record(lines, ["doc_id"])):
        assert "RepartitionByExpression [doc_id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert layout.checked_values(lines, ["doc_id"], {"rucEmisor": ["RUC"]}).first().value == "1790011674001"


def test_words_become_lines_in_one_step(spark):
    words = [(1, 10.0, 5.0, "b"), (1, 1.0, 5.5, "a"), (1, 1.0, 30.0, ""), (1, 1.0, 60.0, "c"), (1, 9.0, 61.0, None), (1, 20.0, 62.5, "d"), (2, 3.0, 1.0, "e")]
    page = spark.createDataFrame([(d, x, y, x + 5, y + 10, t, 600.0, 800.0) for d, x, y, t in words], "doc_id int, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double")
    for tolerance in (None, 3.0):
        found = layout.word_lines(page, ["doc_id"], tolerance)
        got = sorted((r.doc_id, r.line, r.text, r.x0, r.y0, r.x1, r.y1, r.region) for r in found.collect())
        assert got == [(1, 0, "a b", 1.0, 5.0, 15.0, 15.5, "top_left"), (1, 2, "c d", 1.0, 60.0, 25.0, 72.5, "top_left"), (2, 0, "e", 3.0, 1.0, 8.0, 11.0, "top_left")]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("slice(") == 1 and plan.count("array_join(") == 1  # a line is made once, not for each of its columns


PLACED = [
    (1, 0, 10.0, 60.0, 100.0, "VALOR TOTAL"), (1, 1, 90.0, 120.0, 102.5, "7,50"), (1, 2, 70.0, 80.0, 97.5, "$ 1.234,50"), (1, 3, 10.0, 40.0, 112.0, "9"), (1, 4, 10.0, 60.0, 300.0, "Importe Total"), (1, 5, 80.0, 99.0, 300.0, "3"),
    (1, 6, 10.0, 60.0, 200.0, "Identificación"), (1, 7, 9.0, 60.0, 206.0, "no"), (1, 8, 12.0, 60.0, 212.0, "0912345678"), (1, 9, 10.0, 60.0, 211.0, "abc"), (1, 10, 10.0, 60.0, 400.0, "FORMA DE PAGO"), (1, 11, 90.0, 99.0, 400.0, "Efectivo - 5.00"),
    (1, 12, 10.0, 60.0, 500.0, None), (1, 13, 10.0, 60.0, None, "RUC 1790011674001 No. 001-002-000000003"), (2, 0, 10.0, 60.0, 100.0, "AMBIENTE"), (2, 1, 10.0, 60.0, 112.5, "PRODUCCION"), (3, 0, 10.0, 60.0, 1.0, "1" * 49),
]


def test_record_meets_only_what_is_near(spark):
    """What is beside or below a label is found within its range of heights, without a join of a page's lines with its labels."""
    lines = spark.createDataFrame(PLACED, "doc_id int, line int, x0 double, x1 double, y0 double, text string")
    found = layout.layout_record(lines, ["doc_id"])
    assert sorted((r.doc_id, r.field, r.value) for r in found.collect()) == [
        (1, "establecimiento", "001"), (1, "formaPago", "Efectivo"), (1, "formaPagoMonto", "5.00"), (1, "identificacionComprador", "abc"), (1, "numeroComprobante", "001-002-000000003"), (1, "puntoEmision", "002"),
        (1, "secuencial", "000000003"), (1, "valorTotal", "1234.50"), (3, "claveAcceso", "1" * 49),
    ]
    assert sorted((r.doc_id, r.field, r.value) for r in layout.label_values(lines, ["doc_id"], {"a": ["AMBIENTE"], "v": ["VALOR TOTAL"]}).collect()) == [(1, "v", "$ 1.234,50")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


def test_boxes_are_not_stored(spark, sf):
    """The boxes of a page go through its layout as they are made; only the given tables are read."""
    for query in (texts.layout_record, texts.layout_first):
        files = query(spark, sf).inputFiles()
        assert files and all(f"{sf}/" in f for f in files)


EVIDENCE = [
    (1, 0, 10.0, 60.0, 100.0, 110.0, "FECHA EMISION", "a"), (1, 1, 90.0, 99.0, 103.5, 113.0, "right far", "a"), (1, 2, 80.0, 99.0, 103.5, 113.0, "right near", "a"), (1, 3, 10.0, 60.0, 111.0, 121.0, "below", "a"),
    (1, 4, 10.0, 60.0, 300.0, 310.0, "RUC: 1790011674001", "a"), (1, 5, 200.0, 260.0, 500.0, 510.0, "RUC", "b"), (1, 6, 10.0, 60.0, 528.0, 538.0, "same region", "b"), (1, 7, 10.0, 60.0, 529.0, 539.0, "too far", "b"),
    (2, 0, 10.0, 60.0, 100.0, 110.0, "RUC", "a"), (2, 1, 95.0, 99.0, 132.0, 142.0, "aside", "b"), (2, 2, 90.0, 99.0, 131.0, 141.0, "below", "b"), (2, 3, 20.0, 60.0, 100.0, 110.0, None, "a"), (3, 0, 1.0, 2.0, 3.0, 4.0, "RUC", "a"),
]


def test_evidence_is_found_without_a_join(spark):
    """A label line without a value of its own goes through its page's lines, which are gathered once."""
    lines = spark.createDataFrame(EVIDENCE, "doc_id int, line int, x0 double, x1 double, y0 double, y1 double, text string, region string")
    found = layout.nearby_values(lines, {"fecha": ["FECHA EMISION"], "ruc": ["RUC"]}, ["doc_id"])
    assert sorted((r.doc_id, r.line, r.field, r.value, r.confidence) for r in found.collect()) == [
        (1, 0, "fecha", "right near", 0.92), (1, 4, "ruc", "1790011674001", 0.89), (1, 5, "ruc", "same region", 0.68), (2, 0, "ruc", "below", 0.82),
    ]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_checked_lines_are_dealt_once(spark, sf):
    plan = documents.checked_fields(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
