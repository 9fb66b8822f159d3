"""Column functions on odd inputs."""

import datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxloom import catalogs as K
from taxloom.functions import amounts, dates, keys, text


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_decimal(spark):
    inputs = ["12.5", "1.234,56", "1,234.56", " 7 ", "abc", "", None, "1,5", "-3,25", "1.234.567,8"]
    strict = values(spark, lambda c: amounts.decimal(c), inputs)
    assert [None if x is None else float(x) for x in strict] == [12.5, 1234.56, 1234.56, 7.0, None, None, None, 1.5, -3.25, 1234567.8]
    compat = values(spark, lambda c: amounts.decimal(c, compat=True), inputs)
    assert float(compat[2]) == 1.23456 and float(compat[1]) == 1234.56
    assert values(spark, amounts.amount, ["x"]) == [Decimal("0.000000")]


def test_dates(spark):
    inputs = ["03/02/2024", "03/02/2024 10:11:12", "03/02/2024 10:11", "2024-02-03", "31/02/2025", "", None, "x"]
    got = values(spark, dates.timestamp, inputs)
    assert [None if x is None else x.date() for x in got] == [datetime.date(2024, 2, 3)] * 4 + [None] * 4
    assert values(spark, dates.day_first, ["a 03-02-2024 b", "03/02/2024 10:11", "nada"]) == ["03/02/2024", "03/02/2024 10:11:00", ""]
    assert values(spark, dates.month_number, ["Marzo", "marzo ", "3", "13", "SEPTIEMBRE", "x", None]) == [3, 3, 3, None, 9, None, None]
    assert [r and tuple(r) for r in values(spark, dates.period, ["202403", "20240315", "15032024", "209999", "x"])] == [(2024, 3, None), (2024, 3, 15), (2024, 3, 15), None, None]


def mod11(digits):
    total = sum(int(d) * (2 + i % 6) for i, d in enumerate(reversed(digits)))
    rest = 11 - total % 11
    return {11: "0", 10: "1"}.get(rest, str(rest))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("0123456789", min_size=48, max_size=48), min_size=5, max_size=5))
def test_access_key(spark, bodies):
    good = [b + mod11(b) for b in bodies]
    flipped = [b + str((int(mod11(b)) + 1) % 10) for b in bodies]
    assert values(spark, keys.access_key, good + flipped + ["", "123"]) == good + [""] * 7


def test_keys(spark):
    key = "1" * 49
    assert values(spark, keys.find_access_key, [f"a {key} b", f"{key}1", f"{key[:20]} {key[20:]}", ""]) == [key, "", key, ""]
    assert values(spark, keys.parse_series, ["001-002-3", "No 001002000000003", "x", ""]) == ["001-002-000000003", "001-002-000000003", "", ""]
    assert values(spark, keys.yes_no, ["si", "Obligado: NO", None, "x"]) == ["SI", "NO", "", ""]
    assert values(spark, keys.id_type, ["1790011674001", "1712345678", "x", None]) == ["04", "05", "", ""]
    assert values(spark, keys.document_type, ["Nota de Crédito", "FACTURAS", "Guías de remisión", None]) == ["notas_de_credito", "facturas", "guia_de_remision", ""]


def test_text(spark):
    assert values(spark, text.slug, ["Ñandú & Café", None, "--"]) == ["nandu_cafe", "", ""]
    assert values(spark, text.strip_html, ["<p>a&nbsp;&amp;<b>b</b></p>", None]) == ["a & b", ""]
    assert values(spark, text.party_name, ["Ana", "03/02/2024", "1.5", "", None]) == ["Ana", "", "", "", ""]
    assert values(spark, lambda c: text.cut_at(c, ["fecha", "ruc"]), ["Ana RUC 1 fecha", "Ana"]) == ["Ana", "Ana"]
    assert values(spark, lambda c: text.after_label(c, ["total"]), ["TOTAL: 5", "x"]) == ["5", ""]
    assert values(spark, text.is_present, ["x", "N/A", " ", "Sin dato"]) == [True, False, False, False]


@pytest.mark.parametrize(("code", "rate", "slug"), [("2", "0", "IVA_0"), ("2", "7", "EXENTO_IVA"), ("2", "9", "IVA_9"), ("3", "x", "ICE"), ("5", None, "IRBPNR"), ("9", "", "IMP_9_0")])
def test_tax_slug(spark, code, rate, slug):
    df = spark.createDataFrame([(code, rate)], "c string, r string")
    assert df.select(K.tax_slug(F.col("c"), F.col("r"))).first()[0] == slug


def test_labels(spark):
    """Marked letters lose their marks, other letters go, ASCII's own upper case is taken."""
    given = ["Dirección Matriz:", "r.u.c._1", "ß ı ſ x", "ÑANDÚ\t\x00é", None, " a-b ", "naïve \U0001f600z"]
    label = text.upper_label(F.col("c"))
    assert values(spark, text.upper_label, given) == ["DIRECCION MATRIZ", "R U C 1", "X", "NANDU E", "", "A B", "NAIVE Z"]
    assert "upper" in str(label) and "abcdefghijklmnopqrstuvwxyz" not in str(label)
