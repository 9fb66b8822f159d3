"""Report tables: written, found, read back, named."""

import datetime

import pytest
from pyspark.sql import functions as F

from taxloom.operators import combine
from taxloom.plans import documents
from taxloom.sources import reports


def test_bundle(spark, tmp_path):
    full = spark.createDataFrame([("a", 1)], "clave string, n int")
    tables = {"cabecera": full, "detalle": full.filter("false"), "retenciones": full.filter("false"), "errores": full}
    assert reports.write_bundle(tables, str(tmp_path)) == ["cabecera", "detalle", "errores"]
    other = spark.createDataFrame([("b", "x")], "clave string, estado string")
    other.write.parquet(str(tmp_path / "otro"))
    back = reports.read_reports(spark, [str(tmp_path / "cabecera"), str(tmp_path / "otro")])
    assert sorted(map(tuple, back.select("clave", "estado").collect())) == [("a", ""), ("b", "x")]


def test_partitions_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("a", "Emitidos", "01", 2024, 1), ("b", "Recibidos", "01", 2024, 2)], "clave string, origen string, cod_doc string, anio int, mes int")
    reports.write_by_period(df, str(tmp_path / "r"))
    found = reports.find_reports(spark.read.parquet(str(tmp_path / "r")), origen="Recibidos", mes=2)
    assert [r.clave for r in found.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(origen" in found._jdf.queryExecution().toString()


def test_many_reports_are_one_scan(spark, tmp_path):
    """Reports with different columns, some in folders: one scan, first-seen order, and only the files of the folders asked for."""
    paths = []
    for i in range(6):
        df = spark.createDataFrame([(f"k{i}", 2020 + i % 3, i)], f"clave string, anio int, n{i % 2} int")
        df = df.withColumn("extra", F.lit("x")) if i == 4 else df
        paths.append(f"{tmp_path}/r{i}")
        (df.write.partitionBy("anio") if i else df.drop("anio").write).parquet(paths[-1])
    both = reports.read_reports(spark, paths, folders=["anio"])
    assert both.columns == ["clave", "n0", "n1", "extra", "anio"]
    assert sorted((r.clave, r.anio, r.extra) for r in both.collect()) == [("k0", None, ""), ("k1", "2021", ""), ("k2", "2022", ""), ("k3", "2020", ""), ("k4", "2021", "x"), ("k5", "2022", "")]
    assert both._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = reports.find_reports(both, anio="2021")
    assert sorted(r.clave for r in found.collect()) == ["k1", "k4"]
    plan = found._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert plan.metrics().apply("numFiles").value() == 2


@pytest.mark.parametrize(("name", "title"), [("clave_acceso", "Clave de acceso"), ("FORMA_PAGO_2", "Forma de pago 2"), ("IVA_12_BASE", "Impuesto al valor agregado 12% base imponible"), ("ICE_VALOR", "Impuesto a los consumos especiales valor"), ("IMP_9_1_VALOR", "Impuesto codigo 9 porcentaje 1 valor"), ("UNIDAD_TIEMPO_3", "Unidad de tiempo del pago 3"), ("otra_cosa", "Otra cosa")])
def test_titles(name, title):
    assert reports.title(name) == title


def test_periods():
    d = datetime.date
    assert reports.period(2024) == (d(2024, 1, 1), d(2024, 12, 31))
    assert reports.period(2024, 2) == (d(2024, 2, 1), d(2024, 2, 29))
    assert reports.period(2024, 2, 5) == (d(2024, 2, 5), d(2024, 2, 5))
    assert reports.period(2024, 2, last_month=4) == (d(2024, 2, 1), d(2024, 4, 30))
    assert [reports.period_name(2024), reports.period_name(2024, 2), reports.period_name(2024, 2, 5), reports.period_name(2024, 2, last_month=4)] == ["2024", "202402", "20240205", "202402-04"]


def test_fallback_keeps_each_key_once(spark):
    main = spark.createDataFrame([("a", 1, "xml"), ("", 2, "xml")], "k string, o int, s string")
    more = spark.createDataFrame([("a", 3, "pdf"), ("b", 5, "pdf"), ("b", 4, "pdf"), ("", 6, "pdf"), (None, 7, "pdf")], "k string, o int, s string")
    got = combine.with_fallback(main, more, "k", "o").collect()
    assert sorted((r.k or "", r.o) for r in got) == [("", 2), ("", 6), ("", 7), ("a", 1), ("b", 4)]


def test_reconciliation(spark):
    one = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    two = spark.createDataFrame([("b",), ("c",)], "k string")
    rows = combine.reconciled(one, two, ["k"])
    assert sorted(map(tuple, rows.collect())) == [("a", 1, 0), ("b", 1, 1), ("c", 0, 1)]
    assert tuple(combine.completeness(rows.withColumn("g", F.lit(1)), ["g"]).first()) == (1, 2, 2, 1, False)
    empty = combine.completeness(combine.reconciled(one.filter("false"), two.filter("false"), ["k"]).withColumn("g", F.lit(1)), ["g"])
    assert empty.collect() == []


def test_unique_names(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "n string, o int")
    assert [r.nombre_unico for r in combine.numbered_names(df, "n", ["o"]).orderBy("o").collect()] == ["x", "x_1", "y"]


def test_streams_read_a_folder_in_any_order(spark, sf, tmp_path):
    """Events in part files, the latest first, give the same earliest times and counters as the one file."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy(F.desc("ts")).coalesce(1).write.option("maxRecordsPerFile", 100).parquet(f"{tmp_path}/events.parquet")
    wanted = sorted(map(tuple, events.groupBy("user_id").agg(F.min("ts")).collect()))
    assert sorted(map(tuple, documents.unseen_users(spark, str(tmp_path)).collect())) == wanted
    assert documents.daily_counters(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == events.count()


def test_payment_pivot(spark):
    from taxloom.operators import summary

    rows = [("a", i, f"0{i % 10}", float(i), f"{i}0", "dias") for i in range(1, 14)] + [("b", 1, "20", 5.0, None, None)]
    found = {r.clave: r for r in summary.payment_pivot(spark.createDataFrame(rows, "clave string, pago_num int, forma_pago string, pago double, plazo string, unidad_tiempo string")).collect()}
    assert [found["a"][f"TOTAL_PAGO_{i}"] for i in range(1, 14)] == [float(i) for i in range(1, 14)] and found["a"].N_PAGOS == 13
    assert (found["a"].FORMA_PAGO_13, found["a"].PLAZO_13, found["a"].UNIDAD_TIEMPO_13) == ("03", "130", "dias")
    assert (found["b"].FORMA_PAGO_1, found["b"].TOTAL_PAGO_1, found["b"].PLAZO_1, found["b"].FORMA_PAGO_2) == ("20", 5.0, None, None)


def test_fallback_in_one_pass(spark):
    from taxloom.operators import combine

    schema = "clave string, ruta string"
    main = spark.createDataFrame([("a", "1"), ("a", "2"), ("", "3"), (None, "4")], schema)
    other = spark.createDataFrame([("a", "5"), ("b", "7"), ("b", "6"), (" ", "8"), ("", "9"), (None, "10")], schema)
    found = sorted(r.ruta for r in combine.with_fallback(main, other, "clave", "ruta").collect())
    assert found == sorted(["1", "2", "3", "4", "6", "8", "9", "10"])
