"""Documents in folders: only the folders of the selection are listed, files are read once, consolidated ones not at all."""

import datetime

import pytest

from taxloom.plans import documents
from taxloom.sources import files, xml

D = datetime.date
TREE = {
    "Recibidos/Factura/2024/Enero/XML/factura__20240115__a.xml": "a",
    "Recibidos/Factura/2024/Enero/XML/factura__20240131__b.xml": "b",
    "Recibidos/Factura/2024/Febrero/XML/factura__20240201__c.xml": "c",
    "Recibidos/Factura/2024/Febrero/XML/sin_fecha.xml": "d",
    "Recibidos/Factura/2024/Marzo/XML/factura__20240301__e.xml": "e",
    "Emitidos/No Autorizados/Nota de credito/2024/Enero/XML/nota_de_credito__20240105__f.xml": "f",
    "Emitidos/Autorizados/Factura/2024/Enero/XML/factura__20240106__g.xml": "g",
    "Emitidos/Autorizados/Factura/2024/Enero/PDF/factura__20240106__h.xml": "h",
    "179/2024/Enero/07/01_Factura/XML/i.xml": "i",
    "179/2024/Febrero/29/02_Nota de credito/XML/j.xml": "j",
    "Consolidados/Factura/2024/Enero/XML/factura__20240115__k.xml": "k",
    "Recibidos/Factura/2023/Enero/XML/factura__20230115__l.xml": "l",
    "Recibidos/Factura/2024/Enero/XML/notas.txt": "m",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, value in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(value)
    return str(root)


from pyspark.sql import functions as F


def values(df):
    return "".join(sorted(r.value for r in df.collect()))


def test_months():
    assert files.months(D(2023, 11, 30), D(2024, 2, 1)) == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]
    assert files.months(D(2024, 2, 3), D(2024, 2, 3)) == [(2024, 2)]


def test_folders():
    assert files.outermost(["/b/c", "/a/", "/b", "/a", "/bc", "/b/c/d"]) == ["/a", "/b", "/bc"]


@pytest.mark.parametrize(
    ("start", "end", "options", "wanted"),
    [
        (D(2024, 1, 1), D(2024, 1, 31), {}, "abfgi"),
        (D(2024, 1, 10), D(2024, 1, 31), {}, "ab"),
        (D(2024, 1, 1), D(2024, 2, 29), {}, "abcdfgij"),
        (D(2024, 2, 1), D(2024, 2, 28), {}, "c"),
        (D(2024, 1, 1), D(2024, 2, 29), {"kind": "factura"}, "abcgi"),
        (D(2024, 1, 1), D(2024, 12, 31), {"origin": "emitidos", "status": "no_autorizados"}, "f"),
        (D(2023, 1, 1), D(2023, 12, 31), {}, "l"),
        (D(2020, 1, 1), D(2020, 12, 31), {}, ""),
    ],
)
def test_period(spark, tree, start, end, options, wanted):
    assert values(files.scan_period(spark, [tree, f"{tree}/Recibidos", tree + "/"], start, end, **options)) == wanted


def test_only_the_folders_are_listed(spark, tree):
    found = files.scan_period(spark, tree, D(2024, 2, 1), D(2024, 2, 29))
    assert {f.split("/2024/")[1].split("/")[0] for f in found.inputFiles()} == {"Febrero"} and len(found.inputFiles()) == 3


def test_archive(spark, tree, tmp_path):
    root = f"{tmp_path}/archive"
    all_files = xml.scan(spark, tree)
    files.archive(all_files.unionByName(all_files), root)
    files.archive(spark.createDataFrame([("/x/Emitidos/Autorizados/Factura/2025/Mayo/XML/factura__20250501__z.xml", "z")], "path string, value string"), root, repeated=False)
    assert values(files.archived(spark, root, D(2024, 1, 1), D(2024, 1, 31), kind="factura")) == "abghi"
    assert values(files.archived(spark, root, D(2024, 1, 1), D(2024, 1, 31), "emitidos", "no_autorizados")) == "f"
    assert values(files.archived(spark, root, D(2024, 2, 1), D(2024, 2, 28))) == "c"
    assert values(files.archived(spark, root, D(2024, 1, 1), D(2025, 12, 31))) == "abcdefghijz"
    assert files.archived(spark, root, D(2021, 1, 1), D(2021, 1, 31)).collect() == []
    found = files.archived(spark, root, D(2024, 2, 1), D(2024, 3, 31), origin="recibidos")
    listed = found.inputFiles()
    assert listed and all("/origen=recibidos/" in f and ("/mes=02/" in f or "/mes=03/" in f) for f in listed)
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "origen=" in scan and "mes={" not in scan.replace("mes={02", "")


def test_a_large_list_is_not_one_task(spark):
    """The lines of one file meet its delimiter in several partitions, also when nothing is broadcast."""
    from taxloom.sources import listings

    rows = spark.range(5000).selectExpr("'a.txt' AS path", "concat('Factura;', lpad(id, 49, '0'), ';01/02/2024') AS value")
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        found = listings.seed_keys(rows)
        parts = found.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 5000


def test_filed_documents_are_made_once(spark, sf):
    """Documents get their paths where they are made; a join with the header by name dealt all their texts once more."""
    plan = documents.filed_documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_") == 1


def test_archived_documents_are_dealt_once(spark):
    """Repeated paths go where their folder is written; a folder's paths are dealt to more tasks where there are more."""
    paths = [f"/x/Emitidos/Autorizados/Factura/2025/Mayo/XML/factura__202505{i % 28 + 1:02d}__{i}.xml" for i in range(300)]
    docs = spark.createDataFrame([(p, f"{p}!") for p in paths * 2] + [(None, "none")], "path string, value string")
    found = files._dealt(docs, True)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r.path, r.value) for r in found.collect()) == sorted((p, f"{p}!") for p in paths)
    name, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set(name, "256")
        shared = files._dealt(docs, True)
        assert shared.count() == len(paths)
        shares = shared._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "pmod(xxhash64(path" in shares and ", 4)" in shares
