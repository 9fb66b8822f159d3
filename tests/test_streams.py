"""Streams: documents stored once across restarts, and batches that are seen whole or not at all."""

import random

import pytest

from taxloom.sources import reports, xml
from taxloom.streaming import ingest

HEAD = "<infoTributaria><ruc>1790011674001</ruc><claveAcceso>{key}</claveAcceso><codDoc>01</codDoc><estab>001</estab><ptoEmi>002</ptoEmi><secuencial>3</secuencial></infoTributaria>"


def document(key, total):
    return f"<factura>{HEAD.format(key=key)}<infoFactura><fechaEmision>03/02/2024</fechaEmision><importeTotal>{total}</importeTotal></infoFactura></factura>"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ingest.ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def arrive(folder, names, content):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / n).write_text(content[n])


def test_each_key_once(rocks, tmp_path):
    """Files arrive in any order, some keys again and again, also after a restart; the first of each key stays."""
    draw = random.Random(7)
    content = {f"f{i:03d}.xml": document(f"K{draw.randrange(12)}", i) for i in range(40)}
    content |= {"z1.xml": "<factura/>", "z2.xml": "<factura/>"}
    names = sorted(content)
    draw.shuffle(names)
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    arrive(inbox, names[:20], content)
    ingest.ingest(rocks, str(inbox), out, check, files_per_batch=7, once=True).awaitTermination()
    first = {r.clave: (r.archivo_xml, float(r.importe_total)) for r in ingest.committed(rocks, out, "cabecera").collect()}
    assert set(first) == {content[n].split("claveAcceso>")[1][:-2] for n in names[:20] if "claveAcceso" in content[n]}
    arrive(inbox, names[20:], content)
    ingest.ingest(rocks, str(inbox), out, check, files_per_batch=7, once=True).awaitTermination()
    rows = ingest.committed(rocks, out, "cabecera").collect()
    found = {r.clave: (r.archivo_xml, float(r.importe_total)) for r in rows}
    assert len(rows) == len(found) == len({c.split("claveAcceso>")[1] for c in content.values() if "claveAcceso" in c})
    assert all(found[k] == v for k, v in first.items())
    assert all(content[f] == document(k, int(total)) for k, (f, total) in found.items())
    assert ingest.manifest(rocks, out).agg({"errores": "sum"}).first()[0] == 2


def test_one_batch_keeps_the_smallest_path(rocks, tmp_path):
    arrive(tmp_path / "in", ["b.xml", "a.xml", "c.xml"], {"a.xml": document("K", 1), "b.xml": document("K", 2), "c.xml": document("L", 3)})
    ingest.ingest(rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    assert sorted((r.clave, r.archivo_xml) for r in ingest.committed(rocks, str(tmp_path / "out"), "cabecera").collect()) == [("K", "a.xml"), ("L", "c.xml")]


def test_needs_a_store_for_many_keys(spark):
    with pytest.raises(RuntimeError, match="providerClass"):
        ingest.stored_once(spark.createDataFrame([("k", "p", "v")], ingest.STORED))


def test_a_batch_that_dies_is_invisible(spark, tmp_path, monkeypatch):
    """It dies after some of its tables were written; the next run stores the batch whole, once."""
    inbox, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    arrive(inbox, ["a.xml"], {"a.xml": document("A", 1)})
    ingest.ingest(spark, str(inbox), out, check).awaitTermination()
    arrive(inbox, ["b.xml", "c.xml"], {"b.xml": document("B", 2), "c.xml": "<broken>"})
    whole = xml.report_bundle
    monkeypatch.setattr(reports.xml, "report_bundle", lambda parsed: dies(whole, parsed))
    with pytest.raises(Exception, match="died"):
        ingest.ingest(spark, str(inbox), out, check).awaitTermination()
    monkeypatch.undo()
    assert [r.clave for r in ingest.committed(spark, out, "cabecera").collect()] == ["A"]
    assert len([p for p in (tmp_path / "out/datos").glob("lote=1-*/cabecera")]) == 1
    ingest.ingest(spark, str(inbox), out, check).awaitTermination()
    assert sorted(r.clave for r in ingest.committed(spark, out, "cabecera").collect()) == ["A", "B"]
    assert sorted((r.lote, r.documentos, r.errores) for r in ingest.manifest(spark, out).collect()) == [(0, 1, 0), (1, 2, 1)]
    assert ingest.committed(spark, out, "errores").count() == 1


def dies(whole, parsed):
    class Dead:
        write = property(lambda self: (_ for _ in ()).throw(RuntimeError("died")))

    return {"cabecera": whole(parsed)["cabecera"], "detalle": Dead()}


def test_counts_are_the_tables(spark, tmp_path):
    """What Spark counts while it writes the parsed documents is what the tables have."""
    from test_xml import FILES

    docs = spark.createDataFrame(list(FILES.items()), "path string, value string")
    counts = reports.write_parsed(xml.parse(docs), str(tmp_path / "r"))
    tables = xml.report_bundle(spark.read.parquet(str(tmp_path / "r/leidos")))
    assert counts == {name: t.count() for name, t in tables.items()}
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == sorted(["leidos", *(n for n, c in counts.items() if c or n in reports.ALWAYS)])


def test_keys_are_remembered_without_python(rocks, tmp_path):
    """The state is Spark's own deduplication: no Python is called key by key."""
    stream = rocks.readStream.schema(ingest.STORED).parquet(str(tmp_path))
    plan = ingest.stored_once(stream)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan


def test_first_paths(spark):
    import pyarrow as pa

    rows = [("k", "k", "b", "1"), (None, None, None, "2"), ("k", "k", "a", "3"), ("", "", "z", "4"), ("m", "m", None, "5"), (None, None, None, "6"), ("m", "m", "c", "7")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("_key", "clave", "path", "value"), r, strict=True)) for r in part], schema=pa.schema([(c, pa.string()) for c in ("_key", "clave", "path", "value")])) for part in (rows[:3], rows[3:])]
    assert sorted(v for b in ingest._first_paths(iter(batches)) for v in b["value"].to_pylist()) in (["2", "3", "4", "7"], ["3", "4", "6", "7"])


def test_arrivals_are_written_as_they_are_made(spark, sf, tmp_path, monkeypatch):
    """Documents that arrive again have files of their own, made from those that are there; two batches store each key once."""
    from taxloom.plans import documents

    monkeypatch.setattr(documents, "scratch", lambda spark: str(tmp_path))
    stored = documents.stored_once(spark, sf)
    assert stored.count() == stored.select("clave").distinct().count() == 1470
    arrived = spark.read.parquet(str(tmp_path / "llegados")).selectExpr("_metadata.file_name f", "path like 'otra/%' again")
    assert arrived.filter("again").count() > 0 and arrived.groupBy("f").agg({"again": "count"}).count() == arrived.distinct().count()
    assert len(ingest.manifest(spark, str(tmp_path / "out")).collect()) == 2
