"""Hand-written documents: both envelopes, both withholding versions, broken ones."""

import html
import json

import pytest

from taxloom.operators import layout
from taxloom.plans import documents, star
from taxloom.sources import listings, xml
from taxloom.streaming import ingest

HEAD = "<infoTributaria><ambiente>2</ambiente><ruc>1790011674001</ruc><claveAcceso>{key}</claveAcceso><codDoc>{cod}</codDoc><estab>001</estab><ptoEmi>002</ptoEmi><secuencial>000000003</secuencial></infoTributaria>"


def invoice(key="K1", total="1.234,56", tag="factura", cod="01", node="infoFactura"):
    return (
        f"<{tag} version='1.0.0'>{HEAD.format(key=key, cod=cod)}<{node}><fechaEmision>03/02/2024</fechaEmision><razonSocialComprador>Ana</razonSocialComprador>"
        f"<importeTotal>{total}</importeTotal><valorModificacion>9,5</valorModificacion><totalConImpuestos><totalImpuesto><codigo>2</codigo><codigoPorcentaje>4</codigoPorcentaje><baseImponible>100</baseImponible><valor>15</valor></totalImpuesto></totalConImpuestos></{node}>"
        "<detalles><detalle><codigoInterno>A</codigoInterno><descripcion>uno</descripcion><cantidad>2</cantidad></detalle><detalle><codigoPrincipal>B</codigoPrincipal><descripcion>dos</descripcion></detalle></detalles>"
        f"<infoAdicional><campoAdicional nombre='mail'>x@y.z</campoAdicional></infoAdicional></{tag}>"
    )


V1 = f"<comprobanteRetencion>{HEAD.format(key='R1', cod='07')}<infoCompRetencion><periodoFiscal>02/2024</periodoFiscal></infoCompRetencion><impuestos><impuesto><codigo>1</codigo><baseImponible>10</baseImponible><porcentajeRetener>1</porcentajeRetener><valorRetenido>0.1</valorRetenido><codDocSustento>01</codDocSustento></impuesto></impuestos></comprobanteRetencion>"
V2 = f"<comprobanteRetencion version='2.0.0'>{HEAD.format(key='R2', cod='07')}<infoCompRetencion><periodoFiscal>02/2024</periodoFiscal></infoCompRetencion><docsSustento><docSustento><codDocSustento>01</codDocSustento><numDocSustento>001002000000007</numDocSustento><retenciones><retencion><codigo>2</codigo><baseImponible>10</baseImponible><porcentajeRetener>30</porcentajeRetener><valorRetenido>3</valorRetenido></retencion><retencion><codigo>2</codigo><baseImponible>10</baseImponible><porcentajeRetener>30</porcentajeRetener><valorRetenido>3</valorRetenido></retencion></retenciones></docSustento></docsSustento></comprobanteRetencion>"
FILES = {
    "bare.xml": invoice("K1"),
    "cdata.xml": f"<autorizacion><estado>AUTORIZADO</estado><numeroAutorizacion>9</numeroAutorizacion><comprobante><![CDATA[<?xml version='1.0'?>{invoice('K2')}]]></comprobante></autorizacion>",
    "escaped.xml": f"<autorizacion><estado>NO AUTORIZADO</estado><comprobante>{html.escape(invoice('K3'))}</comprobante></autorizacion>",
    "list.xml": f"<autorizaciones><autorizacion><estado>AUTORIZADO</estado><comprobante><![CDATA[{invoice('K4')}]]></comprobante></autorizacion></autorizaciones>",
    "json.xml": json.dumps({"estado": "AUTORIZADO", "comprobante": invoice("K5")}),
    "credit.xml": invoice("K6", "", "notaCredito", "04", "infoNotaCredito"),
    "v1.xml": V1,
    "v2.xml": V2,
    "broken.xml": invoice("K7")[:-20],
    "empty.xml": "<autorizacion><estado>x</estado><comprobante></comprobante></autorizacion>",
    "inner.xml": "<autorizacion><estado>x</estado><comprobante><![CDATA[<factura><a></factura>]]></comprobante></autorizacion>",
    "headless.xml": "<factura><detalles></detalles></factura>",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("xml")
    for name, content in FILES.items():
        (out / name).write_text(content)
    return str(out)


@pytest.fixture(scope="module")
def tables(spark, folder):
    return {k: v.collect() for k, v in xml.report_bundle(xml.parse(xml.scan(spark, folder))).items()}


def test_headers(tables):
    h = {r.clave: r for r in tables["cabecera"]}
    assert set(h) == {"K1", "K2", "K3", "K4", "K5", "K6", "R1", "R2"}
    assert float(h["K1"].importe_total) == 1234.56 and h["K1"].serie == "001-002-000000003" and h["K1"].razon_social_receptor == "Ana"
    assert (h["K2"].estado, h["K2"].numero_autorizacion, h["K3"].estado) == ("AUTORIZADO", "9", "NO AUTORIZADO")
    assert float(h["K6"].importe_total) == 9.5
    assert (h["R1"].periodo_fiscal, h["K1"].periodo_fiscal) == ("02/2024", None)
    assert json.loads(h["K1"].info_adicional) == [{"nombre": "mail", "valor": "x@y.z"}]


def test_summaries(tables):
    found = {r.clave_acceso: r for r in tables["documentos"]}
    assert set(found) == {"K1", "K2", "K3", "K4", "K5", "K6", "R1", "R2"}
    k = found["K1"]
    assert (k.estado, k.fecha_emision, k.razon_social_comprador, k.descripciones, k.codigo_documento) == ("AUTORIZADO", "03/02/2024", "Ana", "uno | dos", "01 - FACTURA")
    assert (k.base_gravada, k.monto_iva, k.tarifas_iva, k.importe_total, k.campos_adicionales) == (100.0, 15.0, "15%", 1234.56, "mail: x@y.z")
    assert (found["K6"].valor_modificacion, found["R1"].base_gravada, found["R1"].tarifas_iva, found["R1"].descripciones) == (9.5, 0.0, "No Disponible", "No Disponible")
    run = tables["resumen"][0]
    assert (run.consulta_id, run.rango_fechas, run.total_documentos) == ("RECIBIDOS_2024-02-03", "2024-02-03 a 2024-02-03", 8)


def test_first_payment(spark):
    """The first payment is the first in the document, and all count in the total."""
    pays = "".join(f"<pago><formaPago>{f}</formaPago><total>{t}</total><plazo>{t}</plazo><unidadTiempo>dias</unidadTiempo></pago>" for f, t in (("20", 7), ("01", 5), ("19", 9)))
    doc = invoice("P1").replace("</infoFactura>", f"<pagos>{pays}</pagos></infoFactura>")
    r = xml.report_bundle(xml.parse(spark.createDataFrame([("p.xml", doc)], "path string, value string")))["documentos"].first()
    assert (r.forma_pago, r.plazo_pago, r.unidad_tiempo_pago, r.total_pago) == ("20 - Otros con utilizacion del sistema financiero", "7", "dias", 21.0)


def test_errors(tables):
    found = {r.archivo_xml.rsplit("/", 1)[1]: r.error for r in tables["errores"]}
    assert found == {"broken.xml": "XML invalido", "empty.xml": "Comprobante vacio", "inner.xml": "Comprobante interno invalido", "headless.xml": "Sin infoTributaria"}


def test_lines_and_taxes(tables):
    assert sorted((r.line_num, r.codigo) for r in tables["detalle"] if r.clave == "K1") == [(1, "A"), (2, "B")]
    assert [(r.nivel, r.pct, float(r.valor)) for r in tables["impuestos"] if r.clave == "K1"] == [("DOCUMENTO", "4", 15.0)]


def test_withholdings(tables):
    found = sorted((r.clave, r.impuesto, r.sustento_numero, float(r.valor)) for r in tables["retenciones"])
    assert found == [("R1", "Renta", "", 0.1), ("R2", "IVA", "001-002-000000007", 3.0), ("R2", "IVA", "001-002-000000007", 3.0)]


def test_stream_is_batch(spark, folder, tables, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark, folder, out, check).awaitTermination()
    got = ingest.committed(spark, out, "cabecera").collect()
    assert sorted(r.clave for r in got) == sorted(r.clave for r in tables["cabecera"])
    assert ingest.manifest(spark, out).agg({"documentos": "sum"}).first()[0] == len(FILES)


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([("2024-01-02T00:00:00", "1", "Emitidos")], "timestamp string, ruc string, origen string")
    listings.append_run(rows, path)
    listings.append_run(rows, path)
    assert listings.history(spark, path).count() == 2
    (tmp_path / "old.json").write_text('[{"timestamp": "t", "ruc": "1", "n_xml": 3}, {"timestamp": "u", "otro": 1}]')
    (tmp_path / "bad.json").write_text("no")
    assert sorted(r.n_xml or 0 for r in listings.history(spark, str(tmp_path / "*.json"), as_array=True).collect()) == [0, 3]


def fold(words, tolerance=None):
    words = sorted(words)
    mean = sum(max(1.0, y1 - y0) for y0, _, _, y1, _ in words) / len(words)
    far = tolerance if tolerance is not None else max(2.0, min(6.0, mean * 0.55))
    lines, now, y = [], [], None
    for w in words:
        if now and abs(w[0] - y) <= far:
            now.append(w)
            y = y if tolerance is not None else (y + w[0]) / 2
        else:
            if now:
                lines.append(now)
            now, y = [w], w[0]
    lines.append(now)
    return [" ".join(t for _, t in sorted((x, t) for _, x, _, _, t in line)) for line in lines]


@pytest.mark.parametrize("tolerance", [None, 3.0])
def test_word_lines(spark, tolerance):
    import random

    r = random.Random(4)
    pages = {p: [(round(r.uniform(0, 60), 1), round(r.uniform(0, 500), 1), 0.0, 0.0, f"w{i}") for i in range(40)] for p in range(6)}
    pages = {p: [(y, x, x + 5, y + r.uniform(3, 14), t) for y, x, _, _, t in ws] for p, ws in pages.items()}
    rows = [(p, *w, 600.0, 800.0) for p, ws in pages.items() for w in ws]
    df = spark.createDataFrame(rows, "page int, y0 double, x0 double, x1 double, y1 double, text string, page_width double, page_height double")
    got = {}
    for row in layout.word_lines(df, ["page"], tolerance).orderBy("page", "line").collect():
        got.setdefault(row.page, []).append(row.text)
    assert got == {p: fold(ws, tolerance) for p, ws in pages.items()}


ENVELOPES = {
    "mark.xml": "﻿" + invoice("E1"), "json.xml": " \n" + json.dumps({"estado": "X", "comprobante": invoice("E2")}), "declared.xml": "\n<?xml version='1.0'?>\n" + invoice("E3"),
    "named.xml": f"<ns:autorizacion xmlns:ns='u'><estado>A</estado><comprobante><![CDATA[{invoice('E4')}]]></comprobante></ns:autorizacion>",
    "twice.xml": f"<autorizacion><estado>A</estado><comprobante><![CDATA[{invoice('E5')}]]></comprobante></autorizacion><autorizacion><estado>B</estado></autorizacion>",
    "after.xml": f"<autorizacion><estado>A</estado><comprobante><![CDATA[{invoice('E6')}]]></comprobante></autorizacion> \n", "brace.xml": "{" + invoice("E7"), "none.xml": None, "blank.xml": " ",
    "word.xml": invoice("E8").replace("<descripcion>uno", "<descripcion>autorizacion uno"),
}


def test_part_of_a_document_as_the_whole(spark):
    """What a table reads of a document gives that table as all of it does, the same documents broken, in every envelope."""
    docs = spark.createDataFrame([*FILES.items(), *ENVELOPES.items()], "path string, value string")
    whole = xml.report_bundle(xml.parse(docs))
    assert {r.clave for r in whole["cabecera"].collect()} == {*(f"K{i}" for i in range(1, 7)), "R1", "R2", *(f"E{i}" for i in (1, 2, 3, 4, 5, 6, 8))}
    makers = {"cabecera": xml.header, "impuestos": xml.taxes, "pagos": xml.payments, "retenciones": xml.withholdings}
    for name, make in makers.items():
        assert sorted(map(str, make(xml.good(xml.parse(docs, name))).collect())) == sorted(map(str, whole[name].collect())), name
    assert sorted(map(str, xml.errors(xml.parse(docs, "errores")).collect())) == sorted(map(str, whole["errores"].collect()))


def test_documents_are_gathered_without_an_aggregation(spark, sf):
    """Each document's lines are gathered as they are dealt; an aggregation sorted all their texts twice more."""
    for made in (documents.xml_documents, star.xml_documents):
        plan = made(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Window [") == 2


def test_a_documents_lines_are_sorted_without_a_lambda(spark, sf):
    from pyspark.sql import functions as F

    from taxloom.plans import bridge

    found = bridge.by_document(bridge.lines(spark, sf), n=F.col("line_num"))
    assert "lambdafunction" not in found._jdf.queryExecution().analyzed().toString()


def test_summaries_are_made_where_the_documents_are(spark):
    """A document's summary comes from its own lists: nothing is dealt out, and two documents under one path have their own facts."""
    docs = spark.createDataFrame([("p.xml", invoice("S1")), ("p.xml", invoice("S2").replace("<descripcion>uno", "<descripcion>tres"))], "path string, value string")
    made = xml.report_bundle(xml.parse(docs))["documentos"]
    assert sorted((r.clave_acceso, r.descripciones, r.base_gravada, r.monto_iva) for r in made.collect()) == [("S1", "uno | dos", 100.0, 15.0), ("S2", "tres | dos", 100.0, 15.0)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
