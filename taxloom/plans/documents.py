"""Queries over documents as XML, text, words and listings that Spark derives from the given tables; streams."""

from __future__ import annotations

import atexit
import datetime
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom import catalogs as K
from taxloom.functions import dates
from taxloom.functions.text import slug
from taxloom.operators import layout, textrules
from taxloom.plans import bridge
from taxloom.plans.bridge import sql
from taxloom.plans.queries import query
from taxloom.sources import files, listings, reports, xml
from taxloom.streaming import ingest


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names; a local session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{named.rstrip('/')}/taxloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def xml_documents(spark: SparkSession, d: str, path: F.Column | None = None) -> DataFrame:
    """(path, value): an XML document for each order, wrapped in CDATA, escaped, or bare in turn; some are broken.

    ``path`` may say otherwise where a document lies, by the columns of the header.
    """

    def tag(name: str, *content) -> F.Column:
        return F.concat(F.lit(f"<{name}>"), *content, F.lit(f"</{name}>"))

    tax = tag("impuesto", tag("codigo", F.lit("2")), tag("codigoPorcentaje", "pct"), tag("baseImponible", F.col("base").cast("string")), tag("valor", F.col("valor").cast("string")))
    line = tag("detalle", tag("codigoPrincipal", F.col("codigo").cast("string")), tag("descripcion", "descripcion"), tag("cantidad", F.col("cantidad").cast("string")), tag("precioUnitario", F.col("precio").cast("string")), tag("impuestos", tax))
    pay = tag("pago", tag("formaPago", "forma_pago"), tag("total", F.col("base").cast("string")))
    # orders are dealt as they are, which is less than the headers made of them
    orders = bridge.table(spark, d, "orders").join(bridge.by_document(bridge.lines(spark, d), line=line, pay=pay), F.col("o_orderkey") == F.col("orderkey"), "left").drop("orderkey")
    h = bridge.header(spark, d, orders, "rows")
    lines, pays = (F.coalesce(F.array_join(f"rows.{c}", ""), F.lit("")) for c in ("line", "pay"))
    node = K.label(F.col("cod_doc"), {"01": "infoFactura", "03": "infoLiquidacionCompra", "04": "infoNotaCredito", "05": "infoNotaDebito", "07": "infoCompRetencion"})
    info = F.concat(F.lit("<"), node, F.lit(">"), tag("fechaEmision", F.date_format("fecha", "dd/MM/yyyy")), tag("importeTotal", F.regexp_replace(F.col("importe").cast("string"), r"\.", ",")), tag("pagos", pays), F.lit("</"), node, F.lit(">"))
    head = tag("infoTributaria", tag("ambiente", F.lit("2")), tag("ruc", "ruc"), tag("claveAcceso", "clave"), tag("codDoc", "cod_doc"), tag("estab", "estab"), tag("ptoEmi", "pto"), tag("secuencial", "sec"))
    doc = F.concat(F.lit('<comprobante_doc version="1.0.0">'), head, info, tag("detalles", lines), F.lit('<infoAdicional><campoAdicional nombre="prioridad">'), "prioridad", F.lit("</campoAdicional></infoAdicional></comprobante_doc>"))
    escaped = F.replace(F.replace(F.replace(doc, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    status = F.coalesce(tag("estado", "estado"), F.lit(""))
    k = F.col("orderkey") % 4
    value = (
        F.when(F.col("orderkey") % 50 == 7, F.left(doc, F.length(doc) - 30))
        .when(k == 0, F.concat(F.lit("<autorizacion>"), status, F.lit("<comprobante><![CDATA["), doc, F.lit("]]></comprobante></autorizacion>")))
        .when(k == 1, F.concat(F.lit("<autorizacion>"), status, F.lit("<comprobante>"), escaped, F.lit("</comprobante></autorizacion>")))
        .otherwise(doc)
    )
    named = F.concat(F.lit("d/"), F.col("orderkey").cast("string"), F.lit(".xml")) if path is None else path
    return h.select(named.alias("path"), value.alias("value"))


@query("s2_xml_header", sql("header", """SELECT clave, CASE WHEN orderkey % 4 < 2 THEN coalesce(estado, 'AUTORIZADO') ELSE 'AUTORIZADO' END AS estado, cod_doc, estab || '-' || pto || '-' || sec AS serie, ruc,
  fecha AS fecha_emision, importe::DOUBLE AS importe_total, to_json([{'nombre': 'prioridad', 'valor': prioridad}])::VARCHAR AS info_adicional FROM header WHERE orderkey % 50 != 7"""))
def xml_header(spark: SparkSession, d: str) -> DataFrame:
    """Headers of wrapped and bare XML."""
    h = xml.header(xml.good(xml.parse(xml_documents(spark, d), "cabecera")))
    return h.select("clave", "estado", "cod_doc", "serie", "ruc", "fecha_emision", F.col("importe_total").cast("double").alias("importe_total"), "info_adicional")


@query("s3_xml_errors", "SELECT 'd/' || o_orderkey || '.xml' AS archivo_xml, 'XML invalido' AS error FROM orders WHERE o_orderkey % 50 = 7")
def xml_errors(spark: SparkSession, d: str) -> DataFrame:
    """S3: broken documents, with the reason."""
    return xml.errors(xml.parse(xml_documents(spark, d), "errores")).select("archivo_xml", "error")


@query("s2_xml_taxes", sql("header lines", "SELECT clave, nivel, line_num, pct, base::DOUBLE AS base, valor::DOUBLE AS valor FROM (SELECT clave, 'LINEA' AS nivel, l.* FROM header h JOIN lines l USING (orderkey) WHERE h.orderkey % 50 != 7)"))
def xml_taxes(spark: SparkSession, d: str) -> DataFrame:
    """Line taxes of XML documents."""
    t = xml.taxes(xml.good(xml.parse(xml_documents(spark, d), "impuestos")))
    return t.select("clave", "nivel", "line_num", "pct", F.col("base").cast("double").alias("base"), F.col("valor").cast("double").alias("valor"))


@query("s2_xml_payments", sql("header lines", "SELECT clave, line_num AS pago_num, forma_pago, " + "CASE forma_pago " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.PAYMENT.items()) + " END AS forma_pago_desc, base::DOUBLE AS total FROM header h JOIN lines l USING (orderkey) WHERE h.orderkey % 50 != 7"))
def xml_payments(spark: SparkSession, d: str) -> DataFrame:
    """Payments of XML documents in order."""
    p = xml.payments(xml.good(xml.parse(xml_documents(spark, d), "pagos")))
    return p.select("clave", "pago_num", "forma_pago", "forma_pago_desc", F.col("total").cast("double").alias("total"))


@query("s10_paths", sql("header", """SELECT orderkey, origin AS origen, CASE WHEN origin = 'Emitidos' THEN CASE WHEN estado = 'AUTORIZADO' THEN 'Autorizados' ELSE 'No autorizados' END END AS estado_ruta,
  year(fecha)::INTEGER AS anio, month(fecha)::INTEGER AS mes, CASE WHEN cod_doc != '05' THEN day(fecha)::INTEGER WHEN year(fecha) = 2001 AND month(fecha) = 1 THEN 1 END AS dia, CASE WHEN cod_doc = '04' THEN 'Factura' ELSE 'factura' END AS tipo_ruta FROM header"""))
def paths(spark: SparkSession, d: str) -> DataFrame:
    """Origin, status, type and period from both folder layouts; a file name's date must agree."""
    h = bridge.header(spark, d)
    status = F.when(F.col("origin") == "Recibidos", "").when(F.col("estado") == "AUTORIZADO", "Autorizados/").otherwise("No Autorizados/")
    base = F.concat(F.lit("/data/179/"), "origin", F.lit("/"), status)
    name = dates.month_name(F.month("fecha"))
    stamp = F.when(F.col("cod_doc") == "05", F.lit("20010101")).otherwise(F.date_format("fecha", "yyyyMMdd"))
    new = F.concat(base, F.lit("Factura/"), F.year("fecha").cast("string"), F.lit("/"), name, F.lit("/XML/factura__"), stamp, F.lit("__x.xml"))
    old = F.concat(base, F.year("fecha").cast("string"), F.lit("/"), name, F.lit("/"), F.date_format("fecha", "dd"), F.lit("/01_Factura/XML/x.xml"))
    path = F.when(F.col("cod_doc") == "04", old).otherwise(new)
    return h.select("orderkey", *[v.alias(c) for c, v in xml.from_path(path).items()])


FIRST_DAY, LAST_DAY = datetime.date(1997, 2, 10), datetime.date(1997, 4, 20)


def filed_documents(spark: SparkSession, d: str) -> DataFrame:
    """The XML documents under the paths of both folder layouts; some in consolidated folders, some twice."""
    k = F.col("orderkey")
    kind, month = K.label(F.col("cod_doc"), K.DOC_TYPE), dates.month_name(F.month("fecha"))
    status = F.when(F.col("origin") == "Recibidos", "").when(F.col("estado") == "AUTORIZADO", "Autorizados/").otherwise("No Autorizados/")
    name = F.concat(slug(kind), F.lit("__"), F.date_format("fecha", "yyyyMMdd"), F.lit("__"), k.cast("string"), F.lit(".xml"))
    new = F.concat("origin", F.lit("/"), status, kind, F.lit("/"), F.year("fecha").cast("string"), F.lit("/"), month, F.lit("/XML/"), name)
    old = F.concat(F.year("fecha").cast("string"), F.lit("/"), month, F.lit("/"), F.date_format("fecha", "dd"), F.lit("/01_"), kind, F.lit("/XML/"), k.cast("string"), F.lit(".xml"))
    path = F.concat(F.lit("/data/179/"), F.when(k % 11 == 5, "Consolidados/").otherwise(""), F.when(k % 7 == 3, old).otherwise(new))
    times = F.sequence(F.lit(1), F.when(k % 13 == 1, 2).otherwise(1))
    return xml_documents(spark, d, F.explode(F.transform(times, lambda _: path))).select("path", "value")


@query("s1_archived_documents", sql("header", """SELECT clave, CASE WHEN orderkey % 7 = 3 THEN 'desconocido' ELSE lower(origin) END AS origen,
  CASE WHEN orderkey % 7 = 3 OR origin = 'Recibidos' THEN 'sin_dato' WHEN estado = 'AUTORIZADO' THEN 'autorizados' ELSE 'no_autorizados' END AS estado, 'factura' AS tipo,
  year(fecha)::INTEGER AS anio, month(fecha)::INTEGER AS mes, day(fecha)::INTEGER AS dia, importe::DOUBLE AS importe_total
FROM header WHERE orderkey % 50 != 7 AND orderkey % 11 != 5 AND cod_doc = '01' AND fecha BETWEEN DATE '1997-02-10' AND DATE '1997-04-20'"""))
def archived_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents stored in folders by what their paths say, and those of a type and period read from their folders only.

    Repeated paths are stored once, consolidated folders not at all.
    """
    root = f"{scratch(spark)}/archivo"
    files.archive(filed_documents(spark, d), root)
    found = files.archived(spark, root, FIRST_DAY, LAST_DAY, kind="factura")
    heads = xml.header(xml.good(xml.parse(found.select("path", "value"), "cabecera"))).select("path", "clave", F.col("importe_total").cast("double").alias("importe_total"))
    return heads.join(found.drop("value"), "path").drop("path")


@query("s4_seed_keys", sql("header", "SELECT CASE WHEN origin = 'Emitidos' THEN 'a.txt' ELSE 'b.txt' END AS path, clave, 'Factura' AS tipo, strftime(fecha, '%d/%m/%Y') AS fecha FROM header"))
def seed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys from delimited lists, each file with its own delimiter."""
    sent = F.col("origin") == "Emitidos"
    mark = F.when(sent, ";").otherwise("\t")
    line = F.array_join(F.array(F.lit("Factura"), F.col("clave"), F.date_format("fecha", "dd/MM/yyyy"), F.lit("1,5")), ";")
    rows = bridge.header(spark, d).select(F.when(sent, "a.txt").otherwise("b.txt").alias("path"), F.replace(line, F.lit(";"), mark).alias("value"))
    return listings.seed_keys(rows)


@query("s5_listing", sql("header", "SELECT orderkey AS page_id, 1 AS row, strftime(fecha, '%d/%m/%Y') AS fecha, 'Factura ' || estab || '-' || pto || '-' || sec AS tipo_serie, clave, '' AS fecha_autorizacion, 'A & B' AS contraparte, '' AS neto, '' AS iva, importe::VARCHAR AS total FROM header"))
def listing(spark: SparkSession, d: str) -> DataFrame:
    """Rows of HTML listings; heads and short rows go."""
    cells = [F.date_format("fecha", "dd/MM/yyyy"), F.concat(F.lit("<b>Factura</b> "), "estab", F.lit("-"), "pto", F.lit("-"), "sec"), F.concat(F.lit(" "), "clave"), F.lit(""), F.lit("A &amp; B"), F.lit(""), F.lit("&nbsp;"), F.col("importe").cast("string")]
    row = F.concat(*[x for c in cells for x in (F.lit('<td class="c">'), c, F.lit("</td>"))])
    page = F.concat(F.lit("<table><tr><th>x</th></tr><tr>"), row, F.lit("</tr><tr><td>fin</td></tr></table>"))
    return listings.listing_rows(bridge.header(spark, d).select(F.col("orderkey").alias("page_id"), page.alias("page")))


@query("s6_label_values", sql("header", "SELECT orderkey AS page_id, unnest(['Clave de acceso', 'Total']) AS label, unnest([clave, importe::VARCHAR]) AS value FROM header"))
def label_values(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a detail page and their first value that isn't empty."""
    page = F.concat(F.lit("<label>Clave de acceso:</label><span></span><label>Clave de acceso:</label> <span><b>"), "clave", F.lit("</b></span><label>Total</label><span>"), F.col("importe").cast("string"), F.lit("</span><label>Vacio</label><span> </span>"))
    return listings.label_values(bridge.header(spark, d).select(F.col("orderkey").alias("page_id"), page.alias("page")))


def text_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): the printed form of each order as lines of text."""
    title = K.label(F.col("cod_doc"), {"01": "FACTURA", "03": "LIQUIDACIÓN DE COMPRA", "04": "NOTA DE CRÉDITO", "05": "NOTA DE DÉBITO", "07": "COMPROBANTE DE RETENCIÓN"})
    body = F.array_join(
        F.array(
            F.concat(F.lit("R.U.C.: "), "ruc"), title, F.concat(F.lit("No. "), "estab", F.lit("-"), "pto", F.lit("-"), "sec"), F.lit("NÚMERO DE AUTORIZACIÓN"), F.col("clave"), F.lit("AMBIENTE: PRODUCCIÓN / EMISIÓN: NORMAL"),
            F.concat(F.lit("Dirección Matriz: Av. "), "prioridad", F.lit(" y Calle "), "estab"), F.concat(F.lit("Fecha Emisión: "), F.date_format("fecha", "dd/MM/yyyy")), F.lit("OBLIGADO A LLEVAR CONTABILIDAD: SI"),
            F.concat(F.col("importe").cast("string"), F.lit(" IVA 30.00 "), F.round(F.col("importe") * F.lit("0.3").cast("decimal(2,1)"), 2).cast("decimal(14,2)").cast("string")), F.concat(F.lit("VALOR TOTAL $ "), F.col("importe").cast("string")),
        ),
        "\n",
    )
    return bridge.header(spark, d).select(F.col("orderkey").alias("doc_id"), body.alias("text"))


@query("x1_text_records", sql("header", """SELECT orderkey AS doc_id, cod_doc, clave AS clave_acceso, ruc, estab || '-' || pto || '-' || sec AS numero, strftime(fecha, '%d/%m/%Y') AS fecha_emision, importe::DOUBLE AS importe_total,
  'PRODUCCIÓN' AS ambiente, 'SI' AS obligado FROM header"""))
def text_records(spark: SparkSession, d: str) -> DataFrame:
    """Part of X1, C13, C31, C35: records from printed forms by rule cascades."""
    return textrules.records(text_documents(spark, d))


@query("x2_tax_rows", sql("header", "SELECT orderkey AS doc_id, 'IVA' AS impuesto, importe::DOUBLE AS base, 30.0::DOUBLE AS pct, round(importe * 0.3, 2)::DOUBLE AS valor FROM header"))
def text_tax_rows(spark: SparkSession, d: str) -> DataFrame:
    """Part of X2: withheld taxes from lines of text."""
    return textrules.tax_rows(textrules.text_lines(text_documents(spark, d))).drop("line")


@query("x10_label_pairs", sql("header", """SELECT orderkey AS doc_id, unnest(['R U C', 'AMBIENTE', 'EMISION', 'DIRECCION MATRIZ', 'FECHA EMISION', 'OBLIGADO A LLEVAR CONTABILIDAD']) AS label,
  unnest([ruc, 'PRODUCCIÓN', 'NORMAL', 'Av. ' || prioridad || ' y Calle ' || estab, strftime(fecha, '%d/%m/%Y'), 'SI']) AS value FROM header"""))
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Label and value pairs of lines."""
    return textrules.label_pairs(textrules.text_lines(text_documents(spark, d)))


@query("x10_numbers_near", sql("header", "SELECT orderkey AS doc_id, clave AS value FROM header"))
def numbers_near(spark: SparkSession, d: str) -> DataFrame:
    """A number on the line after its label."""
    return textrules.numbers_near(textrules.text_lines(text_documents(spark, d)), "AUTORIZACION", 49).drop("line")


@query("x11_addresses", sql("header", "SELECT orderkey AS doc_id, 'Av. ' || prioridad || ' y Calle ' || estab AS value FROM header"))
def addresses(spark: SparkSession, d: str) -> DataFrame:
    """Part of X11, F18: the address nearest to its label."""
    return textrules.addresses(textrules.text_lines(text_documents(spark, d)))


def word_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Words with places, from the lines of each order: code, quantity, description, price, a little out of line."""
    rows = bridge.lines(spark, d)
    y = F.col("line_num") * 20.0 + 300.0
    drift = (F.col("codigo") % 5 - 2) * 0.4
    cells = [(40.0, F.lpad(F.col("codigo").cast("string"), 8, "0")), (110.0, F.col("cantidad").cast("string")), (150.0, F.get(F.split("descripcion", " "), F.lit(0))), (230.0, F.get(F.split("descripcion", " "), F.lit(1))), (490.0, F.col("precio").cast("string"))]
    boxes = F.array(*[F.struct(F.lit(x).alias("x0"), t.alias("text"), (y + drift * i * 0.5).alias("y0")) for i, (x, t) in enumerate(cells)])
    out = rows.select(F.col("orderkey").alias("doc_id"), F.explode(boxes).alias("w")).filter("w.text is not null")
    return out.select("doc_id", F.lit(0).alias("page_index"), F.col("w.text").alias("text"), F.col("w.x0").alias("x0"), F.col("w.y0").alias("y0"), (F.col("w.x0") + 40).alias("x1"), (F.col("w.y0") + 10).alias("y1"), F.lit("layout").alias("source"), F.lit(100.0).alias("conf"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))


@query("w5_word_lines", sql("lines", """SELECT orderkey AS doc_id, 0 AS page_index, (line_num - 1)::INTEGER AS line, lpad(codigo::VARCHAR, 8, '0') || ' ' || cantidad::VARCHAR || ' ' || descripcion || ' ' || precio::VARCHAR AS text,
  CASE WHEN line_num * 20 + 300 + least(0, (codigo % 5 - 2) * 0.8) >= 576 THEN 'bottom_left' ELSE 'middle_left' END AS region FROM lines"""))
def word_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words to lines, with page regions."""
    return layout.word_lines(listings.words(word_boxes(spark, d)), ["doc_id", "page_index"]).select("doc_id", "page_index", "line", "text", "region")


@query("x12_band_items", sql("lines", "SELECT orderkey AS doc_id, line_num::BIGINT AS item, lpad(codigo::VARCHAR, 8, '0') AS codigo, descripcion, cantidad::VARCHAR AS cantidad, precio::VARCHAR AS precio_unitario FROM lines"))
def band_items(spark: SparkSession, d: str) -> DataFrame:
    """Item rows from column bands."""
    words = word_boxes(spark, d).withColumn("line", F.round((F.col("y0") - 300) / 20).cast("int"))
    return layout.band_items(words, ["doc_id"])


def form_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Label and value words of each order's printed form: values beside, below and on the line of their label."""
    cells = [
        (40.0, 50.0, F.lit("FECHA EMISION")), (200.0, 51.0, F.date_format("fecha", "dd/MM/yyyy")), (40.0, 90.0, F.lit("CLAVE DE ACCESO")), (42.0, 108.0, F.col("clave")), (40.0, 200.0, F.concat(F.lit("RUC: "), "ruc")),
    ]
    boxes = F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(y).alias("y0"), t.alias("text"), F.lit(i).alias("line")) for i, (x, y, t) in enumerate(cells)])
    rows = bridge.header(spark, d).select(F.col("orderkey").alias("doc_id"), F.explode(boxes).alias("w")).select("doc_id", F.lit(0).alias("page_index"), "w.*")
    return rows.withColumns({"x1": F.col("x0") + 90, "y1": F.col("y0") + 10, "region": F.lit("top_left")})


@query("x4_layout_fields", sql("header", """SELECT orderkey AS doc_id, unnest(['fecha', 'clave', 'ruc']) AS field, unnest([strftime(fecha, '%d/%m/%Y'), clave, ruc]) AS value, unnest([0.92, 0.82, 0.89])::DOUBLE AS confidence FROM header"""))
def layout_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a layout, each by the best of its evidence."""
    labels = {"fecha": ["FECHA EMISION"], "clave": ["CLAVE DE ACCESO"], "ruc": ["RUC"]}
    page = ["doc_id", "page_index"]
    return layout.best_values(layout.nearby_values(form_boxes(spark, d), labels, page), page).drop("page_index")


@query("x9_left_column", sql("header", """SELECT orderkey AS doc_id, unnest(['FECHA EMISION ' || strftime(fecha, '%d/%m/%Y'), 'CLAVE DE ACCESO', clave, 'RUC: ' || ruc]) AS text FROM header"""))
def left_column(spark: SparkSession, d: str) -> DataFrame:
    """The words of a page's upper left part as lines."""
    words = form_boxes(spark, d).withColumns({"page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    return layout.column_text(words, ["doc_id"], left=True).select("doc_id", "text")


LABELS = {
    "rucEmisor": ["R U C", "R.U.C", "RUC"], "numeroComprobante": ["No.", "NUMERO DE DOCUMENTO"], "claveAcceso": ["CLAVE DE ACCESO"], "obligadoContabilidad": ["OBLIGADO A LLEVAR CONTABILIDAD"],
    "fechaEmision": ["FECHA EMISION", "FECHA DE EMISION"], "razonSocialComprador": ["RAZON SOCIAL NOMBRES Y APELLIDOS", "RAZON SOCIAL COMPRADOR"], "valorTotal": ["IMPORTE TOTAL", "VALOR TOTAL"],
}


def doubtful_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each order's printed form, at places that differ from row to row, some of them wrong or where they don't belong."""
    k = F.col("orderkey")
    right = lambda x, y, label, value: [(x, y, label), (x + 150.0, y + 1.0, value)]
    below = lambda x, y, label, value: [(x, y, label), (x + 5.0, y + 24.0, value)]
    broken = F.concat(F.left("clave", F.lit(48)), (F.right("clave", F.lit(1)).cast("int") + 1).cast("string").substr(1, 1))
    cells = [
        *right(20.0, 20.0, F.when(k % 4 == 1, F.lit("RUC")), F.lit("123")), (20.0, 90.0, F.concat(F.lit("R.U.C.: "), "ruc")), *right(320.0, 20.0, F.lit("No."), F.concat_ws("-", "estab", "pto", "sec")),
        *below(330.0, 90.0, F.lit("CLAVE DE ACCESO"), F.when(k % 5 == 2, broken).otherwise(F.col("clave"))), (330.0, 200.0, F.when(k % 5 == 2, F.concat(F.lit("Clave de acceso: "), "clave"))),
        *right(20.0, 160.0, F.when(k % 3 != 0, F.lit("OBLIGADO A LLEVAR CONTABILIDAD")), F.lit("SI")), *right(20.0, 740.0, F.when(k % 3 == 0, F.lit("OBLIGADO A LLEVAR CONTABILIDAD")), F.lit("NO")),
        *right(20.0, 330.0, F.lit("FECHA EMISION"), F.when(k % 7 == 3, F.lit("31/13/2024")).otherwise(F.date_format("fecha", "dd/MM/yyyy"))), *below(20.0, 400.0, F.lit("RAZON SOCIAL / NOMBRES Y APELLIDOS"), F.concat(F.lit("Cliente "), F.col("custkey").cast("string"))),
        *right(320.0, 640.0, F.lit("VALOR TOTAL"), F.replace(F.col("importe").cast("string"), F.lit("."), F.lit(","))),
    ]
    shift = (k % 7).cast("double")
    at_x, at_y = (F.array(*[F.lit(c[i]) for c in cells]) for i in (0, 1))
    boxes = F.transform(F.array(*[c[2] for c in cells]), lambda t, i: F.struct(i.alias("line"), (F.get(at_x, i) + shift).alias("x0"), (F.get(at_y, i) + shift * 0.5).alias("y0"), t.alias("text")))
    page = (F.col("w.y0") / 800).cast("int")  # a page is 800 high
    rows = bridge.header(spark, d).select(F.col("orderkey").alias("doc_id"), F.explode(boxes).alias("w")).select("doc_id", page.alias("page_index"), "w.*").filter("text is not null")
    return rows.withColumns({"x1": F.col("x0") + 140, "y1": F.col("y0") + 10, "region": layout.region(F.col("x0"), F.col("y0"), F.lit(600.0), F.lit(800.0))})


_CHECKED = {
    "rucEmisor": ("ruc", "0.86"), "numeroComprobante": ("estab || '-' || pto || '-' || sec", "0.92"), "claveAcceso": ("clave", "CASE WHEN orderkey % 5 = 2 THEN 0.86 ELSE 0.82 END"), "obligadoContabilidad": ("CASE WHEN orderkey % 3 != 0 THEN 'SI' END", "0.92"),
    "fechaEmision": ("CASE WHEN orderkey % 7 != 3 THEN strftime(fecha, '%d/%m/%Y') END", "0.92"), "razonSocialComprador": ("'Cliente ' || custkey", "0.82"), "valorTotal": ("importe::VARCHAR", "0.92"),
}


@query("x4_checked_fields", sql("header", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT orderkey AS doc_id, '{f}' AS field, {v} AS value, ({c})::DOUBLE AS confidence FROM header" for f, (v, c) in _CHECKED.items()) + ") WHERE value IS NOT NULL"))
def checked_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of pages by labels in their regions; wrong keys, ids and dates leave before the best evidence is taken."""
    return layout.checked_values(doubtful_boxes(spark, d), ["doc_id", "page_index"], LABELS).drop("page_index")


@query("x9_columns", sql("header", """SELECT doc_id, side, string_agg(text, '|' ORDER BY y) AS texts FROM (
  SELECT orderkey AS doc_id, parte AS side, y, CASE WHEN parte = 'left' AND y = 90 THEN CASE WHEN orderkey % 3 = 0 THEN 'Identificación 1' ELSE 'Calle ' || estab END
    WHEN parte = 'left' THEN 'Emisor ' || custkey || ' ' || y::INTEGER ELSE 'Dato ' || sec || ' ' || y::INTEGER END AS text
  FROM header, (VALUES ('left', 50), ('left', 90), ('left', 130), ('left', 310), ('right', 50), ('right', 330)) x(parte, y))
WHERE side = 'right' OR doc_id % 3 != 0 OR y < 90 GROUP BY doc_id, side"""))
def columns(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a page's left and right columns, above their limits, the left one up to where the buyer begins."""
    k, h = F.col("orderkey"), bridge.header(spark, d)
    shift = (k % 11).cast("double")
    cells = [(x, y, c) for y in (50, 90, 130, 310, 325, 500) for x, c in ((20.0, F.when((F.lit(y) == 90), F.when(k % 3 == 0, "Identificación").otherwise("Calle")).otherwise("Emisor")), (110.0, F.when((F.lit(y) == 90), F.when(k % 3 == 0, F.lit("1")).otherwise(F.col("estab"))).otherwise(F.concat(F.col("custkey").cast("string"), F.lit(f" {y}")))))]
    cells += [(x, y, c) for y in (50, 330, 400) for x, c in ((300.0, F.lit("Dato")), (380.0, F.concat("sec", F.lit(f" {y}"))))]
    words = F.array(*[F.struct((F.lit(x) + shift).alias("x0"), F.lit(float(y)).alias("y0"), c.alias("text")) for x, y, c in cells])
    rows = h.select(k.alias("doc_id"), F.explode(words).alias("w")).select("doc_id", "w.*")
    page = rows.withColumns({"x1": F.col("x0") + 60, "y1": F.col("y0") + 10, "page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    lines = layout.column_texts(page, ["doc_id"])
    return lines.groupBy("doc_id", "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "|").alias("texts"))


@query("s8_run_history", sql("history", "SELECT ruc, origen, anio, mes, dia, tipo, n_xml, n_pdf FROM history"))
def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Run records appended as JSON and read again."""
    path = f"{scratch(spark)}/historial"
    runs = bridge.history(spark, d).withColumn("timestamp", F.col("timestamp").cast("string"))
    listings.append_run(runs.filter("origen = 'Emitidos'"), path)
    listings.append_run(runs.filter("origen = 'Recibidos'"), path)
    return listings.history(spark, path).select("ruc", "origen", "anio", "mes", "dia", "tipo", "n_xml", "n_pdf")


@query("k1_bundle", sql("header lines", """SELECT 'cabecera' AS tabla, (SELECT count(*) FROM header WHERE orderkey % 50 != 7) AS n UNION ALL SELECT 'detalle', (SELECT count(*) FROM lines WHERE orderkey % 50 != 7)
UNION ALL SELECT 'pagos', (SELECT count(*) FROM lines WHERE orderkey % 50 != 7) UNION ALL SELECT 'impuestos', (SELECT count(*) FROM lines WHERE orderkey % 50 != 7)
UNION ALL SELECT 'errores', (SELECT count(*) FROM header WHERE orderkey % 50 = 7) UNION ALL SELECT 'adicionales', (SELECT count(*) FROM header WHERE orderkey % 50 != 7) UNION ALL SELECT 'documentos', (SELECT count(*) FROM header WHERE orderkey % 50 != 7) UNION ALL SELECT 'resumen', 1"""))
def bundle(spark: SparkSession, d: str) -> DataFrame:
    """K1: the report's tables written from documents parsed once, and their rows; empty optional tables aren't written."""
    path = scratch(spark)
    written = reports.write_parsed(xml.parse(xml_documents(spark, d)), path)
    names = [n for n, rows in written.items() if n in reports.ALWAYS or rows]
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("tabla"), F.count(F.lit(1)).alias("n")) for n in names]
    return reduce(DataFrame.unionByName, counts)


@query("t1_ingest", sql("header", "SELECT clave, cod_doc, importe::DOUBLE AS importe_total FROM header WHERE orderkey % 50 != 7"))
def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Documents that arrive as a stream, parsed and stored batch by batch."""
    path = scratch(spark)
    xml_documents(spark, d).write.parquet(f"{path}/llegados", compression="zstd")
    stream = spark.readStream.schema("path string, value string").parquet(f"{path}/llegados")
    ingest.ingest_stream(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return ingest.committed(spark, f"{path}/out", "cabecera").select("clave", "cod_doc", F.col("importe_total").cast("double").alias("importe_total"))


@query("t2_stored_once", sql("header", """SELECT clave, cod_doc, importe::DOUBLE AS importe_total FROM header WHERE orderkey % 50 != 7"""))
def stored_once(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which many arrive again under other names, in several batches; each access key is stored once.

    They arrive in as many files as they are made in, and again in files of their own that come after those, so no text is dealt out for it.
    """
    path, store = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    inbox, packed = f"{path}/llegados", {"compression": "zstd"}
    xml_documents(spark, d).write.parquet(inbox, **packed)
    again = spark.read.parquet(inbox).filter(F.crc32("path") % 3 == 0).withColumn("path", F.concat(F.lit("otra/"), "path"))
    again.write.mode("append").parquet(inbox, **packed)
    files = len(spark.read.parquet(inbox).inputFiles())
    stream = spark.readStream.schema("path string, value string").option("maxFilesPerTrigger", -(-files // 2)).parquet(inbox)
    before = spark.conf.get(store)
    spark.conf.set(store, ingest.ROCKSDB)
    try:
        ingest.ingest_stream(stream, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    finally:
        spark.conf.set(store, before)
    return ingest.committed(spark, f"{path}/out", "cabecera").select("clave", "cod_doc", F.col("importe_total").cast("double").alias("importe_total"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    still = bridge.table(spark, d, "events")
    reader, names = spark.readStream.schema(still.schema), still.inputFiles()
    if names and all(n.endswith("/events.parquet") for n in names):  # one file; a stream reads folders only
        events = reader.option("pathGlobFilter", "events.parquet").parquet(f"{d}/")
    else:
        events = reader.parquet(f"{d}/events.parquet")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # event time has a zone


@query("t2_unseen", "SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id")
def unseen_users(spark: SparkSession, d: str) -> DataFrame:
    """Each key once, with its earliest time, which a streaming aggregate finds in any order of arrival."""
    found = ingest.drained(ingest.first_seen(_events(spark, d), "user_id"), scratch(spark), "complete")
    return found.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("t3_daily_counters", "SELECT date_trunc('day', ts)::TIMESTAMP AS dia, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def daily_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters by day while the events run in."""
    found = ingest.drained(ingest.daily_counters(_events(spark, d), ["event_type"], ["value"]), scratch(spark), "complete")
    return found.withColumn("value", F.round("value", 4)).withColumn("dia", F.col("dia").cast("timestamp_ntz"))
