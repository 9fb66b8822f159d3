"""Queries over report rows of notes and withholdings, and over report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom import catalogs as K
from taxloom.functions import amounts, keys
from taxloom.operators import summary
from taxloom.plans import bridge
from taxloom.plans.bridge import sql
from taxloom.plans.documents import scratch
from taxloom.plans.queries import query
from taxloom.sources import reports


@query("p7_two_slots", sql("lines withholdings", """SELECT orderkey, codigo, min_by(base, line_num)::DOUBLE AS base, CASE WHEN count(*) > 1 THEN max_by(base, line_num)::DOUBLE END AS base_1,
  min_by(valor, line_num)::DOUBLE AS valor, CASE WHEN count(*) > 1 THEN max_by(valor, line_num)::DOUBLE END AS valor_1, sum(valor)::DOUBLE AS total FROM withholdings GROUP BY ALL"""))
def two_slots(spark: SparkSession, d: str) -> DataFrame:
    """The first line of a tax and, if there are more, the last; the total withheld."""
    more = F.count(F.lit(1)) > 1
    aggs = [x for c in ("base", "valor") for x in (F.min_by(c, "line_num").cast("double").alias(c), F.when(more, F.max_by(c, "line_num").cast("double")).alias(f"{c}_1"))]
    return bridge.withholdings(spark, d).groupBy("orderkey", "codigo").agg(*aggs, F.sum("valor").cast("double").alias("total"))


@query("p10_credit_notes", sql("header lines", """SELECT h.orderkey, clave, coalesce(b0, 0) AS base_0, coalesce(b12, 0) AS base_12, coalesce(iva, 0) AS iva,
  CASE WHEN importe != 0 THEN importe::DOUBLE ELSE coalesce(neto + iva, 0) END AS total, coalesce(tarifas, 'No Disponible') AS tarifas
FROM header h LEFT JOIN (SELECT orderkey, coalesce(sum(base) FILTER (pct = '0'), 0)::DOUBLE AS b0, coalesce(sum(base) FILTER (pct = '2'), 0)::DOUBLE AS b12, sum(valor)::DOUBLE AS iva,
  sum(base)::DOUBLE AS neto, concat_ws(', ', CASE WHEN sum(base) FILTER (pct = '2') > 0 THEN '12%' END, CASE WHEN sum(base) FILTER (pct = '3') > 0 THEN '14%' END, CASE WHEN sum(base) FILTER (pct = '4') > 0 THEN '15%' END) AS tarifas
  FROM lines GROUP BY orderkey) USING (orderkey) WHERE cod_doc = '04'"""))
def credit_notes(spark: SparkSession, d: str) -> DataFrame:
    """Bases by rate from the lines; the total is the modified value, else net and VAT."""

    def base(rate: str):
        return F.coalesce(F.sum(F.when(F.col("pct") == rate, F.col("base"))), F.lit(0).cast("decimal(30,4)"))

    rates = [F.when(base(c) > 0, K.IVA_TARIFF[c]) for c in K.TAXED_RATES]
    agg = bridge.lines(spark, d).groupBy("orderkey").agg(
        base("0").cast("double").alias("base_0"), base("2").cast("double").alias("base_12"), F.sum("valor").cast("double").alias("iva"), F.sum("base").cast("double").alias("neto"), F.concat_ws(", ", *rates).alias("tarifas")
    )
    h = bridge.header(spark, d).filter("cod_doc = '04'").join(agg, "orderkey", "left")
    zero = F.lit(0.0)
    total = F.when(F.col("importe") != 0, F.col("importe").cast("double")).otherwise(F.coalesce(F.col("neto") + F.col("iva"), zero))
    return h.select("orderkey", "clave", *[F.coalesce(c, zero).alias(c) for c in ("base_0", "base_12", "iva")], total.alias("total"), F.coalesce("tarifas", F.lit(K.MISSING)).alias("tarifas"))


@query("p11_debit_notes", sql("header lines", """SELECT h.orderkey, coalesce(motivos, 'No Disponible') AS motivos, CASE WHEN suma > 0 THEN suma ELSE importe::DOUBLE END AS valor_modificacion
FROM header h LEFT JOIN (SELECT orderkey, string_agg(descripcion || ': ' || precio, ' | ' ORDER BY line_num) AS motivos, sum(precio)::DOUBLE AS suma FROM lines GROUP BY orderkey) USING (orderkey) WHERE cod_doc = '05'"""))
def debit_notes(spark: SparkSession, d: str) -> DataFrame:
    """Reasons joined and summed; without reasons the document's total."""
    motive = F.concat("descripcion", F.lit(": "), "precio")
    ordered = F.array_sort(F.collect_list(F.struct("line_num", motive.alias("t"))))
    agg = bridge.lines(spark, d).groupBy("orderkey").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " | ").alias("motivos"), F.sum("precio").cast("double").alias("suma"))
    h = bridge.header(spark, d).filter("cod_doc = '05'").join(agg, "orderkey", "left")
    return h.select("orderkey", F.coalesce("motivos", F.lit(K.MISSING)).alias("motivos"), F.when(F.col("suma") > 0, F.col("suma")).otherwise(F.col("importe").cast("double")).alias("valor_modificacion"))


_TITLED = {"clave": "Clave de acceso", "ruc": "RUC del emisor", "fecha": "Fecha de emision", "importe": "Importe total", "estado": "Estado de autorizacion", "prioridad": "Forma de pago 1", "estab": "Plazo del pago 2", "pto": "Impuesto al valor agregado 12% base imponible", "sec": "Impuesto codigo 9 porcentaje 4 valor", "origin": "Origen de datos"}
_NAMES = {"clave": "CLAVE_ACCESO", "ruc": "RUC_EMISOR", "fecha": "FECHA_EMISION", "importe": "IMPORTE_TOTAL", "estado": "ESTADO_AUTORIZACION", "prioridad": "FORMA_PAGO_1", "estab": "PLAZO_2", "pto": "IVA_12_BASE", "sec": "IMP_9_4_VALOR", "origin": "ORIGEN_DE_DATOS"}


@query("p19_titles", sql("header", "SELECT " + ", ".join(f'{c}{"::DOUBLE" if c == "importe" else ""} AS "{t}"' for c, t in _TITLED.items()) + " FROM header"))
def titles(spark: SparkSession, d: str) -> DataFrame:
    """Columns under titles for people."""
    h = bridge.header(spark, d).withColumn("importe", F.col("importe").cast("double"))
    return reports.titled(h.select(*[F.col(c).alias(n) for c, n in _NAMES.items()]))


@query("p22_listing_rows", sql("header", """SELECT orderkey, estab, pto, sec, CASE WHEN importe <= 0 THEN NULL ELSE CASE orderkey % 5 WHEN 0 THEN 'iva15' WHEN 1 THEN 'iva12' WHEN 2 THEN 'iva8' WHEN 3 THEN 'iva5' END END AS columna FROM header"""))
def listing_rows(spark: SparkSession, d: str) -> DataFrame:
    """A listing row's series taken apart and its rate found."""
    h = bridge.header(spark, d)
    written = keys.parse_series(F.concat(F.lit("Factura "), "estab", F.lit("-"), "pto", F.lit("-"), "sec"))
    part, net = F.split(written, "-"), F.col("importe").cast("double")
    rate = F.get(F.array(*[F.lit(x) for x in (0.152, 0.118, 0.08, 0.051, 0.4)]), (F.col("orderkey") % 5).cast("int"))
    return h.select("orderkey", part[0].alias("estab"), part[1].alias("pto"), part[2].alias("sec"), amounts.iva_column(net * rate, net).alias("columna"))


@query("s12_find_reports", sql("header", "SELECT orderkey FROM header WHERE origin = 'Recibidos' AND cod_doc = '01' AND year(fecha) = 1997 AND month(fecha) = 3"))
def find_reports(spark: SparkSession, d: str) -> DataFrame:
    """Part of S12: rows by the columns that partition reports."""
    h = bridge.header(spark, d).withColumns({"anio": F.year("fecha"), "mes": F.month("fecha")})
    return reports.find_reports(h, origin="Recibidos", cod_doc="01", anio=1997, mes=3, estado=None).select("orderkey")


@query("s7_written_reports", sql("header", """SELECT orderkey, origin AS origen, cod_doc, year(fecha)::INTEGER AS anio, month(fecha)::INTEGER AS mes, importe::DOUBLE AS importe, CASE WHEN cod_doc = '01' THEN '' ELSE coalesce(estado, '') END AS estado,
  strftime(fecha, '%Y%m') AS periodo FROM header WHERE cod_doc IN ('01', '04') AND year(fecha) = 1997"""))
def written_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports written by period, found by their folders, and read back as one with columns that one of them lacks."""
    path = scratch(spark)
    h = bridge.header(spark, d).select("orderkey", F.col("origin").alias("origen"), "cod_doc", F.year("fecha").alias("anio"), F.month("fecha").alias("mes"), F.col("importe").cast("double").alias("importe"), "estado")
    reports.write_by_period(h.filter("cod_doc = '01'").drop("estado"), f"{path}/facturas")
    reports.write_by_period(h.filter("cod_doc = '04'"), f"{path}/notas")
    both = reports.read_reports(spark, [f"{path}/facturas", f"{path}/notas"], folders=["origen", "cod_doc", "anio", "mes"])
    found = reports.find_reports(both, anio="1997").withColumns({"anio": F.col("anio").cast("int"), "mes": F.col("mes").cast("int")})
    return found.select("orderkey", "origen", "cod_doc", "anio", "mes", "importe", "estado", F.format_string("%04d%02d", "anio", "mes").alias("periodo"))


@query("s12_report_files", sql("header", """SELECT orderkey, CASE WHEN orderkey % 4 = 1 THEN 'recibidos' ELSE lower(origin) END AS origen, CASE WHEN orderkey % 4 = 1 OR orderkey % 2 = 0 THEN 'xml' ELSE 'pdf' END AS formato,
  CASE WHEN orderkey % 4 = 1 THEN 'factura' ELSE 'nota_credito' END AS tipo_slug, year(fecha)::INTEGER AS anio, month(fecha)::INTEGER AS mes, CASE WHEN orderkey % 4 = 3 THEN day(fecha)::INTEGER END AS dia
FROM header WHERE orderkey % 7 NOT IN (2, 5)"""))
def report_files(spark: SparkSession, d: str) -> DataFrame:
    """Report files by what their names say; consolidated ones and other files aren't among them."""
    h, k = bridge.header(spark, d), F.col("orderkey") % 4
    month = F.date_format("fecha", "yyyyMM")
    kind = F.when(F.col("orderkey") % 2 == 0, "xml").otherwise("pdf")
    main = F.concat_ws("_", "origin", F.lit("reporte"), kind, F.lit("nota_credito"), F.when(k == 3, F.date_format("fecha", "yyyyMMdd")).otherwise(month))
    old = F.concat(F.lit("reporte_factura_"), F.date_format("fecha", "yyyy_MM"), F.when(F.col("orderkey") % 8 == 1, "_2").otherwise(""))
    folder = F.when(F.col("orderkey") % 7 == 2, "/r/Consolidados/").otherwise("/r/1997/")
    name = F.when(F.col("orderkey") % 7 == 5, F.concat(F.lit("notas_"), month)).when(k == 1, old).otherwise(main)
    paths = h.select("orderkey", F.concat(folder, name, F.lit(".xlsx")).alias("path"))
    return reports.report_files(paths).drop("path")


@query("k3_issued_listing", sql("header", """SELECT orderkey, 'Factura' AS "COMPROBANTE", estab || '-' || pto || '-' || sec AS "SERIE_COMPROBANTE", clave AS "CLAVE_ACCESO",
  CASE WHEN orderkey % 4 != 0 THEN fecha::TIMESTAMP + INTERVAL 10 HOUR END AS "FECHA_AUTORIZACION", CASE WHEN orderkey % 4 = 0 THEN 'pendiente' ELSE strftime(fecha, '%d/%m/%Y') || ' 10:00:00' END AS "FECHA_AUTORIZACION_texto",
  strftime(fecha, '%d/%m/%Y') AS "FECHA_EMISION", (importe - custkey % 50)::DOUBLE AS "VALOR_SIN_IMPUESTOS", (importe - custkey % 50)::VARCHAR AS "VALOR_SIN_IMPUESTOS_texto", NULL::DOUBLE AS "IVA", '' AS "IVA_texto",
  CASE WHEN orderkey % 3 != 0 THEN importe::DOUBLE END AS "IMPORTE_TOTAL", CASE WHEN orderkey % 3 = 0 THEN 'por definir' ELSE replace(importe::VARCHAR, '.', ',') END AS "IMPORTE_TOTAL_texto" FROM header"""))
def issued_listing(spark: SparkSession, d: str) -> DataFrame:
    """K3: the listing of issued documents in its eight columns; what doesn't convert isn't lost, a missing column is empty."""
    k = F.col("orderkey")
    listing = bridge.header(spark, d).select(
        "orderkey", F.lit("Factura").alias("COMPROBANTE"), keys.series(F.col("estab"), F.col("pto"), F.col("sec")).alias("SERIE_COMPROBANTE"), F.col("clave").alias("CLAVE_ACCESO"),
        F.date_format("fecha", "dd/MM/yyyy").alias("FECHA_EMISION"), (F.col("importe") - F.col("custkey") % 50).cast("decimal(16,2)").cast("string").alias("VALOR_SIN_IMPUESTOS"),
        F.when(k % 3 == 0, "por definir").otherwise(F.replace(F.col("importe").cast("string"), F.lit("."), F.lit(","))).alias("IMPORTE_TOTAL"),
        F.when(k % 4 == 0, "pendiente").otherwise(F.concat(F.date_format("fecha", "dd/MM/yyyy"), F.lit(" 10:00:00"))).alias("FECHA_AUTORIZACION"),
    )
    out = reports.issued_listing(listing, keep=["orderkey"])
    return out.withColumn("FECHA_AUTORIZACION", F.col("FECHA_AUTORIZACION").cast("timestamp_ntz"))


@query("k5_period_names", sql("header", """SELECT orderkey, CASE orderkey % 4 WHEN 0 THEN strftime(fecha, '%Y') WHEN 1 THEN strftime(fecha, '%Y%m') WHEN 2 THEN strftime(fecha, '%Y%m%d')
  ELSE strftime(fecha, '%Y%m') || CASE WHEN month(fecha) < 10 THEN '-' || lpad((month(fecha) + 2)::VARCHAR, 2, '0') ELSE '' END END AS periodo FROM header"""))
def period_names(spark: SparkSession, d: str) -> DataFrame:
    """K5: what reports of a year, a month, a day and a range of months are called."""
    k, day = F.col("orderkey") % 4, F.col("fecha")
    month, last = F.month(day), F.month(day) + F.when(F.month(day) < 10, 2).otherwise(0)
    name = reports.period_label(F.year(day), F.when(k > 0, month), F.when(k == 2, F.dayofmonth(day)), F.when(k == 3, last))
    return bridge.header(spark, d).select("orderkey", name.alias("periodo"))


@query("s13_best_match", sql("header", """SELECT orderkey, ruc, nivel FROM (SELECT *, min(nivel) OVER (PARTITION BY ruc) AS mejor FROM (
  SELECT *, CASE WHEN origin = 'Emitidos' AND estado = 'AUTORIZADO' THEN 1 WHEN origin = 'Emitidos' THEN 2 ELSE 3 END AS nivel FROM header))
WHERE mejor = 3 OR (mejor = 2 AND nivel <= 2) OR (mejor = 1 AND nivel = 1)"""))
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """For each taxpayer the most specific place that has rows."""
    return reports.best_match(bridge.header(spark, d), "ruc", "Emitidos", "AUTORIZADO").select("orderkey", "ruc", "nivel")


@query("f3_type_filter", sql("header", "SELECT orderkey FROM header WHERE cod_doc = '04'"))
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    """by canonical type; rows of another type go."""
    h = bridge.header(spark, d)
    return h.filter(keys.document_type(K.label(F.col("cod_doc"), K.DOC_TYPE)) == "notas_de_credito").select("orderkey")
