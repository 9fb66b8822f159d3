"""Queries of the column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom import catalogs as K
from taxloom.functions import amounts, dates, keys, text
from taxloom.operators import textrules
from taxloom.plans import bridge
from taxloom.plans.bridge import sql
from taxloom.plans.queries import query

_FOLD = "regexp_replace(translate({c}, '" + text.MARKED + "', '" + text.PLAIN + "'), '[^\\x00-\\x7F]', '', 'g')"


def _fold(c: str) -> str:
    return _FOLD.replace("{c}", c)


@query("c1_clean", "SELECT doc_id, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS limpio FROM documents")
def clean(spark: SparkSession, d: str) -> DataFrame:
    """White space collapsed."""
    return bridge.table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("limpio"))


@query("c8_folding", "SELECT doc_id, md5(" + _fold("text") + ") AS plegado, md5(trim(regexp_replace(lower(" + _fold("text") + "), '[^a-z0-9]+', '_', 'g'), '_')) AS slug, md5(regexp_replace(lower(" + _fold("text") + "), '[^a-z0-9]+', '', 'g')) AS junto, md5(trim(regexp_replace(upper(regexp_replace(" + _fold("text") + ", '[^A-Za-z0-9 ]+', ' ', 'g')), '\\s+', ' ', 'g'))) AS etiqueta FROM documents")
def folding(spark: SparkSession, d: str) -> DataFrame:
    """Accent folding, slugs and labels of whole texts, as digests."""
    t = F.col("text")
    return bridge.table(spark, d, "documents").select("doc_id", F.md5(text.fold(t)).alias("plegado"), F.md5(text.slug(t)).alias("slug"), F.md5(text.squeeze(t)).alias("junto"), F.md5(text.upper_label(t)).alias("etiqueta"))


_NUMBERS = "SELECT orderkey, CASE orderkey % 5 WHEN 0 THEN importe::VARCHAR WHEN 1 THEN replace(importe::VARCHAR, '.', ',') WHEN 2 THEN '1.' || replace(importe::VARCHAR, '.', ',') WHEN 3 THEN '1,' || importe::VARCHAR ELSE 'sin dato' END AS t FROM header"


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("importe").cast("string")
    comma = F.replace(i, F.lit("."), F.lit(","))
    k = F.col("orderkey") % 5
    t = F.when(k == 0, i).when(k == 1, comma).when(k == 2, F.concat(F.lit("1."), comma)).when(k == 3, F.concat(F.lit("1,"), i)).otherwise("sin dato")
    return bridge.header(spark, d).select("orderkey", t.alias("t"))


@query("c2_decimal", sql("header", ", n AS (" + _NUMBERS + """)
SELECT orderkey, coalesce(try_cast(t AS DECIMAL(18,6)), try_cast(replace(replace(t, '.', ''), ',', '.') AS DECIMAL(18,6)), try_cast(replace(t, ',', '') AS DECIMAL(18,6)))::DOUBLE AS compat,
  CASE WHEN contains(t, ',') AND (NOT contains(t, '.') OR instr(reverse(t), ',') < instr(reverse(t), '.')) THEN try_cast(replace(replace(t, '.', ''), ',', '.') AS DECIMAL(18,6))
    ELSE try_cast(replace(t, ',', '') AS DECIMAL(18,6)) END::DOUBLE AS estricto FROM n""").replace("\n, n AS", ",\nn AS"))
def decimal(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with either decimal mark."""
    t = F.col("t")
    return _numbers(spark, d).select("orderkey", amounts.decimal(t, compat=True).cast("double").alias("compat"), amounts.decimal(t).cast("double").alias("estricto"))


_DATES = """SELECT orderkey, CASE orderkey % 6 WHEN 0 THEN strftime(fecha, '%d/%m/%Y') WHEN 1 THEN strftime(fecha, '%d/%m/%Y') || ' 10:20:30' WHEN 2 THEN strftime(fecha, '%Y-%m-%d')
  WHEN 3 THEN strftime(fecha, '%d/%m/%Y') || ' 07:05' WHEN 4 THEN '31/02/2025' ELSE 'emitido el ' || strftime(fecha, '%d-%m-%Y') END AS t FROM header"""


def _dates(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("orderkey") % 6, F.date_format("fecha", "dd/MM/yyyy")
    t = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit(" 10:20:30"))).when(k == 2, F.date_format("fecha", "yyyy-MM-dd")).when(k == 3, F.concat(day, F.lit(" 07:05"))).when(k == 4, "31/02/2025")
    return bridge.header(spark, d).select("orderkey", t.otherwise(F.concat(F.lit("emitido el "), F.date_format("fecha", "dd-MM-yyyy"))).alias("t"))


@query("c3_dates", sql("header", ", n AS (" + _DATES + """),
p AS (SELECT *, coalesce(try_strptime(t, '%d/%m/%Y %H:%M:%S'), try_strptime(t, '%d/%m/%Y %H:%M'), try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%Y-%m-%d')) AS momento,
  replace(regexp_extract(t, '\\d{2}[/-]\\d{2}[/-]\\d{4}(\\s+\\d{2}:\\d{2}(:\\d{2})?)?'), '-', '/') AS f FROM n),
q AS (SELECT *, coalesce(try_strptime(f, '%d/%m/%Y %H:%M:%S'), try_strptime(f, '%d/%m/%Y %H:%M'), try_strptime(f, '%d/%m/%Y')) AS m FROM p)
SELECT orderkey, momento, coalesce(CASE WHEN contains(f, ':') THEN strftime(m, '%d/%m/%Y %H:%M:%S') ELSE strftime(m, '%d/%m/%Y') END, '') AS dia,
  coalesce(strftime(coalesce(try_strptime(nullif(regexp_extract(t, '\\d{2}/\\d{2}/\\d{4}'), ''), '%d/%m/%Y'), try_strptime(nullif(regexp_extract(t, '\\d{4}-\\d{2}-\\d{2}'), ''), '%Y-%m-%d')), '%Y%m%d'), '') AS slug,
  coalesce(strftime(momento, '%Y-%m-%dT%H:%M:%S') || '-05:00', 'No Disponible') AS iso FROM q""").replace("\n, n AS", ",\nn AS"))
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    """Dates in several forms, impossible ones included."""
    t = F.col("t")
    iso = F.concat(F.date_format("momento", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    return _dates(spark, d).select("orderkey", dates.timestamp(t).alias("momento"), dates.day_first(t).alias("dia"), dates.date_slug(t).alias("slug")).withColumn("iso", F.coalesce(iso, F.lit(K.MISSING)))


@query("c11_document_types", sql("header", """, n AS (SELECT orderkey, ['FACTURA', 'Liquidación de compra', 'Nota de Crédito', 'NOTAS DE DÉBITO', 'Comprobante de Retención', 'Guía de remisión', 'Otro: x'][orderkey % 7 + 1] AS t FROM header)
SELECT orderkey, ['facturas', 'liquidacion_de_compra', 'notas_de_credito', 'notas_de_debito', 'retenciones', 'guia_de_remision', 'otro_x'][orderkey % 7 + 1] AS tipo,
  ['01', '03', '04', '05', '07', '06', '01'][orderkey % 7 + 1] AS codigo, [1, 2, 3, 4, 6, 5, 99][orderkey % 7 + 1] AS orden, orderkey % 7 = 4 AS es_retencion FROM n""").replace("\n, n AS", ",\nn AS"))
def document_types(spark: SparkSession, d: str) -> DataFrame:
    """A type's canonical name, code, order and predicates from its many spellings."""
    names = F.array(*[F.lit(x) for x in ("FACTURA", "Liquidación de compra", "Nota de Crédito", "NOTAS DE DÉBITO", "Comprobante de Retención", "Guía de remisión", "Otro: x")])
    t = F.get(names, (F.col("orderkey") % 7).cast("int"))
    singular = F.regexp_replace(text.slug(t), "^notas_", "nota_")
    order = K.label(singular, {k: str(v[0]) for k, v in K.TYPE_ORDER.items()}, F.lit("99")).cast("int")
    kind = keys.document_type(t)
    return bridge.header(spark, d).select("orderkey", kind.alias("tipo"), keys.document_code(t).alias("codigo"), order.alias("orden"), (kind == "retenciones").alias("es_retencion"))


@query("c15_series", sql("header", """SELECT orderkey, estab || '-' || pto || '-' || sec AS serie, estab || '-' || pto || '-' || lpad(substr(sec, 4), 9, '0') AS leida,
  CASE WHEN length((orderkey % 20000)::VARCHAR) <= 3 THEN lpad((orderkey % 20000)::VARCHAR, 3, '0') ELSE '' END AS punto, ruc AS ruc, CASE WHEN orderkey % 2 = 0 THEN 'SI' ELSE 'NO' END AS obligado FROM header"""))
def series(spark: SparkSession, d: str) -> DataFrame:
    """Series put together and read, padded numbers, taxpayer ids, yes and no."""
    written = F.concat_ws(" ", F.lit("No."), F.concat("estab", F.lit("-"), "pto", F.lit("-"), F.substring("sec", 4, 6)))
    return bridge.header(spark, d).select(
        "orderkey", keys.series(F.col("estab"), F.col("pto"), F.col("sec")).alias("serie"), keys.parse_series(written).alias("leida"), keys.padded((F.col("orderkey") % 20000).cast("string"), 3).alias("punto"),
        keys.taxpayer_id(F.concat(F.lit("RUC: "), F.col("ruc"))).alias("ruc"), keys.yes_no(F.when(F.col("orderkey") % 2 == 0, " si ").otherwise("No obligado")).alias("obligado"),
    )


@query("c17_access_keys", sql("header", """SELECT orderkey, CASE WHEN orderkey % 3 = 0 THEN '' ELSE clave END AS clave, clave AS hallada, fecha, cod_doc, ruc, '2' AS ambiente, '1' AS tipo_emision FROM header"""))
def access_keys(spark: SparkSession, d: str) -> DataFrame:
    """Check digits (a wrong one empties the key), keys found in text, and their parts."""
    last = F.right("clave", F.lit(1)).cast("int")
    broken = F.concat(F.left("clave", F.lit(48)), ((last + 1) % 10).cast("string"))
    shown = F.when(F.col("orderkey") % 3 == 0, broken).otherwise(F.concat(F.left("clave", F.lit(20)), F.lit(" "), F.substring("clave", 21, 29)))
    said = F.concat(F.lit("Clave 123: "), F.left("clave", F.lit(30)), F.lit(" "), F.substring("clave", 31, 19), F.lit(" fin 99"))
    plain = F.concat(F.lit("clave="), "clave", F.lit("; otra 1234"))
    parts = keys.key_parts(F.col("clave"))
    return bridge.header(spark, d).select(
        "orderkey", keys.access_key(shown).alias("clave"), keys.find_access_key(F.when(F.col("orderkey") % 2 == 0, plain).otherwise(F.concat(F.lit("x "), F.substring(said, 12, 50), F.lit(" y")))).alias("hallada"),
        *[parts[p].alias(p) for p in ("fecha", "cod_doc", "ruc", "ambiente", "tipo_emision")],
    )


@query("c24_rate_inference", sql("lines", """SELECT orderkey, line_num, CASE WHEN valor != 0 AND base > 0 THEN CASE WHEN abs(v - 0.15) <= 0.01 THEN 'iva15' WHEN abs(v - 0.12) <= 0.01 THEN 'iva12' WHEN abs(v - 0.08) <= 0.01 THEN 'iva8'
  WHEN abs(v - 0.05) <= 0.01 THEN 'iva5' END END AS columna FROM (SELECT *, round(descuento::DOUBLE * 2, 3) + 0.001 AS v FROM lines)"""))
def rate_inference(spark: SparkSession, d: str) -> DataFrame:
    """The rate column that tax over base falls in."""
    rate = F.round(F.col("descuento").cast("double") * 2, 3) + 0.001
    found = F.when(F.col("valor") != 0, amounts.iva_column(rate, F.when(F.col("base") > 0, F.lit(1.0))))
    return bridge.lines(spark, d).select("orderkey", "line_num", found.alias("columna"))


@query("c25_periods", sql("header", """SELECT orderkey, CASE orderkey % 3 WHEN 2 THEN NULL ELSE year(fecha) END::INTEGER AS anio, CASE orderkey % 3 WHEN 2 THEN NULL ELSE month(fecha) END::INTEGER AS mes,
  ['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', 'Septiembre', 'Octubre', 'Noviembre', 'Diciembre'][month(fecha)] AS nombre, month(fecha)::INTEGER AS numero,
  strftime(date_trunc('month', fecha), '%d/%m/%Y') || ' - ' || strftime(last_day(fecha), '%d/%m/%Y') AS rango FROM header"""))
def periods(spark: SparkSession, d: str) -> DataFrame:
    """Period tokens, month names and whole-month ranges."""
    k = F.col("orderkey") % 3
    token = F.when(k == 0, F.date_format("fecha", "yyyyMM")).when(k == 1, F.date_format("fecha", "yyyyMMdd")).otherwise("20259999")
    p = dates.period(token)
    name = dates.month_name(F.month("fecha"))
    return bridge.header(spark, d).select("orderkey", p["year"].alias("anio"), p["month"].alias("mes"), name.alias("nombre"), dates.month_number(F.upper(name)).alias("numero"), dates.month_range(F.year("fecha"), F.month("fecha")).alias("rango"))


@query("c27_row_keys", sql("header", """SELECT orderkey, CASE orderkey % 3 WHEN 0 THEN clave WHEN 1 THEN 'A' || sec ELSE sec || '|' || fecha::VARCHAR || '|' || ruc END AS clave_fila,
  CASE WHEN orderkey % 5 = 0 THEN md5(orderkey::VARCHAR) WHEN orderkey % 2 = 0 THEN ruc || ' | ' || sec ELSE sec END AS id_fila FROM header"""))
def row_keys(spark: SparkSession, d: str) -> DataFrame:
    """Business keys of rows."""
    k, there = F.col("orderkey") % 3, F.col("orderkey") % 5 != 0
    found = keys.row_key([F.when(k == 0, F.col("clave")), F.when(k == 1, F.concat(F.lit("A"), "sec")).otherwise(" ")], F.col("sec"), F.col("fecha").cast("string"), F.col("ruc"))
    return bridge.header(spark, d).select("orderkey", found.alias("clave_fila"), keys.row_id(F.when(there & (F.col("orderkey") % 2 == 0), F.col("ruc")).otherwise(" "), F.when(there, F.col("sec")), otherwise=F.col("orderkey")).alias("id_fila"))


_STRIP = "regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '&nbsp;', ' ', 'g')"
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_e}', '{_c}')"


@query("c29_strip_html", f"SELECT page_id, coalesce(trim(regexp_replace({_STRIP}, '\\s+', ' ', 'g')), '') AS texto FROM pages")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    """Pages as text."""
    return bridge.table(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("texto"))


@query("c31_cascade", "SELECT doc_id, coalesce(nullif(regexp_extract(text, '([0-9]{16})', 1), ''), nullif(regexp_extract(text, 'token = \"([0-9a-f]{8})', 1), ''), nullif(regexp_extract(text, '^([A-Z][a-z]+)', 1), '')) AS valor FROM documents")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first pattern that matches."""
    return bridge.table(spark, d, "documents").select("doc_id", text.cascade(F.col("text"), ["([0-9]{16})", 'token = "([0-9a-f]{8})', "^([A-Z][a-z]+)"]).alias("valor"))


@query("c33_tax_slugs", sql("lines", "SELECT orderkey, line_num, CASE codigo % 4 WHEN 0 THEN " + "CASE pct WHEN '0' THEN 'IVA_0' WHEN '2' THEN 'IVA_12' WHEN '3' THEN 'IVA_14' WHEN '4' THEN 'IVA_15' WHEN '6' THEN 'NO_OBJETO_IVA' ELSE 'EXENTO_IVA' END" + " WHEN 1 THEN 'ICE' WHEN 2 THEN 'IRBPNR' ELSE 'IMP_9_' || pct END AS slug FROM lines"))
def tax_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Column stems of taxes."""
    k = F.col("codigo") % 4
    code = F.when(k == 0, "2").when(k == 1, "3").when(k == 2, "5").otherwise("9")
    return bridge.lines(spark, d).select("orderkey", "line_num", K.tax_slug(code, F.col("pct")).alias("slug"))


@query("c34_cut_text", sql("lines", """SELECT orderkey, line_num, trim(CASE WHEN instr(upper(descripcion), 'RING') > 0 AND (instr(upper(descripcion), 'WIDGET') = 0 OR instr(upper(descripcion), 'RING') < instr(upper(descripcion), 'WIDGET')) THEN substr(descripcion, 1, instr(upper(descripcion), 'RING') - 1)
  WHEN instr(upper(descripcion), 'WIDGET') > 0 THEN substr(descripcion, 1, instr(upper(descripcion), 'WIDGET') - 1) ELSE descripcion END) AS corte, descripcion AS valor FROM lines"""))
def cut_text(spark: SparkSession, d: str) -> DataFrame:
    """Text cut at keywords, and values after their label."""
    line = F.concat(F.lit("Descripción: "), "descripcion")
    return bridge.lines(spark, d).select("orderkey", "line_num", text.cut_at(F.col("descripcion"), ["ring", "widget"]).alias("corte"), text.after_label(line, ["detalle", "descripción"]).alias("valor"))


@query("c36_payment_lines", sql("lines", "SELECT orderkey, line_num, forma_pago AS forma, precio::DOUBLE AS monto FROM lines"))
def payment_lines(spark: SparkSession, d: str) -> DataFrame:
    """A payment form and its trailing amount from one line of text."""
    line = F.concat("forma_pago", F.lit(" - "), K.label(F.col("forma_pago"), K.PAYMENT), F.lit("  "), "precio")
    return bridge.lines(spark, d).select("orderkey", "line_num", F.regexp_extract(line, r"^(\d{2})\b", 1).alias("forma"), amounts.amount(F.regexp_extract(line, r"([\d.,]+)\s*$", 1)).cast("double").alias("monto"))


@query("c39_history_display", sql("history", """SELECT run_id, row_number() OVER (ORDER BY timestamp DESC, run_id) AS n, CASE WHEN dia = 'Todos' THEN strftime(date_trunc('month', timestamp), '%d/%m/%Y') || ' - ' || strftime(last_day(timestamp), '%d/%m/%Y') ELSE 'N/A' END AS filtro
  FROM history WHERE tipo = 'purchase' QUALIFY n <= 500""").replace(", row_number() OVER (ORDER BY timestamp DESC, run_id) AS n", "").replace("QUALIFY n <= 500", ""))
def history_display(spark: SparkSession, d: str) -> DataFrame:
    """Whole-month runs show their range, blanks are N/A."""
    shown = F.when(F.col("dia") == "Todos", dates.month_range(F.col("anio"), F.col("mes"))).otherwise("N/A")
    return bridge.history(spark, d).filter("tipo = 'purchase'").select("run_id", shown.alias("filtro"))




@query("f12_present", sql("header", "SELECT orderkey, trim(split_part(c_mktsegment || ',n/a, ,Sin dato,No Disponible,NONE', ',', (orderkey % 6 + 1)::INTEGER)) NOT IN ('n/a', '', 'Sin dato', 'No Disponible', 'NONE') AS presente, estado IS NULL OR custkey % 3 = 0 AS escasa FROM header LEFT JOIN customer ON custkey = c_custkey"))
def present(spark: SparkSession, d: str) -> DataFrame:
    """whether a value says something, and rows with too few such values."""
    c = bridge.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    h = bridge.header(spark, d).join(c, F.col("custkey") == F.col("c_custkey"), "left")
    v = F.split_part(F.concat("c_mktsegment", F.lit(",n/a, ,Sin dato,No Disponible,NONE")), F.lit(","), (F.col("orderkey") % 6 + 1).cast("int"))
    values = [F.col("estado"), F.col("origin"), F.when(F.col("custkey") % 3 != 0, F.col("prioridad")), F.col("importe").cast("string")]
    said = sum(F.when(text.is_present(F.coalesce(x, F.lit(""))), 1).otherwise(0) for x in values)
    return h.select("orderkey", text.is_present(v).alias("presente"), (said < 4).alias("escasa"))


@query("f16_guards", sql("header", """SELECT orderkey, CASE WHEN orderkey % 2 = 0 THEN importe::VARCHAR END AS monto, CASE orderkey % 4 WHEN 1 THEN 'Sra. ' || prioridad ELSE '' END AS nombre,
  orderkey % 3 = 0 AS direccion FROM header"""))
def guards(spark: SparkSession, d: str) -> DataFrame:
    """Amounts without digits are blanked; what doesn't look like a name or an address is none."""
    shown = F.when(F.col("orderkey") % 2 == 0, F.col("importe").cast("string")).otherwise("--")
    k = F.col("orderkey") % 4
    name = F.when(k == 0, F.date_format("fecha", "dd/MM/yyyy")).when(k == 1, F.concat(F.lit(" Sra. "), "prioridad")).when(k == 2, F.col("importe").cast("string")).otherwise("-")
    place = F.when(F.col("orderkey") % 3 == 0, F.concat(F.lit("Av. Norte y Calle "), "sec")).otherwise(F.col("clave"))
    return bridge.header(spark, d).select("orderkey", F.when(shown.rlike(r"\d"), shown).alias("monto"), text.party_name(name).alias("nombre"), textrules.looks_like_address(place).alias("direccion"))
