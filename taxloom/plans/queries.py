"""Queries over document tables: summaries, tax and payment aggregates, report rows, joins, windows and unions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxloom import catalogs as K
from taxloom.functions import keys as KEY
from taxloom.operators import combine, select, summary
from taxloom.plans import bridge
from taxloom.plans.bridge import sql
from taxloom.sources import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def _case(code: str, names: dict[str, str], default: str | None = None) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {default or code} END"


@query("p1_header", sql("header", "SELECT orderkey, cod_doc, ruc, estab, pto, sec, fecha, importe::DOUBLE AS importe, estado, origin, clave FROM header"))
def header(spark: SparkSession, d: str) -> DataFrame:
    """Header rows with their access keys."""
    return bridge.header(spark, d).withColumn("importe", F.col("importe").cast("double")).drop("custkey", "prioridad")


@query("p4_type_amounts", sql("header", """SELECT orderkey, cod_doc, CASE WHEN cod_doc != '07' THEN coalesce(nullif(importe, 0), 0)::DOUBLE END AS importe,
  CASE WHEN cod_doc = '04' THEN importe::DOUBLE END AS valor_modificacion, CASE WHEN cod_doc = '05' THEN importe::DOUBLE END AS valor_total,
  CASE WHEN cod_doc = '07' THEN strftime(fecha, '%m/%Y') END AS periodo_fiscal FROM header"""))
def type_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Which amount a document's type reports."""
    amount = F.col("importe").cast("double")
    return bridge.header(spark, d).select(
        "orderkey",
        "cod_doc",
        F.when(F.col("cod_doc") != "07", F.coalesce(F.nullif(amount, F.lit(0.0)), F.lit(0.0))).alias("importe"),
        F.when(F.col("cod_doc") == "04", amount).alias("valor_modificacion"),
        F.when(F.col("cod_doc") == "05", amount).alias("valor_total"),
        F.when(F.col("cod_doc") == "07", F.date_format("fecha", "MM/yyyy")).alias("periodo_fiscal"),
    )


@query("p3_receiver", sql("header", """SELECT orderkey, coalesce(nullif(CASE WHEN origin = 'Emitidos' THEN c_name ELSE '' END, ''), ruc) AS receptor,
  CASE WHEN length(ruc) = 13 THEN '04' WHEN length(ruc) = 10 THEN '05' ELSE '' END AS tipo_identificacion
FROM header LEFT JOIN customer ON custkey = c_custkey"""))
def receiver(spark: SparkSession, d: str) -> DataFrame:
    """The first receiver that is named, and the type of its identification."""
    c = bridge.table(spark, d, "customer").select("c_custkey", "c_name")
    h = bridge.header(spark, d).join(c, F.col("custkey") == F.col("c_custkey"), "left")
    name = F.when(F.col("origin") == "Emitidos", F.col("c_name")).otherwise("")
    return h.select("orderkey", F.coalesce(F.nullif(name, F.lit("")), "ruc").alias("receptor"), KEY.id_type(F.col("ruc")).alias("tipo_identificacion"))


@query("p5_receipt_name", sql("header", """SELECT orderkey, left(CASE cod_doc WHEN '01' THEN 'Factura' WHEN '03' THEN 'Liquidacion_de_compra' WHEN '04' THEN 'Nota_de_credito'
  WHEN '05' THEN 'Nota_de_debito' ELSE 'Comprobante_de_retencion' END || '_' || estab || '-' || pto || '-' || sec || '_' || ruc || '_' || strftime(fecha, '%Y%m%d')
  || '_' || replace(importe::VARCHAR, '.', '_'), 180) AS nombre FROM header"""))
def receipt_name(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic document name of at most 180 characters."""
    from taxloom.functions.amounts import amount_slug
    from taxloom.functions.text import file_name

    parts = [K.label(F.col("cod_doc"), K.DOC_TYPE), KEY.series(F.col("estab"), F.col("pto"), F.col("sec")), F.col("ruc"), F.date_format("fecha", "yyyyMMdd"), amount_slug(F.col("importe"))]
    return bridge.header(spark, d).select("orderkey", file_name(F.concat_ws("_", *parts)).alias("nombre"))


@query("p6_standard_row", sql("header lines", """SELECT h.orderkey, clave AS "claveAcceso", cod_doc AS "codDoc", estab || '-' || pto || '-' || sec AS "numeroComprobante",
  strftime(fecha, '%Y-%m-%d') AS "fechaEmision", ruc AS "rucEmisor", importe::DOUBLE AS "importeTotal", coalesce(t, 'No Disponible') AS descripcion
FROM header h LEFT JOIN (SELECT orderkey, string_agg(descripcion, ' ; ' ORDER BY line_num) AS t FROM lines GROUP BY orderkey) USING (orderkey)"""))
def standard_row(spark: SparkSession, d: str) -> DataFrame:
    """The standard report row."""
    text = summary.joined_texts(bridge.lines(spark, d), separator=" ; ")
    return bridge.header(spark, d).join(text, "orderkey", "left").select(
        "orderkey",
        F.col("clave").alias("claveAcceso"),
        F.col("cod_doc").alias("codDoc"),
        KEY.series(F.col("estab"), F.col("pto"), F.col("sec")).alias("numeroComprobante"),
        F.date_format("fecha", "yyyy-MM-dd").alias("fechaEmision"),
        F.col("ruc").alias("rucEmisor"),
        F.col("importe").cast("double").alias("importeTotal"),
        F.coalesce("descripciones", F.lit(K.MISSING)).alias("descripcion"),
    )


@query("p8_rate_columns", sql("header lines", """, r AS (SELECT orderkey, coalesce(sum(base) FILTER (pct = '0'), 0)::DOUBLE AS b0, coalesce(sum(base) FILTER (pct = '2'), 0)::DOUBLE AS b12,
    coalesce(sum(base) FILTER (pct = '3'), 0)::DOUBLE AS b14, coalesce(sum(base) FILTER (pct = '4'), 0)::DOUBLE AS b15,
    coalesce(sum(base) FILTER (pct = '6'), 0)::DOUBLE AS no_objeto, coalesce(sum(base) FILTER (pct = '7'), 0)::DOUBLE AS exento,
    coalesce(sum(valor) FILTER (pct = '3'), 0)::DOUBLE AS v14 FROM lines GROUP BY orderkey)
SELECT h.orderkey, coalesce(b0, 0) AS subtotal_0, coalesce(b12, 0) AS subtotal_12, coalesce(b15, 0) AS subtotal_15, coalesce(b14, 0) AS subtotal_8,
  coalesce(v14, 0) AS iva_8, coalesce(no_objeto, 0) AS subtotal_no_objeto, coalesce(exento, 0) AS subtotal_exento
FROM header h LEFT JOIN r USING (orderkey)""").replace("\n, r AS", ",\nr AS"))
def rate_columns(spark: SparkSession, d: str) -> DataFrame:
    """A subtotal for each rate; the 14 % bucket fills the 8 % columns, which have no code of their own."""
    pivot = summary.tax_pivot(bridge.taxes(spark, d), ["IVA_0", "IVA_12", "IVA_14", "IVA_15", "NO_OBJETO_IVA", "EXENTO_IVA"])
    out = bridge.header(spark, d).select("orderkey").join(pivot, "orderkey", "left").na.fill(0.0)
    return out.select(
        "orderkey", F.col("IVA_0_BASE").alias("subtotal_0"), F.col("IVA_12_BASE").alias("subtotal_12"), F.col("IVA_15_BASE").alias("subtotal_15"), F.col("IVA_14_BASE").alias("subtotal_8"),
        F.col("IVA_14_VALOR").alias("iva_8"), F.col("NO_OBJETO_IVA_BASE").alias("subtotal_no_objeto"), F.col("EXENTO_IVA_BASE").alias("subtotal_exento"),
    )


@query("p9_issued_invoice", sql("header lines", """SELECT h.orderkey, clave, coalesce(iva, 0) AS iva, coalesce(gravada, 0) AS base_gravada, coalesce(total, 0) AS base_total,
  coalesce(items, 'No Disponible') AS items
FROM header h LEFT JOIN (SELECT orderkey, sum(valor)::DOUBLE AS iva, (sum(base) FILTER (pct IN ('2', '3', '4', '5')))::DOUBLE AS gravada, sum(base)::DOUBLE AS total,
  string_agg('Código: ' || codigo || ', Desc: ' || descripcion || ', Cant: ' || cantidad || ', P.Unit: ' || precio, chr(10) ORDER BY line_num) AS items
  FROM lines GROUP BY orderkey) USING (orderkey) WHERE cod_doc = '01' AND origin = 'Emitidos'"""))
def issued_invoice(spark: SparkSession, d: str) -> DataFrame:
    """Issued invoices with VAT, bases and templated items."""
    item = F.concat(F.lit("Código: "), F.col("codigo"), F.lit(", Desc: "), "descripcion", F.lit(", Cant: "), "cantidad", F.lit(", P.Unit: "), "precio")
    lines = bridge.lines(spark, d).withColumn("item", item)
    rows = F.array_sort(F.collect_list(F.struct("line_num", "item")))
    agg = lines.groupBy("orderkey").agg(
        F.sum("valor").cast("double").alias("iva"), F.sum(F.when(F.col("pct").isin(K.TAXED_RATES), F.col("base"))).cast("double").alias("gravada"),
        F.sum("base").cast("double").alias("total"), F.array_join(F.transform(rows, lambda s: s["item"]), "\n").alias("items"),
    )
    h = bridge.header(spark, d).filter("cod_doc = '01' and origin = 'Emitidos'")
    zero = F.lit(0.0)
    return h.join(agg, "orderkey", "left").select(
        "orderkey", "clave", F.coalesce("iva", zero).alias("iva"), F.coalesce("gravada", zero).alias("base_gravada"), F.coalesce("total", zero).alias("base_total"), F.coalesce("items", F.lit(K.MISSING)).alias("items")
    )


_SLOT = """{n} AS (SELECT orderkey, sum(base)::DOUBLE AS {n}_base, CASE WHEN count(*) > 1 THEN 'Varios' ELSE '{n}' END AS {n}_impuesto,
    CASE WHEN count(*) > 1 THEN 0 ELSE min_by(pct, line_num)::DOUBLE END AS {n}_pct, sum(valor)::DOUBLE AS {n}_valor,
    list(base ORDER BY line_num)[1]::DOUBLE AS {n}_base_1, list(pct ORDER BY line_num)[1]::DOUBLE AS {n}_pct_1, list(valor ORDER BY line_num)[1]::DOUBLE AS {n}_valor_1,
    coalesce(list(base ORDER BY line_num)[2]::DOUBLE, 0) AS {n}_base_2, coalesce(list(pct ORDER BY line_num)[2]::DOUBLE, 0) AS {n}_pct_2,
    coalesce(list(valor ORDER BY line_num)[2]::DOUBLE, 0) AS {n}_valor_2 FROM withholdings WHERE codigo = '{c}' GROUP BY orderkey)"""
_SLOT_COLUMNS = ["base", "pct", "valor", "base_1", "pct_1", "valor_1", "base_2", "pct_2", "valor_2"]


@query("p13_withholding_slots", sql("header lines withholdings", ", " + _SLOT.format(n="IVA", c="2") + ", " + _SLOT.format(n="Renta", c="1") + """
SELECT h.orderkey, clave, """ + ", ".join(f"coalesce({n}_{c}, 0) AS {n}_{c}" for n in ("IVA", "Renta") for c in _SLOT_COLUMNS) + """,
  coalesce(IVA_impuesto, 'No Aplica') AS IVA_impuesto, coalesce(Renta_impuesto, 'No Aplica') AS Renta_impuesto
FROM header h LEFT JOIN IVA i ON h.orderkey = i.orderkey LEFT JOIN Renta r ON h.orderkey = r.orderkey WHERE cod_doc = '07'""").replace("\n, IVA AS", ",\nIVA AS"))
def withholding_slots(spark: SparkSession, d: str) -> DataFrame:
    """Withholding rows with summary and two details for each tax."""
    slots = summary.withheld_slots(bridge.withholdings(spark, d), {"2": "IVA", "1": "Renta"})
    out = bridge.header(spark, d).filter("cod_doc = '07'").select("orderkey", "clave").join(slots, "orderkey", "left")
    return summary.fill_slots(summary.fill_slots(out, "IVA"), "Renta")


@query("p15_rate_cascade", sql("lines", """SELECT orderkey, coalesce(nullif(coalesce((sum(base) FILTER (pct = '4'))::DOUBLE, 0), 0), nullif(coalesce((sum(base) FILTER (pct = '2'))::DOUBLE, 0), 0),
  nullif(coalesce((sum(base) FILTER (pct = '3'))::DOUBLE, 0), 0), 0) AS base, CASE WHEN coalesce(sum(base) FILTER (pct = '4'), 0) != 0 THEN 'iva15'
  WHEN coalesce(sum(base) FILTER (pct = '2'), 0) != 0 THEN 'iva12' WHEN coalesce(sum(base) FILTER (pct = '3'), 0) != 0 THEN 'iva8' END AS columna
FROM lines GROUP BY orderkey"""))
def rate_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Part of P15: the first rate in use, from the highest, with zero as default."""
    p = summary.tax_pivot(bridge.taxes(spark, d), ["IVA_15", "IVA_12", "IVA_14"]).na.fill(0.0)
    zero = F.lit(0.0)
    columns = [("IVA_15_BASE", "iva15"), ("IVA_12_BASE", "iva12"), ("IVA_14_BASE", "iva8")]
    return p.select("orderkey", F.coalesce(*[F.nullif(F.col(c), zero) for c, _ in columns], zero).alias("base"), F.coalesce(*[F.when(F.col(c) != 0, n) for c, n in columns]).alias("columna"))


@query("p18_conform", sql("header", "SELECT clave, importe::DOUBLE AS importe, NULL::DOUBLE AS propina, 'DOLAR' AS moneda, try_cast(prioridad AS INTEGER) AS prioridad FROM header"))
def conformed(spark: SparkSession, d: str) -> DataFrame:
    """Exactly a report's columns; what is missing is added, what doesn't convert is empty."""
    return combine.conform(bridge.header(spark, d), {"clave": "string", "importe": "double", "propina": "double", "moneda": "string", "prioridad": "int"}, {"moneda": "DOLAR"})


@query("p20_labels", sql("header", "SELECT orderkey, " + _case("cod_doc", K.DOC_TYPE, "'Desconocido (' || cod_doc || ')'") + " AS tipo, " + _case("substr(clave, 24, 1)", K.ENVIRONMENT) + " AS ambiente, " + _case("lpad((orderkey % 30)::VARCHAR, 2, '0')", K.PAYMENT, "'Desconocido (' || lpad((orderkey % 30)::VARCHAR, 2, '0') || ')'") + " AS forma_pago FROM header"))
def labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of codes from broadcast catalogues, with a fallback."""
    h = bridge.header(spark, d).withColumn("pago", F.lpad((F.col("orderkey") % 30).cast("string"), 2, "0"))
    names = K.dimension(spark, K.PAYMENT, "pago", "pago_label")  # a catalogue: a few rows

    def unknown(code: str):
        return F.concat(F.lit("Desconocido ("), F.col(code), F.lit(")"))

    return h.join(F.broadcast(names), "pago", "left").select(
        "orderkey", K.label(F.col("cod_doc"), K.DOC_TYPE, unknown("cod_doc")).alias("tipo"), K.label(KEY.key_parts(F.col("clave"))["ambiente"], K.ENVIRONMENT).alias("ambiente"),
        F.coalesce("pago_label", unknown("pago")).alias("forma_pago"),
    )


@query("p21_default_status", sql("header", "SELECT orderkey, coalesce(nullif(estado, ''), 'AUTORIZADO') AS estado FROM header"))
def default_status(spark: SparkSession, d: str) -> DataFrame:
    """The default where no status is known."""
    return bridge.header(spark, d).select("orderkey", F.coalesce(F.nullif("estado", F.lit("")), F.lit("AUTORIZADO")).alias("estado"))


@query("p23_back_fill", sql("header", """SELECT orderkey, CASE WHEN orderkey % 4 = 0 THEN 'L' || clave ELSE clave END AS clave FROM header"""))
def back_fill(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a document lacks come from the listing row."""
    h = bridge.header(spark, d)
    documents = h.select("orderkey", F.when(F.col("orderkey") % 4 != 0, F.col("clave")).alias("clave"))
    listing = h.select("orderkey", F.concat(F.lit("L"), "clave").alias("clave"))
    return combine.merged([documents, listing], "orderkey", ["clave"])


@query("a1_count_by_type", sql("header", "SELECT " + _case("cod_doc", K.DOC_COUNTER, "'otros'") + """ AS tipo, count(*) AS n, min(fecha) AS desde, max(fecha) AS hasta,
  'RECIBIDOS_' || min(fecha)::VARCHAR AS consulta, (sum(CASE WHEN cod_doc != '07' THEN importe END))::DOUBLE AS total FROM header GROUP BY 1"""))
def count_by_type(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2, A3: counts, totals and the period covered, by document type."""
    h = bridge.header(spark, d).withColumn("tipo", K.label(F.col("cod_doc"), K.DOC_COUNTER, F.lit("otros")))
    return h.groupBy("tipo").agg(
        F.count(F.lit(1)).alias("n"), F.min("fecha").alias("desde"), F.max("fecha").alias("hasta"), F.concat(F.lit("RECIBIDOS_"), F.min("fecha").cast("string")).alias("consulta"),
        F.sum(F.when(F.col("cod_doc") != "07", F.col("importe"))).cast("double").alias("total"),
    )


@query("a2_totals", sql("header lines", """SELECT (SELECT sum(valor)::DOUBLE FROM lines WHERE orderkey % 5 = 4) AS retenido, (SELECT sum(importe)::DOUBLE FROM header WHERE cod_doc != '07') AS importe,
  (SELECT sum(valor)::DOUBLE FROM lines WHERE orderkey % 5 = 4) + (SELECT sum(importe)::DOUBLE FROM header WHERE cod_doc != '07') AS total"""))
def totals(spark: SparkSession, d: str) -> DataFrame:
    """A2: what type 07 withholds, what the rest amounts to, and both; the two sums are of one row each."""
    held = bridge.taxes(spark, d).filter("orderkey % 5 = 4").agg(F.sum("valor").cast("double").alias("v"))
    paid = bridge.header(spark, d).filter("cod_doc != '07'").agg(F.sum("importe").cast("double").alias("v"))
    both = held.select("v", F.lit(1).alias("k")).unionByName(paid.select("v", F.lit(2).alias("k")))
    out = both.agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("retenido"), F.max(F.when(F.col("k") == 2, F.col("v"))).alias("importe"))
    return out.withColumn("total", F.col("retenido") + F.col("importe"))


@query("a4_tax_by_code", sql("lines", "SELECT orderkey, codigo_impuesto AS codigo, pct, sum(base)::DOUBLE AS base, sum(valor)::DOUBLE AS valor FROM lines GROUP BY ALL"))
def tax_by_code(spark: SparkSession, d: str) -> DataFrame:
    """A4, F8: tax totals by document, code and rate."""
    t = summary.tax_totals(bridge.taxes(spark, d).filter("nivel = 'DOCUMENTO' and codigo = '2'"))
    return t.withColumn("base", F.col("base").cast("double")).withColumn("valor", F.col("valor").cast("double"))


_SLUGS = {"0": "IVA_0", "2": "IVA_12", "3": "IVA_14", "4": "IVA_15", "6": "NO_OBJETO_IVA", "7": "EXENTO_IVA"}


@query("a5_tax_pivot", sql("lines", "SELECT orderkey, " + ", ".join(f"(sum(base) FILTER (pct = '{c}'))::DOUBLE AS {s}_BASE, (sum(valor) FILTER (pct = '{c}'))::DOUBLE AS {s}_VALOR" for c, s in _SLUGS.items()) + " FROM lines GROUP BY orderkey"))
def tax_pivot(spark: SparkSession, d: str) -> DataFrame:
    """The wide tax table."""
    return summary.tax_pivot(bridge.taxes(spark, d), list(_SLUGS.values()))


@query("a6_line_families", sql("lines", """SELECT orderkey, line_num, (sum(base) FILTER (codigo_impuesto = '2'))::DOUBLE AS iva_base, (sum(valor) FILTER (codigo_impuesto = '2'))::DOUBLE AS iva_valor,
  coalesce((sum(valor) FILTER (codigo_impuesto = '3'))::DOUBLE, 0) AS ice_valor, max_by(pct, posicion) AS ultimo_pct FROM lines GROUP BY orderkey, line_num"""))
def line_families(spark: SparkSession, d: str) -> DataFrame:
    """Tax totals of a line by family, and its last rate code."""

    def part(value: str, code: str):
        return F.sum(F.when(F.col("codigo_impuesto") == code, F.col(value))).cast("double")

    return bridge.lines(spark, d).groupBy("orderkey", "line_num").agg(
        part("base", "2").alias("iva_base"), part("valor", "2").alias("iva_valor"), F.coalesce(part("valor", "3"), F.lit(0.0)).alias("ice_valor"), F.max_by("pct", "posicion").alias("ultimo_pct")
    )


@query("a10_joined_lines", sql("lines", "SELECT orderkey, string_agg(descripcion, ' | ' ORDER BY line_num) AS descripciones FROM lines WHERE trim(descripcion) != '' GROUP BY orderkey"))
def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """A10, J1."""
    return summary.joined_texts(bridge.lines(spark, d))


@query("a11_rates_seen", sql("lines", """SELECT orderkey, array_to_string(list_transform(list_sort(list([f, k]::VARCHAR[])), lambda x: x[2]), ', ') AS tarifas FROM (
  SELECT orderkey, lpad(min(line_num)::VARCHAR, 9, '0') AS f, pct AS k FROM lines GROUP BY orderkey, pct) GROUP BY orderkey"""))
def rates_seen(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rates in the order in which they are first seen."""
    rows = F.array_sort(F.collect_list(F.struct("line_num", "pct")))
    return bridge.lines(spark, d).groupBy("orderkey").agg(F.array_join(F.array_distinct(F.transform(rows, lambda s: s["pct"])), ", ").alias("tarifas"))


@query("a13_by_client", sql("header", "SELECT nullif(ruc, lpad('7', 10, '0') || '001') AS cliente, sum(importe)::DOUBLE AS total, count(*) AS n FROM header GROUP BY 1"))
def by_client(spark: SparkSession, d: str) -> DataFrame:
    """Totals by client, with the null client."""
    h = bridge.header(spark, d).withColumn("cliente", F.nullif("ruc", F.lit("0000000007001")))
    return h.groupBy("cliente").agg(F.sum(F.coalesce("importe", F.lit(0).cast("decimal(14,2)"))).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query("a14_rollup", sql("history", """SELECT anio, mes, day(timestamp)::INTEGER AS dia_num, sum(n_xml)::BIGINT AS n_xml, sum(n_pdf)::BIGINT AS n_pdf, count(*) AS n_registros,
  grouping_id(anio, mes, day(timestamp)::INTEGER) AS nivel, CASE WHEN sum(n_xml) + sum(n_pdf) = 0 THEN 'sin_resultados' ELSE 'completado' END AS estado
FROM history GROUP BY ROLLUP (anio, mes, day(timestamp)::INTEGER)"""))
def rollup(spark: SparkSession, d: str) -> DataFrame:
    """Run counters by day, month, year and in all."""
    return combine.rollup_runs(bridge.history(spark, d).withColumn("dia_num", F.dayofmonth("timestamp")), ["anio", "mes", "dia_num"], ["n_xml", "n_pdf"])


@query("a15_error_digest", sql("header", "SELECT origin, count(*) AS n, array_to_string(list_sort(list(clave))[1:5], ', ') AS primeros FROM header WHERE estado = 'NO AUTORIZADO' GROUP BY origin"))
def error_digest(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have an error, and the first five keys; five rows a group leave the window."""
    bad = bridge.header(spark, d).filter("estado = 'NO AUTORIZADO'")
    first = bad.withColumn("r", F.row_number().over(Window.partitionBy("origin").orderBy("clave"))).filter("r <= 5").groupBy("origin").agg(F.array_join(F.array_sort(F.collect_list("clave")), ", ").alias("primeros"))
    return bad.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).join(first, "origin")


@query("a16_best_evidence", sql("lines", """SELECT orderkey, forma_pago AS campo, arg_max(descripcion, [(descuento * 100)::INTEGER, -line_num]) AS valor FROM lines
  WHERE trim(descripcion) != '' GROUP BY ALL"""))
def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    """For each field the value with the most confidence, the earliest of ties."""
    rank = F.struct((F.col("descuento") * 100).cast("int"), -F.col("line_num"))
    return bridge.lines(spark, d).filter("trim(descripcion) != ''").groupBy("orderkey", F.col("forma_pago").alias("campo")).agg(F.max_by("descripcion", rank).alias("valor"))


@query("a17_facet_options", sql("history", "SELECT DISTINCT dia AS option FROM history WHERE origen = 'Emitidos' AND tipo = 'click' AND trim(dia) != ''"))
def facet_options(spark: SparkSession, d: str) -> DataFrame:
    """The values left to choose from after earlier choices."""
    return select.options(select.facets(bridge.history(spark, d), {"origen": "Emitidos", "tipo": "click", "ruc": select.ALL}), "dia", numeric=True)


_SPLIT = """split AS (
  SELECT orderkey, coalesce(sum(base) FILTER (pct IN ('2', '3', '4', '5')), 0)::DOUBLE AS base_gravada,
    coalesce(sum(base) FILTER (pct IN ('0', '6', '7')), 0)::DOUBLE AS base_no_gravada,
    coalesce(sum(valor) FILTER (pct IN ('2', '3', '4', '5')), 0)::DOUBLE AS monto_iva,
    coalesce(sum(base) FILTER (pct = '2'), 0)::DOUBLE AS base_gravada_12, coalesce(sum(valor) FILTER (pct = '2'), 0)::DOUBLE AS monto_iva_12,
    CASE WHEN concat_ws(', ', CASE WHEN sum(base) FILTER (pct = '2') > 0 THEN '12%' END, CASE WHEN sum(base) FILTER (pct = '3') > 0 THEN '14%' END,
        CASE WHEN sum(base) FILTER (pct = '4') > 0 THEN '15%' END) != ''
      THEN concat_ws(', ', CASE WHEN sum(base) FILTER (pct = '2') > 0 THEN '12%' END, CASE WHEN sum(base) FILTER (pct = '3') > 0 THEN '14%' END,
        CASE WHEN sum(base) FILTER (pct = '4') > 0 THEN '15%' END)
      WHEN coalesce(sum(base) FILTER (pct IN ('0', '6', '7')), 0) > 0 THEN '0%' ELSE 'No Disponible' END AS tarifas_iva
  FROM lines GROUP BY orderkey)"""


@query("a18_tax_split", sql("lines", ", " + _SPLIT + "\nSELECT * FROM split").replace("\n, split", ",\nsplit"))
def tax_split(spark: SparkSession, d: str) -> DataFrame:
    """Taxed and untaxed base and VAT."""
    return summary.tax_split(bridge.taxes(spark, d))


@query("j3_first_payment", sql("header lines", """SELECT h.orderkey, p.forma_pago, coalesce(total_pago, 0) AS total_pago FROM header h LEFT JOIN (
  SELECT orderkey, min_by(forma_pago, line_num) AS forma_pago, sum(base)::DOUBLE AS total_pago FROM lines GROUP BY orderkey) p USING (orderkey)"""))
def first_payment(spark: SparkSession, d: str) -> DataFrame:
    """J3, W4."""
    pay = summary.first_payment(bridge.lines(spark, d))
    return bridge.header(spark, d).select("orderkey").join(pay, "orderkey", "left").na.fill({"total_pago": 0.0})


@query("j4_extra_fields", sql("header", """SELECT orderkey, to_json([{'nombre': 'prioridad', 'valor': prioridad}, {'nombre': 'origen', 'valor': origin}])::VARCHAR AS json,
  'prioridad: ' || prioridad || '; origen: ' || origin AS campos FROM header"""))
def extra_fields(spark: SparkSession, d: str) -> DataFrame:
    """Extra fields to JSON, back, and joined."""
    pair = F.array(*[F.struct(F.lit(n).alias("nombre"), F.col(c).alias("valor")) for n, c in (("prioridad", "prioridad"), ("origen", "origin"))])
    out = bridge.header(spark, d).select("orderkey", F.to_json(pair).alias("json"))
    back = F.from_json("json", "array<struct<nombre:string,valor:string>>")
    return out.withColumn("campos", F.array_join(F.transform(back, lambda x: F.concat_ws(": ", x["nombre"], x["valor"])), "; "))


@query("j5_fallback_union", sql("header", """, pdf AS (SELECT CASE WHEN orderkey % 30 = 0 THEN '' WHEN orderkey % 2 = 0 THEN clave ELSE 'P' || (orderkey // 4) END AS clave, orderkey AS ruta, 'PDF' AS fuente
    FROM header WHERE cod_doc != '07'),
  xml AS (SELECT clave, orderkey AS ruta, 'XML' AS fuente FROM header WHERE estado IS NOT NULL)
SELECT * FROM xml UNION ALL SELECT * FROM pdf WHERE clave = ''
UNION ALL SELECT clave, min(ruta), 'PDF' FROM pdf WHERE clave != '' AND clave NOT IN (SELECT clave FROM xml) GROUP BY clave""").replace("\n, pdf", ",\npdf"))
def fallback_union(spark: SparkSession, d: str) -> DataFrame:
    """All XML rows, and printed forms whose key no XML row and no earlier form has."""
    h = bridge.header(spark, d)
    key = F.when(F.col("orderkey") % 30 == 0, "").when(F.col("orderkey") % 2 == 0, F.col("clave")).otherwise(F.concat(F.lit("P"), F.floor(F.col("orderkey") / 4).cast("string")))
    pdf = h.filter("cod_doc != '07'").select(key.alias("clave"), F.col("orderkey").alias("ruta"), F.lit("PDF").alias("fuente"))
    xml = h.filter("estado is not null").select("clave", F.col("orderkey").alias("ruta"), F.lit("XML").alias("fuente"))
    return combine.with_fallback(xml, pdf, "clave", "ruta")


@query("j6_reconciliation", sql("header", """SELECT origin, count(*) AS esperados, count(l.orderkey) AS obtenidos, (count(*) - count(l.orderkey))::BIGINT AS faltantes, count(*) = count(l.orderkey) AS completa
FROM header h LEFT JOIN (SELECT DISTINCT l_orderkey AS orderkey FROM lineitem) l USING (orderkey) GROUP BY origin"""))
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Expected against obtained documents."""
    obtained = bridge.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    rows = combine.reconciled(bridge.header(spark, d).select("orderkey"), obtained, ["orderkey"]).filter("esperado = 1")
    return combine.completeness(rows.join(bridge.header(spark, d).select("orderkey", "origin"), "orderkey"), ["origin"])


@query("u4_missing", sql("header", "SELECT orderkey FROM header WHERE orderkey NOT IN (SELECT l_orderkey FROM lineitem)"))
def missing(spark: SparkSession, d: str) -> DataFrame:
    """U4: the expected documents that weren't obtained, as a set."""
    return bridge.header(spark, d).select("orderkey").join(bridge.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey")), "orderkey", "left_anti")


@query("j9_first_present", sql("header", """SELECT orderkey, coalesce(nullif(CASE WHEN orderkey % 3 = 0 THEN estado ELSE '' END, ''), nullif(CASE WHEN estado IS NOT NULL THEN origin END, ''), prioridad) AS valor FROM header"""))
def first_present(spark: SparkSession, d: str) -> DataFrame:
    """The first of three sources that says something."""
    h = bridge.header(spark, d)
    a = h.select("orderkey", F.when(F.col("orderkey") % 3 == 0, F.col("estado")).otherwise("").alias("valor"))
    b = h.filter("estado is not null").select("orderkey", F.col("origin").alias("valor"))
    c = h.select("orderkey", F.col("prioridad").alias("valor"))
    return combine.merged([a, b, c], "orderkey", ["valor"])


@query("j10_entitlements", """SELECT c_custkey AS license_id, count(*) AS devices FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_acctbal > 0 AND (o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1997-01-01') AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) GROUP BY c_custkey""")
def entitlements(spark: SparkSession, d: str) -> DataFrame:
    """Part of J10: active licences that haven't expired, of entitled users, with their devices."""
    licences = bridge.table(spark, d, "customer").filter("c_acctbal > 0")
    users = bridge.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("c_nationkey"))
    devices = bridge.table(spark, d, "orders").filter("o_orderdate is null or o_orderdate >= '1997-01-01'")
    joined = licences.join(users, "c_nationkey", "left_semi").join(devices, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_custkey").alias("license_id")).agg(F.count(F.lit(1)).alias("devices"))


@query("j10_requests", """WITH licences AS (SELECT c_custkey AS license_id, c_nationkey AS user_id, c_acctbal > 0 AS is_active, CASE WHEN c_custkey % 3 = 0 THEN 'fp' || c_custkey % 4 END AS device_fingerprint,
    CASE WHEN c_custkey % 5 != 0 THEN DATE '1996-01-01' + (c_custkey % 1000)::INTEGER END AS expires_at FROM customer),
  devices AS (SELECT DISTINCT o_custkey AS license_id, 'fp' || o_orderkey % 4 AS fingerprint FROM orders WHERE o_orderkey % 50 = 0),
  requests AS (SELECT o_orderkey AS request_id, o_custkey % 25 AS user_id, 'fp' || o_orderkey % 6 AS fingerprint FROM orders),
  own AS (SELECT r.*, l.* EXCLUDE (user_id) FROM requests r JOIN licences l ON l.user_id = r.user_id AND is_active),
  hits AS (SELECT request_id, license_id, expires_at, 1 AS via FROM own o WHERE EXISTS (SELECT 1 FROM devices d WHERE d.license_id = o.license_id AND d.fingerprint = o.fingerprint)
    UNION ALL SELECT request_id, license_id, expires_at, 2 FROM own WHERE device_fingerprint = fingerprint),
  best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY via, license_id) = 1)
SELECT r.request_id, license_id, CASE via WHEN 1 THEN 'equipo' WHEN 2 THEN 'licencia' END AS via,
  CASE WHEN via IS NULL THEN 'no encontrada' WHEN expires_at < DATE '1997-06-01' THEN 'expirada' ELSE 'valida' END AS estado FROM requests r LEFT JOIN best b ON b.request_id = r.request_id""")
def entitlement_requests(spark: SparkSession, d: str) -> DataFrame:
    """The licence that allows each request, by one of its devices or by its own fingerprint, and its expiry."""
    c, o = bridge.table(spark, d, "customer"), bridge.table(spark, d, "orders")

    def mark(n: str):
        return F.concat(F.lit("fp"), F.expr(n).cast("string"))

    licences = c.select(
        F.col("c_custkey").alias("license_id"), F.col("c_nationkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active"), F.when(F.col("c_custkey") % 3 == 0, mark("c_custkey % 4")).alias("device_fingerprint"),
        F.when(F.col("c_custkey") % 5 != 0, F.expr("date_add(date'1996-01-01', int(c_custkey % 1000))")).alias("expires_at"),
    )
    devices = o.filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("license_id"), mark("o_orderkey % 4").alias("fingerprint"))
    requests = o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 25).alias("user_id"), mark("o_orderkey % 6").alias("fingerprint"))
    return combine.entitled(requests, licences, devices, F.lit("1997-06-01").cast("date"))


@query("w2_newest_first", sql("history", "SELECT row_number() OVER (ORDER BY timestamp DESC, run_id) AS n, run_id, timestamp FROM history WHERE tipo = 'error'"))
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    """All runs of a kind, numbered from the newest on."""
    return select.newest_first(bridge.history(spark, d).filter("tipo = 'error'"), "timestamp", "run_id").select("n", "run_id", "timestamp")


@query("w3_occurrence", sql("lines withholdings", "SELECT orderkey, codigo, line_num, row_number() OVER (PARTITION BY orderkey, codigo ORDER BY line_num) AS vez FROM withholdings"))
def occurrence(spark: SparkSession, d: str) -> DataFrame:
    """The how-manieth line of its tax in the document."""
    w = Window.partitionBy("orderkey", "codigo").orderBy("line_num")
    return bridge.withholdings(spark, d).select("orderkey", "codigo", "line_num", F.row_number().over(w).alias("vez"))


@query("w6_next_value", sql("lines", """SELECT orderkey, line_num, first_value(descripcion IGNORE NULLS) OVER n AS siguiente, last_value(descripcion IGNORE NULLS) OVER p AS anterior
FROM (SELECT orderkey, line_num, CASE WHEN pct != '0' THEN descripcion END AS descripcion FROM lines)
WINDOW n AS (PARTITION BY orderkey ORDER BY line_num ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), p AS (PARTITION BY orderkey ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def next_value(spark: SparkSession, d: str) -> DataFrame:
    """The next and the previous line's value, skipping lines that have none."""
    order = Window.partitionBy("orderkey").orderBy("line_num")
    value = F.when(F.col("pct") != "0", F.col("descripcion"))
    after, before = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    return bridge.lines(spark, d).select("orderkey", "line_num", F.first(value, ignorenulls=True).over(after).alias("siguiente"), F.last(value, ignorenulls=True).over(before).alias("anterior"))


@query("w8_drop_repeats", sql("lines", "SELECT orderkey, line_num, pct FROM (SELECT *, lag(pct) OVER (PARTITION BY orderkey ORDER BY line_num) AS p FROM lines) WHERE p IS DISTINCT FROM pct"))
def drop_repeats(spark: SparkSession, d: str) -> DataFrame:
    """A detail equal to the one before it goes."""
    before = F.lag("pct").over(Window.partitionBy("orderkey").orderBy("line_num"))
    return bridge.lines(spark, d).withColumn("p", before).filter("not (p <=> pct)").select("orderkey", "line_num", "pct")


@query("w9_unique_names", sql("header", "SELECT orderkey, estab || '-' || pto || CASE WHEN n = 1 THEN '' ELSE '_' || (n - 1) END AS nombre FROM (SELECT *, row_number() OVER (PARTITION BY estab, pto, fecha ORDER BY orderkey) AS n FROM header)"))
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that repeat on a day get a counter."""
    named = bridge.header(spark, d).withColumn("nombre", F.concat_ws("-", "estab", "pto"))
    return combine.numbered_names(named, "nombre", ["orderkey"], ("fecha",)).select("orderkey", F.col("nombre_unico").alias("nombre"))


@query("w10_between_markers", sql("lines", """, m AS (SELECT *, max(CASE WHEN pct = '2' THEN line_num END) OVER (PARTITION BY orderkey ORDER BY line_num ROWS UNBOUNDED PRECEDING) AS inicio,
    min(CASE WHEN pct = '4' THEN line_num END) OVER (PARTITION BY orderkey ORDER BY line_num ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fin FROM lines)
SELECT orderkey, line_num FROM m WHERE line_num > inicio AND line_num < fin AND line_num - inicio <= 3""").replace("\n, m AS", ",\nm AS"))
def between_markers(spark: SparkSession, d: str) -> DataFrame:
    """At most three lines between a start and an end marker."""
    order = Window.partitionBy("orderkey").orderBy("line_num")
    start = F.max(F.when(F.col("pct") == "2", F.col("line_num"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    end = F.min(F.when(F.col("pct") == "4", F.col("line_num"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    m = bridge.lines(spark, d).select("orderkey", "line_num", start.alias("inicio"), end.alias("fin"))
    return m.filter("line_num > inicio and line_num < fin and line_num - inicio <= 3").select("orderkey", "line_num")


@query("u1_union_reports", sql("header", """SELECT clave, estado, '' AS origin FROM (SELECT clave, coalesce(estado, '') AS estado FROM header WHERE origin = 'Emitidos') UNION ALL SELECT clave, '', origin FROM header WHERE origin = 'Recibidos'"""))
def union_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of different columns, one below the other."""
    h = bridge.header(spark, d)
    return combine.union_all([h.filter("origin = 'Emitidos'").select("clave", "estado"), h.filter("origin = 'Recibidos'").select("clave", "origin")])


@query("u3_distinct_union", sql("header", "SELECT ruc, fecha FROM header WHERE cod_doc = '01' UNION SELECT ruc, fecha FROM header WHERE cod_doc = '04'"))
def distinct_union(spark: SparkSession, d: str) -> DataFrame:
    """U3."""
    h = bridge.header(spark, d)
    return h.filter("cod_doc = '01'").select("ruc", "fecha").union(h.filter("cod_doc = '04'").select("ruc", "fecha")).distinct()


@query("u5_facet_intersection", sql("history", "SELECT run_id FROM history WHERE origen = 'Emitidos' AND mes::VARCHAR = '1' INTERSECT SELECT run_id FROM history WHERE lower(concat_ws(' ', ruc, origen, tipo)) LIKE '%4 emitidos cl%'"))
def facet_intersection(spark: SparkSession, d: str) -> DataFrame:
    """All facets and the search at once."""
    chosen = select.facets(bridge.history(spark, d), {"origen": "Emitidos", "mes": "1", "anio": select.ALL})
    return select.search(chosen, "4 Emitidos CL", ["ruc", "origen", "tipo"]).select("run_id")


@query("f1_origin_status", sql("header", "SELECT orderkey, origin, estado FROM header WHERE origin = 'Emitidos' AND (estado IS NULL OR estado = 'AUTORIZADO')"))
def origin_status(spark: SparkSession, d: str) -> DataFrame:
    """by origin and status; unknown status passes."""
    return select.by_status(select.by_origin(bridge.header(spark, d), "Emitidos"), "AUTORIZADO").select("orderkey", "origin", "estado")


@query("f4_date_range", sql("header", "SELECT orderkey, fecha FROM header WHERE fecha BETWEEN DATE '1996-03-01' AND DATE '1996-09-30'"))
def date_range(spark: SparkSession, d: str) -> DataFrame:
    """documents of a range of months."""
    start, end = (F.lit(x) for x in reports.period(1996, 3, last_month=9))
    return select.by_period(bridge.header(spark, d), start, end).select("orderkey", "fecha")


@query("f5_period_modes", sql("header", "SELECT 'anio' AS modo, orderkey FROM header WHERE year(fecha) = 1996 UNION ALL SELECT 'meses', orderkey FROM header WHERE year(fecha) = 1996 AND month(fecha) BETWEEN 2 AND 4 UNION ALL SELECT 'dia', orderkey FROM header WHERE fecha = DATE '1996-05-07' UNION ALL SELECT 'mes', orderkey FROM header WHERE year(fecha) = 1996 AND month(fecha) = 5"))
def period_modes(spark: SparkSession, d: str) -> DataFrame:
    """year, range of months, month, day."""
    h = bridge.header(spark, d)
    modes = {"anio": select.in_month(h, 1996), "meses": select.in_month(h, 1996, 2, 4), "dia": select.in_month(h, 1996, 5, day=7), "mes": select.in_month(h, 1996, 5)}
    frames = [df.select(F.lit(n).alias("modo"), "orderkey") for n, df in modes.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


@query("f7_clip", sql("header", "SELECT orderkey FROM header WHERE fecha BETWEEN DATE '1998-01-01' AND least(DATE '2030-12-31', DATE '1998-06-30')"))
def clipped(spark: SparkSession, d: str) -> DataFrame:
    """a period ends today at the latest; here today is a given day."""
    start, end, today = (F.lit(x).cast("date") for x in ("1998-01-01", "2030-12-31", "1998-06-30"))
    return select.by_period(bridge.header(spark, d), *select.clip(start, end, today)).select("orderkey")


@query("f14_age_limit", sql("header", "SELECT orderkey FROM header WHERE DATE '1998-08-02' - fecha > 30"))
def age_limit(spark: SparkSession, d: str) -> DataFrame:
    """documents older than thirty days, on a given day."""
    return select.older_than(bridge.header(spark, d), 30, F.lit("1998-08-02").cast("date")).select("orderkey")


@query("f15_point", sql("header", "SELECT orderkey FROM header WHERE estab = '003' AND pto = '005'"))
def point(spark: SparkSession, d: str) -> DataFrame:
    """F15."""
    return select.facets(bridge.header(spark, d), {"estab": "003", "pto": "005"}).select("orderkey")
