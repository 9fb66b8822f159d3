"""Queries over whole documents: the summary and each report's full row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom import catalogs as K
from taxloom.operators import combine, rows, summary
from taxloom.plans import documents, star
from taxloom.plans.queries import query
from taxloom.plans.star import sql
from taxloom.sources import xml


def _said(c: str) -> str:
    return f"coalesce(nullif(trim({c}), ''), '{K.MISSING}')"


def _text(c: str) -> str:
    return f"coalesce(trim({c}), '')"


def _number(c: str) -> str:
    return f"coalesce({c}::DOUBLE, 0)"


def _some(*numbers: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({n}::DOUBLE, 0)" for n in numbers) + ", 0)"


def _case(code: str, names: dict[str, str], default: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {default} END"


def _select(columns: dict[str, str], source: str = "docs", where: str = "") -> str:
    return "SELECT orderkey, " + ",\n  ".join(f'{v} AS "{c}"' for c, v in columns.items()) + f"\nFROM {source} {where}"


def _extra(separator: str) -> str:
    return _said(f"'prioridad: ' || prioridad || {separator} || 'Correo: ' || correo")


_SUMMARY = {
    **{a: _said(b) for a, b in {
        "estado": "estado", "numero_autorizacion": "numero_autorizacion", "fecha_autorizacion": "fecha_autorizacion", "razon_social_emisor": "razon_social", "dir_establecimiento": "dir_establecimiento", "obligado_contabilidad": "obligado",
        "identificacion_comprador": "identificacion", "nombre_comercial": "nombre_comercial", "estab": "estab", "punto_emision": "pto_emi", "secuencial": "secuencial", "direccion_matriz": "dir_matriz", "contribuyente_rimpe": "rimpe",
        "ruc_emisor": "ruc", "clave_acceso": "clave", "fecha_emision": "fecha_emision_texto", "razon_social_comprador": "razon_social_receptor", "direccion_comprador": "direccion_receptor", "moneda": "moneda", "plazo_pago": "plazo_1",
        "unidad_tiempo_pago": "unidad_1", "codigo_documento_modificado": "cod_doc_modificado", "numero_documento_modificado": "num_doc_modificado", "fecha_emision_doc_sustento": "fecha_doc_sustento", "motivo": "motivo_modificacion",
        "descripciones": "coalesce(motivos_descripcion, descripciones)",
    }.items()},
    **{c: _number(c) for c in ("total_sin_impuestos", "base_gravada", "base_no_gravada", "monto_iva", "total_descuento", "propina", "importe_total", "total_pago", "base_gravada_12", "monto_iva_12")},
    "ambiente": _case("ambiente", K.ENVIRONMENT, "ambiente"), "tipo_emision": _case("tipo_emision", K.EMISSION, "tipo_emision"), "codigo_documento": _case("cod_doc", K.DOC_CODE, "cod_doc"),
    "tipo_identificacion_comprador": _case("tipo_identificacion", K.ID_TYPE, "tipo_identificacion"), "forma_pago": f"{_said('forma_1')} || ' - ' || {_case('forma_1', K.PAYMENT, repr(K.MISSING))}",
    "tarifas_iva": "CASE WHEN tarifas != '' THEN tarifas WHEN base_no_gravada > 0 THEN '0%' ELSE 'No Disponible' END", "valor_modificacion": _some("valor_modificacion_xml", "valor_modificacion"), "campos_adicionales": _extra("'; '"),
}


@query("p17_document_summary", sql(_select(_SUMMARY)))
def document_summary(spark: SparkSession, d: str) -> DataFrame:
    """P17 with J1, J2, J3, J4, A18, W4: the flagship, all 44 columns, from one aggregation of the lines."""
    return rows.summary_row(star.documents(spark, d))


_PARTIES = {
    "rucEmisor": _text("ruc"), "razonSocialEmisor": _text("razon_social"), "direccionMatrizEmisor": _text("dir_matriz"), "numeroComprobante": _text("serie"), "establecimiento": _text("estab"), "puntoEmision": _text("pto_emi"),
    "secuencial": _text("secuencial"), "fechaEmision": "strftime(fecha_emision, '%Y-%m-%d')", "fechaAutorizacion": _text("fecha_autorizacion"), "claveAcceso": _text("clave"),
}
_STANDARD = _PARTIES | {
    "tipoDocumento": "descripcion_doc", "nombreComercial": _text("nombre_comercial"), "direccionSucursalEmisor": _text("dir_establecimiento"), "obligadoContabilidad": _text("obligado"), "tipoContribuyenteRIMPE": _text("rimpe"),
    "razonSocialComprador": _text("razon_social_receptor"), "identificacionComprador": _text("identificacion"), "direccionComprador": _text("direccion_receptor"), "comprobanteModificado": _text("num_doc_modificado"),
    "fechaEmisionModificado": _text("fecha_doc_sustento"), "razonModificacion": _text("motivo_modificacion"), "valorModificacion": _some("valor_modificacion", "valor_modificacion_xml"), "descripcionesProductos": _text("descripciones"),
    "subtotalSinImpuestos": _number("total_sin_impuestos"), "totalDescuento": _number("total_descuento"), "propina": _number("propina"), "valorTotal": _some("importe_total", "valor_total"), "ambiente": "ambiente", "emision": "tipo_emision",
    "informacionAdicional": "info_adicional",
}


@query("p6_standard_columns", sql(_select(_STANDARD)))
def standard_columns(spark: SparkSession, d: str) -> DataFrame:
    """The 30 columns of the standard report."""
    return rows.standard_row(star.documents(spark, d))


_SPECIAL = '(coalesce("IVA_8_BASE", 0) = 0 AND coalesce("IVA_14_BASE", 0) != 0)'
_REPORT = _PARTIES | {
    **dict.fromkeys(("contribuyenteEspecial", "agenteRetencion", "placa", "guia"), f"'{K.MISSING}'"),
    "tipoDocumento": "descripcion_doc", "nombreComercial": _said("nombre_comercial"), "direccionSucursalEmisor": _said("dir_establecimiento"), "obligadoContabilidad": _said("obligado"), "tipoContribuyenteRIMPE": _said("rimpe"),
    "razonSocialComprador": _text("razon_social_receptor"), "identificacionComprador": _text("identificacion"), "direccionComprador": _text("direccion_receptor"), "comprobanteModificado": _said("coalesce(num_doc_modificado, cod_doc_modificado)"),
    "fechaEmisionModificado": _said("fecha_doc_sustento"), "razonModificacion": _said("coalesce(motivo_modificacion, motivos_descripcion)"), "valorModificacion": _some("valor_modificacion_xml", "valor_modificacion"),
    "descripcionesProductos": _said("items"), "subtotalTarifaEspecial": f'CASE WHEN {_SPECIAL} THEN 0 ELSE coalesce("IVA_14_BASE", 0) END', "ivaTarifaEspecial": f'CASE WHEN {_SPECIAL} THEN 0 ELSE coalesce("IVA_14_VALOR", 0) END',
    "subtotal8": f'CASE WHEN {_SPECIAL} THEN "IVA_14_BASE" ELSE coalesce("IVA_8_BASE", 0) END', "iva8": f'CASE WHEN {_SPECIAL} THEN "IVA_14_VALOR" ELSE coalesce("IVA_8_VALOR", 0) END',
    **{f"subtotal{r}": _number(f'"IVA_{r}_BASE"') for r in (15, 12, 5, 0)}, "subtotalNoObjetoIVA": _number('"NO_OBJETO_IVA_BASE"'), "subtotalExentoIVA": _number('"EXENTO_IVA_BASE"'),
    **{f"iva{r}": _number(f'"IVA_{r}_VALOR"') for r in (15, 12, 5)}, "ice": _number('"ICE_VALOR"'), "irbpnr": _number('"IRBPNR_VALOR"'), "subtotalSinImpuestos": _number("total_sin_impuestos"), "totalDescuento": _number("total_descuento"),
    "propina": _number("propina"), "valorTotal": _some("importe_total", "valor_total", "valor_modificacion"), "valorTotalSinSubsidio": "0::DOUBLE", "formaPago": _said(_case("forma_1", K.PAYMENT, "forma_1")), "formaPagoMonto": _number("pago_1"),
    "ambiente": "CASE ambiente WHEN '1' THEN 'PRUEBAS' ELSE 'PRODUCCION' END", "emision": "CASE tipo_emision WHEN '1' THEN 'NORMAL' ELSE 'CONTINGENCIA' END", "informacionAdicional": _extra("chr(10)"),
}


@query("p8_report_row", sql(_select(_REPORT)))
def report_row(spark: SparkSession, d: str) -> DataFrame:
    """The standard report in all 52 columns."""
    return rows.report_row(star.documents(spark, d))


def _over(base: dict[str, str], own: dict[str, str], cod: str) -> str:
    inner = _select(base, "docs", f"WHERE cod_doc = '{cod}'")
    return _select(own, f"({inner}) r")


_SETTLEMENT = {c: f'"{c}"' for c in _REPORT} | {
    "tipoDocumento": "'Liquidación de Compra'", "nombreComercial": f"""CASE WHEN "nombreComercial" = '{K.MISSING}' THEN {_said('"razonSocialEmisor"')} ELSE "nombreComercial" END""", "razonSocialComprador": f"'{K.MISSING}'",
}


@query("p14_settlement_row", sql(_over(_REPORT, _SETTLEMENT, "03")))
def settlement_row(spark: SparkSession, d: str) -> DataFrame:
    """Issued purchase settlements."""
    return rows.settlement_row(rows.report_row(star.documents(spark, d).filter("cod_doc = '03'")))


def _q(c: str) -> str:
    return f'"{c}"'


_RATES = (15, 12, 8, 5)
_BRANCH = f"""CASE WHEN "direccionSucursalEmisor" = '' THEN {_said(_q("direccionMatrizEmisor"))} ELSE "direccionSucursalEmisor" END"""
_ID = """CASE length("identificacionComprador") WHEN 13 THEN '04 - RUC' WHEN 10 THEN '05 - Cedula' ELSE 'No Disponible' END"""
_ISSUED = {
    "Ambiente": _case(_q("ambiente"), {"PRUEBAS": K.ENVIRONMENT["1"], "PRODUCCION": K.ENVIRONMENT["2"]}, "NULL"), "Razón Social Emisor": _said(_q("razonSocialEmisor")), "Identificación Comprador": _said(_q("identificacionComprador")),
    "Tipo Emisión": _case(_q("emision"), {"NORMAL": K.EMISSION["1"], "CONTINGENCIA": K.EMISSION["2"]}, "NULL"), "Establecimiento": "establecimiento", "Punto de Emisión": _q("puntoEmision"), "Secuencial": "secuencial",
    "Contribuyente RIMPE": _q("tipoContribuyenteRIMPE"), "RUC Emisor": _q("rucEmisor"), "Clave de Acceso": _q("claveAcceso"), "Fecha de Emisión": _q("fechaEmision"), "Razón Social Comprador": _said(_q("razonSocialComprador")),
    "Dirección Comprador": _said(_q("direccionComprador")), "Moneda": f"'{K.MISSING}'", "Plazo Pago": f"'{K.MISSING}'", "Unidad Tiempo Pago": f"'{K.MISSING}'", "Descripciones": _q("descripcionesProductos"),
    "Forma Pago": f"'{K.MISSING} - {K.MISSING}'", "Total Sin Impuestos": _q("subtotalSinImpuestos"), "Base Gravada": _some(*[_q(f"subtotal{r}") for r in _RATES]), "Base No Gravada": _q("subtotal0"),
    "Tarifas IVA": "CASE " + " ".join(f"WHEN \"iva{r}\" != 0 THEN '{r}%'" for r in _RATES) + " ELSE '' END", "Monto IVA": _some(*[_q(f"iva{r}") for r in _RATES]), "Total Descuento": _q("totalDescuento"), "Propina": "propina",
    "Importe Total": _q("valorTotal"), "Campos Adicionales": _q("informacionAdicional"), "Obligado Contabilidad": _q("obligadoContabilidad"), "Dirección Matriz": _said(_q("direccionMatrizEmisor")),
    "Dir. Establecimiento": _q("direccionSucursalEmisor"), "Nombre Comercial": _q("nombreComercial"), "Tipo Identificación Comprador": _ID,
}
_INVOICE = _ISSUED | {
    "Código del Documento": f"'{K.DOC_CODE['01']}'", "Estado": f"'{K.MISSING}'", "Número de Autorización": f"'{K.MISSING}'", "Fecha de Autorización": f"'{K.MISSING}'", "Contribuyente RIMPE": f"'{K.MISSING}'",
    "Fecha de Emisión": "strftime(\"fechaEmision\"::DATE, '%d/%m/%Y')", "Moneda": "'DOLAR'", "Base Gravada": "0::DOUBLE", "Base No Gravada": _q("subtotalSinImpuestos"), "Tarifas IVA": "'0%'", "Total Pago": "0::DOUBLE",
    "Base No Gravada 0%": _q("subtotalSinImpuestos"),
}
_NOTE = _ISSUED | {
    "Estado": "''", "Número de Autorización": "''", "Fecha de Autorización": _q("fechaAutorizacion"), "Fecha Emisión Doc. Sustento": _q("fechaEmisionModificado"), "Motivo": _q("razonModificacion"), "Base Gravada 15%": _q("subtotal15"), "Monto IVA 15%": _q("iva15"),
}
_CREDIT = _NOTE | {
    "Código del Documento": f"'{K.DOC_CODE['04']}'", "Dirección Matriz": _q("direccionMatrizEmisor"), "Total Pago": "0::DOUBLE", "Código Documento Modificado": _q("comprobanteModificado"), "Número Documento Modificado": _q("comprobanteModificado"),
    "Valor Modificación": _q("valorModificacion"), "Tipo Identificación Comprador": f"'{K.MISSING}'",
}
_DEBIT = _NOTE | {
    "Código del Documento": f"'{K.DOC_CODE['05']}'", "Total Pago": _q("valorTotal"), "Código Documento Modificado": "'01'", "Número Documento Modificado": _q("comprobanteModificado"), "Valor Modificación": _some(_q("valorModificacion"), _q("valorTotal")),
}


@query("p15_issued_invoices", sql(_over(_REPORT, _INVOICE, "01")))
def issued_invoices(spark: SparkSession, d: str) -> DataFrame:
    """Issued invoices in 38 columns."""
    return rows.issued_invoice(rows.report_row(star.documents(spark, d).filter("cod_doc = '01'")))


@query("p15_issued_credit_notes", sql(_over(_REPORT, _CREDIT, "04")))
def issued_credit_notes(spark: SparkSession, d: str) -> DataFrame:
    """Issued credit notes in 44 columns."""
    return rows.issued_credit_note(rows.report_row(star.documents(spark, d).filter("cod_doc = '04'")))


@query("p15_issued_debit_notes", sql(_over(_REPORT, _DEBIT, "05")))
def issued_debit_notes(spark: SparkSession, d: str) -> DataFrame:
    """Issued debit notes in 44 columns."""
    return rows.issued_debit_note(rows.report_row(star.documents(spark, d).filter("cod_doc = '05'")))


_SUPPORT = """, support AS (
  SELECT orderkey, min_by(sustento_tipo, line_num) AS sustento_tipo, min_by(sustento_numero, line_num) AS sustento_numero, min_by(sustento_fecha, line_num) AS sustento_fecha,
    list({b: base::DOUBLE, p: pct::DOUBLE, v: valor::DOUBLE} ORDER BY line_num) FILTER (codigo = '2') AS iva, list({b: base::DOUBLE, p: pct::DOUBLE, v: valor::DOUBLE} ORDER BY line_num) FILTER (codigo != '2') AS ir
  FROM star_withholdings GROUP BY orderkey),
held AS (SELECT h.*, s.* EXCLUDE (orderkey) FROM star_header h LEFT JOIN support s ON h.orderkey = s.orderkey WHERE cod_doc = '07')
"""
_PART = {"b": "Base_Imponible_Ret", "p": "Porcentaje_Ret", "v": "Valor_Retenido"}
_HELD = _PARTIES | {
    "nombreComercial": _text("nombre_comercial"), "direccionSucursalEmisor": _text("dir_establecimiento"), "obligadoContabilidad": _text("obligado"), "numeroContribuyenteEspecial": "''", "numeroAgenteRetencion": "''",
    "razonSocialSujetoRetenido": _text("razon_social_receptor"), "identificacionSujetoRetenido": _text("identificacion"), "Comprobante_Sustento": _text("sustento_tipo"), "Numero_Sustento": _text("sustento_numero"),
    "Fecha_Emision_Sustento": _text("sustento_fecha"), "Ejercicio_Fiscal": _text("periodo_fiscal"), "ambiente": "ambiente", "emision": "tipo_emision", "informacionAdicional": "info_adicional", "tipoDocumento": "descripcion_doc",
    **{f"{n}_{t}": f"{t}[1].{c}" for t in ("IVA", "IR") for c, n in _PART.items()}, **{f"{n}_{t}_1": f"CASE WHEN len({t}) > 1 THEN {t}[len({t})].{c} END" for t in ("IVA", "IR") for c, n in _PART.items()},
    **{f"Impuesto_Ret_{t}{s}": f"CASE WHEN len({t}) > {i} THEN '{w}' ELSE '' END" for t, w in (("IVA", "IVA"), ("IR", "Renta")) for i, s in enumerate(("", "_1"))},
}
_ISSUED_HELD = _HELD | {
    "nombreComercial": _said("nombre_comercial"), "numeroContribuyenteEspecial": f"'{K.MISSING}'", "numeroAgenteRetencion": f"'{K.MISSING}'", "Numero_Sustento": f"replace({_text('sustento_numero')}, '-', '')", "Ejercicio_Fiscal": _text("ejercicio_fiscal"),
    "fechaAutorizacion": "CASE WHEN fecha_autorizacion IS NULL THEN '' ELSE strftime(left(fecha_autorizacion, 19)::TIMESTAMP, '%d/%m/%Y %H:%M:%S') END", "ambiente": "CASE ambiente WHEN '1' THEN 'PRUEBAS' ELSE 'PRODUCCIÓN' END",
    "emision": "CASE tipo_emision WHEN '1' THEN 'NORMAL' ELSE 'CONTINGENCIA' END", "informacionAdicional": _extra("chr(10)"), "tipoDocumento": "'Retencion'",
    **{f"{n}_{t}": f"CASE WHEN len({t}) = 1 THEN {t}[1].{c} WHEN len({t}) > 1 THEN {'0' if c == 'p' else f'list_sum(list_transform({t}, lambda x: x.{c}))'} ELSE 0 END" for t in ("IVA", "IR") for c, n in _PART.items()},
    **{f"{n}_{t}_{i}": f"coalesce({t}[{i}].{c}, 0)" for t in ("IVA", "IR") for i in (1, 2) for c, n in _PART.items()},
    **{f"Impuesto_Ret_{t}": f"CASE WHEN len({t}) = 1 THEN '{w}' WHEN len({t}) > 1 THEN 'Varios' ELSE 'No Aplica' END" for t, w in (("IVA", "IVA"), ("IR", "Renta"))},
    **{f"Impuesto_Ret_{t}_{i}": f"CASE WHEN len({t}) >= {i} THEN '{w}' ELSE '' END" for t, w in (("IVA", "IVA"), ("IR", "Renta")) for i in (1, 2)},
}


def _held_sql(columns: dict[str, str]) -> str:
    return sql(_SUPPORT + _select(columns, "held"), "star_withholdings star_header", "header lines withholdings").replace("\n, support", ",\nsupport")


def _held(spark: SparkSession, d: str) -> DataFrame:
    support = rows.support_facts(star.withholdings(spark, d))
    return star.header(spark, d).filter("cod_doc = '07'").join(support, "orderkey", "left")


@query("p7_withholding_row", _held_sql(_HELD))
def withholding_row(spark: SparkSession, d: str) -> DataFrame:
    """Received withholdings in 41 columns."""
    return rows.withholding_row(_held(spark, d))


@query("p13_issued_withholding_row", _held_sql(_ISSUED_HELD))
def issued_withholding_row(spark: SparkSession, d: str) -> DataFrame:
    """Issued withholdings in 49 columns."""
    return rows.issued_withholding_row(_held(spark, d))


_FIRST = ", ".join(
    f"max(forma_pago) FILTER (line_num = {i}) AS \"FORMA_PAGO_{i}\", (sum(pago) FILTER (line_num = {i}))::DOUBLE AS \"TOTAL_PAGO_{i}\", max(plazo) FILTER (line_num = {i}) AS \"PLAZO_{i}\", max(unidad_tiempo) FILTER (line_num = {i}) AS \"UNIDAD_TIEMPO_{i}\""
    for i in (1, 2, 3)
)


@query("a7_payment_pivot", sql(f"""SELECT orderkey, {_FIRST}, coalesce(string_agg(concat_ws(' ', line_num, forma_pago, pago::DECIMAL(20,4), plazo, unidad_tiempo), '; ' ORDER BY line_num) FILTER (line_num > 3), '') AS "PAGOS_SIGUIENTES"
FROM star_lines GROUP BY orderkey""", "star_lines", "lines"))
def payment_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Three payments side by side with form, total, term and unit, and all further ones as text."""
    payments = star.lines(spark, d).withColumnRenamed("line_num", "pago_num")
    more = F.concat_ws(" ", F.col("pago_num").cast("string"), "forma_pago", F.col("pago").cast("string"), "plazo", "unidad_tiempo")
    rest = F.array_sort(F.collect_list(F.when(F.col("pago_num") > 3, F.struct(F.col("pago_num").alias("n"), more.alias("t")))))
    text = F.array_join(F.transform(rest, lambda s: s["t"]), "; ").alias("PAGOS_SIGUIENTES")
    return payments.groupBy("orderkey").agg(*summary.payment_columns([1, 2, 3]), text)


@query("a7_all_payments", sql("""SELECT orderkey, count(*) AS n, string_agg(forma_pago, '|' ORDER BY line_num) AS formas, string_agg(pago::DECIMAL(20,4)::VARCHAR, '|' ORDER BY line_num) AS totales,
  string_agg(coalesce(plazo, ''), '|' ORDER BY line_num) AS plazos, string_agg(coalesce(unidad_tiempo, ''), '|' ORDER BY line_num) AS unidades FROM star_lines GROUP BY orderkey""", "star_lines", "lines"))
def all_payments(spark: SparkSession, d: str) -> DataFrame:
    """All payments of a document in order, whatever their number."""
    found = F.array_sort(F.collect_list(F.struct("line_num", "forma_pago", F.col("pago").cast("string").alias("pago"), F.coalesce("plazo", F.lit("")).alias("plazo"), F.coalesce("unidad_tiempo", F.lit("")).alias("unidad"))))
    lists = star.lines(spark, d).groupBy("orderkey").agg(F.count(F.lit(1)).alias("n"), found.alias("p"))
    return lists.select("orderkey", "n", *[F.array_join(F.col(f"p.{c}"), "|").alias(a) for c, a in (("forma_pago", "formas"), ("pago", "totales"), ("plazo", "plazos"), ("unidad", "unidades"))])


_FIELDS = {c: c for c in (
    "path archivo_xml cod_doc descripcion_doc clave serie numero_autorizacion fecha_autorizacion ambiente tipo_emision rimpe version_xml estab pto_emi secuencial ruc razon_social nombre_comercial dir_matriz dir_establecimiento obligado"
    " tipo_identificacion identificacion razon_social_receptor direccion_receptor fecha_emision moneda motivo_modificacion cod_doc_modificado num_doc_modificado fecha_doc_sustento periodo_fiscal ejercicio_fiscal"
).split()}
_XML_AMOUNTS = ["total_sin_impuestos", "total_descuento", "propina", "importe_total", "valor_modificacion", "valor_modificacion_xml", "valor_total", "total_retenido"]
_XML_FIELDS = _FIELDS | {
    "estado": "coalesce(estado, 'AUTORIZADO')", "motivo": "coalesce(motivo, nullif(motivo_modificacion, ''))", "motivos_descripcion": "motivos_descripcion",
    "info_adicional": """'[{"nombre":"prioridad","valor":"' || prioridad || '"},{"nombre":"Correo"' || CASE WHEN correo != '' THEN ',"valor":"' || correo || '"' ELSE '' END || '}]'""",
} | {c: f"coalesce({c}, 0)::DOUBLE" for c in _XML_AMOUNTS}


@query("p1_xml_fields", sql("SELECT " + ", ".join(f"{v} AS {c}" for c, v in _XML_FIELDS.items()) + " FROM docs"))
def xml_fields(spark: SparkSession, d: str) -> DataFrame:
    """All 45 fields of headers, from XML documents of every type and version."""
    h = xml.header(xml.good(xml.parse(star.xml_documents(spark, d), "cabecera")))
    return h.select(*[F.col(c) for c in _XML_FIELDS if c not in _XML_AMOUNTS], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _XML_AMOUNTS])


@query("p12_xml_withholdings", sql("""SELECT clave, sustento_tipo, sustento_numero, sustento_fecha, codigo, CASE codigo WHEN '2' THEN 'IVA' ELSE 'Renta' END AS impuesto, '303' AS codigo_retencion, base::DOUBLE AS base, pct::DOUBLE AS pct, valor::DOUBLE AS valor
FROM star_withholdings JOIN header USING (orderkey)""", "star_withholdings", "header lines withholdings"))
def xml_withholdings(spark: SparkSession, d: str) -> DataFrame:
    """Taxes withheld from XML of both versions, with the documents that they rest on."""
    w = xml.withholdings(xml.good(xml.parse(star.xml_documents(spark, d), "retenciones")))
    return w.withColumns({c: F.col(c).cast("double") for c in ("base", "pct", "valor")})


_FILLED = {c: _STANDARD.get(c, "0::DOUBLE" if c.startswith(rows.NUMBERS) else "''") for c in _REPORT}


@query("k2_conformed_report", sql(_select(_FILLED)))
def conformed_report(spark: SparkSession, d: str) -> DataFrame:
    """The standard row as a report of all 52 columns: text and number columns as such, missing ones filled."""
    docs = star.documents(spark, d)
    wanted = rows.report_schema(rows.report_row(docs).columns)
    return combine.conform(rows.standard_row(docs), wanted, {c: 0 if k == "double" else "" for c, k in wanted.items()})


def _partly(columns: dict[str, str]) -> dict[str, str]:
    """The columns that :func:`_conformed` lacks filled, and nulls in the others."""
    empty = {c: "0::DOUBLE" if c.startswith(rows.NUMBERS) else "''" for c in columns}
    return {c: f"coalesce({v}, {empty[c]})" if len(c) % 3 != 1 else empty[c] for c, v in columns.items()}


def _conformed(full: DataFrame) -> DataFrame:
    """Rows of a report that lack a third of the columns and have the others as text, by the report's schema."""
    partial = full.select("orderkey", *[F.col(f"`{c}`").cast("string").alias(c) for c in full.columns if c != "orderkey" and len(c) % 3 != 1])
    wanted = rows.report_schema(full.columns)
    return combine.conform(partial, wanted, {c: 0 if k == "double" else "" for c, k in wanted.items()})


@query("k2_withholdings", _held_sql(_partly(_HELD)))
def conformed_withholdings(spark: SparkSession, d: str) -> DataFrame:
    """Rows of received withholdings by their report's 41 columns."""
    return _conformed(withholding_row(spark, d))


@query("k2_issued_withholdings", _held_sql(_partly(_ISSUED_HELD)))
def conformed_issued_withholdings(spark: SparkSession, d: str) -> DataFrame:
    """Rows of issued withholdings by their report's 49 columns."""
    return _conformed(issued_withholding_row(spark, d))


@query("k2_issued_invoices", sql(_over(_REPORT, _partly(_INVOICE), "01")))
def conformed_issued_invoices(spark: SparkSession, d: str) -> DataFrame:
    """Rows of issued invoices by their report's 38 columns."""
    return _conformed(issued_invoices(spark, d))


@query("k2_issued_credit_notes", sql(_over(_REPORT, _partly(_CREDIT), "04")))
def conformed_issued_credit_notes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of issued credit notes by their report's 44 columns."""
    return _conformed(issued_credit_notes(spark, d))


@query("k2_issued_debit_notes", sql(_over(_REPORT, _partly(_DEBIT), "05")))
def conformed_issued_debit_notes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of issued debit notes by their report's 44 columns."""
    return _conformed(issued_debit_notes(spark, d))


def _defaults(columns: dict[str, str], texts: dict[str, str], word: str) -> str:
    return ", ".join(f"""{'0::DOUBLE' if c.startswith(rows.NUMBERS) else repr(texts.get(c, word))} AS "{c}\"""" for c in columns)


@query("p16_default_rows", f"""SELECT o_orderkey || '.xml' AS archivo_xml, {_defaults(_INVOICE, {"Descripciones": "", "Tarifas IVA": "0%"}, K.MISSING)} FROM orders WHERE o_orderkey % 50 = 7""")
def default_rows(spark: SparkSession, d: str) -> DataFrame:
    """Default invoice rows for documents that can't be read."""
    broken = xml.errors(xml.parse(documents.xml_documents(spark, d), "errores")).select(F.regexp_extract("archivo_xml", "([^/]*)$", 1).alias("archivo_xml"))
    return rows.default_rows(broken, "archivo_xml", "factura", list(_INVOICE))


@query("p16_default_notes", f"""SELECT o_orderkey || '.xml' AS archivo_xml, {_defaults(_CREDIT, dict.fromkeys(rows.EMPTY_IN_NOTES, ""), K.MISSING)} FROM orders WHERE o_orderkey % 50 = 7""")
def default_notes(spark: SparkSession, d: str) -> DataFrame:
    """Default rows of notes for documents that can't be read."""
    broken = xml.errors(xml.parse(documents.xml_documents(spark, d), "errores")).select(F.regexp_extract("archivo_xml", "([^/]*)$", 1).alias("archivo_xml"))
    return rows.default_rows(broken, "archivo_xml", "nota", list(_CREDIT))


@query("p16_default_withholdings", f"""SELECT orderkey, {_defaults(_ISSUED_HELD, {c: K.MISSING for c in ("nombreComercial", "numeroContribuyenteEspecial", "numeroAgenteRetencion", "informacionAdicional")} | {"Impuesto_Ret_IVA": K.NOT_APPLICABLE, "Impuesto_Ret_IR": K.NOT_APPLICABLE, "tipoDocumento": "Retencion"}, "")}
FROM (SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey % 5 = 4 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))""")
def default_withholdings(spark: SparkSession, d: str) -> DataFrame:
    """Default rows of withholdings of which no line is there."""
    o, l = star.bridge.table(spark, d, "orders"), star.bridge.table(spark, d, "lineitem")
    alone = o.filter("o_orderkey % 5 = 4").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("orderkey"))
    return rows.default_rows(alone, "orderkey", "retencion", list(_ISSUED_HELD))
