"""Documents with all their fields over the given order tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom import catalogs as K
from taxloom.functions import keys
from taxloom.operators import rows
from taxloom.plans import bridge


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their tax, of the document's level in two of three documents, and payment."""
    late = F.col("posicion") % 2 == 0
    return bridge.lines(spark, d).withColumns({
        "nivel": F.when(F.col("orderkey") % 3 != 0, "DOCUMENTO").otherwise("LINEA"), "total": F.col("base"), "pago": F.col("base"),
        "plazo": F.when(late, (F.col("line_num") * 15).cast("string")), "unidad_tiempo": F.when(late, F.lit("dias")),
    })


def withholdings(spark: SparkSession, d: str) -> DataFrame:
    """Taxes withheld, each with the document that it rests on."""
    return bridge.withholdings(spark, d).withColumns({
        "sustento_tipo": F.lit("01"), "sustento_numero": F.concat(F.lit("001-002-"), F.lpad((F.col("orderkey") + F.col("line_num")).cast("string"), 9, "0")), "sustento_fecha": F.when(F.col("line_num") > 1, F.lit("05/03/1995")),
    })


def header(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document, with the fields that a parsed document's header has."""
    h = bridge.header(spark, d)
    who = bridge.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    land = bridge.table(spark, d, "nation").select("n_nationkey", "n_name")
    o = h.join(who, F.col("custkey") == F.col("c_custkey"), "left").join(land, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    key, cust, cod = F.col("orderkey"), F.col("custkey"), F.col("cod_doc")
    note, wrapped, even = cod.isin("04", "05"), key % 4 < 2, cust % 2 == 0
    serie = keys.series(F.col("estab"), F.col("pto"), F.col("sec"))
    zero = F.lit(0).cast("decimal(14,2)")
    extra = F.array(F.struct(F.lit("prioridad").alias("nombre"), F.col("prioridad").alias("valor")), F.struct(F.lit("Correo").alias("nombre"), F.when(even, "a@b.ec").otherwise("").alias("valor")))
    return o.select(
        "orderkey", F.concat(F.lit("d/"), key.cast("string"), F.lit(".xml")).alias("path"), F.concat(key.cast("string"), F.lit(".xml")).alias("archivo_xml"), "clave", F.when(wrapped, F.col("estado")).alias("estado"), F.when(wrapped, F.col("clave")).alias("numero_autorizacion"),
        F.when(wrapped, F.concat(F.date_format("fecha", "yyyy-MM-dd"), F.lit("T10:15:00-05:00"))).alias("fecha_autorizacion"), "cod_doc", K.label(cod, K.DOC_TYPE).alias("descripcion_doc"),
        F.when(cust % 3 != 0, "2").otherwise("1").alias("ambiente"), F.when(key % 11 != 0, "1").otherwise("2").alias("tipo_emision"), F.when((cod == "07") & (key % 2 == 0), "2.0.0").otherwise("1.0.0").alias("version_xml"),
        "estab", F.col("pto").alias("pto_emi"), F.col("sec").alias("secuencial"), serie.alias("serie"), "ruc", F.concat("n_name", F.lit(" S.A.")).alias("razon_social"), F.when(even, F.col("c_mktsegment")).alias("nombre_comercial"),
        F.concat(F.lit("Av. "), "prioridad", F.lit(" y Calle "), "estab").alias("dir_matriz"), F.when(cust % 5 == 0, "REGIMEN RIMPE").alias("rimpe"), F.col("fecha").alias("fecha_emision"),
        F.date_format("fecha", "dd/MM/yyyy").alias("fecha_emision_texto"), F.when(key % 2 == 0, F.concat(F.lit("Local "), "pto")).alias("dir_establecimiento"), F.when(even, "SI").otherwise("NO").alias("obligado"),
        F.when(even, "04").otherwise("05").alias("tipo_identificacion"), F.when(even, F.col("ruc")).otherwise(F.left("ruc", F.lit(10))).alias("identificacion"), F.col("c_name").alias("razon_social_receptor"),
        F.when((cust % 3 != 0) & (cod != "07"), F.col("n_name")).alias("direccion_receptor"), F.when(cod.isin("01", "03"), "DOLAR").alias("moneda"),
        F.when(cod == "04", F.concat(F.lit("Devolucion "), "prioridad")).alias("motivo"), (F.col("importe") - (cust % 50).cast("decimal(14,2)")).cast("decimal(18,2)").alias("total_sin_impuestos"),
        (cust % 50).cast("decimal(18,2)").alias("total_descuento"), (key % 7).cast("decimal(18,2)").alias("propina"), F.col("importe").cast("decimal(18,2)").alias("importe_total"),
        F.when(cod == "04", F.col("importe")).otherwise(zero).cast("decimal(18,2)").alias("valor_modificacion"), F.when(cod == "05", F.col("importe")).otherwise(zero).cast("decimal(18,2)").alias("valor_total"),
        F.when(note, "01").alias("cod_doc_modificado"), F.when(note & (cust % 4 != 0), serie).alias("num_doc_modificado"), F.when(note, F.date_format(F.date_sub("fecha", 10), "dd/MM/yyyy")).alias("fecha_doc_sustento"),
        F.when(cod == "07", F.date_format("fecha", "MM/yyyy")).alias("periodo_fiscal"), F.when(cod == "07", F.date_format("fecha", "yyyy")).alias("ejercicio_fiscal"), F.to_json(extra).alias("info_adicional"),
    )


def documents(spark: SparkSession, d: str, types: list[str] | None = None) -> DataFrame:
    """Headers with what their lines come to; debit notes have their lines as reasons. With ``types`` only documents, and lines, of these."""
    those = F.lit(True) if types is None else bridge.of_types("orderkey", types)
    facts = rows.line_facts(lines(spark, d).filter(those))
    debit = F.col("cod_doc") == "05"
    return header(spark, d).filter(those).join(facts, "orderkey", "left").withColumns({
        "motivo_modificacion": F.when(debit, F.col("descripciones")).otherwise(F.col("motivo")), "motivos_descripcion": F.when(debit, F.col("motivos_descripcion")),
        "valor_modificacion_xml": F.when(debit, F.col("motivos_valor")), "total_retenido": F.when(F.col("cod_doc") == "07", F.col("retenido")),
    })


def xml_documents(spark: SparkSession, d: str) -> DataFrame:
    """(path, value): these documents as XML, in an envelope or bare, withholdings in both versions of their schema."""

    def tag(name: str, *content) -> F.Column:
        return F.concat(F.lit(f"<{name}>"), *content, F.lit(f"</{name}>"))

    def given(name: str, c: str) -> F.Column:
        return F.coalesce(tag(name, F.col(c).cast("string")), F.lit(""))

    held = F.concat(tag("codigo", F.when(F.col("posicion") % 2 == 1, "2").otherwise("1")), tag("codigoRetencion", F.lit("303")), tag("baseImponible", F.col("base").cast("string")), tag("porcentajeRetener", (F.col("descuento") * 100).cast("decimal(6,2)").cast("string")), tag("valorRetenido", F.col("valor").cast("string")))
    number = F.concat(F.lit("001002"), F.lpad((F.col("orderkey") + F.col("line_num")).cast("string"), 9, "0"))
    day = F.when(F.col("line_num") > 1, tag("fechaEmisionDocSustento", F.lit("05/03/1995"))).otherwise("")
    parts = {
        "detalle": tag("detalle", tag("codigoPrincipal", F.col("codigo").cast("string")), tag("descripcion", "descripcion"), tag("cantidad", F.col("cantidad").cast("string"))),
        "pago": tag("pago", tag("formaPago", "forma_pago"), tag("total", F.col("pago").cast("string")), given("plazo", "plazo"), given("unidadTiempo", "unidad_tiempo")),
        "motivo": tag("motivo", tag("razon", "descripcion"), tag("valor", F.col("precio").cast("string"))),
        "v1": tag("impuesto", held, tag("codDocSustento", F.lit("01")), tag("numeroDocumento", number), day),
        "v2": tag("docSustento", tag("codDocSustento", F.lit("01")), tag("numDocSustento", number), day, tag("retenciones", tag("retencion", held))),
    }
    by_doc = bridge.by_document(lines(spark, d), **parts)

    def all_(name: str, c: str) -> F.Column:
        return F.coalesce(tag(name, F.array_join(F.col(f"rows.{c}"), "")), F.lit(""))

    cod, stem = F.col("cod_doc"), F.when(F.col("cod_doc") == "07", "SujetoRetenido").when(F.col("cod_doc") == "03", "Proveedor").otherwise("Comprador")
    node = K.label(cod, {"01": "infoFactura", "03": "infoLiquidacionCompra", "04": "infoNotaCredito", "05": "infoNotaDebito", "07": "infoCompRetencion"})

    def party(name: str, c: str) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"<{name}"), stem, F.lit(">"), c, F.lit(f"</{name}"), stem, F.lit(">")), F.lit(""))

    head = tag("infoTributaria", *[given(n, c) for n, c in {"ambiente": "ambiente", "tipoEmision": "tipo_emision", "razonSocial": "razon_social", "nombreComercial": "nombre_comercial", "ruc": "ruc", "claveAcceso": "clave", "codDoc": "cod_doc", "estab": "estab", "ptoEmi": "pto_emi", "secuencial": "secuencial", "dirMatriz": "dir_matriz", "contribuyenteRimpe": "rimpe"}.items()])
    info = F.concat(
        F.lit("<"), node, F.lit(">"), given("fechaEmision", "fecha_emision_texto"), given("dirEstablecimiento", "dir_establecimiento"), given("obligadoContabilidad", "obligado"), party("tipoIdentificacion", "tipo_identificacion"),
        party("identificacion", "identificacion"), party("razonSocial", "razon_social_receptor"), party("direccion", "direccion_receptor"), given("moneda", "moneda"), given("motivo", "motivo"), given("totalSinImpuestos", "total_sin_impuestos"),
        given("totalDescuento", "total_descuento"), given("propina", "propina"), F.when(cod == "04", given("valorModificacion", "importe_total")).when(cod == "05", given("valorTotal", "importe_total")).otherwise(given("importeTotal", "importe_total")),
        given("codDocModificado", "cod_doc_modificado"), given("numDocModificado", "num_doc_modificado"), given("fechaEmisionDocSustento", "fecha_doc_sustento"), given("periodoFiscal", "periodo_fiscal"), given("ejercicioFiscal", "ejercicio_fiscal"),
        F.when(cod != "07", all_("pagos", "pago")).otherwise(""), F.lit("</"), node, F.lit(">"),
    )
    body = F.when(cod == "05", all_("motivos", "motivo")).when((cod == "07") & (F.col("version_xml") == "2.0.0"), all_("docsSustento", "v2")).when(cod == "07", all_("impuestos", "v1")).otherwise(all_("detalles", "detalle"))
    fields = F.from_json("info_adicional", "array<struct<nombre:string,valor:string>>")
    extra = tag("infoAdicional", F.array_join(F.transform(fields, lambda f: F.concat(F.lit('<campoAdicional nombre="'), f["nombre"], F.lit('">'), f["valor"], F.lit("</campoAdicional>"))), ""))
    doc = F.concat(F.lit('<comprobante version="'), "version_xml", F.lit('">'), head, info, body, extra, F.lit("</comprobante>"))
    wrapped = F.concat(F.lit("<autorizacion>"), given("estado", "estado"), given("numeroAutorizacion", "numero_autorizacion"), given("fechaAutorizacion", "fecha_autorizacion"), F.lit("<comprobante><![CDATA["), doc, F.lit("]]></comprobante></autorizacion>"))
    h = header(spark, d).join(by_doc, "orderkey", "left")
    return h.select("path", F.when(F.col("numero_autorizacion").isNotNull(), wrapped).otherwise(doc).alias("value"))


def _case(code: str, names: dict[str, str], default: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {default} END"


_SLUG = _case("pct", {"0": "IVA_0", "2": "IVA_12", "3": "IVA_14", "4": "IVA_15", "6": "NO_OBJETO_IVA", "7": "EXENTO_IVA"}, "'IVA_5'")
_TAXES = ",\n".join(f"    coalesce(sum({v}) FILTER (slug = '{s}'), 0)::DOUBLE AS \"{s}_{n}\"" for s in rows.SLUGS for v, n in (("base", "BASE"), ("valor", "VALOR")))
_VAT = ",\n".join(
    f"    coalesce(sum({v}) FILTER (nivel = 'DOCUMENTO' AND pct IN ({', '.join(repr(r) for r in rates)})), 0)::DOUBLE AS {name}"
    for name, v, rates in (("base_gravada", "base", "2345"), ("base_no_gravada", "base", "067"), ("monto_iva", "valor", "2345"), ("base_gravada_12", "base", "2"), ("monto_iva_12", "valor", "2"))
)
_USED = ", ".join(f"CASE WHEN sum(base) FILTER (nivel = 'DOCUMENTO' AND pct = '{c}') > 0 THEN '{t}' END" for c, t in K.IVA_TARIFF.items())

#: The same frames for DuckDB; they rest on the bridge's header, lines and withholdings.
SQL = {
    "star_lines": f"""star_lines AS (
  SELECT *, CASE WHEN orderkey % 3 != 0 THEN 'DOCUMENTO' ELSE 'LINEA' END AS nivel, base AS total, base AS pago, {_SLUG} AS slug,
    CASE WHEN posicion % 2 = 0 THEN (line_num * 15)::VARCHAR END AS plazo, CASE WHEN posicion % 2 = 0 THEN 'dias' END AS unidad_tiempo FROM lines)""",
    "facts": f"""facts AS (
  SELECT orderkey, coalesce(string_agg(trim(descripcion), ' | ' ORDER BY line_num) FILTER (trim(descripcion) != ''), '') AS descripciones,
    string_agg(concat_ws(', ', 'Desc: ' || descripcion, 'Cant: ' || cantidad, 'P.Unit: ' || precio, 'Desc: ' || descuento, 'P.Total: ' || total::DECIMAL(20,4)), chr(10) ORDER BY line_num) AS items,
    string_agg('Razon: ' || coalesce(nullif(trim(descripcion), ''), 'No Disponible') || ', Valor: ' || precio, ' | ' ORDER BY line_num) AS motivos_descripcion, sum(precio)::DOUBLE AS motivos_valor,
    min_by(forma_pago, line_num) AS forma_1, min_by(pago, line_num)::DOUBLE AS pago_1, arg_min_null(plazo, line_num) AS plazo_1, arg_min_null(unidad_tiempo, line_num) AS unidad_1,
    sum(pago)::DOUBLE AS total_pago, sum(valor)::DOUBLE AS retenido,
{_TAXES},
{_VAT},
    concat_ws(', ', {_USED}) AS tarifas
  FROM star_lines GROUP BY orderkey)""",
    "star_withholdings": """star_withholdings AS (
  SELECT *, '01' AS sustento_tipo, '001-002-' || lpad((orderkey + line_num)::VARCHAR, 9, '0') AS sustento_numero, CASE WHEN line_num > 1 THEN '05/03/1995' END AS sustento_fecha FROM withholdings)""",
    "star_header": f"""star_header AS (
  SELECT orderkey, 'd/' || orderkey || '.xml' AS path, orderkey || '.xml' AS archivo_xml, clave, CASE WHEN orderkey % 4 < 2 THEN estado END AS estado, CASE WHEN orderkey % 4 < 2 THEN clave END AS numero_autorizacion,
    CASE WHEN orderkey % 4 < 2 THEN strftime(fecha, '%Y-%m-%d') || 'T10:15:00-05:00' END AS fecha_autorizacion, cod_doc, {_case("cod_doc", K.DOC_TYPE, "cod_doc")} AS descripcion_doc,
    CASE WHEN custkey % 3 != 0 THEN '2' ELSE '1' END AS ambiente, CASE WHEN orderkey % 11 != 0 THEN '1' ELSE '2' END AS tipo_emision,
    CASE WHEN cod_doc = '07' AND orderkey % 2 = 0 THEN '2.0.0' ELSE '1.0.0' END AS version_xml, estab, pto AS pto_emi, sec AS secuencial, estab || '-' || pto || '-' || sec AS serie, ruc,
    n_name || ' S.A.' AS razon_social, CASE WHEN custkey % 2 = 0 THEN c_mktsegment END AS nombre_comercial, 'Av. ' || prioridad || ' y Calle ' || estab AS dir_matriz,
    CASE WHEN custkey % 5 = 0 THEN 'REGIMEN RIMPE' END AS rimpe, fecha AS fecha_emision, strftime(fecha, '%d/%m/%Y') AS fecha_emision_texto,
    CASE WHEN orderkey % 2 = 0 THEN 'Local ' || pto END AS dir_establecimiento, CASE WHEN custkey % 2 = 0 THEN 'SI' ELSE 'NO' END AS obligado,
    CASE WHEN custkey % 2 = 0 THEN '04' ELSE '05' END AS tipo_identificacion, CASE WHEN custkey % 2 = 0 THEN ruc ELSE left(ruc, 10) END AS identificacion, c_name AS razon_social_receptor,
    CASE WHEN custkey % 3 != 0 AND cod_doc != '07' THEN n_name END AS direccion_receptor, CASE WHEN cod_doc IN ('01', '03') THEN 'DOLAR' END AS moneda,
    CASE WHEN cod_doc = '04' THEN 'Devolucion ' || prioridad END AS motivo, (importe - custkey % 50)::DOUBLE AS total_sin_impuestos, (custkey % 50)::DOUBLE AS total_descuento, (orderkey % 7)::DOUBLE AS propina,
    importe::DOUBLE AS importe_total, CASE WHEN cod_doc = '04' THEN importe ELSE 0 END::DOUBLE AS valor_modificacion, CASE WHEN cod_doc = '05' THEN importe ELSE 0 END::DOUBLE AS valor_total,
    CASE WHEN cod_doc IN ('04', '05') THEN '01' END AS cod_doc_modificado, CASE WHEN cod_doc IN ('04', '05') AND custkey % 4 != 0 THEN estab || '-' || pto || '-' || sec END AS num_doc_modificado,
    CASE WHEN cod_doc IN ('04', '05') THEN strftime(fecha - 10, '%d/%m/%Y') END AS fecha_doc_sustento, CASE WHEN cod_doc = '07' THEN strftime(fecha, '%m/%Y') END AS periodo_fiscal,
    CASE WHEN cod_doc = '07' THEN strftime(fecha, '%Y') END AS ejercicio_fiscal, prioridad, CASE WHEN custkey % 2 = 0 THEN 'a@b.ec' ELSE '' END AS correo,
    '[{{"nombre":"prioridad","valor":"' || prioridad || '"}},{{"nombre":"Correo","valor":"' || CASE WHEN custkey % 2 = 0 THEN 'a@b.ec' ELSE '' END || '"}}]' AS info_adicional
  FROM header LEFT JOIN customer ON custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)""",
    "docs": """docs AS (
  SELECT h.*, f.* EXCLUDE (orderkey, motivos_descripcion), CASE WHEN cod_doc = '05' THEN descripciones ELSE motivo END AS motivo_modificacion, CASE WHEN cod_doc = '05' THEN motivos_descripcion END AS motivos_descripcion,
    CASE WHEN cod_doc = '05' THEN motivos_valor END AS valor_modificacion_xml, CASE WHEN cod_doc = '07' THEN retenido END AS total_retenido
  FROM star_header h LEFT JOIN facts f ON h.orderkey = f.orderkey)""",
}


def sql(select: str, names: str = "star_lines facts star_header docs", base: str = "header lines") -> str:
    """A query over some of the frames."""
    return "WITH " + ",\n".join([bridge.SQL[n] for n in base.split()] + [SQL[n] for n in names.split()]) + "\n" + select
