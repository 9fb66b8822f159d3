"""Wide report rows: one row for each document, in the columns of each report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom import catalogs as K
from taxloom.functions import keys
from taxloom.functions.text import clean, fold, is_present, present

#: Tax column stems for which facts have a base and a value.
SLUGS = ["IVA_0", "IVA_5", "IVA_8", "IVA_12", "IVA_14", "IVA_15", "NO_OBJETO_IVA", "EXENTO_IVA", "ICE", "IRBPNR"]


#: What the names of a report's number columns begin with.
NUMBERS = (
    "subtotal", "iva", "ice", "irbpnr", "propina", "total", "valor", "formaPagoMonto", "Base_Imponible", "Porcentaje", "Valor_Retenido",
    "Total ", "Base ", "Monto ", "Propina", "Importe ", "Valor ",
)


def report_schema(columns: list[str]) -> dict[str, str]:
    """The types of a report's columns: keys are whole numbers, amounts are numbers, the rest is text."""
    return {c: "bigint" if c == "orderkey" else "double" if c.startswith(NUMBERS) else "string" for c in columns}


def _zero() -> Column:
    return F.lit(0).cast("decimal(38,6)")


def line_facts(lines: DataFrame, key: str = "orderkey") -> DataFrame:
    """All that a report needs of a document's lines, taxes and payments, in one aggregation.

    ``lines`` has, for each line, line_num, its item (codigo, descripcion, cantidad, precio, descuento, total), its tax
    (nivel, codigo_impuesto, pct, base, valor) and its payment (forma_pago, pago, plazo, unidad_tiempo). Taxes of the level
    DOCUMENTO count where a document has any, else those of its lines. A group is one document.
    """
    slug = K.tax_slug(F.col("codigo_impuesto"), F.col("pct"))
    rows = lines.withColumn("slug", slug).withColumn("whole", F.col("nivel") == "DOCUMENTO")
    whole = F.max("whole")

    def tax(stem: str, value: str) -> Column:
        own = F.col("slug") == stem
        there = F.sum(F.when(own & F.col("whole"), F.col(value)))
        return F.coalesce(F.when(whole, there).otherwise(F.sum(F.when(own, F.col(value)))), _zero()).cast("double").alias(f"{stem}_{'BASE' if value == 'base' else 'VALOR'}")

    def vat(value: str, rates: list[str]) -> Column:
        return F.coalesce(F.sum(F.when(F.col("whole") & (F.col("codigo_impuesto") == "2") & F.col("pct").isin(rates), F.col(value))), _zero())

    def joined(text: Column, separator: str) -> Column:
        found = F.sort_array(F.collect_list(F.struct(F.col("line_num").alias("n"), text.alias("t"))))
        return F.array_join(F.filter(F.transform(found, lambda s: F.trim(s["t"])), lambda t: t != ""), separator)

    def part(name: str, c: str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))

    item = F.concat_ws(", ", part("Desc", "descripcion"), part("Cant", "cantidad"), part("P.Unit", "precio"), part("Desc", "descuento"), part("P.Total", "total"))
    reason = F.concat(F.lit("Razon: "), F.coalesce(present(F.col("descripcion")), F.lit(K.MISSING)), F.lit(", Valor: "), F.coalesce(F.col("precio").cast("string"), F.lit(K.MISSING)))
    first = F.min_by(F.struct("forma_pago", "pago", "plazo", "unidad_tiempo"), "line_num")
    used = [F.when(vat("base", [c]) > 0, K.IVA_TARIFF[c]) for c in K.TAXED_RATES]
    return rows.groupBy(key).agg(
        joined(F.coalesce("descripcion", F.lit("")), " | ").alias("descripciones"),
        joined(item, "\n").alias("items"),
        joined(reason, " | ").alias("motivos_descripcion"),
        F.sum("precio").cast("double").alias("motivos_valor"),
        first.alias("pago_1"),
        F.sum("pago").cast("double").alias("total_pago"),
        F.sum("valor").cast("double").alias("retenido"),
        *[tax(s, v) for s in SLUGS for v in ("base", "valor")],
        vat("base", K.TAXED_RATES).cast("double").alias("base_gravada"),
        vat("base", K.UNTAXED_RATES).cast("double").alias("base_no_gravada"),
        vat("valor", K.TAXED_RATES).cast("double").alias("monto_iva"),
        vat("base", ["2"]).cast("double").alias("base_gravada_12"),
        vat("valor", ["2"]).cast("double").alias("monto_iva_12"),
        F.concat_ws(", ", *used).alias("tarifas"),
    )


def _said(c: Column | str) -> Column:
    """The text, or the word for missing."""
    return F.coalesce(present(F.col(c) if isinstance(c, str) else c), F.lit(K.MISSING))


def _text(c: str) -> Column:
    """The text, or an empty one."""
    return F.coalesce(F.trim(F.col(c)), F.lit(""))


def _number(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(0.0))


def _some(*numbers: Column) -> Column:
    """The first number that isn't null or zero, else zero."""
    return F.coalesce(*[F.nullif(n.cast("double"), F.lit(0.0)) for n in numbers], F.lit(0.0))


def extra_fields(c: str, separator: str) -> Column:
    """'name: value' of the extra fields, which are a JSON list; missing ones have their word."""
    fields = F.from_json(F.col(c), "array<struct<nombre:string,valor:string>>")
    named = F.filter(fields, lambda f: (F.trim(F.coalesce(f["nombre"], F.lit(""))) != "") | (F.trim(F.coalesce(f["valor"], F.lit(""))) != ""))
    return _said(F.array_join(F.transform(named, lambda f: F.concat(F.trim(F.coalesce(f["nombre"], F.lit(""))), F.lit(": "), F.trim(F.coalesce(f["valor"], F.lit(""))))), separator))


def summary_row(docs: DataFrame, key: str = "orderkey") -> DataFrame:
    """The summary of each document in 44 columns. ``docs`` is the header with :func:`line_facts` beside it."""

    def labelled(c: str, names: dict[str, str]) -> Column:
        return _said(K.label(_text(c), names))

    form = F.col("pago_1.forma_pago")
    day = F.date_format("fecha_emision", "dd/MM/yyyy")
    return docs.select(
        key,
        _said("estado").alias("estado"), _said("numero_autorizacion").alias("numero_autorizacion"), _said("fecha_autorizacion").alias("fecha_autorizacion"),
        labelled("ambiente", K.ENVIRONMENT).alias("ambiente"), _said("razon_social").alias("razon_social_emisor"), _said("dir_establecimiento").alias("dir_establecimiento"),
        _said("obligado").alias("obligado_contabilidad"), labelled("tipo_identificacion", K.ID_TYPE).alias("tipo_identificacion_comprador"), _said("identificacion").alias("identificacion_comprador"),
        labelled("tipo_emision", K.EMISSION).alias("tipo_emision"), _said("nombre_comercial").alias("nombre_comercial"), labelled("cod_doc", K.DOC_CODE).alias("codigo_documento"),
        _said("estab").alias("estab"), _said("pto_emi").alias("punto_emision"), _said("secuencial").alias("secuencial"), _said("dir_matriz").alias("direccion_matriz"),
        _said("rimpe").alias("contribuyente_rimpe"), _said("ruc").alias("ruc_emisor"), _said("clave").alias("clave_acceso"), F.coalesce(day, _said("fecha_emision_texto")).alias("fecha_emision"),
        _said("razon_social_receptor").alias("razon_social_comprador"), _said("direccion_receptor").alias("direccion_comprador"), _said("moneda").alias("moneda"),
        _said("pago_1.plazo").alias("plazo_pago"), _said("pago_1.unidad_tiempo").alias("unidad_tiempo_pago"),
        _said(F.coalesce(F.when(F.col("cod_doc") == "05", present(F.col("motivos_descripcion"))), F.col("descripciones"))).alias("descripciones"),
        F.concat_ws(" - ", _said(form), _said(K.label(form, K.PAYMENT, F.lit("")))).alias("forma_pago"),
        _number("total_sin_impuestos").alias("total_sin_impuestos"), _number("base_gravada").alias("base_gravada"), _number("base_no_gravada").alias("base_no_gravada"),
        F.when(F.col("tarifas") != "", F.col("tarifas")).when(F.col("base_no_gravada") > 0, "0%").otherwise(K.MISSING).alias("tarifas_iva"),
        _number("monto_iva").alias("monto_iva"), _number("total_descuento").alias("total_descuento"), _number("propina").alias("propina"), _number("importe_total").alias("importe_total"),
        _number("total_pago").alias("total_pago"), _said("cod_doc_modificado").alias("codigo_documento_modificado"), _said("num_doc_modificado").alias("numero_documento_modificado"),
        _said("fecha_doc_sustento").alias("fecha_emision_doc_sustento"), _said("motivo_modificacion").alias("motivo"), _some(F.col("valor_modificacion_xml"), F.col("valor_modificacion")).alias("valor_modificacion"),
        extra_fields("info_adicional", "; ").alias("campos_adicionales"), _number("base_gravada_12").alias("base_gravada_12"), _number("monto_iva_12").alias("monto_iva_12"),
    )


def _parties() -> dict[str, Column]:
    """Columns that the report rows share: issuer, numbers, dates, receiver."""
    return {
        "rucEmisor": _text("ruc"), "razonSocialEmisor": _text("razon_social"), "direccionMatrizEmisor": _text("dir_matriz"), "numeroComprobante": _text("serie"), "establecimiento": _text("estab"),
        "puntoEmision": _text("pto_emi"), "secuencial": _text("secuencial"), "fechaEmision": F.coalesce(F.date_format("fecha_emision", "yyyy-MM-dd"), F.lit("")), "fechaAutorizacion": _text("fecha_autorizacion"), "claveAcceso": _text("clave"),
    }


def standard_row(docs: DataFrame, key: str = "orderkey") -> DataFrame:
    """The 30 columns of the standard report that a header and its line texts fill, as they are."""
    plain = {
        "tipoDocumento": "descripcion_doc", "nombreComercial": "nombre_comercial", "direccionSucursalEmisor": "dir_establecimiento", "obligadoContabilidad": "obligado", "tipoContribuyenteRIMPE": "rimpe",
        "razonSocialComprador": "razon_social_receptor", "identificacionComprador": "identificacion", "direccionComprador": "direccion_receptor", "comprobanteModificado": "num_doc_modificado",
        "fechaEmisionModificado": "fecha_doc_sustento", "razonModificacion": "motivo_modificacion", "descripcionesProductos": "descripciones", "ambiente": "ambiente", "emision": "tipo_emision", "informacionAdicional": "info_adicional",
    }
    numbers = {
        "valorModificacion": _some(F.col("valor_modificacion"), F.col("valor_modificacion_xml")), "subtotalSinImpuestos": _number("total_sin_impuestos"), "totalDescuento": _number("total_descuento"),
        "propina": _number("propina"), "valorTotal": _some(F.col("importe_total"), F.col("valor_total")),
    }
    columns = _parties() | {n: _text(c) for n, c in plain.items()} | numbers
    return docs.select(key, *[v.alias(c) for c, v in columns.items()])


def _word(c: str, words: dict[str, str]) -> Column:
    """A code or a text as one of a few words: the first whose key the folded text is or holds; else the text in capitals."""
    text = F.upper(fold(_text(c)))
    found = F.upper(_text(c))
    for key, word in reversed(words.items()):
        found = F.when((text == key) if len(key) == 1 else F.contains(text, F.lit(key)), word).otherwise(found)
    return found


# Words of environments and emissions.
ENVIRONMENT_WORDS = {"PRODUCCION": "PRODUCCION", "PRUEBAS": "PRUEBAS", "1": "PRUEBAS", "2": "PRODUCCION"}
EMISSION_WORDS = {"NORMAL": "NORMAL", "INDISPONIBILIDAD": "CONTINGENCIA", "CONTINGENCIA": "CONTINGENCIA", "1": "NORMAL", "2": "CONTINGENCIA"}


def report_row(docs: DataFrame, key: str = "orderkey") -> DataFrame:
    """The standard report in all 52 columns.

    A document without a base at 8 % but with one at 14 %, which is the code of special rates, has the latter in the
    columns of 8 %; else both have their own.
    """
    special = (F.col("IVA_8_BASE") == 0) & (F.col("IVA_14_BASE") != 0)
    never = {c: F.lit(K.MISSING) for c in ("contribuyenteEspecial", "agenteRetencion", "placa", "guia")}  # no document has them
    said = {
        "nombreComercial": "nombre_comercial", "direccionSucursalEmisor": "dir_establecimiento", "obligadoContabilidad": "obligado", "tipoContribuyenteRIMPE": "rimpe",
        "fechaEmisionModificado": "fecha_doc_sustento", "descripcionesProductos": "items",
    }
    columns = _parties() | never | {n: _said(c) for n, c in said.items()} | {
        "tipoDocumento": _text("descripcion_doc"), "razonSocialComprador": _text("razon_social_receptor"), "identificacionComprador": _text("identificacion"), "direccionComprador": _text("direccion_receptor"),
        "comprobanteModificado": _said(F.coalesce(present(F.col("num_doc_modificado")), F.col("cod_doc_modificado"))), "razonModificacion": _said(F.coalesce(present(F.col("motivo_modificacion")), F.col("motivos_descripcion"))),
        "valorModificacion": _some(F.col("valor_modificacion_xml"), F.col("valor_modificacion")),
        "subtotalTarifaEspecial": F.when(special, 0.0).otherwise(F.col("IVA_14_BASE")), "ivaTarifaEspecial": F.when(special, 0.0).otherwise(F.col("IVA_14_VALOR")),
        "subtotal8": F.when(special, F.col("IVA_14_BASE")).otherwise(F.col("IVA_8_BASE")), "iva8": F.when(special, F.col("IVA_14_VALOR")).otherwise(F.col("IVA_8_VALOR")),
        **{f"subtotal{r}": F.col(f"IVA_{r}_BASE") for r in (15, 12, 5, 0)}, "subtotalNoObjetoIVA": F.col("NO_OBJETO_IVA_BASE"), "subtotalExentoIVA": F.col("EXENTO_IVA_BASE"),
        **{f"iva{r}": F.col(f"IVA_{r}_VALOR") for r in (15, 12, 5)}, "ice": F.col("ICE_VALOR"), "irbpnr": F.col("IRBPNR_VALOR"),
        "subtotalSinImpuestos": F.col("total_sin_impuestos"), "totalDescuento": F.col("total_descuento"), "propina": F.col("propina"),
        "valorTotal": _some(F.col("importe_total"), F.col("valor_total"), F.col("valor_modificacion")), "valorTotalSinSubsidio": F.lit(0.0),
        "formaPago": _said(F.coalesce(present(K.label(F.col("pago_1.forma_pago"), K.PAYMENT, F.lit(""))), F.col("pago_1.forma_pago"))), "formaPagoMonto": F.col("pago_1.pago"),
        "ambiente": _word("ambiente", ENVIRONMENT_WORDS), "emision": _word("tipo_emision", EMISSION_WORDS), "informacionAdicional": extra_fields("info_adicional", "\n"),
    }
    return docs.select(key, *[(_number(v) if c.startswith(NUMBERS) else v).alias(c) for c, v in columns.items()])


def settlement_row(report: DataFrame) -> DataFrame:
    """Issued purchase settlements: the standard report with its own words where it has nothing to say."""
    obliged = clean(F.col("obligadoContabilidad"))
    return report.withColumns({
        "tipoDocumento": F.lit("Liquidación de Compra"),
        "nombreComercial": F.when(is_present(F.col("nombreComercial")), F.col("nombreComercial")).otherwise(_said("razonSocialEmisor")),
        "agenteRetencion": F.replace(F.col("agenteRetencion"), F.lit("Resolucion"), F.lit("Resolución")),
        "obligadoContabilidad": F.when(obliged.isin("SI", "NO"), obliged).otherwise(K.MISSING),
        "razonSocialComprador": F.lit(K.MISSING),
        "direccionComprador": F.when(is_present(F.col("direccionComprador")), F.col("direccionComprador")).otherwise(""),
        "informacionAdicional": F.when(is_present(F.col("informacionAdicional")), F.col("informacionAdicional")).otherwise(K.MISSING),
    })


RATES = (15, 12, 8, 5)


def _issued(report: DataFrame, code: str, branch: Column, trade: Column, id_kind: Column) -> dict[str, Column]:
    """Columns that issued invoices, credit notes and debit notes share, from the standard report."""
    labels = {"ambiente": {"PRODUCCION": "2", "PRUEBA": "1", "1": "1", "2": "2"}, "emision": {"NORMAL": "1", "INDISPONIBILIDAD": "2", "CONTINGENCIA": "2", "1": "1", "2": "2"}}

    def labelled(c: str, names: dict[str, str]) -> Column:
        return K.label(_word(c, labels[c]), names)

    rate = F.coalesce(*[F.when(F.col(f"iva{r}") != 0, f"{r}%") for r in RATES], F.lit(""))
    no = F.lit(K.MISSING)
    return {
        "Ambiente": labelled("ambiente", K.ENVIRONMENT), "Razón Social Emisor": _said("razonSocialEmisor"), "Dir. Establecimiento": branch, "Tipo Identificación Comprador": id_kind,
        "Identificación Comprador": _said("identificacionComprador"), "Tipo Emisión": labelled("emision", K.EMISSION), "Nombre Comercial": trade, "Código del Documento": F.lit(K.DOC_CODE[code]),
        "Establecimiento": F.col("establecimiento"), "Punto de Emisión": F.col("puntoEmision"), "Secuencial": F.col("secuencial"), "Contribuyente RIMPE": _said("tipoContribuyenteRIMPE"), "RUC Emisor": F.col("rucEmisor"),
        "Clave de Acceso": F.col("claveAcceso"), "Fecha de Emisión": F.col("fechaEmision"), "Razón Social Comprador": _said("razonSocialComprador"), "Dirección Comprador": _said("direccionComprador"),
        "Moneda": no, "Plazo Pago": no, "Unidad Tiempo Pago": no, "Descripciones": F.col("descripcionesProductos"), "Forma Pago": F.lit(f"{K.MISSING} - {K.MISSING}"),
        "Total Sin Impuestos": F.col("subtotalSinImpuestos"), "Base Gravada": _some(*[F.col(f"subtotal{r}") for r in RATES]), "Base No Gravada": F.col("subtotal0"), "Tarifas IVA": rate,
        "Monto IVA": _some(*[F.col(f"iva{r}") for r in RATES]), "Total Descuento": F.col("totalDescuento"), "Propina": F.col("propina"), "Importe Total": F.col("valorTotal"), "Campos Adicionales": _said("informacionAdicional"),
    }


def _obliged() -> Column:
    return F.when(clean(F.col("obligadoContabilidad")).isin("SI", "NO"), clean(F.col("obligadoContabilidad"))).otherwise(K.MISSING)


def _kind_of_id() -> Column:
    return _said(K.label(keys.id_type(F.col("identificacionComprador")), K.ID_TYPE))


def _or_head(c: str, other: str) -> Column:
    return _said(F.coalesce(present(F.col(c)), F.col(other)))


def issued_invoice(report: DataFrame, key: str = "orderkey") -> DataFrame:
    """Issued invoices in 38 columns: all of the total is untaxed, the VAT is that of the highest rate in use."""
    shared = _issued(report, "01", _or_head("direccionSucursalEmisor", "direccionMatrizEmisor"), _or_head("nombreComercial", "razonSocialEmisor"), _kind_of_id())
    untaxed = F.col("subtotalSinImpuestos")
    own = {
        "Estado": F.lit(K.MISSING), "Número de Autorización": F.lit(K.MISSING), "Fecha de Autorización": F.lit(K.MISSING), "Obligado Contabilidad": _obliged(), "Dirección Matriz": _said("direccionMatrizEmisor"), "Contribuyente RIMPE": F.lit(K.MISSING),
        "Fecha de Emisión": _said(F.coalesce(F.date_format(F.try_to_date("fechaEmision", "yyyy-MM-dd"), "dd/MM/yyyy"), F.col("fechaEmision"))), "Moneda": F.lit("DOLAR"), "Base Gravada": F.lit(0.0), "Base No Gravada": untaxed,
        "Tarifas IVA": F.lit("0%"), "Total Pago": F.lit(0.0), "Base No Gravada 0%": untaxed,
    }
    return report.select(key, *[v.alias(c) for c, v in (shared | own).items()])


def _note(report: DataFrame, code: str, own: dict[str, Column], key: str, **shared: Column) -> DataFrame:
    both = {
        "Estado": F.lit(""), "Número de Autorización": F.lit(""), "Fecha de Autorización": F.col("fechaAutorizacion"), "Fecha Emisión Doc. Sustento": _said("fechaEmisionModificado"), "Motivo": _said("razonModificacion"),
        "Base Gravada 15%": F.col("subtotal15"), "Monto IVA 15%": F.col("iva15"),
    }
    return report.select(key, *[v.alias(c) for c, v in (_issued(report, code, **shared) | both | own).items()])


def issued_credit_note(report: DataFrame, key: str = "orderkey") -> DataFrame:
    """Issued credit notes in 44 columns."""
    own = {
        "Obligado Contabilidad": _said("obligadoContabilidad"), "Dirección Matriz": F.col("direccionMatrizEmisor"), "Total Pago": F.lit(0.0), "Código Documento Modificado": _said("comprobanteModificado"),
        "Número Documento Modificado": _said("comprobanteModificado"), "Valor Modificación": F.col("valorModificacion"),
    }
    return _note(report, "04", own, key, branch=_said("direccionSucursalEmisor"), trade=_said("nombreComercial"), id_kind=F.lit(K.MISSING))


def issued_debit_note(report: DataFrame, key: str = "orderkey") -> DataFrame:
    """Issued debit notes in 44 columns: what is paid is the total, which stands in for a missing modified value."""
    changed = clean(F.col("comprobanteModificado"))
    number = F.coalesce(F.nullif(F.regexp_extract(changed, r"(\d{3}-\d{3}-\d{9})", 1), F.lit("")), changed)
    own = {
        "Obligado Contabilidad": _obliged(), "Dirección Matriz": _said("direccionMatrizEmisor"), "Total Pago": F.col("valorTotal"), "Código Documento Modificado": keys.document_code(F.col("comprobanteModificado")),
        "Número Documento Modificado": _said(number), "Valor Modificación": _some(F.col("valorModificacion"), F.col("valorTotal")),
    }
    return _note(report, "05", own, key, branch=_or_head("direccionSucursalEmisor", "direccionMatrizEmisor"), trade=_or_head("nombreComercial", "razonSocialEmisor"), id_kind=_kind_of_id())


def _withholding_head(said: bool) -> dict[str, Column]:
    """Header columns of withholding rows; ``said`` puts the word for missing where the issued report does."""
    text = _said if said else _text
    more = {"numeroContribuyenteEspecial": F.lit(K.MISSING if said else ""), "numeroAgenteRetencion": F.lit(K.MISSING if said else "")}
    return _parties() | more | {
        "nombreComercial": text("nombre_comercial"), "direccionSucursalEmisor": _text("dir_establecimiento"), "obligadoContabilidad": _text("obligado"), "razonSocialSujetoRetenido": _text("razon_social_receptor"),
        "identificacionSujetoRetenido": _text("identificacion"), "Comprobante_Sustento": _text("sustento_tipo"), "Fecha_Emision_Sustento": _text("sustento_fecha"),
    }


def support_facts(withholdings: DataFrame, key: str = "orderkey") -> DataFrame:
    """First support document of a withholding, and for each tax its lines' summary, first and last or second ones.

    ``withholdings`` has line_num, codigo (2: VAT; the rest is income tax), base, pct, valor, sustento_tipo,
    sustento_numero, sustento_fecha.
    """
    rows = withholdings.withColumn("tax", F.when(F.col("codigo") == "2", "IVA").otherwise("IR"))
    item = F.struct("line_num", *[F.col(c).cast("double").alias(c) for c in ("base", "pct", "valor")])

    def first(c: str) -> Column:
        return F.min_by(c, F.when(present(F.col(c)).isNotNull(), F.col("line_num"))).alias(c)

    lists = [F.array_sort(F.collect_list(F.when(F.col("tax") == t, item))).alias(t) for t in ("IVA", "IR")]
    return rows.groupBy(key).agg(first("sustento_tipo"), first("sustento_numero"), first("sustento_fecha"), *lists)


_PARTS = [("base", "Base_Imponible_Ret"), ("pct", "Porcentaje_Ret"), ("valor", "Valor_Retenido")]


def withholding_row(docs: DataFrame, key: str = "orderkey") -> DataFrame:
    """Received withholdings in 41 columns: each tax's first line, and its last one where there are more.

    ``docs`` is the header with :func:`support_facts` beside it. Slots without a line are null, their tax is empty.
    """
    columns = _withholding_head(False) | {
        "ambiente": _text("ambiente"), "emision": _text("tipo_emision"), "Numero_Sustento": _text("sustento_numero"), "Ejercicio_Fiscal": _text("periodo_fiscal"),
        "informacionAdicional": _text("info_adicional"), "tipoDocumento": _text("descripcion_doc"),
    }
    for tax, word in (("IVA", "IVA"), ("IR", "Renta")):
        n = F.coalesce(F.size(tax), F.lit(0))
        for suffix, row, there in (("", F.get(tax, F.lit(0)), n > 0), ("_1", F.get(tax, n - 1), n > 1)):
            columns |= {f"{name}_{tax}{suffix}": F.when(there, row[c]) for c, name in _PARTS}
            columns[f"Impuesto_Ret_{tax}{suffix}"] = F.when(there, word).otherwise("")
    return docs.select(key, *[v.alias(c) for c, v in columns.items()])


def issued_withholding_row(docs: DataFrame, key: str = "orderkey") -> DataFrame:
    """Issued withholdings in 49 columns: a summary and two details for each tax.

    No line: zeros and 'No Aplica'. One: summary and first detail are that line. More: sums, 'Varios', rate 0, and the
    first two lines.
    """
    stamp = F.to_timestamp(F.regexp_extract("fecha_autorizacion", r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1).try_cast("timestamp_ntz"))
    words = {"PRODUCCION": "PRODUCCIÓN", "PRUEBA": "PRUEBAS", "1": "PRUEBAS", "2": "PRODUCCIÓN"}
    columns = _withholding_head(True) | {
        "fechaAutorizacion": F.coalesce(F.date_format(stamp, "dd/MM/yyyy HH:mm:ss"), _text("fecha_autorizacion")), "ambiente": _word("ambiente", words), "emision": _word("tipo_emision", EMISSION_WORDS),
        "Numero_Sustento": F.replace(_text("sustento_numero"), F.lit("-"), F.lit("")), "Ejercicio_Fiscal": _text("ejercicio_fiscal"), "informacionAdicional": extra_fields("info_adicional", "\n"), "tipoDocumento": F.lit("Retencion"),
    }
    for tax, word in (("IVA", "IVA"), ("IR", "Renta")):
        n, one = F.coalesce(F.size(tax), F.lit(0)), F.get(tax, F.lit(0))

        def total(c: str, tax: str = tax) -> Column:
            return F.aggregate(tax, F.lit(0.0), lambda acc, s: acc + s[c])

        for c, name in _PARTS:
            many = F.lit(0.0) if c == "pct" else total(c)
            columns[f"{name}_{tax}"] = F.when(n == 0, 0.0).when(n == 1, one[c]).otherwise(many)
            for i in (1, 2):
                columns[f"{name}_{tax}_{i}"] = F.when(n >= i, F.get(tax, F.lit(i - 1))[c]).otherwise(0.0)
        columns[f"Impuesto_Ret_{tax}"] = F.when(n == 0, K.NOT_APPLICABLE).when(n == 1, word).otherwise("Varios")
        for i in (1, 2):
            columns[f"Impuesto_Ret_{tax}_{i}"] = F.when(n >= i, word).otherwise("")
    return docs.select(key, *[v.alias(c) for c, v in columns.items()])


# Text columns of issued rows that are empty by default, not the word for missing; and other defaults.
EMPTY_IN_NOTES = [
    "Estado", "Número de Autorización", "Fecha de Autorización", "Ambiente", "Razón Social Emisor", "Tipo Emisión", "Código del Documento", "Establecimiento", "Punto de Emisión", "Secuencial", "Dirección Matriz", "RUC Emisor",
    "Clave de Acceso", "Fecha de Emisión", "Descripciones", "Tarifas IVA",
]
OTHER_DEFAULTS = {"Descripciones": "", "Tarifas IVA": "0%"}
SAID_IN_WITHHOLDINGS = ["nombreComercial", "numeroContribuyenteEspecial", "numeroAgenteRetencion", "informacionAdicional"]
WITHHOLDING_DEFAULTS = {"Impuesto_Ret_IVA": K.NOT_APPLICABLE, "Impuesto_Ret_IR": K.NOT_APPLICABLE, "tipoDocumento": "Retencion"}


def default_row(kind: str, columns: list[str]) -> dict[str, object]:
    """The values of an issued row ('factura', 'nota' or 'retencion') of a document of which nothing could be read."""
    texts = {
        "factura": {c: OTHER_DEFAULTS.get(c, K.MISSING) for c in columns},
        "nota": {c: "" if c in EMPTY_IN_NOTES else K.MISSING for c in columns},
        "retencion": {c: WITHHOLDING_DEFAULTS.get(c, K.MISSING if c in SAID_IN_WITHHOLDINGS else "") for c in columns},
    }[kind]
    return {c: 0 if t == "double" else texts[c] for c, t in report_schema(columns).items()}


def default_rows(documents: DataFrame, key: str, kind: str, columns: list[str]) -> DataFrame:
    """A default row for each of the documents."""
    types = report_schema(columns)
    return documents.select(key, *[F.lit(v).cast(types[c]).alias(c) for c, v in default_row(kind, columns).items()])
