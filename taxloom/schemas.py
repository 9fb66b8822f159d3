"""Schemas of the tax documents' XML. All leaves are text; amounts and dates are parsed afterwards."""

from __future__ import annotations


def _struct(fields: str, **nested: str) -> str:
    parts = [f"{f}: string" for f in fields.split()] + [f"{k}: {v}" for k, v in nested.items()]
    return f"struct<{', '.join(parts)}>"


TAX = _struct("codigo codigoPorcentaje tarifa baseImponible valor codigoRetencion porcentajeRetener valorRetenido numeroDocumento tipoDocumento codDocSustento fechaEmisionDocSustento")
_INFO_TEXTS = (
    "fechaEmision dirEstablecimiento obligadoContabilidad moneda motivo propina totalSinImpuestos totalDescuento importeTotal valorModificacion valorTotal"
    " codDocModificado numDocModificado fechaEmisionDocSustento periodoFiscal ejercicioFiscal"
    " tipoIdentificacionComprador identificacionComprador razonSocialComprador direccionComprador"
    " tipoIdentificacionProveedor identificacionProveedor razonSocialProveedor direccionProveedor"
    " tipoIdentificacionSujetoRetenido identificacionSujetoRetenido razonSocialSujetoRetenido"
)
_INFO_LISTS = {"totalConImpuestos": f"struct<totalImpuesto: array<{TAX}>>", "pagos": f"struct<pago: array<{_struct('formaPago total plazo unidadTiempo')}>>"}
INFO = _struct(_INFO_TEXTS, **_INFO_LISTS)
_LINE_TAXES = {"impuestos": f"struct<impuesto: array<{TAX}>>"}
LINE = _struct("codigoPrincipal codigoAuxiliar codigoInterno descripcion cantidad precioUnitario descuento precioTotalSinImpuesto centroCosto", **_LINE_TAXES)
WITHHELD = _struct("codigo codigoRetencion baseImponible porcentajeRetener valorRetenido")
SUPPORT = _struct("codDocSustento numDocSustento fechaEmisionDocSustento", retenciones=f"struct<retencion: array<{WITHHELD}>>")
INFO_NODES = ["infoFactura", "infoLiquidacionCompra", "infoNotaCredito", "infoNotaDebito", "infoCompRetencion"]
_HEAD = "ambiente tipoEmision razonSocial nombreComercial ruc claveAcceso codDoc estab ptoEmi secuencial dirMatriz contribuyenteRimpe"
_PARTS = {
    "infoTributaria": _struct(_HEAD), **dict.fromkeys(INFO_NODES, INFO), "detalles": f"struct<detalle: array<{LINE}>>", "motivos": f"struct<motivo: array<{_struct('razon valor')}>>", "impuestos": f"struct<impuesto: array<{TAX}>>",
    "docsSustento": f"struct<docSustento: array<{SUPPORT}>>", "infoAdicional": "struct<campoAdicional: array<struct<_nombre: string, _VALUE: string>>>",
}
DOCUMENT = _struct("_version", **_PARTS, _corrupt_record="string")  # the parser wants it last


def _info(fields: str, **lists: str) -> dict[str, str]:
    return dict.fromkeys(INFO_NODES, _struct(fields, **lists))


_KEY = {"infoTributaria": _struct("claveAcceso")}
#: What each table of a report reads of a document, where that is less than all of it.
READ_BY = {
    "errores": _KEY,
    "cabecera": {k: v for k, v in _PARTS.items() if k != "detalles"} | _info(_INFO_TEXTS),
    "pagos": _KEY | _info("", pagos=_INFO_LISTS["pagos"]),
    "impuestos": _KEY | _info("fechaEmision", totalConImpuestos=_INFO_LISTS["totalConImpuestos"]) | {"detalles": f"struct<detalle: array<{_struct('', **_LINE_TAXES)}>>", "impuestos": _PARTS["impuestos"]},
    "retenciones": _KEY | _info("fechaEmision") | {k: _PARTS[k] for k in ("impuestos", "docsSustento")},
}


def document(table: str | None = None) -> str:
    """The schema of a document, or of what one table reads of it; the parser still goes through the whole text, so the same documents are broken."""
    return _struct("_version", **READ_BY.get(table, _PARTS), _corrupt_record="string")
ENVELOPE = _struct("estado numeroAutorizacion fechaAutorizacion ambiente comprobante _corrupt_record")
HISTORY = (
    "timestamp string, ruc string, origen string, anio int, mes int, dia string, tipo string, estado string, n_xml int, n_pdf int, n_registros int, fecha_filtro string,"
    " estado_autorizacion string, establecimiento string, punto_emision string, tipo_visible string, reporte string, reporte_xml string, reporte_pdf string"
)
