"""Code catalogues of the tax documents, as dictionaries and as small dimension frames."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Document types, their counters, and labels of codes.
DOC_TYPE = {"01": "Factura", "03": "Liquidacion de compra", "04": "Nota de credito", "05": "Nota de debito", "07": "Comprobante de retencion"}
DOC_COUNTER = {"01": "facturas", "03": "liquidaciones", "04": "nc", "05": "nd", "07": "retenciones"}
DOC_CODE = {"01": "01 - FACTURA", "03": "03 - LIQUIDACION DE COMPRA", "04": "04 - NOTA DE CREDITO", "05": "05 - NOTA DE DEBITO", "07": "07 - COMPROBANTE DE RETENCION"}
TAX = {"2": "IVA", "3": "ICE", "5": "IRBPNR"}
WITHHELD_TAX = {"1": "Renta", "2": "IVA", "6": "ISD"}
IVA_RATE = {"0": "IVA 0%", "2": "IVA 12%", "3": "IVA 14%", "4": "IVA 15%", "5": "IVA 5%", "6": "No objeto IVA", "7": "Exento IVA"}
IVA_TARIFF = {"2": "12%", "3": "14%", "4": "15%", "5": "5%"}
PAYMENT = {
    "01": "Sin utilizacion del sistema financiero",
    "15": "Compensacion de deudas",
    "16": "Tarjeta de debito",
    "17": "Dinero electronico",
    "18": "Tarjeta prepago",
    "19": "Tarjeta de credito",
    "20": "Otros con utilizacion del sistema financiero",
    "21": "Endoso de titulos",
}
ENVIRONMENT = {"1": "1 - Pruebas", "2": "2 - Produccion"}
EMISSION = {"1": "1 - Emision normal", "2": "2 - Emision por indisponibilidad del sistema"}
ID_TYPE = {"04": "04 - RUC", "05": "05 - Cedula", "06": "06 - Pasaporte", "07": "07 - Consumidor final", "08": "08 - Identificacion del exterior", "09": "09 - Placa"}
MONTHS = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]
# Slug of a document type's name, its order and label; anything else has order 99.
TYPE_ORDER = {
    "factura": (1, "Factura"),
    "liquidacion_de_compra": (2, "Liquidacion_de_Compra"),
    "liquidacion_de_compra_de_bienes_y_prestacion_de_servicios": (2, "Liquidacion_de_Compra"),
    "nota_de_credito": (3, "NotaCredito"),
    "nota_credito": (3, "NotaCredito"),
    "nota_de_debito": (4, "NotaDebito"),
    "nota_debito": (4, "NotaDebito"),
    "guia_de_remision": (5, "GuiaRemision"),
    "guia_remision": (5, "GuiaRemision"),
    "comprobante_de_retencion": (6, "Retencion"),
    "comprobante_de_retencion_venta": (6, "Retencion"),
    "retencion": (6, "Retencion"),
    "retenciones": (6, "Retencion"),
}
# Rate codes with and without a tax, and the words of reports for what is missing.
TAXED_RATES = ["2", "3", "4", "5"]
UNTAXED_RATES = ["0", "6", "7"]
MISSING = "No Disponible"
NOT_APPLICABLE = "No Aplica"


def label(code: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """The code's label; without one the default, or the code itself. Catalogues are literals: nothing is joined."""
    found = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(found, F.trim(code)), code if default is None else default)


def dimension(spark: SparkSession, names: dict[str, str], code: str = "code", text: str = "label") -> DataFrame:
    """A catalogue as a frame of as many rows, for broadcast joins."""
    return spark.createDataFrame(list(names.items()), f"{code} string, {text} string")


def tax_slug(code: Column, rate: Column) -> Column:
    """Column stem of a tax: IVA_12, NO_OBJETO_IVA, ICE, IRBPNR, or IMP_code_rate."""
    stem = lambda name: name.replace("%", "").replace(" ", "_").upper()
    other = F.upper(F.replace(F.replace(F.concat(F.lit("IVA "), rate, F.lit("%")), F.lit("%"), F.lit("")), F.lit(" "), F.lit("_")))
    return (
        F.when(code == "2", label(rate, {k: stem(v) for k, v in IVA_RATE.items()}, other))
        .when(code == "3", "ICE")
        .when(code == "5", "IRBPNR")
        .otherwise(F.concat(F.lit("IMP_"), code, F.lit("_"), F.coalesce(F.nullif(rate, F.lit("")), F.lit("0"))))
    )
