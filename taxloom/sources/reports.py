"""Report tables on disk: write them, find them, read them back, and name their columns for people."""

from __future__ import annotations

import datetime
import re
from calendar import monthrange

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from taxloom.functions import amounts, dates
from taxloom.functions.text import fold
from taxloom.sources import xml

ALWAYS = ["resumen", "cabecera", "detalle", "impuestos", "pagos"]
PARTITIONS = ["origen", "estado_ruta", "cod_doc", "anio", "mes"]

# Titles of report columns; other columns get their words.
TITLES = {
    "CONSULTA_ID": "ID de consulta",
    "FECHA_EJECUCION": "Fecha y hora de ejecucion",
    "RANGO_FECHAS": "Rango de fechas consultado",
    "TOTAL_DOCUMENTOS": "Total de documentos",
    "ARCHIVO_XML": "Archivo XML",
    "RUTA_XML": "Ruta del archivo XML",
    "COD_DOC": "Codigo del documento",
    "DESCRIPCION_DOC": "Descripcion del comprobante",
    "CLAVE_ACCESO": "Clave de acceso",
    "SERIE_COMPROBANTE": "Serie del comprobante",
    "ESTADO_AUTORIZACION": "Estado de autorizacion",
    "NUMERO_AUTORIZACION": "Numero de autorizacion",
    "FECHA_AUTORIZACION": "Fecha de autorizacion",
    "AMBIENTE": "Ambiente",
    "ESTAB": "Establecimiento",
    "PTO_EMI": "Punto de emision",
    "SECUENCIAL": "Secuencial",
    "RUC_EMISOR": "RUC del emisor",
    "RAZON_SOCIAL_EMISOR": "Razon social del emisor",
    "NOMBRE_COMERCIAL_EMISOR": "Nombre comercial del emisor",
    "DIR_MATRIZ": "Direccion de la matriz",
    "DIR_ESTABLECIMIENTO": "Direccion del establecimiento",
    "TIPO_IDENTIFICACION_COMPRADOR": "Tipo de identificacion del receptor",
    "IDENTIFICACION_COMPRADOR": "Identificacion del receptor",
    "RAZON_SOCIAL_COMPRADOR": "Nombre o razon social del receptor",
    "DIRECCION_COMPRADOR": "Direccion del receptor",
    "FECHA_EMISION": "Fecha de emision",
    "TOTAL_SIN_IMPUESTOS": "Total sin impuestos",
    "TOTAL_DESCUENTO": "Total de descuentos",
    "IMPORTE_TOTAL": "Importe total",
    "MONEDA": "Moneda",
    "MOTIVO": "Motivo",
    "VALOR_MODIFICACION": "Valor de la modificacion",
    "VALOR_TOTAL": "Valor total",
    "TOTAL_RETENIDO": "Total retenido",
    "PERIODO_FISCAL": "Periodo fiscal",
    "EJERCICIO_FISCAL": "Ejercicio fiscal",
    "LINE_NUM": "Numero de linea",
    "CODIGO_PRINCIPAL": "Codigo principal",
    "DESCRIPCION": "Descripcion del item",
    "CANTIDAD": "Cantidad",
    "PRECIO_UNITARIO": "Precio unitario",
    "PRECIO_TOTAL_SIN_IMPUESTO": "Precio total sin impuestos",
    "CENTRO_COSTO": "Centro de costo",
    "CTA_CONTABLE": "Cuenta contable",
    "NIVEL": "Nivel del impuesto",
    "CODIGO": "Codigo del impuesto",
    "CODIGO_PORCENTAJE": "Codigo de porcentaje",
    "TARIFA": "Tarifa",
    "BASE_IMPONIBLE": "Base imponible",
    "VALOR": "Valor del impuesto",
    "PAGO_NUM": "Numero de pago",
    "FORMA_PAGO": "Forma de pago (codigo)",
    "FORMA_PAGO_DESC": "Descripcion de la forma de pago",
    "PLAZO": "Plazo",
    "UNIDAD_TIEMPO": "Unidad de tiempo",
    "TIPO_IMPUESTO": "Tipo de impuesto",
    "CODIGO_RETENCION": "Codigo de retencion",
    "PORCENTAJE_RETENER": "Porcentaje a retener",
    "VALOR_RETENIDO": "Valor retenido",
    "DOC_SUSTENTO_TIPO": "Tipo del documento de sustento",
    "DOC_SUSTENTO_ESTAB": "Establecimiento del documento de sustento",
    "DOC_SUSTENTO_PTO": "Punto de emision del documento de sustento",
    "DOC_SUSTENTO_SECUENCIAL": "Secuencial del documento de sustento",
    "FECHA_EMISION_DOC_SUSTENTO": "Fecha del documento de sustento",
    "ERROR": "Descripcion del error",
}
# Names of taxes, of a tax column's part, and of a payment column's part.
TAX_NAMES = {"IVA": "Impuesto al valor agregado", "ICE": "Impuesto a los consumos especiales", "IRBPNR": "Impuesto redimible a las botellas plasticas no retornables"}
TAX_PARTS = {"BASE": "base imponible", "VALOR": "valor", "TARIFA": "tarifa", "CODIGO_PORCENTAJE": "codigo de porcentaje"}
PAYMENT_PARTS = {"FORMA_PAGO": "Forma de pago", "TOTAL_PAGO": "Monto del pago", "PLAZO": "Plazo del pago", "UNIDAD_TIEMPO": "Unidad de tiempo del pago"}


def write_bundle(tables: dict[str, DataFrame], path: str) -> list[str]:
    """One Parquet table for each frame; those that aren't always there are left out when empty."""
    written = []
    for name, table in tables.items():
        if name in ALWAYS or not table.isEmpty():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
            written.append(name)
    return written


def write_parsed(parsed: DataFrame, path: str) -> dict[str, int]:
    """Write documents that :func:`taxloom.sources.xml.parse` gives as a report, and tell the rows of each table.

    The parsed documents are written first, and while they are, Spark counts what each table will have; a table that isn't always there
    is written only if it has rows, without a job to find that out. All tables are then made from the stored documents. No table needs rows
    of several documents but the run's, so nothing is shuffled; all are packed by zstd, which takes half the disk.
    """
    seen, packed = Observation(), {"mode": "overwrite", "compression": "zstd"}
    parsed.observe(seen, *[n.alias(t) for t, n in xml.row_counts(parsed).items()]).write.parquet(f"{path}/leidos", **packed)
    counts = {t: int(n) for t, n in seen.get.items()}
    for name, table in xml.report_bundle(parsed.sparkSession.read.schema(parsed.schema).parquet(f"{path}/leidos")).items():
        if name in ALWAYS or counts[name]:
            table.write.parquet(f"{path}/{name}", **packed)
    return counts


def write_by_period(table: DataFrame, path: str) -> None:
    """Documents with their path columns, in folders by origin, status, type, year and month."""
    there = [c for c in PARTITIONS if c in table.columns]
    table.hint("rebalance", *there).write.mode("append").partitionBy(*there).parquet(path)


def read_reports(spark: SparkSession, paths: list[str], folders: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Earlier reports as one, in one scan: columns in the order in which they first appear, missing text empty.

    Spark merges the schemas of all files, whatever the number of reports. ``folders`` names the columns that are in the names of
    folders; they come last, as text, null for a report without them. A filter on them leaves out the files of other folders.
    """
    merged = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*paths)
    at = {c: F.nullif(F.regexp_extract("_metadata.file_path", f"/{c}=([^/]*)/", 1), F.lit("")) for c in folders}
    found = merged.select("*", *[F.nullif(v, F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c) for c, v in at.items()])
    return found.na.fill("", [c for c in merged.columns])


def find_reports(reports: DataFrame, **wanted: str | int | None) -> DataFrame:
    """Reports by any of their partition columns; None matches all. Spark prunes the folders."""
    for name, value in wanted.items():
        if value is not None:
            reports = reports.filter(F.col(name) == value)
    return reports


def best_match(reports: DataFrame, by: str, origin: str, status: str, origin_col: str = "origin", status_col: str = "estado") -> DataFrame:
    """For each ``by``, the rows of the most specific place that has any: origin and status, else origin, else all."""
    hit = F.when((F.col(origin_col) == origin) & (F.col(status_col) == status), 1).when(F.col(origin_col) == origin, 2).otherwise(3)
    ranked = reports.withColumn("nivel", hit)
    best = ranked.groupBy(by).agg(F.min("nivel").alias("_best"))  # combined before it is exchanged; a large ``by`` can be split
    return ranked.join(best, by).filter("nivel <= _best").drop("_best").select(*ranked.columns)


def report_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """What the names of report files say: origin, format, type and period; files in a folder of consolidated ones go.

    Names are ``<origin>_reporte_<format>_<type>_<period>`` or ``reporte_<type>_<year>_<month>``, which is of received XML; a
    copy has a number behind the period. Other files aren't reports.
    """
    main = r"(recibidos|emitidos)_reporte_(xml|pdf)_(.+?)_(\d{6,8})"
    old = r"reporte_(.+?)_(\d{4})_(\d{2})"
    name = rf"(?i)^(?:.*/)?(?:{main}|{old})(?:_\d+)?\.[a-z]+$"
    folder = F.transform(F.split(path, "/"), lambda x: F.lower(fold(x)))

    def once(c: Column) -> Column:
        """The same value, which later steps don't evaluate again."""
        return F.explode(F.array(c))

    mark = "\x01"
    parts = F.split(F.lower(F.regexp_replace(path, name, mark.join(f"${i}" for i in range(1, 8)))), mark)
    there = paths.filter(~F.array_contains(folder, "consolidados") & F.col(path).rlike(name)).withColumn("_parts", once(parts))

    def part(i: int) -> Column:
        return F.nullif(F.get("_parts", F.lit(i)), F.lit(""))

    token = F.coalesce(part(3), F.concat(part(5), part(6)))
    dated = there.withColumn("_when", once(dates.period(token)))
    return dated.select(
        *paths.columns, F.coalesce(part(0), F.lit("recibidos")).alias("origen"), F.coalesce(part(1), F.lit("xml")).alias("formato"), F.coalesce(part(2), part(4)).alias("tipo_slug"),
        F.col("_when.year").alias("anio"), F.col("_when.month").alias("mes"), F.col("_when.day").alias("dia"),
    ).filter("anio is not null")


def typed_beside_text(df: DataFrame, numbers: list[str], times: list[str]) -> DataFrame:
    """Amounts and times as values, each with its text beside it (``_texto``), so that what doesn't convert isn't lost."""
    typed = {c: amounts.decimal(F.col(c), "decimal(18,2)").cast("double") for c in numbers} | {c: dates.timestamp(F.col(c)) for c in times}
    return df.select(*[x for c in df.columns for x in ([typed[c].alias(c), F.col(c).alias(f"{c}_texto")] if c in typed else [F.col(c)])])


# The columns of the listing of issued documents.
ISSUED_LISTING = ["COMPROBANTE", "SERIE_COMPROBANTE", "CLAVE_ACCESO", "FECHA_AUTORIZACION", "FECHA_EMISION", "VALOR_SIN_IMPUESTOS", "IVA", "IMPORTE_TOTAL"]


def issued_listing(rows: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The listing of issued documents: its columns in order, missing ones empty, amounts and times typed beside their text."""
    there = {c.upper(): c for c in rows.columns}
    whole = rows.select(*keep, *[(F.coalesce(F.col(there[c]).cast("string"), F.lit("")) if c in there else F.lit("")).alias(c) for c in ISSUED_LISTING])
    return typed_beside_text(whole, ["VALOR_SIN_IMPUESTOS", "IVA", "IMPORTE_TOTAL"], ["FECHA_AUTORIZACION"])


def title(name: str) -> str:
    """A column's title: from the dictionary, from the patterns of pivoted columns, else its words in title case."""
    key = name.upper()
    if key in TITLES:
        return TITLES[key]
    if m := re.fullmatch(rf"({'|'.join(PAYMENT_PARTS)})_(\d+)", key):
        return f"{PAYMENT_PARTS[m[1]]} {m[2]}"
    if m := re.fullmatch(rf"({'|'.join(TAX_NAMES)})(?:_(\d{{1,3}}))?_({'|'.join(TAX_PARTS)})", key):
        return f"{TAX_NAMES[m[1]]}{f' {m[2]}%' if m[2] else ''} {TAX_PARTS[m[3]]}"
    if m := re.fullmatch(r"IMP_(\w+?)_(\w+)_(BASE|VALOR)", key):
        return f"Impuesto codigo {m[1]} porcentaje {m[2]} {TAX_PARTS[m[3]]}"
    return name.replace("_", " ").strip().capitalize()


def titled(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: title(c) for c in df.columns})


def period(year: int, month: int | None = None, day: int | None = None, last_month: int | None = None) -> tuple[datetime.date, datetime.date]:
    """First and last day of a year, a month, a range of months, or a day."""
    if month is None:
        return datetime.date(year, 1, 1), datetime.date(year, 12, 31)
    if day:
        return datetime.date(year, month, day), datetime.date(year, month, day)
    end = last_month or month
    return datetime.date(year, month, 1), datetime.date(year, end, monthrange(year, end)[1])


def period_name(year: int, month: int | None = None, day: int | None = None, last_month: int | None = None) -> str:
    """yyyy, yyyyMM, yyyyMMdd, or yyyyMM-MM for a range of months, which no reader takes for a day."""
    if month is None:
        return f"{year}"
    if day:
        return f"{year}{month:02d}{day:02d}"
    return f"{year}{month:02d}" + (f"-{last_month:02d}" if last_month and last_month != month else "")


def period_label(year: Column, month: Column, day: Column, last_month: Column) -> Column:
    """:func:`period_name` of columns; null stands for a part that isn't there."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    to = F.when(day.isNull() & (last_month != month), F.concat(F.lit("-"), two(last_month)))
    return F.concat(year.cast("string"), F.coalesce(two(month), F.lit("")), F.coalesce(two(day), F.lit("")), F.coalesce(to, F.lit("")))
