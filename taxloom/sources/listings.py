"""Rows from delimited seed lists, HTML listings, label and value pages, and the run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom import schemas
from taxloom.functions.keys import find_access_key
from taxloom.functions.text import present, strip_html

LISTING = ["fecha", "tipo_serie", "clave", "fecha_autorizacion", "contraparte", "neto", "iva", "total"]


def delimiter(sample: Column) -> Column:
    """Of semicolon, comma and tab the one that occurs most."""
    counts = {c: F.length(sample) - F.length(F.replace(sample, F.lit(c), F.lit(""))) for c in (";", ",", "\t")}
    most = F.greatest(*counts.values())
    return F.when(counts[";"] == most, ";").when(counts[","] == most, ",").otherwise("\t")


SHARES = 64


def seed_keys(rows: DataFrame, line: str = "value", of: str = "path") -> DataFrame:
    """(of, clave, tipo, fecha) of the lines that hold an access key; the delimiter is each file's own.

    A file's lines meet its delimiter in ``SHARES`` shares by their hash, so a large file isn't one task.
    """
    counts = [F.sum(F.length(F.col(line)) - F.length(F.replace(F.col(line), F.lit(c), F.lit("")))).alias(n) for c, n in ((";", "s"), (",", "c"), ("\t", "t"))]
    most = F.greatest("s", "c", "t")
    marks = rows.groupBy(of).agg(*counts).select(of, F.when(F.col("s") == most, ";").when(F.col("c") == most, ",").otherwise("\t").alias("mark"))
    shares = marks.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(line), F.lit(SHARES)).cast("int"))
    cells = dealt.join(shares, [of, "_share"]).drop("_share").withColumn("cells", F.expr(f"split({line}, mark)"))
    key = F.get(F.filter("cells", lambda c: c.rlike(r"^\s*\d{49}\s*$")), 0)
    day = F.get(F.filter("cells", lambda c: c.rlike(r"^\s*\d{2}/\d{2}/\d{4}")), 0)
    kind = F.get(F.filter("cells", lambda c: c.rlike("(?i)factura|nota|retenci|liquidaci")), 0)
    return cells.withColumns({"clave": F.trim(key), "tipo": F.trim(kind), "fecha": F.trim(day)}).filter("clave is not null").select(of, "clave", "tipo", "fecha")


def listing_rows(pages: DataFrame, html: str = "page", of: str = "page_id") -> DataFrame:
    """The rows of a listing's table with at least three cells, as eight text columns."""
    rows = pages.select(of, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), strip_html)
    out = rows.select(of, "row", cells.alias("cells")).filter("size(cells) >= 3")
    return out.select(of, "row", *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(LISTING)]).withColumn("clave", F.coalesce(F.nullif(find_access_key(F.col("clave")), F.lit("")), "clave"))


def label_values(pages: DataFrame, html: str = "page", of: str = "page_id") -> DataFrame:
    """(of, label, value): for each label of a detail page the first value that isn't empty."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(F.col(html), F.lit(r"(?is)<label[^>]*>(.*?)</label>\s*<span[^>]*>(.*?)</span>"), F.lit(1)).alias("label"),
        F.regexp_extract_all(F.col(html), F.lit(r"(?is)<label[^>]*>(.*?)</label>\s*<span[^>]*>(.*?)</span>"), F.lit(2)).alias("value"),
    )
    rows = pages.select(of, F.posexplode(pairs).alias("pos", "x")).select(of, "pos", F.rtrim(strip_html(F.col("x.label")), F.lit(": ")).alias("label"), strip_html(F.col("x.value")).alias("value"))
    return rows.filter("value != ''").groupBy(of, "label").agg(F.min_by("value", "pos").alias("value"))


def history(spark: SparkSession, path: str, as_array: bool = False) -> DataFrame:
    """Run records from JSON, one on a line or (``as_array``) files that are one array; broken ones are dropped."""
    rows = spark.read.schema(schemas.HISTORY + ", _corrupt_record string").option("multiLine", as_array).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.filter(F.col("timestamp").isNotNull()).drop("_corrupt_record")


def append_run(rows: DataFrame, path: str) -> None:
    """Add run records; nothing that was there is rewritten."""
    rows.write.mode("append").json(path)


def words(df: DataFrame, least: float = 20) -> DataFrame:
    """Word boxes: blank words go, and recognised ones of too little confidence."""
    return df.filter(present(F.col("text")).isNotNull() & ((F.col("source") != "ocr") | (F.col("conf") >= least)))
