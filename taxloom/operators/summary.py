"""Per-document aggregates and the summary that joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom import catalogs as K


def tax_totals(taxes: DataFrame, key: str = "orderkey") -> DataFrame:
    """Base and value by document, tax code and rate code."""
    return taxes.groupBy(key, "codigo", "pct").agg(F.sum("base").alias("base"), F.sum("valor").alias("valor"))


def tax_pivot(taxes: DataFrame, slugs: list[str], key: str = "orderkey") -> DataFrame:
    """A column pair for each slug. The columns are given, so no pass over the data looks for them."""
    named = taxes.withColumn("slug", K.tax_slug(F.col("codigo"), F.col("pct")))
    parts = [f(F.when(F.col("slug") == s, F.col(c))).cast("double").alias(f"{s}_{n}") for s in slugs for f, c, n in ((F.sum, "base", "BASE"), (F.sum, "valor", "VALOR"))]
    return named.groupBy(key).agg(*parts)


def _among(value: str, rates: list[str]) -> Column:
    return F.coalesce(F.sum(F.when(F.col("pct").isin(rates), F.col(value))), F.lit(0).cast("decimal(38,6)")).cast("double")


def tax_split(taxes: DataFrame, key: str = "orderkey") -> DataFrame:
    """Taxed and untaxed base, VAT, the 12 % part, and the rates in use in catalogue order."""
    document = taxes.filter("nivel = 'DOCUMENTO' and codigo = '2'") if "nivel" in taxes.columns else taxes
    used = [F.when(F.coalesce(F.sum(F.when(F.col("pct") == c, F.col("base"))), F.lit(0).cast("decimal(38,4)")) > 0, K.IVA_TARIFF[c]) for c in K.TAXED_RATES]
    out = document.groupBy(key).agg(
        _among("base", K.TAXED_RATES).alias("base_gravada"),
        _among("base", K.UNTAXED_RATES).alias("base_no_gravada"),
        _among("valor", K.TAXED_RATES).alias("monto_iva"),
        _among("base", ["2"]).alias("base_gravada_12"),
        _among("valor", ["2"]).alias("monto_iva_12"),
        F.concat_ws(", ", *used).alias("rates"),
    )
    return out.withColumn("tarifas_iva", F.when(F.col("rates") != "", F.col("rates")).when(F.col("base_no_gravada") > 0, "0%").otherwise(K.MISSING)).drop("rates")


def first_payment(payments: DataFrame, key: str = "orderkey") -> DataFrame:
    """Form of the first payment, and the total."""
    return payments.groupBy(key).agg(F.min_by("forma_pago", "line_num").alias("forma_pago"), F.sum("base").cast("double").alias("total_pago"))


def joined_texts(lines: DataFrame, text: str = "descripcion", place: str = "line_num", separator: str = " | ", key: str = "orderkey") -> DataFrame:
    """The texts of a document's lines in order, joined. A document's lines are few: a group is one document."""
    ordered = F.array_sort(F.collect_list(F.struct(place, text)))
    return lines.filter(F.trim(text) != "").groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s[text]), separator).alias("descripciones"))


def withheld_slots(withholdings: DataFrame, taxes: dict[str, str], key: str = "orderkey") -> DataFrame:
    """Summary and two details of each withheld tax (``taxes``: code to name), from one aggregation.

    One line is both summary and first detail; more lines are summed up as 'Varios' with rate 0, and the first two are
    details. Without a line of a tax there are zeros and 'No Aplica'; :func:`fill_slots` does that for documents without
    any line.
    """
    row, aggs, out = F.struct("line_num", *[F.col(c).cast("double").alias(c) for c in ("base", "pct", "valor")]), [], []
    for code, name in taxes.items():
        own = F.col("codigo") == code
        aggs += [F.sum(F.when(own, F.col(c))).cast("double").alias(f"{name}_{c}") for c in ("base", "valor")]
        aggs.append(F.array_sort(F.collect_list(F.when(own, row))).alias(f"{name}_rows"))
        n, first = F.size(f"{name}_rows"), F.get(f"{name}_rows", F.lit(0))
        out += [F.when(n == 0, K.NOT_APPLICABLE).when(n > 1, "Varios").otherwise(name).alias(f"{name}_impuesto"), F.when(n == 1, first["pct"]).otherwise(0.0).alias(f"{name}_pct")]
        out += [F.coalesce(f"{name}_{c}", F.lit(0.0)).alias(f"{name}_{c}") for c in ("base", "valor")]
        out += [F.coalesce(F.get(f"{name}_rows", F.lit(i - 1))[c], F.lit(0.0)).alias(f"{name}_{c}_{i}") for i in (1, 2) for c in ("base", "pct", "valor")]
    return withholdings.groupBy(key).agg(*aggs).select(key, *out)


def fill_slots(df: DataFrame, name: str) -> DataFrame:
    """Zeros and 'No Aplica' where a document has no withheld line."""
    return df.na.fill({c: 0.0 for c in df.columns if c.startswith(f"{name}_") and c != f"{name}_impuesto"}).na.fill({f"{name}_impuesto": K.NOT_APPLICABLE})


def payment_columns(numbers: list[int]) -> list[Column]:
    """Form, total, term and unit of the payments with these numbers, as aggregates over ``pago_num``."""
    there = {"FORMA_PAGO": "forma_pago", "PLAZO": "plazo", "UNIDAD_TIEMPO": "unidad_tiempo"}
    out = []
    for n in numbers:
        own = F.col("pago_num") == n
        texts = {name: F.max(F.when(own, F.col(c))).alias(f"{name}_{n}") for name, c in there.items()}
        out += [texts["FORMA_PAGO"], F.sum(F.when(own, F.col("pago"))).cast("double").alias(f"TOTAL_PAGO_{n}"), texts["PLAZO"], texts["UNIDAD_TIEMPO"]]
    return out


def payment_pivot(payments: DataFrame, key: str = "clave") -> DataFrame:
    """Four columns for each payment of a document, up to the largest number that any document has.

    That number is one aggregate over the payments; it is the number of a document's payments, not of documents.
    """
    most = payments.agg(F.max("pago_num")).first()[0] or 0
    return payments.groupBy(key).agg(F.count(F.lit(1)).alias("N_PAGOS"), *payment_columns(list(range(1, most + 1))))
