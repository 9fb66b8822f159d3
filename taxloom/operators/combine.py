"""Combining reports: fallback union, first-present merge, reconciliation, roll-up, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxloom.functions.text import present


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the given order; rows without a key all stay."""
    blank = present(F.col(key)).isNull()
    ranked = df.filter(~blank).withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.filter("_rank = 1").drop("_rank").unionByName(df.filter(blank))


def with_fallback(main: DataFrame, fallback: DataFrame, key: str, order: str) -> DataFrame:
    """All main rows, and the fallback's first row of each key that no main row has; its rows without a key stay.

    Both sides are read once and meet in one exchange by key: a window gives each row of a key whether the key has a
    main row, and its place among the fallback's rows. Rows without a key are dealt by ``order`` and don't meet.
    """
    rows = main.withColumn("_main", F.lit(True)).unionByName(fallback.withColumn("_main", F.lit(False)))
    known = present(F.col(key))
    alone = F.when(known.isNull(), F.xxhash64(order))
    of_key = Window.partitionBy(known, alone)
    marked = rows.withColumn("_there", F.max("_main").over(of_key)).withColumn("_place", F.row_number().over(of_key.orderBy(F.desc("_main"), order)))
    return marked.filter(F.col("_main") | known.isNull() | (~F.col("_there") & (F.col("_place") == 1))).drop("_main", "_there", "_place")


def merged(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """For each key the first present value of each column, in the order of the sources. Keys are unique in a source."""
    out = sources[0].select(key, *[F.col(c).alias(f"{c}_0") for c in columns])
    for i, df in enumerate(sources[1:], 1):
        out = out.join(df.select(key, *[F.col(c).alias(f"{c}_{i}") for c in columns]), key, "full")
    return out.select(key, *[F.coalesce(*[present(F.col(f"{c}_{i}")) for i in range(len(sources))]).alias(c) for c in columns])


def union_all(frames: list[DataFrame], missing: str = "") -> DataFrame:
    """Union by name, columns in the order in which they first appear, missing text filled."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.na.fill(missing)


def reconciled(expected: DataFrame, obtained: DataFrame, keys: list[str]) -> DataFrame:
    """Each expected or obtained row with whether it was expected and obtained."""
    left = expected.select(*keys).distinct().withColumn("esperado", F.lit(1))
    right = obtained.select(*keys).distinct().withColumn("obtenido", F.lit(1))
    return left.join(right, keys, "full").na.fill(0, ["esperado", "obtenido"])


def completeness(rows: DataFrame, by: list[str]) -> DataFrame:
    """Expected, obtained and missing by group. Missing rows are those of the set difference, not of the sizes."""
    missing = F.sum(F.when((F.col("esperado") == 1) & (F.col("obtenido") == 0), 1).otherwise(0))
    return rows.groupBy(*by).agg(F.sum("esperado").alias("esperados"), F.sum("obtenido").alias("obtenidos"), missing.alias("faltantes"), (missing == 0).alias("completa"))


def rollup_runs(runs: DataFrame, levels: list[str], counters: list[str]) -> DataFrame:
    """Counters by day, month and range in one pass, with the level's number and a status."""
    total = runs.rollup(*levels).agg(*[F.sum(c).alias(c) for c in counters], F.count(F.lit(1)).alias("n_registros"), F.grouping_id().alias("nivel"))
    return total.withColumn("estado", F.when(sum(F.col(c) for c in counters) == 0, "sin_resultados").otherwise("completado"))


def numbered_names(df: DataFrame, name: str, order: list[str | Column], within: tuple[str, ...] = ()) -> DataFrame:
    """Names made different, among the rows of each ``within``: a repeated one gets _1, _2 and so on, in order."""
    n = F.row_number().over(Window.partitionBy(name, *within).orderBy(*order)) - 1
    return df.withColumn("nombre_unico", F.when(n == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string"))))


def entitled(requests: DataFrame, licences: DataFrame, devices: DataFrame, at: Column) -> DataFrame:
    """For each request (request_id, user_id, fingerprint) the licence that allows it, and whether that has expired.

    A licence (license_id, user_id, is_active, device_fingerprint, expires_at) of the user counts while it is active, if
    one of its devices (license_id, fingerprint) has the request's fingerprint; only without such a one, if its own
    fingerprint, of the time before devices, is the request's. Of several the smallest counts.

    The best licence is found once for each user and fingerprint, so a request meets one row, however many licences its user has.
    """
    active = licences.filter("is_active")
    licence = F.struct(F.col("via"), "license_id", "expires_at")
    known = active.join(devices, "license_id").withColumn("via", F.lit(1)).select("user_id", "fingerprint", licence.alias("l"))
    legacy = active.withColumn("via", F.lit(2)).select("user_id", F.col("device_fingerprint").alias("fingerprint"), licence.alias("l"))
    best = known.unionByName(legacy).filter("user_id is not null and fingerprint is not null").groupBy("user_id", "fingerprint").agg(F.min("l").alias("l"))
    met = requests.join(best, ["user_id", "fingerprint"], "left")
    found = met.withColumn("b", F.when(F.col("request_id").isNotNull(), F.min("l").over(Window.partitionBy("request_id"))))
    state = F.when(F.col("b").isNull(), "no encontrada").when(F.col("b.expires_at") < at, "expirada").otherwise("valida")
    return found.select("request_id", F.col("b.license_id").alias("license_id"), F.when(F.col("b.via") == 1, "equipo").when(F.col("b.via") == 2, "licencia").alias("via"), state.alias("estado"))


def conform(df: DataFrame, schema: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Exactly the schema's columns in order: missing ones are added, values that don't convert become the default."""
    defaults = defaults or {}
    there = {c.lower(): c for c in df.columns}

    def column(name: str, kind: str) -> Column:
        default = F.lit(defaults.get(name)).cast(kind)
        return F.coalesce(F.col(f"`{there[name.lower()]}`").try_cast(kind), default) if name.lower() in there else default

    return df.select(*[column(n, k).alias(n) for n, k in schema.items()])
