"""Runs over periods: what is complete at each level, and where a run that stopped goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE, FAILED, RUNNING, PENDING = "completed", "failed", "running", "pending"


def merged_completeness(expected: DataFrame, obtained: DataFrame, levels: list[str], keys: list[str], split: str, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Expected and obtained rows merged from the lowest level up to all: (counts, missing).

    Rows are told apart by ``keys`` and belong to a place given by ``levels``, the widest first; ``split`` is the key whose
    values ``parts`` are counted apart. ``counts`` has for each place of each level (``nivel``: 0 the lowest) and each part
    ``esperados_``, ``obtenidos_`` (sums of the lowest level's different rows), ``faltantes_`` (their difference, not below 0),
    ``ids_faltantes_`` (different rows expected at that level and obtained nowhere in it), and ``completa``. ``missing`` has those
    rows themselves, by level.

    A row's repeats within a place are one before anything is exchanged; then every row is brought to all its levels at
    once, by grouping sets. Nothing is collected, and a level's rows are never read again.
    """
    sides = expected.select(*levels, *keys, F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(obtained.select(*levels, *keys, F.lit(0).alias("e"), F.lit(1).alias("o")))
    lowest = sides.groupBy(*levels, *keys).agg(F.max("e").alias("e"), F.max("o").alias("o"))
    sets = [[*levels[:n], *keys] for n in range(len(levels), -1, -1)]
    height = sum((F.grouping(c).cast("int") for c in levels[1:]), F.grouping(levels[0]).cast("int"))
    each = lowest.groupingSets([[F.col(c) for c in s] for s in sets], *levels, *keys).agg(F.sum("e").alias("n_e"), F.sum("o").alias("n_o"), F.max("e").alias("e"), F.max("o").alias("o"), height.alias("nivel"))
    lacking = (F.col("e") == 1) & (F.col("o") == 0)
    out = []
    for p in parts:
        own, name = F.col(split) == p, p.lower()
        wanted, got = (F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)) for c in ("n_e", "n_o"))
        out += [wanted.alias(f"esperados_{name}"), got.alias(f"obtenidos_{name}"), F.greatest(wanted - got, F.lit(0)).alias(f"faltantes_{name}"), F.count(F.when(own & lacking, 1)).alias(f"ids_faltantes_{name}")]
    counts = each.groupBy("nivel", *levels).agg(*out)
    whole = sum((F.col(f"faltantes_{p.lower()}") for p in parts[1:]), F.col(f"faltantes_{parts[0].lower()}")) == 0
    said = [F.when(F.col(f"esperados_{p.lower()}") > 0, F.concat(F.lit(f"{p} "), F.col(f"obtenidos_{p.lower()}").cast("string"), F.lit("/"), F.col(f"esperados_{p.lower()}").cast("string"))) for p in parts]
    counts = counts.withColumns({"completa": whole, "mensaje": F.concat_ws(" | ", *said)})
    return counts, each.filter(lacking).select("nivel", *levels, *keys)


def unit_states(log: DataFrame) -> DataFrame:
    """The last state of each run's unit, from a log (run_id, unidad, estado, momento, error) that is only added to.

    Of states at one moment 'completed' counts before 'failed', and that before 'running'.
    """
    rank = F.when(F.col("estado") == DONE, 3).when(F.col("estado") == FAILED, 2).otherwise(1)
    return log.groupBy("run_id", "unidad").agg(F.max_by(F.struct("estado", "error"), F.struct("momento", rank)).alias("s"), F.max("momento").alias("momento")).select("run_id", "unidad", "s.estado", "s.error", "momento")


def resume_points(runs: DataFrame, log: DataFrame) -> DataFrame:
    """Where each run goes on: its state, completed units, the next month and day, the last completed unit, the last error.

    ``runs`` has run_id, inicio, fin and ``por`` ('dia' or 'mes'): a unit is a day, or a month by its first day. A run is
    completed when all its units are, failed while its latest entry is a failure, running once anything was started, else pending.
    The next unit is the first that isn't completed; a run by months has day 0.
    """
    months = F.sequence(F.trunc("inicio", "month"), F.col("fin"), F.expr("interval 1 month"))
    days = F.sequence(F.col("inicio"), F.col("fin"), F.expr("interval 1 day"))
    planned = runs.withColumn("unidad", F.explode(F.when(F.col("por") == "mes", months).otherwise(days)))
    known = planned.join(unit_states(log), ["run_id", "unidad"], "left")
    done = F.col("estado") == DONE
    latest = F.max_by(F.struct("estado", "error"), F.struct("momento", "unidad"))
    out = known.groupBy("run_id", "por").agg(
        F.count(F.lit(1)).alias("unidades"), F.count(F.when(done, 1)).alias("completadas"), F.max(F.when(done, F.col("unidad"))).alias("ultima_completada"),
        F.min(F.when(~F.coalesce(done, F.lit(False)), F.col("unidad"))).alias("siguiente"), F.count("estado").alias("empezadas"), latest.alias("ultimo"),
    )
    state = F.when(F.col("completadas") == F.col("unidades"), DONE).when(F.col("ultimo.estado") == FAILED, FAILED).when(F.col("empezadas") > 0, RUNNING).otherwise(PENDING)
    day = F.when(F.col("siguiente").isNotNull(), F.when(F.col("por") == "mes", 0).otherwise(F.dayofmonth("siguiente")))
    return out.select("run_id", state.alias("estado"), "unidades", "completadas", F.month("siguiente").alias("siguiente_mes"), day.alias("siguiente_dia"), "ultima_completada", F.when(state == FAILED, F.col("ultimo.error")).alias("ultimo_error"))
