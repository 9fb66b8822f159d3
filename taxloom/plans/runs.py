"""Queries over runs: completeness merged over periods, and where runs go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.operators import progress
from taxloom.plans import bridge
from taxloom.plans.queries import query

LEVELS = ["anio", "mes", "dia"]

_START = f"""WITH {bridge.SQL["header"]},
sides AS (
  SELECT clave, f AS formato, fecha + (CASE WHEN n = 1 THEN 1 ELSE 0 END)::INTEGER AS fecha, 1 AS e, 0 AS o
  FROM header, (VALUES ('XML'), ('PDF')) x(f), (VALUES (0), (1)) y(n) WHERE n = 0 OR orderkey % 6 = 0
  UNION ALL SELECT clave, 'XML', fecha, 0, 1 FROM header WHERE orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT clave, 'PDF', fecha + 1, 0, 1 FROM header WHERE orderkey % 6 = 0),
low AS (SELECT year(fecha)::INTEGER AS anio, month(fecha)::INTEGER AS mes, day(fecha)::INTEGER AS dia, clave, formato, max(e) AS e, max(o) AS o FROM sides GROUP BY ALL),
levels AS (
  SELECT anio, mes, dia, clave, formato, sum(e)::BIGINT AS ne, sum(o)::BIGINT AS no, max(e) AS e, max(o) AS o, grouping(anio) + grouping(mes) + grouping(dia) AS nivel
  FROM low GROUP BY GROUPING SETS ((anio, mes, dia, clave, formato), (anio, mes, clave, formato), (anio, clave, formato), (clave, formato)))"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Expected and obtained files by day: a sixth of the documents is expected again a day later, when its PDF comes."""
    h = bridge.header(spark, d)
    there = bridge.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"))

    def dated(df: DataFrame, day: F.Column) -> DataFrame:
        return df.withColumn("day", day).select(F.year("day").alias("anio"), F.month("day").alias("mes"), F.dayofmonth("day").alias("dia"), "clave", "formato")

    again = h.filter("orderkey % 6 = 0")
    both = lambda df: df.withColumn("formato", F.explode(F.array(F.lit("XML"), F.lit("PDF"))))
    expected = dated(both(h), F.col("fecha")).unionByName(dated(both(again), F.date_add("fecha", 1)))
    obtained = dated(h.join(there, "orderkey", "left_semi").withColumn("formato", F.lit("XML")), F.col("fecha")).unionByName(dated(again.withColumn("formato", F.lit("PDF")), F.date_add("fecha", 1)))
    return expected, obtained


def _part(name: str) -> str:
    own = f"formato = '{name.upper()}'"
    return f"""coalesce(sum(ne) FILTER ({own}), 0)::BIGINT AS esperados_{name}, coalesce(sum(no) FILTER ({own}), 0)::BIGINT AS obtenidos_{name},
    greatest(coalesce(sum(ne) FILTER ({own}), 0) - coalesce(sum(no) FILTER ({own}), 0), 0)::BIGINT AS faltantes_{name}, count(*) FILTER ({own} AND e = 1 AND o = 0) AS ids_faltantes_{name}"""


@query("a14_completeness", f"""{_START},
counted AS (SELECT nivel, anio, mes, dia, {_part('xml')}, {_part('pdf')} FROM levels GROUP BY nivel, anio, mes, dia)
SELECT *, faltantes_xml + faltantes_pdf = 0 AS completa, concat_ws(' | ', CASE WHEN esperados_xml > 0 THEN 'XML ' || obtenidos_xml || '/' || esperados_xml END, CASE WHEN esperados_pdf > 0 THEN 'PDF ' || obtenidos_pdf || '/' || esperados_pdf END) AS mensaje FROM counted""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Expected, obtained and missing files of each day, merged to months, years and all."""
    return progress.merged_completeness(*_sides(spark, d), LEVELS, ["clave", "formato"], "formato", ["XML", "PDF"])[0]


@query("a14_missing", f"{_START} SELECT nivel, anio, mes, dia, clave, formato FROM levels WHERE e = 1 AND o = 0")
def missing(spark: SparkSession, d: str) -> DataFrame:
    """The files missing at each level; one that comes on another day is missing on its day only."""
    return progress.merged_completeness(*_sides(spark, d), LEVELS, ["clave", "formato"], "formato", ["XML", "PDF"])[1]


@query("t1_resume_points", """WITH log AS (
  SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN date_trunc('month', ts)::DATE ELSE ts::DATE END AS unidad,
    CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' WHEN 2 THEN 'running' ELSE 'completed' END AS estado, ts AS momento, event_type AS error, event_id FROM events),
states AS (
  SELECT run_id, unidad, arg_max({'estado': estado, 'error': error}, (momento, CASE estado WHEN 'completed' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END)) AS s, max(momento) AS momento FROM log GROUP BY ALL),
units AS (
  SELECT run_id, por, unnest(CASE WHEN por = 'mes' THEN generate_series(DATE '2024-01-01', DATE '2024-01-24', INTERVAL 1 MONTH) ELSE generate_series(DATE '2024-01-03', DATE '2024-01-24', INTERVAL 1 DAY) END)::DATE AS unidad
  FROM (SELECT DISTINCT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 'mes' ELSE 'dia' END AS por FROM events)),
found AS (
  SELECT run_id, por, count(*) AS unidades, count(*) FILTER (s.estado = 'completed') AS completadas, max(u.unidad) FILTER (s.estado = 'completed') AS ultima_completada,
    min(u.unidad) FILTER (s.estado IS DISTINCT FROM 'completed') AS siguiente, count(s.estado) AS empezadas, arg_max(s, (momento, u.unidad)) FILTER (momento IS NOT NULL) AS ultimo
  FROM units u LEFT JOIN states USING (run_id, unidad) GROUP BY run_id, por)
SELECT run_id, CASE WHEN completadas = unidades THEN 'completed' WHEN ultimo.estado = 'failed' THEN 'failed' WHEN empezadas > 0 THEN 'running' ELSE 'pending' END AS estado, unidades, completadas,
  month(siguiente)::INTEGER AS siguiente_mes, CASE WHEN siguiente IS NOT NULL THEN CASE WHEN por = 'mes' THEN 0 ELSE day(siguiente) END END::INTEGER AS siguiente_dia, ultima_completada,
  CASE WHEN completadas < unidades AND ultimo.estado = 'failed' THEN ultimo.error END AS ultimo_error
FROM found""")
def resume_points(spark: SparkSession, d: str) -> DataFrame:
    """Where each run goes on, from the log of its units."""
    e = bridge.table(spark, d, "events")
    by_month, k = F.col("user_id") % 3 == 0, F.col("event_id") % 7
    state = F.when(k == 0, progress.FAILED).when(k.isin(1, 2), progress.RUNNING).otherwise(progress.DONE)
    unit = F.when(by_month, F.trunc("ts", "month")).otherwise(F.to_date("ts"))
    log = e.select(F.col("user_id").alias("run_id"), unit.alias("unidad"), state.alias("estado"), F.col("ts").alias("momento"), F.col("event_type").alias("error"))
    runs = e.select(F.col("user_id").alias("run_id"), F.when(by_month, "mes").otherwise("dia").alias("por")).distinct()
    start, end = F.to_date(F.lit("2024-01-03")), F.to_date(F.lit("2024-01-24"))
    return progress.resume_points(runs.withColumns({"inicio": start, "fin": end}), log)
