"""Documents in folders: an archive by origin, status, type and month, and the folders in which single files arrive."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom import catalogs as K
from taxloom.functions.text import fold, slug
from taxloom.sources import xml

LAYOUT = ["origen", "estado", "tipo", "anio", "mes"]
ARCHIVE = "path string, value string, dia int, origen string, estado string, tipo string, anio int, mes int"
UNKNOWN = "sin_dato"
CONSOLIDATED = "consolidados"


def months(start: datetime.date, end: datetime.date) -> list[tuple[int, int]]:
    """Year and month of every month that a period touches."""
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    return [(n // 12, n % 12 + 1) for n in range(first, last + 1)]


def _any_of(values: Iterable[str]) -> str:
    found = sorted(set(values))
    return found[0] if len(found) == 1 else "{" + ",".join(found) + "}"


def archive_glob(start: datetime.date, end: datetime.date, origin: str | None = None, status: str | None = None, kind: str | None = None) -> str:
    """The archive's folders that a selection needs, as one pattern below its root; other folders aren't even listed."""
    above = "/".join(f"{c}={v or '*'}" for c, v in zip(LAYOUT[:3], (origin, status, kind), strict=True))
    return f"{above}/{_any_of(f'anio={y}/mes={m:02d}' for y, m in months(start, end))}"


def loose_glob(start: datetime.date, end: datetime.date, kind: str | None = None) -> str:
    """The folders of both layouts in which single documents of a period and type are, as one pattern below a root.

    ``<origin>/[<status>/]<type>/<year>/<month name>/XML`` and, from before, ``<year>/<month name>/<day>/<nn>_<type>/XML`` with
    any folders above.
    """
    name = "*" if kind is None else "".join(f"[{c}{c.upper()}]" if c in "bcdfghjklmnpqrstvwxyz" else "?" for c in kind)  # vowels may have marks
    by_month = _any_of(f"{y}/{K.MONTHS[m - 1]}" for y, m in months(start, end))
    new = [f"{above}{name}/{by_month}/XML" for above in ("", "*/", "*/*/")]
    old = [f"{above}{by_month}/*/*{name}/XML" for above in ("", "*/", "*/*/")]
    return "{" + ",".join(new + old) + "}"


def outermost(folders: Iterable[str]) -> list[str]:
    """Folders without repeats and without those inside another, so that no file is read twice."""
    kept: list[str] = []
    for f in sorted({f.rstrip("/") for f in folders}):
        if not any(f.startswith(f"{k}/") for k in kept):
            kept.append(f)
    return kept


def _selected(documents: DataFrame, start: datetime.date, end: datetime.date, wanted: dict[str, str | None]) -> DataFrame:
    """Documents of the days of a period; one whose day isn't known needs its whole month in the period."""
    month = F.make_date("anio", "mes", F.lit(1))
    dated = F.when(F.col("dia").isNotNull(), F.make_date("anio", "mes", "dia").between(start, end)).otherwise((month >= F.lit(start)) & (F.last_day(month) <= F.lit(end)))
    for name, value in wanted.items():
        if value is not None:
            dated &= F.col(name) == value
    return documents.filter(dated)


def _placed(documents: DataFrame) -> DataFrame:
    """Documents with what their path says, in words fit for folder names; consolidated ones go."""
    said = xml.from_path(F.col("path"))
    at = {"origen": slug(said["origen"]), "estado": slug(said["estado_ruta"]), "tipo": slug(said["tipo_ruta"]), "anio": said["anio"], "mes": said["mes"], "dia": said["dia"]}
    words = {c: F.coalesce(F.nullif(v, F.lit("")), F.lit(UNKNOWN)) for c, v in at.items() if c in ("origen", "estado", "tipo")}
    folders = F.transform(F.split("path", "/"), lambda x: F.lower(fold(x)))
    return documents.filter(~F.array_contains(folders, CONSOLIDATED)).withColumns(at | words)


def _dealt(documents: DataFrame, repeated: bool) -> DataFrame:
    """Documents with their folders' columns, dealt to tasks by folder once; of repeated paths one stays.

    A path says its folder, so repeated ones meet where their folder is written, and texts aren't dealt by path before. A folder's paths
    go to one task for every 64 shuffle partitions, so that neither a large month is one task nor a small one many files.
    """
    placed = _placed(documents).withColumns({"anio": F.coalesce("anio", F.lit(0)), "mes": F.lpad(F.coalesce("mes", F.lit(0)).cast("string"), 2, "0")})
    if not repeated:
        return placed.select("path", "value", "dia", *LAYOUT).hint("rebalance", *LAYOUT)
    shares = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 64)
    shared = placed.withColumn("_share", F.pmod(F.xxhash64("path"), F.lit(shares)))
    return shared.repartition(*LAYOUT, "_share").dropDuplicates([*LAYOUT, "_share", "path"]).select("path", "value", "dia", *LAYOUT)


def archive(documents: DataFrame, root: str, repeated: bool = True) -> None:
    """Add documents (path, value) to the archive below ``root``, one folder for each origin, status, type, year and month.

    A path that comes several times is stored once (``repeated=False``: none does, as after :func:`scan_period`, and Spark deals the rows to
    files of even size). Documents of consolidated folders aren't stored; what a path doesn't say is 'sin_dato', or year and month 0.
    A month with very many documents is several files. Documents are dealt once; see :func:`_dealt`.
    """
    _dealt(documents, repeated).write.mode("append").option("compression", "zstd").partitionBy(*LAYOUT).parquet(root)


def archived(spark: SparkSession, root: str, start: datetime.date, end: datetime.date, origin: str | None = None, status: str | None = None, kind: str | None = None) -> DataFrame:
    """The archive's documents of a period, and of an origin, status and type where given; (path, value, dia, and the folders' columns).

    Only the folders that the selection names are listed. A selection without any folder gives no rows.
    """
    try:
        found = spark.read.schema(ARCHIVE).option("basePath", root).parquet(f"{root}/{archive_glob(start, end, origin, status, kind)}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ARCHIVE)
    return _selected(found, start, end, {})


def scan_period(spark: SparkSession, folders: str | list[str], start: datetime.date, end: datetime.date, origin: str | None = None, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Single XML files of a period below some folders, by the folders' names: (path, value, and what the path says).

    A file is read once, however the folders overlap; those of consolidated folders are left out.
    """
    roots = outermost([folders] if isinstance(folders, str) else folders)
    patterns = [f"{r}/{loose_glob(start, end, kind)}" for r in roots]
    frames = []
    for p in patterns:
        try:
            frames.append(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{xml,XML}").text(p, wholetext=True))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not frames:
        return _selected(_placed(spark.createDataFrame([], "path string, value string")), start, end, {})
    files = [f.select(xml.file_path().alias("path"), "value") for f in frames]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return _selected(_placed(out), start, end, {"origen": origin, "estado": status, "tipo": kind})
