"""Completeness merged over levels and resume points, against plain Python."""

import datetime
import random

from taxloom.operators import progress

D = datetime.date


def test_completeness(spark):
    draw = random.Random(5)
    rows = lambda n: [(draw.choice("ab"), draw.randrange(3), f"k{draw.randrange(12)}", draw.choice(["XML", "PDF"])) for _ in range(n)]
    expected, obtained = rows(60), rows(50)
    frame = lambda r: spark.createDataFrame(r, "mes string, dia int, k string, f string").repartition(3)
    counts, missing = progress.merged_completeness(frame(expected), frame(obtained), ["mes", "dia"], ["k", "f"], "f", ["XML", "PDF"])
    e, o = set(expected), set(obtained)
    got = {(r.nivel, r.mes, r.dia): r for r in counts.collect()}
    assert set(got) == {(0, m, d) for m, d, _, _ in e | o} | {(1, m, None) for m, _, _, _ in e | o} | {(2, None, None)}
    lost = set()
    for (level, m, d), r in got.items():
        inside = lambda x: (m is None or x[0] == m) and (d is None or x[1] == d)  # noqa: E731, B023
        for f in ("XML", "PDF"):
            wanted, there = [x for x in e if inside(x) and x[3] == f], [x for x in o if inside(x) and x[3] == f]
            ids = {x[2] for x in wanted} - {x[2] for x in there}
            lost |= {(level, m, d, k, f) for k in ids}
            name = f.lower()
            assert (r[f"esperados_{name}"], r[f"obtenidos_{name}"], r[f"faltantes_{name}"], r[f"ids_faltantes_{name}"]) == (len(wanted), len(there), max(0, len(wanted) - len(there)), len(ids))
        assert r.completa == (r.faltantes_xml == 0 and r.faltantes_pdf == 0)
    assert set(map(tuple, missing.collect())) == lost and missing.count() == len(lost)
    none = frame([])
    assert [c.collect() for c in progress.merged_completeness(none, none, ["mes", "dia"], ["k", "f"], "f", ["XML", "PDF"])] == [[], []]


def test_resume(spark):
    at = lambda h: datetime.datetime(2024, 3, 1, h)
    runs = spark.createDataFrame([(i, D(2024, 1, 30), D(2024, 2, 2), "dia") for i in range(1, 6)] + [(6, D(2024, 1, 30), D(2024, 3, 2), "mes")], "run_id int, inicio date, fin date, por string")
    log = [(1, D(2024, 1, 30 + i) if i < 2 else D(2024, 2, i - 1), "completed", at(i), None) for i in range(4)]
    log += [(2, D(2024, 1, 30), "running", at(1), None), (2, D(2024, 1, 30), "completed", at(2), None), (2, D(2024, 1, 31), "failed", at(3), "sin red")]
    log += [(3, D(2024, 1, 30), "failed", at(1), "x"), (3, D(2024, 1, 30), "completed", at(1), None), (3, D(2024, 1, 31), "running", at(4), None)]
    log += [(4, D(2024, 2, 1), "completed", at(1), None), (6, D(2024, 1, 1), "completed", at(1), None)]
    out = progress.resume_points(runs, spark.createDataFrame(log, "run_id int, unidad date, estado string, momento timestamp_ntz, error string"))
    got = {r.run_id: tuple(r)[1:] for r in out.collect()}
    assert got == {
        1: ("completed", 4, 4, None, None, D(2024, 2, 2), None),
        2: ("failed", 4, 1, 1, 31, D(2024, 1, 30), "sin red"),
        3: ("running", 4, 1, 1, 31, D(2024, 1, 30), None),
        4: ("running", 4, 1, 1, 30, D(2024, 2, 1), None),
        5: ("pending", 4, 0, 1, 30, None, None),
        6: ("running", 3, 1, 2, 0, D(2024, 1, 1), None),
    }
