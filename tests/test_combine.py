"""Combining: the licence of each request."""

import datetime

from pyspark.sql import functions as F

from taxloom.operators import combine

LICENCES = "license_id long, user_id int, is_active boolean, device_fingerprint string, expires_at date"


def test_a_request_meets_one_row(spark):
    """One user has all licences and makes all requests; the plan's joins hand on no more rows than there are requests and devices."""
    n, day = 3000, datetime.date(1996, 1, 1)
    licences = spark.createDataFrame([(i, 1, i % 2 == 0, f"f{i % 3}", day) for i in range(n)], LICENCES)
    devices = spark.createDataFrame([(i, "f9") for i in range(0, n, 5)], "license_id long, fingerprint string")
    requests = spark.createDataFrame([(i, 1 if i % 10 else None, f"f{i % 10}") for i in range(n)], "request_id long, user_id int, fingerprint string")
    found = combine.entitled(requests, licences, devices, F.lit("1997-06-01").cast("date"))
    got = {r.request_id: (r.license_id, r.via, r.estado) for r in found.collect()}
    wanted = {0: (0, "licencia", "expirada"), 1: (4, "licencia", "expirada"), 2: (2, "licencia", "expirada"), 9: (0, "equipo", "expirada")}
    assert got == {i: (None, None, "no encontrada") if i % 10 not in (1, 2, 9) else wanted[i % 10] for i in range(n)}
    most, nodes = 0, [found._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())] + ([node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else []) + ([node.plan()] if "QueryStage" in node.nodeName() else [])
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
    assert 0 < most <= n
