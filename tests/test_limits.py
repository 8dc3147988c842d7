"""Inputs at the edge of what is stored: wide numbers, fine times, other model depths, missing settings."""

from __future__ import annotations

import datetime as dt
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemtape import session
from tandemtape.functions import payload
from tandemtape.operators import econometrics, parsing, validation

RECORD = '{"type":"match","trade_id":5,"sequence":9,"time":"%s","product_id":"BTC-USD","side":"sell","size":"%s","price":"%s"}'


def classified(spark, *records):
    rows = [(i, "coinbase", "text", RECORD % r) for i, r in enumerate(records)]
    return parsing.classify(spark.createDataFrame(rows, "record_index long, venue string, frame_type string, raw_frame string"))


def test_times_of_any_precision_and_zone(spark):
    good = {
        "2026-07-30T21:00:00.123456789Z": dt.datetime(2026, 7, 30, 21, 0, 0, 123456), "2026-07-30T21:00:00.9999999+00": dt.datetime(2026, 7, 30, 21, 0, 0, 999999),
        "2026-07-30 21:00:00+0230": dt.datetime(2026, 7, 30, 18, 30), "2026-07-30T21:00:00-01": dt.datetime(2026, 7, 30, 22, 0), "2026-07-30T21:00Z": dt.datetime(2026, 7, 30, 21, 0),
    }
    got = spark.createDataFrame([(k,) for k in good], "t string").select("t", F.date_format(payload.instant(F.col("t")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).collect()
    assert {r.t: dt.datetime.strptime(r.at, "%Y-%m-%d %H:%M:%S.%f") for r in got} == good
    kinds = classified(spark, *[(t, "1", "2") for t in [*good, "2026-07-30T21:00:00", "2026-07-30T21:00:00.Z", "soon"]]).orderBy("record_index").collect()
    assert [r.result_kind for r in kinds] == ["trade"] * len(good) + ["invalid"] * 3


def test_unfit_numbers_are_no_parse_errors(spark):
    wide = classified(spark, ("2026-07-30T21:00:00Z", "1", "123456789012345678901.5"), ("2026-07-30T21:00:00Z", "1e-19", "2"), ("2026-07-30T21:00:00Z", "0.0", "2"), ("2026-07-30T21:00:00Z", "1", "-1e-30"))
    assert [r.result_kind for r in wide.orderBy("record_index").collect()] == ["trade", "trade", "invalid", "invalid"]


def test_absent_required_column_is_missing_everywhere(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "")], "k long, a string")
    got = {r.k: r.missing for r in validation.missing_fields(rows, ["k"], ["a", "b"]).collect()}
    assert got == {1: ["b"], 2: ["a", "b"]}


@pytest.mark.parametrize(("adf_lag", "var_lag"), [(4, 2), (8, 16), (20, 10)])
def test_models_of_other_depths(spark, adf_lag, var_lag):
    rng = np.random.default_rng(4)
    y = np.zeros((500, 2))
    for t in range(1, 500):
        y[t] = 0.3 * y[t - 1] + 0.2 * y[t - 1, ::-1] + rng.normal(size=2)
    rows = [("a", "baseline", i, 500, float(p), float(q)) for i, (p, q) in enumerate(y)]
    df = spark.createDataFrame(rows, "attempt_id string, configuration_id string, pos long, n long, y1 double, y2 double")
    got = econometrics.return_models(df, econometrics.ModelConfig(adf_max_lag=adf_lag, var_max_lag=var_lag)).collect()[0]

    def fitted(p, start):
        x = np.column_stack([np.ones(500 - start)] + [y[start - k : 500 - k, i] for k in range(1, p + 1) for i in (0, 1)])
        b = np.linalg.lstsq(x, y[start:], rcond=None)[0]
        return b, y[start:] - x @ b

    scores = []
    for p in range(var_lag + 1):
        _, e = fitted(p, var_lag)
        scores.append(math.log(np.linalg.det(e.T @ e / len(e))) + math.log(len(e)) / len(e) * (4 * p + 2))
    best = max(int(np.argmin(scores)), 1)
    assert got.lag == best and np.allclose(np.array(got.coefficients).reshape(-1, 2), fitted(best, best)[0], rtol=1e-7, atol=1e-10)
    assert all(a.status == "COMPUTED" and a.lags <= adf_lag for a in got.adf)


def test_a_cluster_must_name_its_shared_folder():
    made = []

    def spark(master, named):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: named))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(spark("spark://host:7077", None))
    assert not made and session.shared_folder(spark("yarn", "hdfs://x/y")) == "hdfs://x/y"


def test_unknown_archive_facts_fail_closed(spark):
    from tandemtape.operators import quality

    ids = {"INTEGRITY_ARCHIVE_VALIDATION_FAILED", "INTEGRITY_WRITER_FAILURES", "INTEGRITY_RAW_RECORD_SHORTFALL"}
    policy = quality.QualityPolicy()
    rules = [r for r in quality._rules(policy) if r[0] in ids]
    rows = spark.createDataFrame([(1, None, None, 5, None), (2, True, 0, 5, 5), (3, False, 2, 5, 6)], "k int, archive_valid boolean, writer_failures int, frames int, manifest_records int")
    got = rows.select("k", *[r[6].alias(r[0]) for r in rules]).orderBy("k").collect()
    assert len(rules) == 3 and [[r[i] for i in sorted(ids)] for r in got] == [[True] * 3, [False] * 3, [True] * 3]
