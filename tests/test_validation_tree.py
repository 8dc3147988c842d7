"""The hash tree over two runs names what differs."""

from __future__ import annotations

from tandemtape.operators import identity


def test_planted_changes_are_named(spark):
    rows = [(i * 37, f"v{i}") for i in range(400)] + [(None, "n"), (-5, "m"), (1 << 40, "far")]
    changed = [(k, v) for k, v in rows if k != 37] + [(74, "v2"), (9, "new")]
    changed = [(k, "other" if k == 370 else v) for k, v in changed if k is not None]
    schema = "k long, v string"
    first, second = spark.createDataFrame(rows, schema), spark.createDataFrame(changed, schema)
    got = {r.k: (r.first_rows, r.second_rows) for r in identity.run_differences(first, second, "k", (12, 4, 0)).collect()}
    assert got == {37: (1, 0), 74: (1, 2), 9: (0, 1), 370: (1, 1), None: (1, 0)}
    assert identity.run_differences(first, first.repartition(3), "k").collect() == []
    empty = spark.createDataFrame([], schema)
    assert identity.run_differences(empty, empty, "k").collect() == []


def test_run_differences_name_a_row_both_lost_and_repeated(spark, tmp_path):
    """The key 688847 is lost by one rule and repeated by the other, so both runs hold it once."""
    import duckdb

    from tandemtape.plans.registry import ORACLES, QUERIES
    import tandemtape.plans  # noqa: F401

    rows = [(k, 10 * k, "O") for k in (3, 5, 7, 100, 1014, 1020, 688847)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["run_differences"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        want = con.sql(ORACLES["run_differences"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and (688847, 1, 1) in want
