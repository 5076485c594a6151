"""Core numbers where the SQL's 30 rounds of h-indices are too few."""

import duckdb

from graphloom import catalog


def test_a_long_chain_has_cores_of_one_though_thirty_rounds_of_the_sql_say_two(spark, tmp_path):
    spark.range(0, 200, 1, 1).selectExpr("id AS event_id", "id AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    found = {r["node_id"]: r["core"] for r in catalog.QUERIES["core_numbers"](spark, str(tmp_path)).collect()}
    assert found == dict.fromkeys(range(200), 1)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql = dict(db.execute(catalog.ORACLES["core_numbers"]).fetchall())
    assert all(sql[i] >= c for i, c in found.items()) and {sql[0], sql[100]} == {1, 2}
