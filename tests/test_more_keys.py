"""Queries on event keys and values that the test data doesn't hold."""

import duckdb
import pandas as pd

from courtflow.plans.registry import ORACLE_SQL, QUERIES
from tests.test_queries import rows


def both(spark, tmp_path, name, ids, value):
    """What a query and its SQL give for events of these ids and one value."""
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(range(len(ids)), unit="s")
    events = pd.DataFrame({"event_id": ids, "ts": at.as_unit("us"), "user_id": [i % 7 for i in ids], "event_type": "click", "value": value, "props": "{}"})
    events.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    return rows(QUERIES[name](spark, str(tmp_path)).toPandas()), rows(con.execute(ORACLE_SQL[name]).df())


def test_a_wrist_in_the_middle_of_the_shoulders_is_a_forehand_of_either_hand(spark, tmp_path):
    ids = [e for e in range(3, 9000, 4) if e * 37 % 200 == 95 and e % 11 and e % 7 and e % 97]
    found, sql = both(spark, tmp_path, "swing_classes", ids, 0.0)
    assert len(sql) > 10 and found == sql
