import __spark_entry__
from tidemark import catalog


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["tx_id", "factors", "risk_score", "risk_level", "action", "sar_required", "action_required"]
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
