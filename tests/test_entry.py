import re

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 11 and df.columns[0] == "table_name"


def test_contract_names():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 30
    for name in q:  # names opN_ belong to the optional subpackage's ten operators
        assert not name.startswith("op") or re.fullmatch(r"op([1-9]|1[0-3])_\w+", name)
