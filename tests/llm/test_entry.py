import __spark_entry__


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert [n for k in range(1, 11) if not any(x.startswith(f"op{k}_") for x in names) for n in [k]] == []
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
