from mnemo.cli import answer


def test_shell(engine):
    assert answer(engine, "CREATE TABLE t (id INTEGER, v TEXT);") == "ok, 0 rows"
    assert answer(engine, "INSERT INTO t VALUES (1, NULL);") == "ok, 1 row"
    assert answer(engine, "SELECT * FROM t;").splitlines()[3] == "| 1  | NULL |"
    assert answer(engine, ".tables") == "t" and answer(engine, ".schema t").startswith("CREATE TABLE t (")
    assert answer(engine, "SELEKT").startswith("ParseError") and answer(engine, ".quit") is None
    assert "Scan parquet" in answer(engine, ".explain SELECT id FROM t WHERE id = 1")
