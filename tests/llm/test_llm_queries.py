"""Every training-data query on the smallest tables, against its SQL where there is one."""

import pytest

from quillmill.llm.catalog import oracle_sql, queries
from quillmill.session import ship
from tests.compare import connect, spark_rows, sql_rows

SQL = oracle_sql()
COLUMNS = {
    "p1_found": {"section", "task_no"}, "p2_found": {"task_no_a", "task_no_b"}, "p3_found": {"row_table", "row_no"}, "p4_found": {"row_table", "row_no", "defect"},
    "p5_found": {"task_no", "group_no"}, "p6_found": {"task_no", "group_no"}, "p8_found": {"doc_id", "item_id"}, "p9_found": {"doc_id"},
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, data, name):
    ship(spark)
    df = queries()[name](spark, f"{data}/sf0.001")
    cols, rows = spark_rows(df)
    if name in COLUMNS:
        assert set(cols) == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in SQL:
        assert (cols, rows) == sql_rows(connect(f"{data}/sf0.001"), SQL[name])
