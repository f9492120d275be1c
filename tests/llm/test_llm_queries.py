"""Every registered query of the subpackage on the smallest data."""

import pytest

from tracefold.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": ["first_row_id", "row_id"], "p4_found": ["source_id_a", "source_id_b"], "p5_found": ["name_a", "name_b"],
    "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind", "value"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [str(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
