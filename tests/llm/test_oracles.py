"""Every query of the subpackage: against its SQL where there is one, else that it gives a row for each input row."""

import oracle
import pytest

from fieldecho.llm import queries

DIR = "/root/testdata/sf0.001"
ROWS = {"op1_quality_rules": 200, "op3_secret_scan": 200, "op4_page_text": 50, "op5_simhash": 200, "op6_kd_shards": 200, "op8_line_dedup": 200, "op10_language_id": 200}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    assert not oracle.compare(queries.QUERIES[name](spark, DIR), oracle.connect(DIR), queries.ORACLES[name])


@pytest.mark.parametrize("name", list(ROWS))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() == ROWS[name]
