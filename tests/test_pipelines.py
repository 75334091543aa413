"""Steps of relation pipelines that no catalogue query covers."""

from datetime import date

import pytest

from millrace.errors import SemanticError
from millrace.operators.pipelines import run_pipeline
from millrace.sources.relations import csv_folder, seed_sql, statements, tables


def test_date_spine(spark):
    spine = lambda **s: [r[0] for r in run_pipeline(spark, None, [{"date_spine": s}]).collect()]
    assert spine(start="2024-02-28", end="2024-03-01") == [date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    assert len(spine(start=date(2020, 1, 1), end="2020-01-03", max_days=3)) == 3
    eleven_years = {"start": "2014-01-01", "end": "2024-12-31"}
    assert len(spine(**eleven_years, max_days=5000)) == 4018
    for bad in (eleven_years, {"start": "2020-01-01", "end": "2020-01-04", "max_days": 3}, {"start": "2020-01-02", "end": "2020-01-01"}, {"start": "soon", "end": "2020-01-01"}):
        with pytest.raises(SemanticError) as e:
            spine(**bad)
        assert e.value.code == "INVALID_CONFIG"


def test_seeds(spark, tmp_path):
    script = "CREATE OR REPLACE TEMP VIEW a_seed AS SELECT 'x;\ny' AS t, \"it's;\" AS u; -- a comment; of two parts\n/* and; another */ CREATE OR REPLACE TEMP VIEW b_seed AS SELECT * FROM `a_seed`;\n;"
    assert len(statements(script)) == 2 and statements("") == [] and statements("SELECT 1") == ["SELECT 1"]
    seed_sql(spark, script)
    assert [tuple(r) for r in tables(spark)("b_seed").collect()] == [("x;\ny", "it's;")]
    (tmp_path / "t.csv").write_text('id,name\n1,"a, b"\n2,\n')
    assert [tuple(r) for r in csv_folder(spark, str(tmp_path), {"t": "id long, name string"})("t").collect()] == [(1, "a, b"), (2, None)]
