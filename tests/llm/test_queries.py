"""The text queries against their SQL on the small tables, and the packing of the whole documents table."""

import pytest

from tests.oracle import DATA, compare, connect
from tidemill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    compare(spark, connect(), queries.QUERIES[name], queries.ORACLES[name])


def test_packing_holds_everything(spark):
    packed = queries.p7_packing(spark, str(DATA)).toPandas()
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for _, part in packed.groupby("window_name"):
        assert part.doc_id.nunique() == documents
        held = part[part.container_no.notna()]
        assert (held.groupby("container_no").n_tokens.sum() <= held.capacity_tokens.iloc[0]).all()


def test_leaks_cover_found(spark):
    assert queries.p8_found(spark, str(DATA)).count() <= queries.p8_leaks(spark, str(DATA)).count()


def test_nothing_else_imports_llm():
    from pathlib import Path

    package = Path(queries.__file__).parents[1]
    assert not [p for p in package.rglob("*.py") if p.parent.name != "llm" and "tidemill.llm" in p.read_text()]
