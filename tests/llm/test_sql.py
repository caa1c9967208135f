import pytest
from oracle_compare import same

from fieldweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(name, spark, data):
    same(queries.queries()[name], queries.oracle_sql()[name], spark, data)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_covers_the_table(name, spark, data):
    df = queries.queries()[name](spark, data)
    if name in ("op10_decontamination", "quality_ablations"):
        assert df.count() > 0
    elif name == "op4_substring_dedup":
        assert df.where("removed").count() > 0
    else:
        ids = spark.read.parquet(f"{data}/documents.parquet").select("doc_id")
        assert df.select("doc_id").distinct().count() == ids.distinct().count()
