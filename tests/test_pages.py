import pytest
from pyspark.sql import functions as F

from quire.operators import pages
from quire.plans.cli import page_numbers


@pytest.mark.parametrize("spec", ["1-3,5", "7", "4-2", "2,2,1-2", "10-12"])
def test_ranges(spark, spec):
    want = page_numbers(spec)
    assert spark.range(1).select(pages.parse_ranges(F.lit(spec)).alias("x")).first().x == want


def test_filters(spark):
    rows = spark.createDataFrame([(1, k) for k in range(8)], "doc_id long, pageno int")
    assert pages.select(rows, None).count() == pages.select(rows, []).count() == 8
    assert sorted(r.pageno for r in pages.select(rows, [5, 2, 2, 99]).collect()) == [2, 5]
    assert pages.preset(rows, "First").count() == 1 and pages.preset(rows, "Others").count() == 8
    assert pages.preset(rows, "First 20 pages", demo=True).count() == 8


def test_enabled_services(spark):
    named = spark.createDataFrame([(0, "Google"), (1, "DeepL"), (2, "OpenAI")], "position int, name string")
    got = pages.enabled_services(spark, named, [" OPENAI "]).orderBy("position").collect()
    assert [r.name for r in got] == ["Google", "Bing", "OpenAI"]
    with pytest.raises(ValueError, match="none"):
        pages.enabled_services(spark, named, ["x"])
