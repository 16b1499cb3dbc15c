"""Every study writes its tables."""

import pytest
from pyspark.sql import functions as F
from spectrafield.plans import catalog, reports

DATA = "/root/testdata/sf0.001"


def test_studies_name_queries():
    assert {q for t in reports.STUDIES.values() for q in t.values()} <= set(catalog.queries())


@pytest.mark.parametrize("study", ["band_correlation", "variograms", "textures", "spectra_correlation"])
def test_written_tables_are_the_queries(spark, tmp_path, study):
    paths = reports.run(spark, study, DATA, str(tmp_path), kind="parquet")
    assert len(paths) == len(reports.STUDIES[study])
    for path, query in zip(paths, reports.STUDIES[study].values(), strict=True):
        assert spark.read.parquet(path).count() == catalog.queries()[query](spark, DATA).count()


def test_dates_and_unknown_study(spark, tmp_path):
    path = reports.run(spark, "band_correlation", DATA, str(tmp_path), ["N"])[0]
    assert [r["date"] for r in spark.read.csv(path, header=True).select("date").distinct().collect()] == ["N"]
    assert spark.read.csv(path, header=True, inferSchema=True).where(F.abs("r") > 1).count() == 0
    with pytest.raises(ValueError):
        reports.run(spark, "none", DATA, str(tmp_path))
