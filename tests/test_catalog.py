import duckdb
import pytest

import __spark_entry__ as entry
from prismfold.plans import catalog

DIR = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["smooth_sg", "normalize_ch", "markers_roc", "correlation_network", "quality_snr", "coordinate_layout", "matrix_cells", "correlation_pairs_labelled", "forest_summary", "forest_confusion", "scatter_points", "time_series_points", "sample_collection"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("embeddings", "events", "labels", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalog.queries()[name](spark, DIR)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    c = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in c.description]
    want = sorted(map(repr, (tuple(r[names.index(k)] for k in sorted(names)) for r in c.fetchall())))
    assert sorted(names) == sorted(df.columns) and rows == want


def test_the_rest_imports_nothing_of_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parents[1]
    sources = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert sources and not [p for p in sources if re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M)]
