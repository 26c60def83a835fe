import pytest

from edge_rows import EDGES


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns with names that operators use."""
    data = [(i, t, "en", "src", len(t or ""), 1, 2, "x") for i, t in EDGES]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, row long, component long, sequence_id string")


@pytest.fixture(scope="session")
def none(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def documents(data_dir):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{data_dir}/documents.parquet' ORDER BY doc_id").fetchall()
