import pytest

NB = "row_id long, docno long, cat string, token string, tf int, df long, loaded_at timestamp_ntz"


@pytest.fixture
def nb(spark):
    """Builds an nb table from (row_id, docno, cat, token, tf), with further columns whose names the operators use inside."""

    def make(rows):
        df = spark.createDataFrame([(*r, None, None) for r in rows], NB)
        return df.selectExpr("*", "'x' AS term", "7 AS salt", "'y' AS lone", "1 AS total", "2 AS score", "3 AS n", "4 AS id", "5 AS margin", "6 AS quota")

    return make
