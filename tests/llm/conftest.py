import pytest

SMALL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def make(spark):
    """Documents from (id, text) pairs, with columns of clashing names besides."""

    def build(*rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], SMALL)
        if extra:
            for c in ("key", "digest", "row", "shift", "p", "set", "component", "part", "__gone", "lines", "piece", "shard", "b", "n"):
                df = df.withColumn(c, df["doc_id"].cast("string"))
        return df

    return build
