import pytest

from logmill.session import local_session

SF = "/root/testdata/sf0.001"
#: 2024-01-01T00:00:00Z
T0 = 1_704_067_200_000_000_000


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


LOGS = "id bigint, ts_ns bigint, level tinyint, service string, message string, labels map<string,string>, data string"


@pytest.fixture(scope="session")
def logs(spark):
    def make(rows, extra=""):
        """Rows of dicts as a log table; extra adds columns that clash with names used inside."""
        df = spark.createDataFrame([tuple(r.get(c) for c in ("id", "ts_ns", "level", "service", "message", "labels", "data")) for r in rows], LOGS)
        from pyspark.sql import functions as F

        return df.select("*", *[F.lit("x").alias(c) for c in extra.split()])

    return make
