import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture
def raster(spark):
    """Turn rows of numbers (None = no pixel) into a pixel table."""
    def build(rows, name="value", kind="INT"):
        data = [(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]
        return spark.createDataFrame(data, f"row_idx BIGINT, col_idx BIGINT, {name} {kind}")
    return build
