import pytest

from dimloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def rows(df, *order):
    """The rows as sorted tuples."""
    out = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(out, key=lambda r: tuple((v is not None, str(v)) for v in r))
