import pytest

from foliolake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()


def rows(df):
    """Rows as tuples in a stable order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
