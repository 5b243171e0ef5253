import pytest

from meshwright.session import local_session


@pytest.fixture(scope="session")
def spark():
    """A session for many tiny jobs: nothing to re-plan, nothing worth compiling."""
    session = local_session(4, "tests", 2)
    for key, value in {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false"}.items():
        session.conf.set(key, value)
    return session
