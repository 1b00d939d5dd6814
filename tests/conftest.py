import pytest

from glossloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    # Small data and very many different plans: compiling them would take most of the time.
    return local_session(4, **{"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
