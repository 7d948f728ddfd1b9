import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from noticiario.session import local_session

    session = local_session("tests", 4, 4, "4g")
    # tiny tables: compiling each plan takes longer than running it; the driver contract's queries run compiled
    session.conf.set("spark.sql.codegen.wholeStage", os.environ.get("TEST_CODEGEN", "false"))
    yield session
    session.stop()
