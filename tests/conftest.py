import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sparkfolio.session import local_session

    s = local_session(8, **{"spark.ui.showConsoleProgress": "false",
                            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from tools.check_results import duck as connect

    return connect(SF)
