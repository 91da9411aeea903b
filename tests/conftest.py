import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from utterlake.plans.session import session

    made = session("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.sql.ansi.enabled": "true"})
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
