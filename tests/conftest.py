import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session, ship

    session = get_session("local[4]", **{"spark.sql.shuffle.partitions": "3", "spark.sql.adaptive.enabled": "false", "spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})  # tiny tables: compiling would take longer than running
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
