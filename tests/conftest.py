import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from packetloom.session import local_session, ship

    session = local_session()
    session.sparkContext.setLogLevel("OFF")
    # tiny inputs: compiling generated code costs more than running it
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    ship(session)
    yield session
    session.stop()
