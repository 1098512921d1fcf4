import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folium.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=8, memory="8g", shuffle=8)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("stored")))
    return session
