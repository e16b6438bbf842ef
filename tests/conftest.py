import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from attestra.session import local_session, workers_import

    s = local_session(4, "tests", spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    workers_import(s)
    yield s
    s.stop()
