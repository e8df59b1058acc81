import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerflow.session import checkpoint_dir, get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", **{"spark.sql.shuffle.partitions": "8"})
    checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def ds(spark):
    from ledgerflow.sources.views import Dataset
    return Dataset(spark, SF_SMALL)
