import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tallyframe.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

ITEMS = ("DataSet bigint, IDLevel string, PreyClass string, PreyOrder string, PreyScientificName string, "
         "CountInt bigint, PreyMass double")


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", 4)


@pytest.fixture(scope="session")
def make_items(spark):
    """Items from (diet, name, count[, mass[, level[, class[, order]]]]) tuples."""
    def make(rows, partitions=1):
        full = []
        for row in rows:
            diet, name, count, mass, level, cls, order = (*row, *(None, "Species", "Mammalia", "O1")[len(row) - 3:])
            full.append((diet, level, cls, order, name, count, mass))
        return spark.createDataFrame(full, ITEMS).repartition(partitions)
    return make


def by_key(df, key="DataSet"):
    """{key: row} of a small result."""
    return {row[key]: row for row in df.collect()}
