import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kerbside.session import get_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def accidents(spark):
    from kerbside.catalogue.adapters import accidents
    return accidents(spark, TESTDATA).cache()


# Rows of the published sample, as literals (accident_id, date, time, lat, lon, weather, road, speed,
# vehicles, casualties, light, surface, junction, severity).
SAMPLE = [
    ("ACC001", "2024-01-15", "08:30", 51.5074, -0.1278, "Clear", "Urban", 30, 2, 1, "Daylight", "Dry", "T-junction", "Minor"),
    ("ACC002", "2024-01-15", "17:45", 51.5080, -0.1290, "Rain", "Urban", 30, 3, 2, "Daylight", "Wet", "Crossroads", "Serious"),
    ("ACC003", "2024-01-16", "23:15", 51.4900, -0.1400, "Clear", "Rural", 60, 1, 1, "Dark", "Dry", "Not at junction", "Minor"),
    ("ACC004", "2024-01-17", "07:00", 51.5200, -0.1100, "Fog", "Motorway", 70, 4, 3, "Daylight", "Wet", "Slip road", "Fatal"),
]


@pytest.fixture(scope="session")
def sample(spark):
    from pyspark.sql import functions as F
    names = (
        "accident_id date time latitude longitude weather road_type speed_limit num_vehicles num_casualties "
        "light_conditions road_surface junction_type severity"
    ).split()
    return spark.createDataFrame(SAMPLE, names).withColumns({
        c: F.col(c).cast("int") for c in ("speed_limit", "num_vehicles", "num_casualties")
    })
