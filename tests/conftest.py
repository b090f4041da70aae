"""One session for all tests, and the small worked tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemill.session import build_session, new_scratch, remove_scratch  # noqa: E402
from tidemill.sinks.landing import save_table  # noqa: E402
from tidemill.sources.catalog import Layers  # noqa: E402

TESTDATA = os.environ.get("TIDEMILL_TESTDATA", "/root/testdata/sf0.001")

ANIMALS = [
    (1, "Rougheye rockfish", "Teleostei", 495.0, 205.0),
    (2, "Olm", "Amphibia", 17.0, 102.0),
    (3, "Eastern box turtle", "Reptilia", 372.0, 138.0),
    (4, "Naked mole-rat", "Mammalia", 35.0, 31.0),
    (5, "House mouse", "Mammalia", 20.0, 4.0),
]

SALES = [
    (1, "West", "Widget", 12, 480), (2, "East", "Gadget", 5, 275), (3, "West", "Gadget", 9, 495),
    (4, "South", "Widget", 20, 800), (5, "East", "Widget", 7, 280), (6, "North", "Gizmo", 3, 210),
    (7, "West", "Gizmo", 11, 770), (8, "South", "Gadget", 6, 330),
]


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tidemill-tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def animals(spark):
    return spark.createDataFrame(
        ANIMALS, "animal_no int, species string, class string, body_mass_g double, longevity_yrs double"
    )


@pytest.fixture(scope="session")
def sales(spark):
    return spark.createDataFrame(SALES, "order_id int, region string, product string, units int, revenue int")


@pytest.fixture(scope="session")
def zoo(spark, animals):
    """The layers of a small warehouse: a staging table and one mart."""
    layers = Layers("zoo", new_scratch(spark, "zoo")).create(spark)
    save_table(animals, layers.staging, "stg_animals")
    mart = animals.groupBy("class").agg({"animal_no": "count", "longevity_yrs": "max"}).toDF("class", "a", "b")
    # groupBy().agg() with a dict orders its outputs freely; name them by type.
    names = {"bigint": "n_species", "double": "max_longevity"}
    mart = mart.toDF("class", *[names[t] for _, t in mart.dtypes[1:]])
    save_table(mart.select("class", "n_species", "max_longevity"), layers.marts, "mart_longevity_by_class")
    return layers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, str(type(v)), v) for v in t))


def plan_of(df) -> str:
    """The executed plan as text."""
    return df._jdf.queryExecution().toString()
