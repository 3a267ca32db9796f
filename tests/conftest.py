import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lodestone.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def catalog(spark):
    from lodestone.sources.catalog import CATALOG_SCHEMA

    colors = ["black", "white", "blue", "red", "green", "yellow"]
    materials = ["leather", "cotton", "nylon", "wool", "silk", "polyester"]
    prices = ["10", "20", "30", "40", "60", "120"]
    rows = [
        (f"P{i}", f"{c} {m} running Shoes", [m, "comfortable everyday feature"], [f"A {c} option"], p,
         ["Clothing, Shoes & Jewelry", "Women", "Shoes"], {"Department": "womens", "Color": c}, 4.2, 100, "Example")
        for i, (c, m, p) in enumerate(zip(colors, materials, prices))]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)
