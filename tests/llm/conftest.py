from __future__ import annotations

import pytest

from samples import EDGES, FOLDER, documents


@pytest.fixture(scope="session")
def edges(spark):
    return documents(spark, EDGES).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
