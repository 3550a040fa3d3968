import pytest
from cases import no_documents, odd_documents


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark).coalesce(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return no_documents(spark)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
