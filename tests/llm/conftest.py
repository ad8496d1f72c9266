import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    """The session with the package on the executors."""
    from marketlake.llm.storage import ship_package

    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def documents(llm):
    return llm.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
