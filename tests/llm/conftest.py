import pytest


@pytest.fixture(scope="session")
def forest(spark):
    from pairlens.llm import secrets

    return secrets.train_forest(secrets.example_findings(spark))
