import pytest


@pytest.fixture(scope="session")
def spark():
    from sheaf.session import session

    return session("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
