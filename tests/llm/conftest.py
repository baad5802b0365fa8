import pytest

from evalspan.runtime import Workspace, ship


@pytest.fixture
def work(spark, request):
    ship(spark)
    return Workspace(spark, request.node.name.split("[")[0])
