import pytest

from shiftwright.llm.common import small_batches


@pytest.fixture(autouse=True)
def batches(spark):
    small_batches(spark)
