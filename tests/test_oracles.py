"""Every registered query against its SQL on the smallest tables."""

import pytest

from fieldmarch import plans
from tests.oracle import compare


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, sf, name):
    result = compare(spark, sf, name, plans.QUERIES[name], plans.ORACLES.get(name))
    assert result["ok"], result["why"]
