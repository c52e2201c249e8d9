import pytest

from tandemetry.plans import catalog, extras, motion  # noqa: F401  the others add to the queries of the catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(name, same_as_oracle):
    same_as_oracle(catalog.QUERIES[name], catalog.ORACLES[name])
