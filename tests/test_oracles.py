import pytest

from heron import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(name, same_as_oracle):
    same_as_oracle(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_rows(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
