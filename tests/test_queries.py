import pytest

from peakloom.plans import derived, detection, invariants, round_trips, serve  # noqa: F401  (they register their queries)
from peakloom.plans.queries import ORACLES, QUERIES

from .helpers import of, oracle


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    got = of(QUERIES[name](spark, sf))
    if name in ORACLES:
        want = oracle(ORACLES[name], sf)
        assert got[0] == want[0]
        assert got[1] == want[1]
    else:
        assert got[1]


@pytest.mark.parametrize("name", ["serve_programs_of_term", "serve_archetypes_of_term", "serve_gene_frequency"])
def test_look_ups_of_a_term_that_occurs(sf, name):
    """An empty result on both sides would prove nothing, at any size."""
    for size in (sf, sf.replace("0.001", "0.01"), sf.replace("0.001", "0.1")):
        assert oracle(ORACLES[name], size)[1]
