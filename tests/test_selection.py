from tandemetry.operators import screening
from tandemetry.plans import extras


def test_query_makes_all_shuffles(spark, monkeypatch):
    """A cut of the shuffles to none is seen in the numbers that the operator is given."""
    from conftest import DATA

    told = {}
    monkeypatch.setattr(screening, "selection_cells", lambda rows, taus, hits, permutations=200, *more: told.update(n=permutations) or rows)
    extras.validated_selection(spark, DATA)
    assert told == {"n": 200}
