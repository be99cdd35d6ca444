"""Every registered query against its SQL, at the smallest scale."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from check_oracle import compare, connect
from conftest import SMALL

from starboard.registry import load_all


@pytest.fixture(scope="module")
def outcomes(spark):
    """All comparisons, several at a time: each is short and leaves most cores idle. No plan may have a nested loop."""
    duck = connect(SMALL)

    def outcome(name):
        try:
            return compare(spark, duck.cursor(), name, load_all()[name], SMALL)[0]
        except Exception as error:  # noqa: BLE001 - reported by the query's own test
            return f"ERROR {error}"

    with ThreadPoolExecutor(8) as pool:
        return dict(zip(load_all(), pool.map(outcome, load_all())))


@pytest.mark.parametrize("name", list(load_all()))
def test_agrees_with_sql(outcomes, name):
    text = outcomes[name]
    assert text.startswith(("ok ", "rows only")), text
    assert "TYPES" not in text


def test_entry_file(spark):
    import __spark_entry__ as entry

    top = entry.entry(spark)
    assert "weighted_rating" in top.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(load_all()) <= set(entry.oracle_sql())
