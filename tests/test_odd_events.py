"""Queries against their SQL on small tables of odd events."""

import pytest

from airloom.streaming.machine import UnitMachine

from .test_queries import canonical

FIELDS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR"


@pytest.fixture
def both(spark, tmp_path):
    """A query's and its SQL's rows over a table of (event_id, time, user_id, value, k)."""
    duckdb = pytest.importorskip("duckdb")

    def run(name: str, events: list[tuple]):
        from airloom.plans import catalogue

        c = duckdb.connect()
        c.execute(f"CREATE TABLE events ({FIELDS})")
        rows = [(i, f"2024-01-{at}", user, "view", value, f'{{"k": {k}}}') for i, at, user, value, k in events]
        c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
        c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
        return got, c.execute(catalogue.ORACLE_SQL[name]).df()

    return run


def test_history_keeps_the_sign_of_a_slope_that_rounds_to_zero(both):
    # the third time is 43 seconds short of a symmetrical one: a slope of about -3e-7 a minute
    got, want = both(
        "q43_history_doc",
        [(1, "02 00:00:00", 3, 9.5, 11), (2, "02 01:40:00", 3, 7.25, 10), (3, "02 03:19:17", 3, 8.0, 11)],
    )
    assert "avg_zone_temp_slope=-0, " in got.text[0]
    assert canonical(got) == canonical(want)


def test_summary_stream_counts_events_of_one_microsecond_and_ids_out_of_order(both):
    once = [(i, f"{2 + i // 12:02} {i % 12 * 2:02}:00:00.5", 3 + 8 * (i % 2), 5.0 + i, i * 7 % 100) for i in range(40)]
    copies = [(i + 1000, at, user + 8, value + 1, k) for i, at, user, value, k in once[::3]]
    got, want = both("st_exact_summaries", once + copies)
    assert want.sample_count.sum() > 40
    assert canonical(got) == canonical(want)


def test_values_of_equal_arrivals_stay_with_their_events():
    m = UnitMachine(20, 5, ("x",))
    closed = [w for ts, x in ((3, 1.0), (4, 2.0), (4, 4.0), (30, 9.0)) for w in m.push(ts, 7, f"{ts} {x}", (x,))]
    (_, _, samples, _, _, _, mean, _, low, high, delta, _), *_ = closed or list(m.flush())
    assert (samples, low, high, delta) == (3, 1.0, 4.0, 3.0) and mean == pytest.approx(7 / 3)
