"""Who waits for whom, up to the root."""

from datetime import datetime, timedelta

import pytest

from fleetlens.operators import locks

DB = "database"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def chains(spark):
    """held: (database, sid, resource); waiting: the same. Sessions log on in the order of their number."""

    def build(held, waiting, background=()):
        rows = [(d, s, r, 0, 1, 0) for d, s, r in held] + [(d, s, r, 0, 0, 6) for d, s, r in waiting]
        sids = {(d, s) for d, s, _ in [*held, *waiting]}
        sessions = [(d, s, "BACKGROUND" if s in background else "USER", T0 + timedelta(minutes=s)) for d, s in sids]
        found = locks.wait_chains(
            spark.createDataFrame(rows, "database string, sid int, id1 int, id2 int, block int, request int"),
            spark.createDataFrame(sessions, "database string, sid int, type string, logon_time timestamp_ntz"),
            DB,
        )
        return {(r.database, r.waiter_sid): (r.blocker_sid, r.root_sid, r.depth, r.deadlock) for r in found.collect()}

    return build


def test_a_chain_of_fifty_in_two_databases(chains):
    """Session n holds resource n and waits for n - 1; in B the chain is cut in the middle."""
    held = [(d, n, n) for d in "AB" for n in range(51)]
    waiting = [(d, n, n - 1) for d in "AB" for n in range(1, 51) if (d, n) != ("B", 25)]
    got = chains(held, waiting)
    assert len(got) == 99
    assert all(got["A", n] == (n - 1, 0, n, False) for n in range(1, 51))
    assert all(got["B", n] == (n - 1, 0, n, False) for n in range(1, 25))
    assert all(got["B", n] == (n - 1, 25, n - 25, False) for n in range(26, 51))


def test_deadlocks(chains):
    """1, 2, 3 wait in a circle, 4 and 5 for the circle, 7 for 6; 8 and 9 for each other."""
    held = [("A", n, n) for n in (1, 2, 3, 4, 6, 8, 9)]
    waiting = [("A", 1, 2), ("A", 2, 3), ("A", 3, 1), ("A", 4, 1), ("A", 5, 4), ("A", 7, 6), ("A", 8, 9), ("A", 9, 8)]
    got = chains(held, waiting)
    assert {s for (_, s), r in got.items() if r[3]} == {1, 2, 3, 8, 9}
    assert got["A", 4] == (1, None, None, False) and got["A", 5] == (4, None, None, False)
    assert got["A", 7] == (6, 6, 1, False)


def test_several_holders_and_own_locks(chains):
    """The first holder that is not the waiter blocks; background holders block nobody."""
    held = [("A", 1, 10), ("A", 2, 10), ("A", 3, 10), ("A", 0, 10), ("A", 5, 11)]
    waiting = [("A", 1, 10), ("A", 4, 10), ("A", 4, 11), ("A", 6, 12)]
    got = chains(held, waiting, background=(0,))
    assert got == {("A", 1): (2, 2, 1, False), ("A", 4): (1, 2, 2, False)}


def test_no_waiters(chains):
    assert chains([("A", 1, 1)], [("A", 2, 3)]) == {}
