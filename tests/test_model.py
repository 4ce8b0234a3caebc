"""Calls of outside models: retries, late replies, errors as rows, verdicts."""

import time

import pytest

from lucerna import catalog
from lucerna.operators import model as M


def counted(replies):
    """A client that gives the replies in turn; a number is a status."""
    seen = []

    def client(prompt):
        seen.append(prompt)
        r = replies[len(seen) - 1]
        if isinstance(r, int):
            raise M.Refused(r)
        return r

    return client, seen


def test_one_retry_after_a_server_error_only():
    client, seen = counted([503, "ok"])
    assert M.with_retry(client, 0)("p") == "ok" and seen == ["p", "p"]
    client, seen = counted([500, 502, "never"])
    with pytest.raises(M.Refused):
        M.with_retry(client, 0)("p")
    assert len(seen) == 2
    client, seen = counted([404, "never"])
    with pytest.raises(M.Refused):
        M.with_retry(client, 0)("p")
    assert len(seen) == 1


def test_late_replies_are_never_used():
    def client(prompt):
        time.sleep(1.0 if prompt == "slow" else 0)
        return prompt.upper()

    got = list(M.timed(client, iter(["a", "slow", None, "b"]), 0.2))
    assert [r for r, _ in got] == ["A", None, None, "B"]
    assert [e is None for _, e in got] == [True, False, True, True] and got[1][1].startswith(M.TECHNICAL)


def test_asked_rows(spark):
    def client(prompt):
        if prompt == "boom":
            raise ValueError("no")
        return '{"ok": %s}' % prompt

    rows = spark.createDataFrame([(1, "true", "x"), (2, "false", "x"), (3, "boom", "x"), (4, None, "x"), (5, "maybe", "x")], "qid long, prompt string, row string")
    out = {r.qid: r for r in M.verdicts(M.asked(rows, client, pause=0)).collect()}
    assert {i: r.verdict for i, r in out.items()} == {1: True, 2: False, 3: None, 4: None, 5: None}
    assert out[3].error == f"{M.TECHNICAL}: no" and out[4].reply is None and out[4].error is None and all(r.row == "x" for r in out.values())
    assert M.asked(rows.limit(0), client).count() == 0


def test_rule_queries_have_their_sql():
    from lucerna import catalog_rules

    own = [n for n, f in vars(catalog_rules).items() if n in catalog.QUERIES and f.__module__ == catalog_rules.__name__]
    assert len(own) > 20 and all(n in catalog.ORACLE_SQL for n in own)
