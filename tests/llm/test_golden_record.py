"""Golden records against brute force: cold and hot clusters, nulls, blanks, ties, repeats, odd balances, other columns."""

import collections
import datetime
import math
import random

import pytest

SCHEMA = "cluster string, client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, node long, n long"
TRUST = {"store": 1, "crm": 2, "partner": 3, "web": 4}
LEAST = datetime.datetime(1, 1, 1)


def clients() -> list[tuple]:
    rng, day = random.Random(3), datetime.datetime(2024, 3, 1, 5, 0, 0, 123457)
    blank = [None, "", " \t", "\x0b\n\r\x0c "]
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        text = lambda *some: rng.choice([*some, *some, rng.choice(blank)])
        at = None if rng.random() < 0.1 else day + datetime.timedelta(days=rng.randint(0, 14), microseconds=rng.choice([0, 0, 1]))
        balance = rng.choice([None, None, 0.005, -1.235, 2.675, 1e17, math.inf, math.nan, float(i)])
        ids = (rng.choice([i, i, None]), 7 if hot else rng.choice([None, rng.randint(8, 90), 2**60 + i // 40]))
        rows.append(("x", *ids, text(*TRUST, "other"), at, text(" é ", "née", "ab", "𝒳yz"), text("a@b", "c@d"), text("Oslo", "Bonn"), rng.choice([None, 1, 2]), text("p", "q", "r"), balance, 1, 2))
    return rows + rows[:40] + [("x", None, None, None, None, None, None, None, None, None, None, 1, 2)]


def brute(rows: list[tuple]) -> collections.Counter:
    clusters = collections.defaultdict(list)
    keys = [c.split()[0] for c in SCHEMA.split(", ")]
    for r in rows:
        r = dict(zip(keys, r))
        for c in ("source", "name", "email", "city", "segment"):
            r[c] = r[c] if (r[c] or "").strip(" \t\n\x0b\x0c\r") else None
        clusters[r["client_id"] if r["master_id"] is None else r["master_id"]].append(r)
    found = collections.Counter()
    more = lambda v: (v is not None, v if v is not None and v == v else math.inf if v is not None else 0)
    for c, members in clusters.items():
        latest = max((r["updated_at"] for r in members if r["updated_at"]), default=None)
        for r in members:
            r["fresh"] = r["updated_at"] is not None and r["updated_at"] >= latest - datetime.timedelta(hours=240)
            r["trust"] = -TRUST.get(r["source"], 5)
            r["recent"] = (r["updated_at"] is not None, r["updated_at"] or LEAST, r["trust"], r["client_id"] is not None, -(r["client_id"] or 0))
            r["trusted"] = (r["fresh"], r["trust"], r["recent"])
        best = lambda field, order: max((r for r in members if r[field] is not None), key=lambda r: (order(r), more(r[field]) if field == "balance" else r[field]), default={})
        segment, email, name = best("segment", lambda r: r["recent"]), best("email", lambda r: r["trusted"]), best("name", lambda r: (len(r["name"]), r["trusted"]))
        balance = best("balance", lambda r: (r["segment"] == segment.get("segment"), r["recent"]))
        home = max(members, key=lambda r: ((r["city"] is not None) + (r["nation_id"] is not None), r["recent"], (r["city"] is not None, r["city"] or ""), (r["nation_id"] is not None, r["nation_id"] or 0)))
        x = balance.get("balance")
        cents = math.floor(100 * x + 0.5) if x is not None and math.isfinite(x) and abs(x) < 9e16 else None
        filled = home["city"] is not None or home["nation_id"] is not None
        found[c, len(members), sum(not r["fresh"] for r in members), name.get("name"), email.get("email"), segment.get("segment"), home["city"], home["nation_id"], cents,
              name.get("client_id"), email.get("client_id"), segment.get("client_id"), balance.get("client_id"), home["client_id"] if filled else None] += 1
    return found


COLUMNS = "cluster_id n_records n_stale name email segment city nation_id balance_cents name_from email_from segment_from balance_from address_from".split()


@pytest.mark.parametrize("hot, group, leaf", [(1000, 4096, 4096), (20, 50, 4), (0, 10, 3)])
def test_golden_records(spark, hot, group, leaf):
    """All clusters cold; some of each kind, over three levels of nodes; all hot."""
    from vellum.llm.golden_record import golden_records

    rows = clients()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = golden_records(frame, hot=hot, group_rows=group, leaf_rows=leaf)
    assert collections.Counter(tuple(r) for r in found.select(*COLUMNS).collect()) == brute(rows)


def test_no_clients(spark):
    from vellum.llm.golden_record import golden_records

    assert golden_records(spark.createDataFrame([], SCHEMA)).isEmpty()
