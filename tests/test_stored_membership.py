"""Membership from snapshots and deltas, and the primary industry by a sweep, against folding every event."""

import datetime as dt
import os
import random

import pytest

from builders import day, relations
from tidemark import schemas
from tidemark.operators import membership as mb
from tidemark.sources.memberships import Memberships

DAYS = [(dt.date(2026, 8, 3) + dt.timedelta(days=k)).isoformat() for k in range(20)]


def history(spark, seed, kind="industry"):
    """A baseline on the first day, and random additions and removals after it."""
    rng = random.Random(seed)
    edges = [(f"60000{s}", f"B{b}", b) for s in range(4) for b in range(4)]
    live = set(rng.sample(edges, 7))

    def row(edge, **more):
        return dict(stock_code=edge[0], board_code=edge[1], source_order=edge[2] % 3, board_type=kind, **more)

    base = [row(e, baseline_date=DAYS[0]) for e in sorted(live)]
    events = []
    for d in DAYS[1:]:
        for e in rng.sample(edges, rng.randint(0, 4)):
            change = "removed" if e in live else "added"
            live ^= {e}
            events.append(row(e, effective_date=d, change_type=change, detected_at=dt.datetime.fromisoformat(f"{d}T16:00:00")))
    return relations(spark, base, schemas.RELATION_BASELINE), relations(spark, events, schemas.RELATION_CHANGE)


def edges_of(df):
    return sorted((r["stock_code"], r["board_code"], r["effective_date"]) for r in df.collect())


def test_snapshots_and_deltas_equal_folding_all_events(spark, root):
    baseline, changes = history(spark, 1, "concept")
    store = Memberships(spark, root)
    assert store.read(DAYS[3]).count() == 0
    store.save_baseline(baseline)
    store.save_changes(changes)
    for d in (DAYS[6], DAYS[12]):
        store.snapshot(d)
    for d in (DAYS[0], DAYS[5], DAYS[6], DAYS[9], DAYS[19]):
        assert edges_of(store.read(d)) == edges_of(mb.members_as_of(baseline, changes, d)), d
    assert store.read(DAYS[19], "industry").count() == 0
    assert store.read("2026-01-01").count() == 0
    store.snapshot(DAYS[12])  # again, from itself
    assert edges_of(store.read(DAYS[13])) == edges_of(mb.members_as_of(baseline, changes, DAYS[13]))


def test_a_read_opens_one_snapshot_and_the_changes_since(spark, root):
    baseline, changes = history(spark, 2, "concept")
    store = Memberships(spark, root)
    store.save_baseline(baseline)
    store.save_changes(changes)
    store.snapshot(DAYS[10])
    opened = {os.path.basename(os.path.dirname(f)) for f in store.read(DAYS[13]).inputFiles()}
    known = set(os.listdir(f"{root}/changes"))
    assert opened == {f"snapshot_date={DAYS[10]}"} | {f"effective_date={d}" for d in DAYS[11:14] if f"effective_date={d}" in known}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_industry_sweep_equals_the_lowest_edge_of_each_date(spark, seed):
    baseline, changes = history(spark, seed)
    index = spark.createDataFrame([(day(d), i) for i, d in enumerate(DAYS) if i % 4 != 3], "trade_date date, date_idx int")
    index = index.selectExpr("trade_date", "CAST(row_number() OVER (ORDER BY trade_date) - 1 AS INT) AS date_idx")
    got = sorted((r["trade_date"], r["stock_code"], r["industry_code"]) for r in mb.primary_industry_by_date(baseline, changes, index).collect())
    want = []
    for d in [r["trade_date"] for r in index.orderBy("trade_date").collect()]:
        want += [(d, r["stock_code"], r["industry_code"]) for r in mb.primary_industry(baseline, changes, d.isoformat()).collect()]
    assert got == sorted(want)
    spans = mb.primary_industry_spans(baseline, changes).collect()
    for s in spans:  # no neighbour goes on with the same industry
        assert not [t for t in spans if t["stock_code"] == s["stock_code"] and t["valid_from"] == s["valid_to"] and t["industry_code"] == s["industry_code"]]
