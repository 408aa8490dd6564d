"""Queries of the catalogue over the whole log, against results worked out from the log's own rows."""

import json

import pytest

from strandlog import catalog
from strandlog.operators import stats


@pytest.fixture(scope="module")
def seven(spark, tmp_path_factory):
    """A folder with 3,200 events, two at a time: seven bundles, the last one of 200 operations."""
    path = str(tmp_path_factory.mktemp("seven"))
    spark.range(3200).selectExpr(
        "id as event_id", "timestamp_seconds(1704067200 + id div 2 * 60) as ts", "id % 40 as user_id", "element_at(array('view', 'signup', 'error', 'click'), cast(id % 4 as int) + 1) as event_type"
    ).write.parquet(f"{path}/events.parquet")
    return path


def places(df):
    return sorted(r.global_pos for r in df.collect())


def test_head_and_latest_are_the_logs_own(spark, seven, sf):
    assert places(catalog.QUERIES["latest_n"](spark, seven)) == list(range(2500, 3200))
    assert places(catalog.QUERIES["bundle_range"](spark, seven)) == [*range(1500), *range(2000, 2500), *range(3000, 3200)]
    assert places(catalog.QUERIES["latest_n"](spark, sf)) == list(range(1000))
    with pytest.raises(ValueError, match="out of range"):  # bundle 3 of two
        catalog.QUERIES["bundle_range"](spark, sf)


def test_reversed_log_has_every_operation(spark, seven):
    did = catalog.ops_of(spark, seven).where("global_pos = 7").first().did
    got = [(r.global_pos, r.did) for r in catalog.QUERIES["did_log_rev"](spark, seven).collect()]
    assert got == [(g, did) for g in range(3167, 0, -40)] and len(got) == 80


def test_joins_and_dedups_take_the_whole_log(spark, seven):
    ops = [(r.global_pos, r.did, r.cid, r.bundle, r.position, r.created_at) for r in catalog.ops_of(spark, seven).collect()]
    got = {n: sorted(tuple(r[c] for c in ("global_pos", "did", "cid")) for r in catalog.QUERIES[n](spark, seven).collect()) for n in ("did_ops_join", "batch_resolve", "mempool_dedup", "boundary_dedup")}
    whole = sorted(o[:3] for o in ops)
    assert len(whole) == 3200 and got["did_ops_join"] == whole and got["batch_resolve"] == whole
    # the whole log comes twice; the mempool is the last bundle, and has its operations already
    assert got["mempool_dedup"] == sorted(o[:3] for o in ops if o[3] < 7)
    # each bundle's boundary: the operations at its end that share its last time
    known = set()
    for b in range(1, 8):
        mine = sorted((o for o in ops if o[3] == b), key=lambda o: -o[4])
        for o in mine:
            if o[5] != mine[0][5]:
                break
            known.add(o[2])
    assert got["boundary_dedup"] == sorted(o[:3] for o in ops if o[2] not in known) and len(known) == 14


def test_domain_of_a_very_long_name(spark):
    names = ["at://" + "a." * 6000 + "far.example/x", "at://" + "b" * 12_000 + "_.near.example", "at://u.near.example"]
    rows = [(json.dumps({"operation": {"alsoKnownAs": [n]}}),) for n in names]
    df = spark.createDataFrame(rows, "raw string")
    assert {(r.domain, r.n, r.invalid) for r in stats.domains(df).collect()} == {("far.example", 1, 0), ("near.example", 2, 1)}
    assert [(r.domain, r.n) for r in stats.top(stats.domains(df), "domain").collect()] == [("near.example", 2), ("far.example", 1)]
