"""What the stored log and its manifest shuffle, and that results stay the same."""

import json
import re

import pytest

from strandlog import catalog
from strandlog.sources import bundles, manifest


def plan(df, stage="executedPlan"):
    return getattr(df._jdf.queryExecution(), stage)().toString()


def test_lines_are_made_after_the_last_shuffle(spark, sf, tmp_path):
    dealt = catalog.bundles_of(spark, sf)
    assert dealt.exceptAll(catalog.ops_of(spark, sf).select(dealt.columns)).isEmpty() and dealt.count() == catalog.ops_of(spark, sf).count()
    for df in (bundles.write(dealt, str(tmp_path / "b")), manifest.content(dealt)):
        shuffles = [x for x in plan(df).splitlines() if re.search(r"Exchange hashpartitioning\(bundle", x)]
        assert len(shuffles) == 1 and "REPARTITION_BY_COL" in shuffles[0]


def test_content_of_files_shuffles_nothing(spark, tmp_path):
    """Odd lines: the older name of the time, no DID, no JSON, numbers for texts, another type of operation, an empty file."""
    folder = str(tmp_path)
    files = {
        1: [json.dumps({"did": f"d{k % 3}", "createdAt" if k % 2 else "created_at": f"2024-01-01T00:00:0{k}Z", "x": "é"}, ensure_ascii=False) for k in range(7)],
        2: ["no json", json.dumps({"did": None, "createdAt": "a"}), json.dumps({"did": 5, "operation": 7, "createdAt": 6})],
        3: ["{}"],
        4: [],
    }
    for n, lines in files.items():
        (tmp_path / f"{n:06d}.jsonl.zst").write_bytes(bundles.pack(lines, {"bundle_number": n, "origin": "o"}, 2))
    got = manifest.content_of_files(spark, folder)
    assert "Exchange" not in plan(got)
    want = manifest.content(bundles.scan(spark, folder, 10))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    (tmp_path / "000005.jsonl.zst").write_bytes(b"broken")
    with pytest.raises(Exception, match="bundle 5"):
        manifest.content_of_files(spark, folder).collect()
