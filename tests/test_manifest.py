import hashlib
import json

import pyarrow.parquet as pq

from panelspark.plans import registry

SF = "/root/testdata/sf0.001"


def test_manifest_hashes_the_files_behind_the_bars(spark, tmp_path):
    """Raw files that give the same bars, in another order of rows and in two parts, are told apart by their digests."""
    raw = pq.read_table(f"{SF}/lineitem.parquet")
    parts = tmp_path / "lineitem.parquet"
    parts.mkdir()
    half = len(raw) // 2
    pq.write_table(raw.slice(half), parts / "part-0.parquet")
    pq.write_table(raw.slice(0, half), parts / "part-1.parquet")
    one, two = (registry.dataset_manifest(spark, str(d)).first() for d in (SF, tmp_path))
    assert one["dataset_hash"] == two["dataset_hash"] and one["rows"] == two["rows"]
    hashed = lambda r: sorted(json.loads(r["files"]).values())
    assert hashed(one) == [hashlib.sha256(open(f"{SF}/lineitem.parquet", "rb").read()).hexdigest()]
    assert hashed(two) == sorted(hashlib.sha256(p.read_bytes()).hexdigest() for p in parts.iterdir())
