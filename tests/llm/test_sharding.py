from __future__ import annotations

import zlib

import pytest

from furrow.llm import sharding


def brute(rows, shards):
    """Global order, prefix sums, cuts at equal shares."""
    rows = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, before, out, slots = sum(r[1] for r in rows), 0, [], {}
    for i, size, crc in rows:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((i, size, crc, shard, slots.get(shard, 0), before))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def key(row):
    return tuple((x is not None, x or 0) for x in row)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_matches_brute_force(docs, odd, shards):
    for df in (docs, odd):
        want = sorted(brute([(r.doc_id, r.text) for r in df.collect()], shards), key=key)
        got = sharding.shard_by_bytes(df, shards).select("doc_id", "size", "text_crc32", "shard", "slot", "byte_start")
        assert sorted(map(tuple, got.collect()), key=key) == want


def test_balanced_contiguous_and_gapless(docs):
    got = sharding.shard_by_bytes(docs, 8).toPandas().sort_values("byte_start")
    assert got.shard.is_monotonic_increasing
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()
    for _, part in got.groupby("shard"):
        assert part.slot.tolist() == list(range(len(part)))


def test_one_hot_id_is_cut(spark):
    df = spark.range(1000).selectExpr("if(id < 700, 5, id) as doc_id", "'same text' as text")
    sizes = sharding.shard_by_bytes(df, 4).groupBy("shard").sum("size").toPandas()
    assert len(sizes) == 4 and sizes["sum(size)"].max() == sizes["sum(size)"].min()


def test_empty_table_and_bad_count(none, docs):
    assert sharding.shard_by_bytes(none, 8).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs, 0)
