"""Shards against brute force over all cuts."""

import hashlib
import random
import zlib

import pytest

from docpipe.llm.sharding import bytes_law, plan_shards, shard_slots, write_shards

SCHEMA = "doc_id long, text string, shard string, size string, key string, slot string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], SCHEMA)


def brute(rows, shards):
    """shard of each text: large groups alone, the rest by trying all cuts."""
    groups = {}
    for _, text in rows:
        key = hashlib.sha256((text or "").encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len((text or "").encode()) + 1
    left, alone = sum(groups.values()), []
    for key, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if len(alone) + 1 >= shards or size * (shards - len(alone)) <= left:
            break
        alone.append(key)
        left -= size
    rest = sorted((k, s) for k, s in groups.items() if k not in alone)
    runs = shards - len(alone)

    def cut(capacity):
        places, run, held = {}, 0, 0
        for key, size in rest:
            if held + size > capacity:
                run, held = run + 1, 0
            held += size
            places[key] = run
        return places

    sizes = [s for _, s in rest]
    sums = sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)})
    fitting = [c for c in sums if c >= max(sizes) and max(cut(c).values()) < runs]
    places = cut(fitting[0]) if rest else {}
    return {**{k: i for i, k in enumerate(alone)}, **{k: p + len(alone) for k, p in places.items()}}


def check(spark, rows, shards):
    got = bytes_law(frame(spark, rows), shards).collect()
    want = brute(rows, shards) if rows else {}
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    text_of = dict(rows)
    slots = {}
    for r in got:
        text = text_of[r.doc_id] or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        assert r.shard == want[hashlib.sha256(text.encode()).hexdigest()]
        assert (r.law, r.grown_shard) == ("bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_random_groups(spark, shards):
    rng = random.Random(shards)
    texts = ["".join(rng.choice("ab é🙂") for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(40)]
    check(spark, [(i, rng.choice(texts)) for i in range(120)], shards)


def test_a_hot_group_has_a_shard_and_the_rest_is_even(spark):
    rows = [(i, "the same long text " * 5 if i % 3 == 0 else f"text number {i}") for i in range(300)]
    check(spark, rows, 8)
    counts = {r.shard: r["count"] for r in shard_slots(frame(spark, rows), 8).groupBy("shard").count().collect()}
    assert counts[0] == 100 and set(counts) == set(range(8))
    assert max(counts[i] for i in range(1, 8)) - min(counts[i] for i in range(1, 8)) <= 3


def test_odd_rows(spark):
    check(spark, [], 8)
    check(spark, [(1, None), (2, ""), (3, None)], 8)
    check(spark, [(None, "a"), (1, "b"), (2, "x" * 100_000), (3, " \t\n")], 4)


def test_repeated_rows_have_slots_of_their_own(spark):
    rows = bytes_law(frame(spark, [(1, "a"), (1, "a"), (2, "a"), (3, None)]), 2).collect()
    assert len(rows) == 4 and len({(r.shard, r.slot) for r in rows}) == 4
    assert len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    with pytest.raises(ValueError):
        plan_shards(frame(spark, []), 0)


def test_written_shards_follow_the_plan(spark, tmp_path):
    rows = [(i, f"text {i % 50} " * (i % 7 + 1)) for i in range(200)]
    docs = frame(spark, rows)
    plan = plan_shards(docs, 5)
    write_shards(docs, str(tmp_path / "out"), plan, files=2)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert set(found.columns) == set(docs.columns)
    assert {(r.doc_id, r.shard) for r in found.collect()} == {(r.doc_id, r.shard) for r in shard_slots(docs, 5).collect()}
