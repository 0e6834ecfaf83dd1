import random
import zlib
from collections import defaultdict

from postline.llm import sharding
from tests.llm.helpers import collected, documents, prose

COLUMNS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def plain_bfd(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            i = min(fits)[1]
        else:
            i = len(rooms)
            rooms.append(max(capacity, s))
        rooms[i] -= s
        out.append(i)
    return out, len(rooms)


def test_tree_packs_as_the_plain_method_does():
    rnd = random.Random(1)
    for _ in range(60):
        capacity = rnd.randint(20, 200)
        sizes = sorted((rnd.randint(1, 120) for _ in range(rnd.randint(0, 80))), reverse=True)
        assert sharding.best_fit_decreasing(sizes, capacity) == plain_bfd(sizes, capacity)


def test_fixed_number_uses_the_least_capacity():
    items = [(s, f"i{i}") for i, s in enumerate([9, 8, 7, 6, 5, 4, 3, 3, 2, 1])]
    where = sharding.into_fixed(items, 3)
    load = defaultdict(int)
    for s, n in items:
        load[where[n]] += s
    assert max(load.values()) == 16 and sum(load.values()) == 48
    big = sharding.into_fixed([(1000, "big"), (5, "a"), (5, "b"), (6, "c"), (4, "d")], 3)
    assert [n for n, s in big.items() if s == big["big"]] == ["big"]


def checked(rows, out, shards=8):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((d, s, c) for d, s, c, *_ in out), key=repr) == sorted(((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    load, slots, group = defaultdict(int), defaultdict(list), defaultdict(set)
    for _, s, c, law, shard, slot, grown in out:
        assert law == "bytes" and grown is None and 0 <= shard < shards
        load[shard] += s
        slots[shard].append(slot)
        group[c, s].add(shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in group.values())
    return load


def test_awkward_rows_and_sizes(spark):
    docs = documents(spark)
    checked([(r.doc_id, r.text) for r in docs.collect()], collected(sharding.sharding(docs), *COLUMNS))
    rows = [(i, prose(i % 700, 20 + i % 90), "en", "a") for i in range(1500)]
    load = checked(rows, collected(sharding.sharding(documents(spark, rows)), *COLUMNS))
    assert max(load.values()) - min(load.values()) < 0.02 * max(load.values())
    assert sharding.sharding(documents(spark, [])).collect() == []


def test_a_capacity_opens_as_many_shards_as_it_needs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REGION", 4)
    rows = [(i, prose(i % 200, 30), "en", "a") for i in range(400)] + [(900, "z" * 9000, "en", "b")]
    told = sharding.pack_capacity(sharding.rows_of(documents(spark, rows)), 4000).collect()
    load, group = defaultdict(int), defaultdict(set)
    for r in told:
        load[r.shard] += r["size"]
        group[r.text_crc32].add(r.shard)
    assert len(told) == 401 and all(len(x) == 1 for x in group.values())
    assert sorted(load) == list(range(len(load)))
    assert sorted(load.values())[-1] == 9001 and all(v <= 4000 for v in sorted(load.values())[:-1])
    assert len(load) <= 1.35 * sum(load.values()) / 4000 + 2
