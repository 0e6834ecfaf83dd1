import math
from collections import Counter, defaultdict

import pytest

from postline.llm import mixing
from tests.llm.helpers import collected, documents, prose, words


def plain_targets(sizes):
    """Reshare round by round, as the contract says."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in fixed]
        share = left / sum(weight[s] for s in free) if free else 0.0
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in free}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]


def check(rows, out):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    source = defaultdict(list)
    for r in rows:
        source[r[0], len(words(r[1]))].append(r[3])
    aims, taken = plain_targets(sizes), defaultdict(int)
    assert len(out) == len(rows)
    for doc_id, size, source_size, target, got in out:
        assert 0 <= got <= 3 * size
        s = next(x for x in source[doc_id, size] if sizes[x] == source_size and math.isclose(aims[x], target, rel_tol=1e-12, abs_tol=1e-9))
        taken[s] += got
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= 0.5 + 1e-6


COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


@pytest.mark.parametrize("case", ["awkward", "capped", "no words"])
def test_targets_and_words_taken(spark, case):
    rows = {
        "awkward": None,
        "capped": [(i, prose(i, 3 + i), "en", "abcdefg"[i % 7] if i < 30 else "z") for i in range(120)],
        "no words": [(1, None, "en", "a"), (2, "  ", "en", "b")],
    }[case]
    docs = documents(spark, rows)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    out = collected(mixing.mixing(docs), *COLUMNS)
    check(rows, out)
    if case == "capped":
        assert collected(mixing.mixing(docs.repartition(3)), *COLUMNS) == out  # reruns agree


def test_empty_table(spark):
    assert mixing.mixing(documents(spark, [])).collect() == []
    assert mixing.mix(documents(spark, [])).count() == 0


def test_mix_has_the_planned_copies(spark):
    rows = [(i, prose(i % 50, 5 + i % 17), "en", "abc"[i % 3] if i % 7 else None) for i in range(200)] + [(777, prose(3, 30), "en", "a")] * 5
    docs = documents(spark, rows)
    planned = Counter()
    for r in mixing.plan(docs).collect():
        planned[r.doc_id] += r.taken
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "__shard"]
    got, texts = Counter(), {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        assert texts[r.doc_id].startswith(r.text)
    assert got == +planned


def test_tree_splits_every_quota_exactly_and_fairly(spark):
    quotas = spark.createDataFrame([(0, 400), (1, 37), (2, 0), (3, 1)], "nth int, draws long")
    total = Counter()
    for seed in range(4):
        leaves = mixing.split_quotas(quotas, 5, f"s{seed}").collect()
        by = defaultdict(int)
        places = defaultdict(int)
        for r in leaves:
            by[r.nth] += r.draws
            places[r.shard] += r.draws
            total[r.nth, r.shard] += r.draws
        assert dict(by) == {0: 400, 1: 37, 2: 0, 3: 1}
        assert sorted(places) == [0, 1, 2, 3, 4] and max(places.values()) - min(places.values()) <= 2
    for shard in range(5):  # means of 4 draws: 80 and 7.4 of each
        assert abs(total[0, shard] / 4 - 80) < 10 and abs(total[1, shard] / 4 - 7.4) < 5
    assert len({total[1, s] for s in range(5)}) > 1


def test_shards_come_in_parts_that_grow_in_number_with_the_data(spark):
    rows = [(i, prose(i, 20), "en", "ab"[i % 2]) for i in range(300)]
    docs = documents(spark, rows)
    mixed = mixing.mix(docs, shards=4, part_bytes=2000)
    assert mixed.rdd.getNumPartitions() >= 15
    filled = [n for n in mixed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(filled) >= 10 and max(filled) < 0.25 * sum(filled)
    own = {r.doc_id: sorted(r.shards) for r in mixing.plan(docs, shards=4).selectExpr("doc_id", "transform(draws, x -> x.shard) as shards").collect()}
    got = {}
    for r in mixed.collect():
        got.setdefault(r.doc_id, []).append(r["__shard"])
    assert {i: sorted(s) for i, s in got.items()} == {i: s for i, s in own.items() if s}


def test_the_query_tells_the_shard_of_each_copy(spark):
    rows = [(i, prose(i, 8 + i % 5), "en", "abc"[i % 3]) for i in range(90)]
    for r in mixing.mixing(documents(spark, rows)).collect():
        assert (r.taken > 0) == bool(r.shards) and all(0 <= int(s) < mixing.SHARDS for s in r.shards.split(",") if s)
