import random

import numpy as np
import xxhash

from postline.llm import simhash
from tests.llm.helpers import collected, documents, prose, words


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, max_bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def expected(rows, max_bits=4):
    prints = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_groups(prints, max_bits)
    least = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in set(groups)}
    return sorted(((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, groups)), key=repr)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collected(simhash.simhash(docs), "doc_id", "fingerprint", "component_id") == expected(rows)


def test_empty_table(spark):
    assert simhash.simhash(documents(spark, [])).collect() == []
    assert simhash.keep_one(documents(spark, [])).columns == documents(spark, []).columns


def near(rnd, base, bits):
    for b in rnd.sample(range(64), bits):
        base ^= 1 << b
    return base


def test_links_of_random_and_clustered_fingerprints_match_all_pairs(spark):
    rnd = random.Random(4)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    prints = [rnd.getrandbits(64) for _ in range(300)] + [near(rnd, rnd.choice(centres), rnd.randint(0, 6)) for _ in range(500)]
    for max_bits, block in ((4, 2048), (4, 40), (1, 40)):
        rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"), "doc_id", max_bits) if block == 2048 else None
        if got is None:
            classes = spark.createDataFrame(rows, "doc_id long, fp long").select("fp").distinct()
            links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in collected(simhash.links(classes, max_bits, block), "a", "b")]
            assert all(a != b for a, b in links)
            index = {p: i for i, p in enumerate(dict.fromkeys(prints))}
            parent = list(range(len(index)))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in links:
                parent[find(index[a])] = find(index[b])
            mine, all_pairs = [find(i) for i in range(len(index))], plain_groups(list(index), max_bits)
            assert len(set(zip(mine, all_pairs))) == len(set(mine)) == len(set(all_pairs))
        else:
            groups = plain_groups(prints, max_bits)
            least = {}
            for i, g in enumerate(groups):
                least[g] = min(least.get(g, i), i)
            told = {r.fp & (1 << 64) - 1: r.component_id for r in got.collect()}
            assert [told[p] for p in prints] == [least[g] for g in groups]


def test_majority_counts_in_parts():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 70_000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.majority(hashes) == want


def test_keep_one_leaves_one_row_of_each_group_with_all_columns(spark):
    base = prose(5, 400)
    rows = [(i, base if i % 2 else base + f" end{i}", "en", "a") for i in range(10, 20)] + [(1, prose(6, 200), "en", "b"), (1, prose(6, 200), "en", "b"), (None, prose(8, 90), "fr", None), (None, prose(8, 90), "fr", None)]
    docs = documents(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = plain_groups([plain_fingerprint(r[1]) for r in rows], 4)
    assert kept.count() == len(set(groups))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)[0] == 1
