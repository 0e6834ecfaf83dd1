import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from postline.llm import packing
from tests.llm.helpers import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def test_ids_equal_the_tokenizer_s_own():
    own, plain = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    assert own.by_chunk
    rnd = random.Random(2)
    alphabet = list("abcXYZ'019.,!$\t\n  ") + ["'s", "'LL", "é", "Σ", "ς", "İ", "ß", "é", "́", "\x1c", "\x85", " ", " ", "🎉", "中", "<|endoftext|>", "<|", "|>", "ǅ", "ﬁ", "¼", "\x00"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(own.ids(t), dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_full_tables_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS", 3)
    monkeypatch.setattr(packing, "WORDS", 3)
    own, plain = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    text = "one two three four five one two three, four. five!"
    assert np.frombuffer(own.ids(text), dtype="<u4").tolist() == plain.encode(text).ids


def test_awkward_rows_round_trip(spark):
    docs = documents(spark)
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            want[r.doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    out = [tuple(r[c] for c in COLUMNS) for r in packing.packing(docs, PATH).collect()]
    assert Counter(x[:5] for x in out) == want
    check_windows([(x[5], x[6], x[2]) for x in out])
    assert packing.packing(documents(spark, []), PATH).collect() == []
    with_ids = packing.pieces(docs, PATH, with_ids=True).where("doc_id = 1").first()
    assert zlib.crc32(np.array(with_ids.ids, dtype="<u4").tobytes()) == with_ids.ids_crc32


def check_windows(rows, capacity=4096):
    at = {}
    for window, offset, length in sorted(rows):
        assert offset == at.get(window, 0)
        at[window] = offset + length
        assert at[window] <= capacity
    assert sorted(at) == list(range(len(at)))
    return at


def plain_best(left, room):
    sums = {0}
    for n, k in left.items():
        sums = {s + n * i for s in sums for i in range(k + 1) if s + n * i <= room}
    return max(sums)


def test_fill_is_closest_to_capacity():
    rnd = random.Random(5)
    for _ in range(200):
        left = {rnd.randint(1, 40): rnd.randint(1, 6) for _ in range(rnd.randint(0, 6))}
        room = rnd.randint(0, 120)
        chosen = packing.fill(left, room)
        assert all(0 < k <= left[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == plain_best(left, room)


def test_plan_uses_every_piece_once_with_little_padding():
    rnd = random.Random(6)
    counts = Counter(min(4096, int(rnd.lognormvariate(6.3, 1.0)) + 1) for _ in range(20_000))
    plan = packing.plan_windows(dict(counts))
    used, fills = Counter(), Counter()
    for n, first, each, window, offset in zip(plan.length, plan.first, plan.each, plan.window, plan.offset):
        assert first == used[n] or first > used[n]
        fills[window] += n * each
    starts = sorted({*plan.window, plan.windows})
    times = {a: b - a for a, b in zip(starts, starts[1:])}
    for n, each, window in zip(plan.length, plan.each, plan.window):
        used[n] += each * times[window]
    assert used == counts and max(fills.values()) <= 4096
    padding = sum((4096 - fills[w]) * t for w, t in times.items())
    assert padding / (4096 * plan.windows) < 0.01


def test_worker_processes_keep_no_tables_after_a_task(spark):
    packing.pieces(documents(spark), PATH).collect()

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            own = packing.encoder(PATH)
            yield pa.RecordBatch.from_pydict({"n": [len(own.chunks) + len(own.words)]})

    found = spark.range(64, numPartitions=16).mapInArrow(held, "n long").collect()
    assert found and all(r.n == 0 for r in found)


def test_a_full_table_keeps_early_texts_until_many_others_were_met(monkeypatch):
    monkeypatch.setattr(packing, "CHUNKS", 3)
    monkeypatch.setattr(packing, "LATE", 2)
    own = packing.Encoder(PATH)
    own.ids("one two three four five")
    assert set(own.chunks) == {"one", "two", "three"}
    own.ids(" ".join(f"w{chr(97 + i)}" for i in range(20)))
    assert "one" not in own.chunks and len(own.chunks) <= 3
