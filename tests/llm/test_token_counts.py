import random

import public_tokenizers

from postline.llm import token_counts
from tests.llm.helpers import collected, documents, words

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain_count(word, pieces, byte):
    """(best score, fewest tokens) over all segmentations."""
    word = token_counts.MARK + word
    best = {0: (0.0, 0)}
    for i in range(1, len(word) + 1):
        ways = [(best[j][0] + pieces[word[j:i]], best[j][1] + 1) for j in range(max(0, i - 40), i) if word[j:i] in pieces]
        if word[i - 1] not in pieces:
            n = len(word[i - 1].encode())
            ways.append((best[i - 1][0] + n * byte, best[i - 1][1] + n))
        best[i] = max(ways, key=lambda x: (x[0], -x[1]))
    return best[len(word)][1]


def test_counts_match_brute_force_over_all_segmentations():
    pieces = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.5, "ab": -4.0, "aba": -5.0, "bb": -5.0, "▁ab": -4.5, "c": -9.0}
    own = token_counts.Unigram(pieces)

    def every(word, score=0.0, n=0):
        if not word:
            yield score, -n
        for k in range(1, len(word) + 1):
            if word[:k] in pieces:
                yield from every(word[k:], score + pieces[word[:k]], n + 1)
        if word and word[0] not in pieces:
            m = len(word[0].encode())
            yield from every(word[1:], score + m * own.byte, n + m)

    rnd = random.Random(1)
    for _ in range(300):
        w = "".join(rnd.choice("aabbcé") for _ in range(rnd.randint(1, 9)))
        assert own.count(w.encode()) == -max(every("▁" + w), key=lambda x: (round(x[0], 9), x[1]))[1]


def test_rows_match_a_plain_pass(spark):
    pieces = token_counts.read_pieces(PATH)
    byte = min(pieces.values()) - 1.0
    docs = documents(spark)
    want = []
    for r in docs.collect():
        found = words(r.text)
        known = {w: plain_count(w, pieces, byte) for w in set(found)}
        want.append((r.doc_id, len(found), sum(known[w] for w in found)))
    assert collected(token_counts.token_counts(docs, PATH), "doc_id", "n_pretokens", "n_tokens") == sorted(want, key=repr)
    assert token_counts.token_counts(documents(spark, []), PATH).collect() == []


def test_new_tries_give_the_same_counts(monkeypatch):
    pieces = token_counts.read_pieces(PATH)
    whole = token_counts.Unigram(pieces)
    rnd = random.Random(3)
    found = ["".join(rnd.choice("theaoing") for _ in range(rnd.randint(1, 12))).encode() for _ in range(500)]
    want = [whole.count(w) for w in found]
    assert len(whole.score) < sum(len(w) + 1 for w in found)  # prefixes are shared
    monkeypatch.setattr(token_counts, "NODES", 20)
    monkeypatch.setattr(token_counts, "LONG", 9)
    small = token_counts.Unigram(pieces)
    assert [small.count(w) for w in found] == want and len(small.score) < 60
