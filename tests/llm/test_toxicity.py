import random
import zlib

import numpy as np
import pytest

from postline.llm import toxicity
from tests.llm.helpers import documents, prose


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 80).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), ("idiot", "scumbag", "worthless")[i // 5 % 3])
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def scorer_of(spark, corpus):
    rows, labels = corpus
    return toxicity.train(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy_and_columns(spark, corpus):
    rows, labels = corpus
    out = toxicity.toxicity(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows)
    truth = {d: t for d, _, t in labels}
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)


@pytest.mark.parametrize("written", ["1d10t", "i d i o t", "idiooooot", "1.d.1.o.t", "id!ot!!", "(idiot)", "IDIOT", "sc_um.b-ag", "$cumb@g", "w0rthle55", "w o r t h l e s s"])
def test_obfuscated_words_are_restored(spark, corpus, written, _cache={}):
    if "scorer" not in _cache:
        _cache["scorer"] = scorer_of(spark, corpus)
    s = _cache["scorer"]
    reader = toxicity.Reader(s.model, s.names)
    clean, text = prose(900, 40), f"{prose(900, 20)} {written} {prose(901, 20)} {written}"
    low, high = s.scores([clean, text], reader)
    assert low < 0.5 < high


def test_letters_beside_symbols_stay_clean(spark, corpus):
    s = scorer_of(spark, corpus)
    reader = toxicity.Reader(s.model, s.names)
    texts = ["4 1 d 10 x", "call 555-1000 or 10:45, a b c d", "in 1dx0 the", "ing!! on$$$ the%%% er###", "| a | b | i | o |"]
    assert (s.scores(texts, reader) < 0.5).all()


def test_pruning_by_skeletons_changes_no_score(spark, corpus):
    s = scorer_of(spark, corpus)
    pruned = toxicity.Reader(s.model, s.names)
    full = toxicity.Reader(s.model, s.names)
    full.starts = {toxicity.skeleton(w)[:3] for w in ["".join(p) for p in __import__("itertools").product("abcdefghiklmnopqrstuvwxyz", repeat=3)]} | {""}
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("aid1o0t$smw!.") for _ in range(rnd.randint(1, 8))) for _ in range(20)) for _ in range(30)]
    assert np.allclose(s.scores(texts, pruned), s.scores(texts, full))


def test_decode_is_the_best_path(spark, corpus):
    model = scorer_of(spark, corpus).model

    def paths(token, last="", out="", cost=0.0):
        if not token:
            yield out, cost
            return
        c = token[0]
        ways = [(x, toxicity.COST_LEET) for x in toxicity.LEET.get(c, "")]
        if c in toxicity.LEET:
            ways += [("", toxicity.COST_DROP)] + ([("", toxicity.COST_REPEAT)] if c == last else [])
        elif c.isalpha():
            ways = [(c, 0.0)] + ([("", toxicity.COST_REPEAT)] if c == last else [])
        else:
            ways = [("", toxicity.COST_SPACE if c in toxicity.SEPARATORS else toxicity.COST_DROP)]
        for x, k in ways:
            yield from paths(token[1:], c, out + x, cost + k)

    def score(out):
        s, total = [27, 27, 27], 0.0
        for x in [*(ord(c) - 97 for c in out), 27]:
            total += float(model[tuple(s)][x])
            s = [*s[1:], x]
        return total

    for token in ("1d10t", "id!!oot", "s c u m", "l1l", "$$0"):
        best = max(score(o) - k for o, k in paths(token))
        got = toxicity.decode(token, model)
        assert any(o == got and abs(score(o) - k - best) < 1e-4 for o, k in paths(token))


def test_awkward_rows_and_labels(spark):
    docs = documents(spark)
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == docs.count() and {r.predicted for r in none} == {0}
    odd = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, None), (None, 1, 1), (999, 1, 0), (7, 1, 0)], "doc_id long, toxic_ int, toxic int")
    assert toxicity.toxicity(docs, odd).count() == docs.count()
    assert toxicity.toxicity(documents(spark, []), odd).collect() == []
    assert [r.held_out for r in none if r.doc_id is None] == [True, True]


def test_character_counts_match_one_pass(spark):
    docs = documents(spark, [(1, "ab ba", "en", "a"), (2, None, "en", "a"), (3, "Éz", "en", "a")])
    model = toxicity.character_model(docs)
    assert model.shape == (28,) * 4 and np.allclose(np.exp(model.astype(float)).sum(axis=-1), 1, atol=1e-3)
    assert model[27, 27, 27, 0] > model[27, 27, 27, 25]  # a word began with a, none with z


def test_counts_of_features_do_not_depend_on_batches(spark, corpus):
    rows, labels = corpus
    docs, told = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chosen = []
    for size in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            chosen.append(toxicity.train(docs, told).names)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert chosen[0] == chosen[1] and {"idiot", "scumbag", "worthless"} <= set(chosen[0])


@pytest.mark.parametrize("written", ["id" + "i" * 80 + "ot", "w" + " . - " * 3 + "o r t h l e s s", "1d10ts", "id0iot", "o n s c u m b a g", "i d i o t w o r t h l e s s", "the/" * 20 + "1d10t", " ".join("ontheing" * 5) + " i d i o t", "on-1d10t", "idiot!scumb4g"])
def test_obfuscated_words_are_found_in_long_tokens_runs_and_inflections(spark, corpus, written, _cache={}):
    if "scorer" not in _cache:
        _cache["scorer"] = scorer_of(spark, corpus)
    s = _cache["scorer"]
    reader = toxicity.Reader(s.model, s.names)
    low, high = s.scores([prose(900, 40), f"{prose(900, 20)} {written} {prose(901, 20)} {written}"], reader)
    assert low < 0.5 and high > 2 * low, (low, high)
    assert reader.numbers(written)


def test_a_long_path_is_the_same_in_pieces(spark, corpus):
    model = scorer_of(spark, corpus).model
    assert toxicity.restore("the-" * 3000 + "1d10t", model) == ["the"] * 3000 + ["idiot"]
    assert len(toxicity.decode("1" * 5000 + "a", model)) > 0
