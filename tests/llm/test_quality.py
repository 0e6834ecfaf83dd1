import math
import re
from collections import Counter, defaultdict

import numpy as np

from postline.llm import quality
from tests.llm.helpers import collected, documents, prose, words

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def plain_base(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered |= {i, i + 1, i + 2}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        duplicates += bool(words(line)) and line in seen
        seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_columns(spark):
    rows = [(1, "a b c a b c d\na b\n\n \na b\na b", "en", "a"), (2, "x | y <z>\r\n#1 # 1", "en", "a"), (3, ("one two three\n" * 30), "en", "b"), (4, "a a a a", "de", "b")]
    docs = documents(spark, rows + [(r.doc_id, r.text, r.lang, r.source) for r in documents(spark).collect()])
    out = quality.quality(docs)
    assert collected(out, *BASE) == sorted(((r.doc_id, *plain_base(r.text)) for r in docs.collect()), key=repr)
    assert all(not (r.base_failed and r.kept) for r in out.collect())
    assert quality.quality(documents(spark, [])).collect() == []


def test_bands_reject_odd_text_and_keep_the_rest(spark):
    rows = [(i, prose(i, 150), "en", "a") for i in range(120)] + [(1000 + i, "".join(chr(945 + (i * 7 + k * k) % 24) + " " * (k % 5 == 0) for k in range(800)), "en", "a") for i in range(3)]
    kept = {r.doc_id: r.kept for r in quality.quality(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[1000 + i] for i in range(3))


def test_copies_do_not_set_the_band(spark):
    rows = [(i, prose(i, 150), "en", "a") for i in range(60)] + [(1000 + i, " ".join(["thing reing"] * 3 + ["anthe"] * 3 + prose(500, 150).split()), "en", "a") for i in range(90)]
    out = {r.doc_id: r for r in quality.quality(documents(spark, rows)).collect()}
    losses = [math.log(out[i].perplexity) for i in (*range(60), 1000)]
    middle = sorted(losses)[30]
    reach = quality.WIDTH * 1.4826 * sorted(abs(x - middle) for x in losses)[30]
    for r in out.values():
        own = reach * math.sqrt(1 + quality.SHORT / len(dict((i, t) for i, t, *_ in rows)[r.doc_id]))
        assert math.isclose(math.log(r.upper), middle + own, abs_tol=2e-3 * quality.WIDTH) and math.isclose(math.log(r.lower), middle - own, abs_tol=2e-3 * quality.WIDTH)
    assert all(out[i].kept for i in range(60))


def plain_model(texts):
    """Modified Kneser-Ney of the texts of one language, term by term: {gram: probability}."""
    ngrams = Counter()
    for t in texts:
        for packed in quality.grams(t):
            ngrams.update(packed.tolist())
    top, classes = quality.ORDER, 1 << quality.BITS
    levels = {top: Counter({tuple(g // classes**k % classes for k in reversed(range(top))): c for g, c in ngrams.items()})}
    for n in range(top - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discounts(counts):
        n = [0, *(sum(c == k for c in counts) for k in (1, 2, 3, 4))]
        if min(n[1:4]) == 0:
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        return tuple(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))

    d = {n: discounts(list(levels[n].values())) for n in levels}
    after = {n: defaultdict(dict) for n in levels}
    for n, level in levels.items():
        for g, c in level.items():
            after[n][g[:-1]][g] = c

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / classes
        own = after[n][g[:-1]]
        lost = sum(d[n][min(c, 3) - 1] for c in own.values())
        return (own[g] - d[n][min(own[g], 3) - 1] + lost * p(g[1:])) / sum(own.values())

    return {g: p(tuple(g // classes**k % classes for k in reversed(range(top)))) for g in ngrams}


def test_losses_match_the_plain_formula(spark, monkeypatch):
    texts = [(prose(1, 60), "en"), (prose(2, 60) + " 4444 55é 漢字", "en"), (None, "en"), ("", None), (prose(3, 40), None), (prose(4, 40), ""), (prose(1, 60), "de"), (prose(1, 60), "en")]
    docs = documents(spark, [(i, t, lang, "a") for i, (t, lang) in enumerate(texts)])
    plain = {lang: plain_model([t for t, other in texts if t and other == lang]) for _, lang in texts}
    want = {}
    for i, (t, lang) in enumerate(texts):
        own = [plain[lang][g] for packed in quality.grams(t or "") for g in packed.tolist()]
        want[i] = -sum(map(math.log, own)) / len(own) if own else None
    # a model that is broadcast or not, blocks of any size, and several copies of each part give the same
    for block, group, shared in ((quality.BLOCK, quality.GROUP, quality.SHARED), (quality.BLOCK, quality.GROUP, 0), (300, 1, 0)):
        monkeypatch.setattr(quality, "SHARED", shared)
        monkeypatch.setattr(quality, "BLOCK", block)
        monkeypatch.setattr(quality, "GROUP", group)
        got = {r.doc_id: r.loss for r in quality.measured(docs).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] is None if want[i] is None else math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)


def test_probabilities_sum_to_less_than_one_and_the_model_grows(spark):
    few = [(i, prose(i, 100), "en", "a") for i in range(3)]
    many = few + [(100 + i, prose(100 + i, 100) + f" añ{chr(300 + i)}x", "en", "a") for i in range(20)]
    sizes = []
    for rows in (few, many):
        p = quality.probabilities(quality.count_grams(quality.blocks(documents(spark, rows).select("doc_id", "lang", "text"))))
        sizes.append(p.count())
        total = p.groupBy((p.gram / (1 << quality.BITS)).cast("long").alias("context")).sum("p").collect()
        assert all(0 < r["sum(p)"] <= 1 + 1e-9 for r in total)
    assert sizes[0] < sizes[1]


def test_other_languages_and_reversed_words_are_rejected(spark):
    rows = [(i, prose(i, 150), "en", "a") for i in range(120)]
    other = [(500 + i, prose(500 + i, 150).translate(str.maketrans("aeiou", "äëïöü")), "de", "a") for i in range(120)]
    wrong = [(1000 + i, other[i][1], "en", "a") for i in range(3)]
    mixed = [(3000 + i, " ".join(w[::-1] for w in rows[i][1].split()), "en", "a") for i in range(3)]
    kept = {r.doc_id: r.kept for r in quality.quality(documents(spark, rows + other + wrong + mixed)).collect()}
    assert all(kept[i] for i in (*range(120), *range(500, 620)))
    assert not any(kept[i] for i in (1000, 1001, 1002, 3000, 3001, 3002))


def test_grams_do_not_depend_on_pieces(monkeypatch):
    text = prose(4, 400) + " 12345 " + prose(5, 50)
    whole = np.concatenate(list(quality.grams(text)))
    monkeypatch.setattr(quality, "PIECE", 64)
    assert abs(len(np.concatenate(list(quality.grams(text)))) - len(whole)) <= 1


def test_medians_match_sorted_values(spark):
    rows = [("en", 1.0 + (i * i % 97) / 100) for i in range(41)] + [(None, 2.0), ("de", None)]
    limits = {r.lang: r for r in quality.bands(spark.createDataFrame(rows, "lang string, loss double"), 2.0).collect()}
    values = defaultdict(list)
    for lang, v in rows:
        if v is not None:
            values[lang].append(v)
    for lang, v in values.items():
        m = sorted(v)[(len(v) - 1) // 2]
        mad = sorted(abs(x - m) for x in v)[(len(v) - 1) // 2]
        reach = 2.0 * max(quality.LEAST, 1.4826 * mad)
        assert math.isclose(limits[lang].lower, m - reach, abs_tol=1e-3) and math.isclose(limits[lang].upper, m + reach, abs_tol=1e-3)
    assert set(limits) == {"en", None}


def test_lookup_finds_each_ngram_in_a_few_places_of_the_array():
    rng = np.random.default_rng(3)
    for size in (1, 2, 1000, 50_000):
        kinds = np.unique(rng.integers(0, 1 << 60, size))
        keys = np.sort(quality.hashed(kinds))
        for part in (keys, keys[keys <= keys[len(keys) // 3]]):  # the whole range, and a part of it
            values = rng.random(len(part)).astype(np.float32)
            asked = rng.permutation(kinds[np.isin(quality.hashed(kinds), part)])
            asked = np.append(asked, asked)
            find = quality.Lookup(part, values)
            np.testing.assert_array_equal(find(asked), values[np.searchsorted(part, quality.hashed(asked))])
            # so few keys have the same top bits that no search is needed
            assert np.diff(find.first).max(initial=0) < 16 and len(find.first) <= 4 * len(part) + 2
