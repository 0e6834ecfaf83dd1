import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from postline.llm.common import components
from postline.llm import ledger, line_dedup, mixing, packing, quality, sharding, simhash, token_counts, toxicity
from tests.llm.helpers import awkward, clashing, collected, documents, prose
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"


def test_stages_take_awkward_and_empty_documents(spark):
    for rows in (awkward(), []):
        docs = documents(spark, rows)
        n = len(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            if name in ("toxicity", "secrets"):
                assert out.count() == n or name == "toxicity"
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == bool(rows)


def test_clean_documents_stay_and_others_go(spark):
    rows = [(1000 + i, prose(i, 90), "en", "ab"[i % 2]) for i in range(12)] + [(2000, "the idiot on the stupid idiot moron " + prose(50, 40), "en", "a"), (2001, prose(3, 90), "en", "b")]
    docs = documents(spark, rows)
    kept = corpus_pipeline.reject_toxic(spark, documents(spark, rows).unionByName(spark.read.parquet(f"{LABELLED}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True), LABELLED)
    ids = {r[0] for r in collected(kept, "doc_id")}
    assert 2000 not in ids and {1000 + i for i in range(12)} <= ids
    one = {r[0] for r in collected(corpus_pipeline.one_of_each_group(spark, docs, SF), "doc_id")}
    assert 2001 not in one and {1000 + i for i in range(12)} <= one


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(900 + i, 900 + (i + 1) % 9) for i in range(9)] + [(3, 3), (160, 950), (950, 951)]
    got = dict(collected(components(spark.createDataFrame(edges, "a long, b long"), "t"), "node", "root"))
    want = {n: 100 for n in [*range(101, 161), 950, 951]} | {500 + i: 500 for i in range(1, 40)} | {900 + i: 900 for i in range(1, 9)}
    assert got == want


def some_documents(spark):
    rows = [(i, prose(i % 9, 30 + i % 4), "en", "ab"[i % 2]) for i in range(24)] + [(50, "password = abcdefgh12345678 " + prose(50, 20), "en", None), (51, None, "en", "a")]
    return documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")


def test_no_column_name_clashes_in_a_stage(spark):
    docs = some_documents(spark)
    wide = clashing(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        a, b = stage(spark, docs, SF), stage(spark, wide, SF)
        assert b.columns == wide.columns, name
        assert collected(a, *docs.columns) == collected(b, *docs.columns), name
        assert {r["toxic"] for r in b.select("toxic").collect()} == {"x"}, name
    a, b = (corpus_pipeline.STAGES[-1][1](spark, d, SF) for d in (docs, wide))
    assert a.columns == b.columns and a.count() == b.count()


def test_no_column_name_clashes_in_an_operator(spark):
    import public_tokenizers

    docs = some_documents(spark)
    wide, labels = clashing(docs), spark.createDataFrame([(i, 0, i % 2) for i in range(24)], "doc_id long, quality int, toxic int")
    for run in (
        lambda d: simhash.simhash(d, shingle=4, max_bits=4), lambda d: toxicity.toxicity(d, labels), mixing.mixing, lambda d: sharding.sharding(d, shards=8),
        quality.quality, ledger.secrets, line_dedup.line_dedup, lambda d: packing.packing(d, public_tokenizers.path("word_bpe_49k.json")),
        lambda d: token_counts.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
    ):
        a, b = run(docs), run(wide)
        assert a.columns == b.columns
        if "sequence_id" not in a.columns:
            assert collected(a, *a.columns) == collected(b, *a.columns)


def test_run_equals_a_plain_pass_through_all_stages(spark, tmp_dir):
    """Every row of run() against the stages done one by one in plain Python; the mix, which is drawn by hash, by its targets and prefixes."""
    labelled = spark.read.parquet(f"{LABELLED}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(400)
    key = "secret = abcdef0123456789abcd"
    own = [(10_000, "the idiot on the stupid idiot moron " + prose(50, 40), "en", "a"), (10_001, f"{prose(61, 50)} {key} {prose(62, 20)}", "en", "b"), (10_002, prose(63, 80), "en", "b"), (10_003, prose(63, 80), "en", "a"), (10_004, None, "en", "a"), (None, prose(64, 70), "fr", None)]
    docs = labelled.unionByName(documents(spark, own).select(*labelled.columns))
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.read.parquet(f"{LABELLED}/labels.parquet").write.parquet(f"{tmp_dir}/labels.parquet")
    rows = [tuple(r) for r in docs.collect()]

    scorer = toxicity.train(spark.read.parquet(f"{tmp_dir}/documents.parquet"), spark.read.parquet(f"{tmp_dir}/labels.parquet"))
    scores = scorer.scores([r[1] for r in rows], toxicity.Reader(scorer.model, scorer.names))
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    assert 10_000 not in {r[0] for r in rows} and len(rows) > 300

    groups = plain_groups([plain_fingerprint(r[1]) for r in rows], 4)
    least = {g: min((r[0] for r, h in zip(rows, groups, strict=True) if h == g and r[0] is not None), default=None) for g in set(groups)}
    rows = [r for r, g in zip(rows, groups, strict=True) if r[0] == least[g]]
    assert {10_001, 10_002} <= {r[0] for r in rows} and 10_003 not in {r[0] for r in rows}

    found = {r.doc_id: r.spans for r in ledger.secrets(documents(spark, [r[:4] for r in rows])).collect()}

    def redacted(r):
        spans = sorted(tuple(map(int, x.split(":")[1:])) for x in found[r[0]].split(",") if x)
        out, at = "", 0
        for start, stop in spans:
            if start >= at:
                out, at = out + r[1][at:start] + "[SECRET]", stop
            at = max(at, stop)
        return out + r[1][at:] if r[1] is not None else None

    texts = {r[0]: (redacted(r), r[3]) for r in rows}
    assert "abcdef0123456789abcd" not in texts[10_001][0] and "[SECRET]" in texts[10_001][0]

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")

    def pieces(text):
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        return tuple((s, len(p), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), 4096) for p in [ids[s : s + 4096]])

    got = Counter()
    windows = {}
    for r in corpus_pipeline.run(spark, tmp_dir).collect():
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in windows.values():  # gapless, and no longer than a window
        ends = np.cumsum([0, *[n for _, n in sorted(spans)]])
        assert [o for o, _ in sorted(spans)] == ends[:-1].tolist() and ends[-1] <= 4096

    sizes, taken = Counter(), Counter()
    for text, source in texts.values():
        sizes[source] += len(whole.findall(text or ""))
    for doc_id, (text, source) in texts.items():
        mine = Counter({k[1:]: n for k, n in got.items() if k[0] == doc_id})
        full = Counter(pieces(text))
        copies = min((mine[p] // n for p, n in full.items()), default=0)
        for p, n in full.items():
            mine[p] -= copies * n
        parts, mine = whole.findall(text or ""), +mine
        taken[source] += copies * len(parts)
        if mine:  # one copy more, cut after a word
            cut = [n for n in range(1, len(parts) + 1) if Counter(pieces("".join(parts[:n]))) == mine]
            assert cut, doc_id
            taken[source] += cut[0]
    assert {k[0] for k in got} <= set(texts)
    aims = plain_targets(dict(sizes))
    assert all(abs(taken[s] - aims[s]) <= 0.5 + 1e-6 for s in sizes)
