"""Small tables with every awkward case, shared by the tests of the corpus operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, `key` string, path string, blob string, score string, shard string, length string, _n string, _k string"
EXTRA = ("x",) * 10


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(["the", "on", "er", "ing", "th", "an", "re", "in"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def awkward():
    long = prose(9, 30_000)
    return [
        (1, prose(1, 120), "en", "a"), (2, prose(2, 120), "en", "b"), (3, prose(1, 120), "en", None), (3, prose(1, 120), "en", None),
        (4, None, None, "a"), (5, "", "en", "b"), (6, " \t\r\n ", "de", "c"), (None, prose(3, 60), "fr", "a"), (None, None, None, None),
        (7, long, "en", "a"), (8, long + " tail", "en", "c"), (9, "x" * 40_000, "en", "a"), (10, "naïve\x1cword é̀ 🎉 <|endoftext|>", "fr", "b"),
        (11, "one two three", "en", "b"), (11, "one two four", "en", "b"), (-5, prose(2, 120), "en", "b"),
    ]


def documents(spark, rows=None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *EXTRA) for r in rows], SCHEMA)


#: Names that modules give to columns of their own.
CLASHING = """toxic _id _doc name pos n x k y __toxicity draws _key _at at place row key whole order part draw draws shard __shard _s nth block size bytes passes last copies
source_size target goal got fp c p q node root a b up more t1 t2 h1 h2 m1 m2 m_id keep gone head heads kind doc seq piece tokens ids length start offset fill seen blob path version rule
findings span spans _n _k _by0 _b _bk _in score held_out predicted band low high perplexity words n_words digest rank slot shard_ bin room group size_ law class cid __own __blob __spans __simhash_fp __simhash_no __simhash_id""".split()


def clashing(docs):
    """docs with all of CLASHING as further columns of text."""
    have = {c.lower() for c in docs.columns}
    extra = [c for c in dict.fromkeys(CLASHING) if c.lower() not in have]
    return docs.selectExpr("*", *[f"'x' as `{c}`" for c in extra])


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
