import random
import re

from pyspark.sql import functions as F

from postline.constants import INTERNSHIP_PATTERNS, SECURITY_CLEARANCE_PATTERNS, US_LOCATION_PATTERNS
from postline.functions.regex import java_pattern
from postline.functions.text import contains_word, fold_literal

PIECES = ["US", "us", "u.s.", "U.S.A", "USA", "usa", "United States", "remote", "Remote-US", "remote u.s.", " ",
          ", ", "-", "é", "ü", "_", "1", "CA", "ca", "Texas", "new  york", "Washington DC", "washington, dc",
          "NYC", "Berlin", ".", "(", ")", "Austin", "Caustin", "intern", "Internship", "co-op", "coop", "co op",
          "secret", "top secret", "ts/sci", "security clearance", "clearance required", "active clearance", "dod",
          "eligible to obtain and maintain", "an active u.s. secret security clearance", "\t", " "]


def _python(patterns, text):
    out = False
    for p, ic in patterns:
        out = out or re.search(p, text, re.IGNORECASE if ic else 0) is not None
    return out


def _spark(patterns):
    col = None
    for p, ic in patterns:
        t = F.col("t").rlike(java_pattern(p, ic))
        col = t if col is None else (col | t)
    return col


def test_patterns_match_python_re(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 8))) for _ in range(1500)]
    texts += ["Remote - U.S.", "Toronto, CA", "éus", "us-é", "U.S.Aé", "washington,  dc", "Georgia"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    groups = {"us": US_LOCATION_PATTERNS, "intern": INTERNSHIP_PATTERNS, "clear": SECURITY_CLEARANCE_PATTERNS}
    rows = df.select("t", *[_spark(p).alias(k) for k, p in groups.items()]).collect()
    for r in rows:
        for k, p in groups.items():
            assert r[k] == _python(p, r.t), (k, r.t)


def test_whole_word_matches_python(spark):
    rnd = random.Random(10)
    words = ["c++", "ar", "xr", "vr", "unreal engine 5", "real-time 3d", "la"]
    fill = ["ar", "xr", "c++", "c", "+", " ", "é", "_", "1", "-", "3d", "real-time", "unreal engine 5", "la", "lá", "ß"]
    texts = ["".join(rnd.choice(fill) for _ in range(rnd.randint(1, 10))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[contains_word(F.col("t"), w).alias(f"w{i}") for i, w in enumerate(words)]).collect()
    for r in rows:
        for i, w in enumerate(words):
            k = fold_literal(w)
            want = re.search(rf"(?<!\w){re.escape(k)}(?!\w)", r.t) is not None
            assert r[f"w{i}"] == want, (w, r.t)
