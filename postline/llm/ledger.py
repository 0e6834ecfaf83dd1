"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger keeps, in
two Parquet tables below its root, which rules (name and version) each blob has been scanned
with, and what was found. A run scans only blobs for which some rule version is missing, and
those only with the missing rules; findings are then joined back to all paths of a blob.

Places of matches come without Python: the gaps between matches (split) and the matches
themselves (regexp_extract_all) alternate, so running sums of their lengths are the places.

Defined cases: a null text is the empty blob; equal texts are one blob, scanned once, and all
their rows get its findings; equal rows stay as many rows; null paths are paths like any
other; an empty table or a blob without findings gives zero counts and empty span lists; spans
of different kinds may overlap; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postline.llm.common import cut, free_name, shared_folder


@dataclass(frozen=True)
class Rule:
    """``group`` is the capturing group that must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: The contract's kinds. A run of 16 and more hex digits is a maximal run, so the bound may stand in the pattern; that of
#: assign may not, as a failing match there uses up text in which another one would begin.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: A key block reaches to its END line. Without one (cut off, or another block begins first) it has the header fields
#: and runs of base64 that follow, and a shorter last line. Loops are possessive, so they need no stack and no second pass.
_TO_END = r"(?>[^-]*+(?:-(?!----)[^-]*+)*+)-----END [A-Z ]{0,40}PRIVATE KEY-----"
_GAP = r"(?:[\s\x22',+>]|\\[nrt])"
_BODY = rf"(?:{_GAP}++(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?![^\s\x22'\\]|[\x20\t]*+[^\s\x22'\\]))?+)*+"
#: Kinds beside them: key blocks, JSON web tokens, and tokens with a service's own beginning.
MORE = (
    Rule("pem", rf"-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{_TO_END}|{_BODY})", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("service", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, kind, start, stop) of each match, for blobs (blob, text, rules: array of the rule names to apply)."""
    found = [
        F.struct(
            F.lit(i).alias("i"),
            F.when(F.array_contains("rules", r.name), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("m"),
        )
        for i, r in enumerate(rules)
    ]
    hits = blobs.select("blob", "text", F.explode(F.filter(F.array(*found), lambda x: F.size(x.m) > 0)).alias("k")).select("blob", "text", "k.i", "k.m")
    pattern = F.element_at(F.array(*[F.lit(r.pattern) for r in rules]), F.col("i") + 1)
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    group = F.coalesce(*[F.when(F.col("i") == i, lengths(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)))) for i, r in enumerate(rules) if r.group], lengths(F.col("m")))
    parts = hits.select("blob", "i", F.posexplode(F.arrays_zip(lengths(F.split("text", pattern, -1)).alias("gap"), lengths(F.col("m")).alias("len"), group.alias("own"))).alias("at", "x")).select("blob", "i", "at", "x.*")
    upto = W.partitionBy("blob", "i").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    placed = parts.withColumn("start", F.sum("gap").over(upto) + F.sum("len").over(upto) - F.col("len")).where("len is not null")
    least, names, kinds = ([f(x) for x in rules] for f in (lambda r: F.lit(r.least), lambda r: F.lit(r.name), lambda r: F.lit(r.kind)))
    nth = lambda xs: F.element_at(F.array(*xs), F.col("i") + 1)
    placed = placed.where(F.col("own") >= nth(least))
    return placed.select("blob", nth(names).alias("rule"), nth(kinds).alias("kind"), F.col("start").cast("long").alias("start"), (F.col("start") + F.col("len")).cast("long").alias("stop"))


class Ledger:
    """``root`` holds ``scanned`` (blob, rules) and ``findings`` (blob, rule, kind, start, stop); both only grow."""

    SCANNED = "blob string, rules array<string>"
    FINDINGS = "blob string, rule string, kind string, start long, stop long"

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or shared_folder(spark, "ledger")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # nothing has been scanned yet

    def scanned(self) -> DataFrame:
        return self._table("scanned", self.SCANNED)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """What the given rules have found; equal rows (of a run that was repeated) count once."""
        return self._table("findings", self.FINDINGS).where(F.col("rule").isin([r.name for r in rules])).distinct()

    def update(self, versions: DataFrame, path_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new in versions; gives (path, blob) for each of its rows.

        Findings are written before the blobs count as scanned, so a run that breaks off is
        made good by the next one.
        """
        own = versions.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).withColumn("blob", address(F.col("text")))
        paths = cut(own.select("path", "blob"), "paths")
        every = F.array(*[F.lit(r.name) for r in rules])
        seen = self.scanned().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        missing = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        todo = paths.select("blob").distinct().join(seen, "blob", "left").withColumn("rules", missing).where(F.size("rules") > 0)
        todo = cut(todo.select(F.col("blob").alias("_blob"), "rules"), "todo")
        # one row of each blob, whatever its paths; each task keeps one before they are dealt, so a blob with very many rows isn't dealt to one task
        one = own.groupBy("blob").agg(F.any_value(F.coalesce("text", F.lit(""))).alias("text"))
        text = one.join(todo.hint("shuffle_hash"), one.blob == todo["_blob"]).select("blob", "text", "rules")
        scan(text, rules).write.mode("append").parquet(f"{self.root}/findings")
        todo.select(F.col("_blob").alias("blob"), "rules").write.mode("append").parquet(f"{self.root}/scanned")
        return paths

    def by_blob(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans): the spans of each blob that has any, by start and then kind as the rules list them."""
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
        span = F.struct("start", order[F.col("kind")].alias("nth"), "stop", "kind")
        return self.findings(rules).groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    ledger = ledger or Ledger(docs.sparkSession)
    paths = ledger.update(docs, id_col, text_col)
    base = lambda s: s["nth"] < len(BASE)
    count = lambda i: F.size(F.filter("spans", lambda s: s["nth"] == i)).cast("long")
    own = cut(ledger.by_blob().select("blob", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], as_text(F.filter("spans", base)).alias("base"), as_text(F.col("spans")).alias("spans")), "digests")
    rows = paths.join(own, "blob", "left")
    return rows.select(
        F.col("path").alias("doc_id"), *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", id_col: str = "doc_id", ledger: Ledger | None = None) -> DataFrame:
    """docs, all their rows and columns, with each span of a secret in the text replaced by ``mark`` (overlapping spans by one)."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.update(docs, id_col, text_col)
    own, blob, found = (free_name(docs, n) for n in ("__own", "__blob", "__spans"))
    spans = cut(ledger.by_blob().select(F.col("blob").alias(blob), F.col("spans").alias(found)), "spans")
    rows = docs.withColumn(own, address(F.col(text_col))).join(spans, F.col(own) == F.col(blob), "left")
    text = F.col(text_col)
    # (text so far, end of the last span): a span that begins before that end only moves it
    step = lambda s, x: F.when(x["start"] < s["at"], F.struct(s["out"].alias("out"), F.greatest(s["at"], x["stop"]).alias("at"))).otherwise(
        F.struct(F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mark)).alias("out"), x["stop"].alias("at"))
    )
    done = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.col(found).isNotNull(), done).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
