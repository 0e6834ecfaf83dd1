"""Relevance scoring with weighted whole-word keyword rules.

A rule set is a small configuration dimension (tens of rules).  It is read
once on the driver and turned into literal ``CASE`` columns: every rule is
one ``rlike`` with a constant pattern, evaluated inside whole-stage codegen,
and the folded title / description are projected once and reused by all
rules.  For rule sets too large for literal columns, ``score_by_tokens``
gives the same result through an equi-join on each keyword's leading word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    EXCLUDE_KEYWORDS,
    EXPORT_CONTROL_PENALTY,
    EXPORT_CONTROL_PHRASE,
    INCLUDE_KEYWORDS,
    NO_MATCH_REASON,
    TITLE_BOOST_KEYWORDS,
)
from ..functions.regex import java_word
from ..functions.text import fold_cleaned, fold_literal, fold_text

SECTIONS = ("title_boost", "include", "exclude")
RULE_SCHEMA = T.StructType(
    [
        T.StructField("section", T.StringType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("keyword", T.StringType(), False),
        T.StructField("weight", T.DoubleType(), False),
    ]
)
# Above this many rules the literal-column plan is replaced by the token join.
LITERAL_RULE_LIMIT = 2000


@dataclass(frozen=True)
class Rule:
    section: str
    pos: int
    keyword: str
    weight: float

    @property
    def folded(self) -> str:
        return fold_literal(self.keyword)


def default_rules() -> list[Rule]:
    out = []
    for section, entries in (
        ("include", INCLUDE_KEYWORDS),
        ("title_boost", TITLE_BOOST_KEYWORDS),
        ("exclude", EXCLUDE_KEYWORDS),
    ):
        out.extend(Rule(section, i, kw, float(w)) for i, (kw, w) in enumerate(entries))
    return out


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.section, r.pos, r.keyword, float(r.weight)) for r in rules], RULE_SCHEMA
    )


def _g(value: float) -> str:
    return f"{value:g}"


def ordered(rules: list[Rule]) -> dict[str, list[Rule]]:
    by = {s: sorted((r for r in rules if r.section == s), key=lambda r: r.pos) for s in SECTIONS}
    unknown = {r.section for r in rules} - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown rule sections {sorted(unknown)}")
    return by


def title_label(rule: Rule, weight: float) -> str:
    return f'title "{rule.keyword}" +{_g(weight)}'


def body_label(rule: Rule) -> str:
    return f'"{rule.keyword}" +{_g(rule.weight)}'


def penalty_label(rule: Rule) -> str:
    return f'"{rule.keyword}" -{_g(rule.weight)}'


PHRASE_LABEL = f'"{EXPORT_CONTROL_PHRASE}" -{EXPORT_CONTROL_PENALTY}'


def _word(text: Column, rule: Rule) -> Column:
    folded = rule.folded
    if not folded:
        return F.lit(False)
    # substring first (cheap, necessary); the regex then checks the word edges
    return F.contains(text, F.lit(folded)) & text.rlike(java_word(folded))


def score_postings(
    df: DataFrame,
    rules: list[Rule] | None = None,
    title: str = "title",
    description: str = "description",
    folded: bool = False,
    only_if: str | None = None,
) -> DataFrame:
    """Adds ``match_score`` (INT 0..100) and ``match_reason``.

    Score = title boosts + include weights (x1.5 in the title, else x1 in the
    description) - exclude penalties - 1000 for the export-control phrase,
    rounded half-even and clamped to 0..100.

    ``folded=True`` says ``title`` / ``description`` are already folded.
    ``only_if`` names a boolean column: rows where it is false get NULL score
    and reason and no rule is evaluated for them.
    """
    rules = default_rules() if rules is None else rules
    if len(rules) > LITERAL_RULE_LIMIT:
        return score_by_tokens(df, rules, title, description, folded=folded, only_if=only_if)
    by = ordered(rules)
    base = df.columns
    if folded:
        tmp = df.withColumn("_st", F.col(title)).withColumn("_sd", F.col(description))
    else:
        tmp = df.withColumn("_st", fold_text(title)).withColumn("_sd", fold_text(description))
    tmp = tmp.withColumn("_sc", F.concat(F.col("_st"), F.lit(" "), F.col("_sd")))
    t, d, c = F.col("_st"), F.col("_sd"), F.col("_sc")
    guard = F.col(only_if) if only_if else None

    def g(test: Column) -> Column:
        return test if guard is None else F.when(guard, test).otherwise(F.lit(False))

    flags = []
    for i, r in enumerate(by["title_boost"]):
        flags.append(g(_word(t, r)).alias(f"_b{i}"))
    for i, r in enumerate(by["include"]):
        flags.append(g(_word(t, r)).alias(f"_it{i}"))
        flags.append(g(_word(d, r)).alias(f"_id{i}"))
    for i, r in enumerate(by["exclude"]):
        flags.append(g(_word(c, r)).alias(f"_x{i}"))
    phrase = fold_literal(EXPORT_CONTROL_PHRASE)
    flags.append(g(F.lit(bool(phrase)) & F.contains(c, F.lit(phrase))).alias("_ph"))
    tmp = tmp.select(*[F.col(x) for x in base], *flags)

    score: Column = F.lit(0.0)
    additions, penalties = [], []
    for i, r in enumerate(by["title_boost"]):
        m = F.col(f"_b{i}")
        score = score + F.when(m, F.lit(r.weight)).otherwise(F.lit(0.0))
        additions.append(F.when(m, F.lit(title_label(r, r.weight))))
    for i, r in enumerate(by["include"]):
        mt, md = F.col(f"_it{i}"), F.col(f"_id{i}")
        score = score + F.when(mt, F.lit(r.weight * 1.5)).when(md, F.lit(r.weight)).otherwise(F.lit(0.0))
        additions.append(F.when(mt, F.lit(title_label(r, r.weight * 1.5))).when(md, F.lit(body_label(r))))
    for i, r in enumerate(by["exclude"]):
        m = F.col(f"_x{i}")
        score = score - F.when(m, F.lit(r.weight)).otherwise(F.lit(0.0))
        penalties.append(F.when(m, F.lit(penalty_label(r))))
    score = score - F.when(F.col("_ph"), F.lit(float(EXPORT_CONTROL_PENALTY))).otherwise(F.lit(0.0))
    penalties.append(F.when(F.col("_ph"), F.lit(PHRASE_LABEL)))

    added = F.concat_ws(", ", *additions) if additions else F.lit("")
    pen = F.concat_ws(", ", *penalties)
    reason = F.concat(
        F.when(added != "", F.concat(F.lit("Matched: "), added)).otherwise(F.lit(NO_MATCH_REASON)),
        F.when(pen != "", F.concat(F.lit(". Penalties: "), pen)).otherwise(F.lit("")),
    )
    final = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(score, 0))).cast("int")
    if guard is not None:
        final = F.when(guard, final)
        reason = F.when(guard, reason)
    return tmp.select(*[F.col(x) for x in base], final.alias("match_score"), reason.alias("match_reason"))


def score_by_tokens(
    df: DataFrame,
    rules: list[Rule] | DataFrame,
    title: str = "title",
    description: str = "description",
    key: str | None = None,
    folded: bool = False,
    only_if: str | None = None,
) -> DataFrame:
    """Same result as ``score_postings`` for rule sets of any size.

    Where a keyword matches as a whole word, its first run of word characters
    is a whole token of the text.  Candidates come from an equi-join of
    (row, token) with (rule, first word); each candidate is then verified with
    the exact pattern, so the result is exact.  Keywords without any word
    character are verified against every row (an empty token stands for them,
    added only where there are such rules).  ``folded`` and ``only_if`` are
    those of ``score_postings``.

    ``key`` names a unique row key used to join the hits back; without one a
    row id is generated and pinned with a reliable checkpoint, so a task
    recomputed after an executor loss cannot hand out different ids.
    """
    spark = df.sparkSession
    if isinstance(rules, DataFrame):
        rdf = rules.select("section", "pos", "keyword", "weight")
    else:
        rdf = rules_frame(spark, rules)
    # keyword folding mirrors the text fold (lower case + sharp s)
    rdf = rdf.withColumn("folded", fold_text("keyword")).filter(F.col("folded") != "")
    rdf = rdf.withColumn("lead", F.regexp_extract("folded", r"[\p{L}\p{N}_]+", 0))
    rdf = rdf.withColumn(
        "pattern",
        F.concat(
            F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(F.col("folded"), F.lit(r"\E"), F.lit(r"\E\\E\Q")),
            F.lit(r"\E(?![\p{L}\p{N}_])"),
        ),
    )
    rdf = rdf.withColumn(
        "order", F.when(F.col("section") == "title_boost", 0).when(F.col("section") == "include", 1).otherwise(2)
    )
    base = df.columns
    if key:
        keyed = df.withColumn("_rid", F.col(key))
    else:
        from ..session import checkpoint_dir

        checkpoint_dir(spark)
        keyed = df.withColumn("_rid", F.monotonically_increasing_id()).checkpoint(eager=True)
    fold = F.col if folded else fold_text
    guarded = keyed.filter(F.col(only_if)) if only_if else keyed
    texts = guarded.select(
        "_rid",
        fold(title).alias("_st"),
        fold(description).alias("_sd"),
    ).withColumn("_sc", F.concat(F.col("_st"), F.lit(" "), F.col("_sd")))
    words = F.filter(F.array_distinct(F.split("_sc", r"[^\p{L}\p{N}_]+")), lambda x: x != "")
    if rdf.filter(F.col("lead") == "").limit(1).count():
        words = F.array_append(words, F.lit(""))
    tokens = texts.select("_rid", F.explode(words).alias("lead"))
    from .ordering import broadcast_if_small

    # equi-join on the leading word; the rules side is broadcast only when its size is
    # proven small, so a hot token ('the') never gathers all its rows in one task
    by_lead = tokens.join(broadcast_if_small(rdf), "lead")
    cand = by_lead.select("_rid", "section", "pos", "keyword", "weight", "pattern", "order")
    hits = cand.join(texts, "_rid").select(
        "_rid", "section", "pos", "keyword", "weight", "order",
        F.regexp_like(F.col("_st"), F.col("pattern")).alias("in_title"),
        F.regexp_like(F.col("_sd"), F.col("pattern")).alias("in_desc"),
        F.regexp_like(F.col("_sc"), F.col("pattern")).alias("in_all"),
    )
    w = F.col("weight")
    kw = F.col("keyword")
    contrib = (
        F.when((F.col("section") == "title_boost") & F.col("in_title"), w)
        .when((F.col("section") == "include") & F.col("in_title"), w * 1.5)
        .when((F.col("section") == "include") & F.col("in_desc"), w)
        .when((F.col("section") == "exclude") & F.col("in_all"), -w)
    )
    hits = hits.withColumn("contrib", contrib).filter(F.col("contrib").isNotNull())
    hits = hits.withColumn("label_w", F.abs(F.col("contrib")))
    # six significant digits without trailing zeros (the ':g' number format)
    g6 = F.format_string("%.6g", F.col("label_w"))
    label_num = F.when(
        F.contains(g6, F.lit("e")), F.regexp_replace(g6, r"\.?0+e", "e")
    ).when(F.contains(g6, F.lit(".")), F.regexp_replace(g6, r"\.?0+$", "")).otherwise(g6)
    label = (
        F.when(F.col("section") == "exclude", F.concat(F.lit('"'), kw, F.lit('" -'), label_num))
        .when(F.col("in_title"), F.concat(F.lit('title "'), kw, F.lit('" +'), label_num))
        .otherwise(F.concat(F.lit('"'), kw, F.lit('" +'), label_num))
    )
    per_row = hits.groupBy("_rid").agg(
        F.sort_array(F.collect_list(F.struct("order", "pos", "contrib", label.alias("label")))).alias("hits")
    )
    phrase = fold_literal(EXPORT_CONTROL_PHRASE)
    joined = keyed.join(per_row, "_rid", "left").join(texts.select("_rid", "_sc"), "_rid", "left")
    hits_arr = F.coalesce(F.col("hits"), F.array().cast("array<struct<order:int,pos:int,contrib:double,label:string>>"))
    adds = F.filter(hits_arr, lambda h: h["order"] < 2)
    pens = F.filter(hits_arr, lambda h: h["order"] == 2)
    ph = F.contains(F.col("_sc"), F.lit(phrase))
    total = F.aggregate(hits_arr, F.lit(0.0), lambda acc, h: acc + h["contrib"]) - F.when(
        ph, F.lit(float(EXPORT_CONTROL_PENALTY))
    ).otherwise(F.lit(0.0))
    added = F.array_join(F.transform(adds, lambda h: h["label"]), ", ")
    pen_list = F.transform(pens, lambda h: h["label"])
    pen_list = F.when(ph, F.array_append(pen_list, F.lit(PHRASE_LABEL))).otherwise(pen_list)
    pen = F.array_join(pen_list, ", ")
    reason = F.concat(
        F.when(added != "", F.concat(F.lit("Matched: "), added)).otherwise(F.lit(NO_MATCH_REASON)),
        F.when(pen != "", F.concat(F.lit(". Penalties: "), pen)).otherwise(F.lit("")),
    )
    final = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(total, 0))).cast("int")
    if only_if:
        final, reason = F.when(F.col(only_if), final), F.when(F.col(only_if), reason)
    return joined.select(*[F.col(x) for x in base], final.alias("match_score"), reason.alias("match_reason"))


def keyword_hits(df: DataFrame, rules: list[Rule], title: str = "title", description: str = "description", clean: bool = False) -> DataFrame:
    """(row, rule) pairs with a whole-word hit and the field it hit in
    (title, description or the combined text), one row per pair.

    Each rule is a literal test; the hits of a row are built as one array and
    exploded, so no row is paired with rules that do not hit it. Title and description are tested once for each
    rule. The combined text has a hit where one of them has; beyond that only a keyword with a space can lie
    across their border, so just its surroundings there are tested. ``clean=True`` says that white space
    is already collapsed in both texts (as ``clean_text`` does); they are only folded then.
    """
    fold = fold_cleaned if clean else fold_text
    x = df.withColumn("_t", fold(title)).withColumn("_d", fold(description))
    keep = [c for c in df.columns if c not in (title, description)]
    tests, hits = [], []
    for i, r in enumerate(rules):
        across = "false"
        if " " in r.folded:
            n = len(r.folded) + 1  # one character more, so that the edges of the word are seen; a letter stands for what is cut off
            across = _word_sql(f"(if(length(_t) > {n}, 'x', '') || right(_t, {n}) || ' ' || left(_d, {n}) || if(length(_d) > {n}, 'x', ''))", r)
        tests += [f"{_word_sql(c, r)} AS `{c}{i}`" for c in ("_t", "_d")]
        rule = f"'section', {_quoted(r.section)}, 'pos', {int(r.pos)}, 'keyword', {_quoted(r.keyword)}"
        found = {"title": f"`_t{i}`", "description": f"`_d{i}`", "all": f"`_t{i}` OR `_d{i}` OR {across}"}
        hits += [f"if({test}, named_struct({rule}, 'field', '{field}'), null)" for field, test in found.items()]
    if not rules:
        hits = ["cast(null AS struct<section: string, pos: int, keyword: string, field: string>)"]
    quoted = [f"`{c}`" for c in keep]
    x = x.selectExpr(*quoted, "_t", "_d", *tests).selectExpr(*quoted, f"explode(filter(array({', '.join(hits)}), h -> h IS NOT NULL)) AS _h")
    return x.select(*quoted, "_h.*")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _word_sql(text: str, rule: Rule) -> str:
    """``_word`` as SQL text: a rule set is one parse then, and not a call to the JVM for each part of each rule."""
    folded = rule.folded
    return f"(contains({text}, {_quoted(folded)}) AND regexp_like({text}, {_quoted(java_word(folded))}))" if folded else "false"
