"""Request-log operators: response classes, admission budget, backoff, pacing.

A sequential rate limiter throttles requests one at a time; here the same rules are
table operators over a log ``(seq, url, api, status_code, ts)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    API_DELAY_SECONDS,
    BACKOFF_SECONDS,
    MAX_REQUESTS_PER_API_SOURCE,
    MAX_REQUESTS_PER_DOMAIN,
    MAX_TOTAL_REQUESTS,
    PAGE_DELAY_SECONDS,
)
from ..functions.urls import url_domain
from .ordering import ordered_lag, salted_top_k


def response_classes(log: DataFrame) -> DataFrame:
    """403 -> skipped, 429 -> backed_off, other >= 400 -> error, else ok."""
    c = F.col("status_code")
    cls = (
        F.when(c == 403, F.lit("skipped"))
        .when(c == 429, F.lit("backed_off"))
        .when(c >= 400, F.lit("error"))
        .otherwise(F.lit("ok"))
    )
    return log.withColumn("response_class", cls)


def request_admission(
    log: DataFrame,
    max_total: int = MAX_TOTAL_REQUESTS,
    per_domain: int = MAX_REQUESTS_PER_DOMAIN,
    per_api_domain: int = MAX_REQUESTS_PER_API_SOURCE,
    salts: int = 64,
) -> DataFrame:
    """Which requests the budget admits, in ``seq`` order.

    Sequential rule: refuse when the run total reached ``max_total``, or
    when the domain already had ``limit`` admitted requests (limit is
    ``per_api_domain`` for API calls, else ``per_domain``); refused calls use
    no budget.  Closed form (``per_domain <= per_api_domain``): the first
    ``per_domain`` requests of a domain pass, then only API requests, the
    first ``per_api_domain - per_domain`` of them; the run admits the first
    ``max_total`` of those.  Two window passes, each over a bounded number of
    rows per task: per (domain, salt) the first ``per_domain`` rows and the
    first ``per_api_domain`` API rows survive (every admissible row does), then
    per domain the ranks decide; the run cap is a distributed top-k.
    """
    if per_domain > per_api_domain:
        raise ValueError("per_domain must not exceed per_api_domain")
    r = log.withColumn("domain", url_domain("url"))
    api = F.col("api").cast("int")
    # phase 1, per (domain, salt): keep the first per_domain rows and the first
    # per_api_domain API rows -- every row that can be admitted survives, and at most
    # per_domain + per_api_domain rows per (domain, salt) remain
    salt = F.pmod(F.xxhash64("seq"), F.lit(salts))
    w1 = Window.partitionBy("domain", "_salt").orderBy("seq")
    cand = (
        r.select("seq", "domain", F.coalesce(F.col("api"), F.lit(False)).alias("api"))
        .withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(w1))
        .withColumn("_ra", F.sum(api).over(w1.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("_r") <= per_domain) | (F.col("api") & (F.col("_ra") <= per_api_domain)))
    )
    # phase 2, per domain over that bounded set: global rank, running API count, and the
    # API requests inside the first per_domain
    w2 = Window.partitionBy("domain").orderBy("seq")
    whole = Window.partitionBy("domain")
    ranked = (
        cand.withColumn("rn", F.row_number().over(w2))
        .withColumn("ra", F.sum(api).over(w2.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("ra_head", F.sum(F.when(F.col("rn") <= per_domain, api).otherwise(F.lit(0))).over(whole))
    )
    extra_api = per_api_domain - per_domain
    ok = (F.col("rn") <= per_domain) | (
        F.col("api") & (F.col("ra") - F.col("ra_head") <= extra_api)
    )
    dom_ok = ranked.filter(ok).select("seq")
    granted = dom_ok.orderBy("seq").limit(max_total).withColumn("granted", F.lit(True))
    out = r.join(F.broadcast(granted), "seq", "left")  # at most max_total rows
    # one scalar: the seq at which the run budget ran out (None if it never did)
    n, last = granted.agg(F.count(F.lit(1)), F.max("seq")).first()
    cutoff = last if n >= max_total else None
    is_granted = F.coalesce(F.col("granted"), F.lit(False))
    reason = (
        F.when(is_granted, F.lit("granted"))
        .when(F.lit(cutoff is not None) & (F.col("seq") > F.lit(cutoff if cutoff is not None else 0)), F.lit("total"))
        .otherwise(F.lit("domain"))
    )
    return out.select(*r.columns, is_granted.alias("granted"), reason.alias("decision"))


def backoff_delays(log: DataFrame, ladder=BACKOFF_SECONDS, salts: int = 64) -> DataFrame:
    """Seconds waited after each 429: the n-th 429 of a domain waits ladder[min(n, len)-1]."""
    r = log.withColumn("domain", url_domain("url")).filter(F.col("status_code") == 429)
    steps = len(ladder)
    early = salted_top_k(r.select("seq", "domain"), "domain", ["seq"], steps - 1, salts, "attempt")
    out = r.join(early, ["seq", "domain"], "left")
    ladder_arr = F.array(*[F.lit(int(x)) for x in ladder])
    attempt = F.coalesce(F.col("attempt"), F.lit(steps))
    return out.select(
        *r.columns, attempt.cast("int").alias("attempt"), F.element_at(ladder_arr, attempt.cast("int")).alias("delay_seconds")
    )


def pacing_shortfall(log: DataFrame, page_delay=PAGE_DELAY_SECONDS[0], api_delay=API_DELAY_SECONDS[0]) -> DataFrame:
    """Gap since the previous request of the same domain and the shortfall
    against the minimum delay (the configured minimum replaces the random draw)."""
    r = log.withColumn("domain", url_domain("url"))
    with_prev = ordered_lag(r, "domain", ["ts", "seq"], "ts", "prev_ts")
    gap = F.unix_micros(F.col("ts")) - F.unix_micros(F.col("prev_ts"))
    gap_s = (gap / F.lit(1_000_000.0)).alias("gap_seconds")
    minimum = F.when(F.col("api"), F.lit(float(api_delay))).otherwise(F.lit(float(page_delay)))
    short = F.when(F.col("prev_ts").isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), minimum - gap / F.lit(1_000_000.0))
    )
    return with_prev.select(*r.columns, gap_s, short.alias("shortfall_seconds"))
