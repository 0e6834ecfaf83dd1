"""Record identity: SHA-256 posting hash and the single merge key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_text, remembered


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@remembered
def job_hash(title, company, url, location) -> Column:
    """sha256(fold(title) | fold(company) | url) with fold(location) when url is ''.

    ``url`` must already be normalised.
    """
    url = F.coalesce(_col(url), F.lit(""))
    third = F.when(url != "", url).otherwise(fold_text(location))
    return F.sha2(F.concat_ws("|", fold_text(title), fold_text(company), third), 256)


@remembered
def entity_key(url, job_hash_col) -> Column:
    """The stored row a posting merges into: its URL, else its hash.

    Equal to "look up by hash, then by URL": a stored row's URL never
    changes, a hash hit implies the same URL, and a URL hit implies it
    trivially.
    """
    url = F.coalesce(_col(url), F.lit(""))
    return F.when(url != "", url).otherwise(_col(job_hash_col))


def legacy_key(title, company, location, url) -> Column:
    """Browser-side fallback key: the four fields joined by '||'."""
    return F.concat_ws(
        "||", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in (title, company, location, url)]
    )


def job_key(job_hash_col, title, company, location, url) -> Column:
    h = F.coalesce(_col(job_hash_col), F.lit(""))
    return F.when(h != "", h).otherwise(legacy_key(title, company, location, url))
