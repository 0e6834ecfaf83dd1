"""URL column functions: normalisation, domain, relative resolution, safe links.

The URL is split once with an RFC 3986 regex (``regexp_extract``); query
parameters are handled with ``split`` / ``filter`` / ``transform``.  No UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NETLOC_SCHEMES, TRACKING_PARAMETERS, TRACKING_PREFIX
from .regex import WS_CLASS
from .text import let, remembered

# scheme, authority, path, query, fragment
URL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_STRIP = "^" + WS_CLASS + "+|" + WS_CLASS + "+$"
_C0_LEAD = r"^[\x{00}-\x{20}]+"
_UNSAFE = r"[\t\r\n]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _prepared(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), _STRIP, "")
    s = F.regexp_replace(s, _C0_LEAD, "")
    return F.regexp_replace(s, _UNSAFE, "")


def url_part(c, idx: int) -> Column:
    return F.regexp_extract(_prepared(_col(c)), URL_PARTS, idx)


def _form_decode(s: Column) -> Column:
    # '+' is a space, then percent-decoding; undecodable text is kept as is
    return F.coalesce(F.try_url_decode(s), F.replace(s, F.lit("+"), F.lit(" ")))


def _form_encode(s: Column) -> Column:
    # unreserved set A-Z a-z 0-9 _ . - ~ kept, space as '+'
    return F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _clean_query(query: Column) -> Column:
    pieces = F.filter(F.split(query, "&", -1), lambda p: p != "")

    def keep(p: Column) -> Column:
        name = F.lower(_form_decode(F.substring_index(p, "=", 1)))
        return ~name.isin(*TRACKING_PARAMETERS) & ~name.startswith(TRACKING_PREFIX)

    def encode(p: Column) -> Column:
        pos = F.instr(p, "=")
        name = F.when(pos > 0, F.substring(p, F.lit(1), pos - 1)).otherwise(p)
        value = F.when(pos > 0, F.substring(p, pos + 1, F.lit(1 << 30))).otherwise(F.lit(""))
        return F.concat(_form_encode(_form_decode(name)), F.lit("="), _form_encode(_form_decode(value)))

    return F.array_join(F.transform(F.filter(pieces, keep), encode), "&")


@remembered
def normalize_url(c) -> Column:
    """Trim; lower-case scheme and authority; drop fragment, trailing '/',
    tracking parameters; re-encode the query.  NULL or '' gives ''."""
    c = _col(c)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(let(let(_prepared(c), _split), _joined))


def _split(s: Column) -> Column:
    """Scheme, authority, path and query of a prepared URL, each normalised."""
    path = F.regexp_replace(F.regexp_extract(s, URL_PARTS, 3), "/+$", "")
    return F.struct(
        F.lower(F.regexp_extract(s, URL_PARTS, 1)).alias("s"),
        F.lower(F.regexp_extract(s, URL_PARTS, 2)).alias("n"),
        let(path, lambda p: F.when(p == "", F.lit("/")).otherwise(p)).alias("p"),
        _clean_query(F.regexp_extract(s, URL_PARTS, 4)).alias("q"),
    )


def _joined(z: Column) -> Column:
    scheme, netloc, path, query = (z[x] for x in ("s", "n", "p", "q"))
    body = (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, path))
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(
            (scheme != "") & scheme.isin(*NETLOC_SCHEMES) & path.startswith("/"),
            F.concat(F.lit("//"), path),
        )
        .otherwise(path)
    )
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        body,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


@remembered
def url_domain(c) -> Column:
    """Lower-cased authority (host and port) of a URL; '' when there is none."""
    return F.lower(url_part(c, 2))


@remembered
def safe_link(c) -> Column:
    """The URL when its scheme is http or https (or it has none), else '#'."""
    c = F.coalesce(_col(c), F.lit(""))
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.when(scheme.isin("", "http", "https"), c).otherwise(F.lit("#"))


def _remove_dots(segments: Column) -> Column:
    def step(acc: Column, seg: Column) -> Column:
        return F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(seg == ".", acc).otherwise(F.array_append(acc, seg))

    resolved = F.aggregate(segments, F.array().cast("array<string>"), step)
    open_end = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(resolved, open_end), "/")


def _relative_segments(b_path: Column, h_path: Column) -> Column:
    """Segments of the base's folder followed by the link's; empty ones between the first and the last go."""
    base = let(F.split(b_path, "/", -1), lambda b: F.when(F.element_at(b, -1) != "", F.slice(b, 1, F.size(b) - 1)).otherwise(b))
    return let(
        F.concat(base, F.split(h_path, "/", -1)),
        lambda x: F.filter(x, lambda s, i: (s != "") | (i == 0) | (i == F.size(x) - 1)),
    )


#: Scheme, authority, path, query with its sign and fragment with its sign of a link; the base needs the first four.
_LINK_PARTS = (("s", URL_PARTS, 1), ("n", URL_PARTS, 2), ("p", URL_PARTS, 3), ("q", r"(?s)^[^?#]*(\?[^#]*)?", 1), ("f", r"(?s)^[^#]*(#.*)?", 1))


@remembered
def resolve_url(base, href) -> Column:
    """Resolve ``href`` against ``base`` the way a browser link does."""

    def parts(c: Column) -> Column:
        return F.struct(c.alias("u"), *[F.regexp_extract(c, pattern, group).alias(name) for name, pattern, group in _LINK_PARTS])

    def resolved(z: Column) -> Column:
        b, h = z["b"], z["h"]
        origin = F.concat(F.when(b["s"] != "", F.concat(b["s"], F.lit(":"))).otherwise(F.lit("")), F.when(b["n"] != "", F.concat(F.lit("//"), b["n"])).otherwise(F.lit("")))
        segments = F.when(h["p"].startswith("/"), F.split(h["p"], "/", -1)).otherwise(_relative_segments(b["p"], h["p"]))
        path = let(
            let(segments, _remove_dots),
            lambda p: F.when(p == "", F.lit("/")).when((b["n"] != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p),
        )
        # an empty query sign of the base doesn't carry over
        query = F.when(h["q"] != "", h["q"]).when(b["q"] != "?", b["q"]).otherwise(F.lit(""))
        return (
            F.when(h["u"] == "", b["u"])
            .when(h["s"] != "", h["u"])
            .when(h["u"].startswith("//") & (h["n"] != ""), F.concat(b["s"], F.lit(":"), h["u"]))
            .otherwise(F.concat(origin, F.when(h["p"] == "", F.concat(b["p"], query)).otherwise(F.concat(path, h["q"])), h["f"]))
        )

    pair = F.struct(parts(F.coalesce(_col(base), F.lit(""))).alias("b"), parts(F.coalesce(_col(href), F.lit(""))).alias("h"))
    return let(pair, resolved)
