"""DuckDB SQL builders for the oracle: the same semantics as the Spark
column functions, written independently in SQL (RE2 regex dialect)."""

from __future__ import annotations

from ..constants import (
    EXPORT_CONTROL_PENALTY,
    EXPORT_CONTROL_PHRASE,
    INTERNSHIP_PATTERNS,
    NETLOC_SCHEMES,
    NO_MATCH_REASON,
    SECURITY_CLEARANCE_PATTERNS,
    STATUSES,
    TRACKING_PARAMETERS,
    TRACKING_PREFIX,
    UI_LOCATION_PATTERN_COUNT,
    US_LOCATION_PATTERNS,
)
from ..functions.regex import WS_CLASS, re2_pattern, re2_word, sql_str
from ..functions.text import fold_literal
from ..functions.urls import URL_PARTS
from ..operators.scoring import PHRASE_LABEL, Rule, body_label, ordered, penalty_label, title_label

WS_RUN = WS_CLASS + "+"


def lit(s: str) -> str:
    return sql_str(s)


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {lit(WS_RUN)}, ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(replace(lower({clean(x)}), 'ß', 'ss'), 'ς', 'σ')"


def ascii_words(x: str) -> str:
    """Non-ASCII letters and digits to '0' so RE2's ASCII \\b sees the same classes."""
    inner = f"regexp_replace(coalesce({x}, ''), {lit(r'[^\P{L}\x00-\x7F]')}, '0', 'g')"
    return f"regexp_replace({inner}, {lit(r'[^\P{N}\x00-\x7F]')}, '0', 'g')"


def any_pattern(text: str, patterns) -> str:
    mapped = ascii_words(text)
    tests = [f"regexp_matches({mapped}, {lit(re2_pattern(p, ic))})" for p, ic in patterns]
    return "(" + " OR ".join(tests) + ")"


def is_us(location: str, mode: str = "strict") -> str:
    if mode == "strict":
        return any_pattern(f"coalesce({location}, '')", US_LOCATION_PATTERNS)
    return any_pattern(f"lower(coalesce({location}, ''))", US_LOCATION_PATTERNS[:UI_LOCATION_PATTERN_COUNT])


def is_intern(title: str, etype: str) -> str:
    return any_pattern(f"concat_ws(' ', {fold(title)}, {fold(etype)})", INTERNSHIP_PATTERNS)


def needs_clearance(title: str, etype: str, desc: str) -> str:
    return any_pattern(
        f"concat_ws(' ', {fold(title)}, {fold(etype)}, {fold(desc)})", SECURITY_CLEARANCE_PATTERNS
    )


def eligible(t="title", e="employment_type", d="description", loc="location") -> str:
    return f"({is_us(loc)} AND NOT {is_intern(t, e)} AND NOT {needs_clearance(t, e, d)})"


def _prepared(x: str) -> str:
    s = f"regexp_replace(coalesce({x}, ''), {lit('^' + WS_CLASS + '+|' + WS_CLASS + '+$')}, '', 'g')"
    s = f"regexp_replace({s}, {lit(r'^[\x{00}-\x{20}]+')}, '')"
    return f"regexp_replace({s}, {lit(r'[\t\r\n]')}, '', 'g')"


def url_part(x: str, idx: int) -> str:
    return f"regexp_extract({_prepared(x)}, {lit(URL_PARTS)}, {idx})"


def _dec(s: str) -> str:
    return f"url_decode(replace({s}, '+', ' '))"


def _enc(s: str) -> str:
    return f"replace(url_encode({s}), '%20', '+')"


def normalize_url(x: str) -> str:
    parts = f"regexp_extract({_prepared(x)}, {lit(URL_PARTS)}, ['sc', 'nl', 'pa', 'qu', 'fr'])"
    scheme = "lower(u.sc)"
    netloc = "lower(u.nl)"
    path = "(CASE WHEN regexp_replace(u.pa, '/+$', '') = '' THEN '/' ELSE regexp_replace(u.pa, '/+$', '') END)"
    name = "(CASE WHEN strpos(p, '=') > 0 THEN substr(p, 1, strpos(p, '=') - 1) ELSE p END)"
    value = "(CASE WHEN strpos(p, '=') > 0 THEN substr(p, strpos(p, '=') + 1) ELSE '' END)"
    pname = _dec("split_part(p, '=', 1)")
    keep = (
        f"NOT (lower({pname}) IN {in_list(TRACKING_PARAMETERS)}) "
        f"AND NOT starts_with(lower({pname}), {lit(TRACKING_PREFIX)})"
    )
    pieces = "list_filter(string_split(u.qu, '&'), lambda p: p <> '')"
    kept = f"list_filter({pieces}, lambda p: {keep})"
    encoded = f"list_transform({kept}, lambda p: {_enc(_dec(name))} || '=' || {_enc(_dec(value))})"
    query = f"array_to_string({encoded}, '&')"
    body = (
        f"(CASE WHEN {netloc} <> '' THEN '//' || {netloc} || {path} "
        f"WHEN starts_with({path}, '//') THEN '//' || {path} "
        f"WHEN {scheme} <> '' AND {scheme} IN {in_list(NETLOC_SCHEMES)} AND starts_with({path}, '/') "
        f"THEN '//' || {path} ELSE {path} END)"
    )
    out = (
        f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END) || {body} || "
        f"(CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"
    )
    bound = f"list_transform([{parts}], lambda u: {out})[1]"
    return f"(CASE WHEN coalesce({x}, '') = '' THEN '' ELSE {bound} END)"


def url_domain(x: str) -> str:
    return f"lower({url_part(x, 2)})"


def iso(ts: str) -> str:
    return f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00')"


def posting_ts(x: str) -> str:
    s = f"coalesce(CAST({x} AS VARCHAR), '')"
    n = f"(CASE WHEN regexp_full_match({s}, '[0-9]{{1,18}}') THEN CAST({s} AS BIGINT) END)"
    secs = f"(CASE WHEN {n} > 10000000000 THEN {n} // 1000 ELSE {n} END)"
    epoch = f"(CASE WHEN {secs} <= 253402300799 THEN make_timestamp({secs} * 1000000) END)"
    fmts = "['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d']"
    parsed = f"try_strptime({s}, {fmts})"
    return f"(CASE WHEN regexp_full_match({s}, '[0-9]+') THEN {epoch} ELSE {parsed} END)"


def normalize_date(x: str) -> str:
    s = f"coalesce(CAST({x} AS VARCHAR), '')"
    n = f"(CASE WHEN regexp_full_match({s}, '[0-9]{{1,18}}') THEN CAST({s} AS BIGINT) END)"
    secs = f"(CASE WHEN {n} > 10000000000 THEN {n} // 1000 ELSE {n} END)"
    epoch = f"(CASE WHEN {secs} <= 253402300799 THEN make_timestamp({secs} * 1000000) END)"
    zone = f"regexp_extract({s}, '(Z|z|[+-][0-9]{{2}}:?[0-9]{{2}})$', 1)"
    body = f"(CASE WHEN {zone} <> '' THEN substr({s}, 1, length({s}) - length({zone})) ELSE {s} END)"
    fmts = "['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d']"
    wall = f"(CASE WHEN NOT regexp_matches({body}, '[A-Za-z]{{3,}}$') THEN try_strptime({body}, {fmts}) END)"
    offset = (
        f"(CASE WHEN {zone} = '' THEN '' WHEN upper({zone}) = 'Z' THEN '+00:00' "
        f"WHEN length({zone}) = 5 THEN substr({zone}, 1, 3) || ':' || substr({zone}, 4, 2) ELSE {zone} END)"
    )
    frac = f"(CASE WHEN epoch_us({wall}) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us({wall}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END)"
    text = f"strftime({wall}, '%Y-%m-%dT%H:%M:%S') || {frac} || {offset}"
    return (
        f"(CASE WHEN {s} = '' THEN '' WHEN regexp_full_match({s}, '[0-9]+') THEN coalesce({iso(epoch)}, {s}) "
        f"WHEN {wall} IS NOT NULL THEN {text} ELSE {s} END)"
    )


def job_hash(title: str, company: str, url: str, location: str) -> str:
    third = f"(CASE WHEN coalesce({url}, '') <> '' THEN {url} ELSE {fold(location)} END)"
    return f"sha256(concat_ws('|', {fold(title)}, {fold(company)}, {third}))"


def status_rank(c: str = "status") -> str:
    whens = " ".join(f"WHEN {lit(s)} THEN {i}" for i, s in enumerate(STATUSES, start=1))
    return f"(CASE {c} {whens} ELSE {len(STATUSES) + 1} END)"


def _word(text: str, rule: Rule) -> str:
    k = rule.folded
    if not k:
        return "false"
    return f"regexp_matches({text}, {lit(re2_word(k))})"


def _dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def score_columns(rules, t: str = "_st", d: str = "_sd", c: str = "_sc") -> tuple[str, str]:
    """(score, reason) SQL expressions over folded title / description / combined."""
    by = ordered(list(rules))
    score = "CAST(0.0 AS DOUBLE)"
    adds, pens = [], []
    for r in by["title_boost"]:
        m = _word(t, r)
        score = f"({score} + (CASE WHEN {m} THEN {_dbl(r.weight)} ELSE {_dbl(0.0)} END))"
        adds.append(f"(CASE WHEN {m} THEN {lit(title_label(r, r.weight))} END)")
    for r in by["include"]:
        mt, md = _word(t, r), _word(d, r)
        score = (
            f"({score} + (CASE WHEN {mt} THEN {_dbl(r.weight * 1.5)} WHEN {md} THEN {_dbl(r.weight)} "
            f"ELSE {_dbl(0.0)} END))"
        )
        adds.append(
            f"(CASE WHEN {mt} THEN {lit(title_label(r, r.weight * 1.5))} WHEN {md} THEN {lit(body_label(r))} END)"
        )
    for r in by["exclude"]:
        m = _word(c, r)
        score = f"({score} - (CASE WHEN {m} THEN {_dbl(r.weight)} ELSE {_dbl(0.0)} END))"
        pens.append(f"(CASE WHEN {m} THEN {lit(penalty_label(r))} END)")
    phrase = fold_literal(EXPORT_CONTROL_PHRASE)
    ph = f"contains({c}, {lit(phrase)})"
    score = f"({score} - (CASE WHEN {ph} THEN {_dbl(float(EXPORT_CONTROL_PENALTY))} ELSE {_dbl(0.0)} END))"
    pens.append(f"(CASE WHEN {ph} THEN {lit(PHRASE_LABEL)} END)")
    added = f"concat_ws(', ', {', '.join(adds)})" if adds else "''"
    pen = f"concat_ws(', ', {', '.join(pens)})"
    reason = (
        f"((CASE WHEN {added} <> '' THEN 'Matched: ' || {added} ELSE {lit(NO_MATCH_REASON)} END) || "
        f"(CASE WHEN {pen} <> '' THEN '. Penalties: ' || {pen} ELSE '' END))"
    )
    final = f"CAST(greatest(0.0, least(100.0, round_even({score}, 0))) AS INTEGER)"
    return final, reason


# --- markup -------------------------------------------------------------------
from ..functions import markup as M  # noqa: E402


_NAMES = "MAP {" + ", ".join(f"{lit(name)}: {lit(text)}" for name, text in M.NAMES.items()) + "}"


def _ref_text(r: str) -> str:
    digits = f"regexp_extract({r}, {lit(M.REF_DIGITS)}, 1)"
    code = (
        f"(CASE WHEN length({digits}) > {M.MAX_REF_DIGITS} THEN 1114112 "
        f"WHEN lower(substr({r}, 3, 1)) = 'x' THEN coalesce(TRY_CAST('0x' || {digits} AS BIGINT), 0) "
        f"ELSE coalesce(TRY_CAST({digits} AS BIGINT), 0) END)"
    )
    mapped = f"(CASE WHEN {code} BETWEEN 128 AND 159 THEN {list(M.C1_CODES)}[{code} - 127] ELSE {code} END)"
    valid = f"({code} > 0 AND {code} <= 1114111 AND NOT ({code} >= 55296 AND {code} <= 57343))"
    dropped = " OR ".join([f"({code} % 65536 >= 65534 AND {code} <= 1114111)", *[f"{code} BETWEEN {low} AND {high}" for low, high in M.DROPPED_CODES]])
    char = f"(CASE WHEN {dropped} THEN '' WHEN {valid} THEN chr(CAST({mapped} AS INTEGER)) ELSE '�' END)"
    known = f"regexp_extract({r}, {lit(M.PREFIX)})"
    named = f"coalesce({_NAMES}[{r}], CASE WHEN {known} <> '' THEN {_NAMES}[{known}] || substr({r}, length({known}) + 1) END, {r})"
    return f"(CASE WHEN starts_with({r}, '&#') THEN {char} ELSE {named} END)"


def decode_entities(x: str) -> str:
    refs = f"regexp_extract_all({x}, {lit('(' + M.REFERENCE + ')')}, 1)"
    pieces = f"regexp_split_to_array({x}, {lit(M.REFERENCE)})"
    joined = (
        f"list_transform([{{'p': {pieces}, 'r': {refs}}}], lambda z: z.p[1] || "
        f"array_to_string(list_transform(z.r, lambda r, i: {_ref_text('r')} || z.p[i + 1]), ''))[1]"
    )
    return f"(CASE WHEN len({refs}) = 0 THEN {x} ELSE {joined} END)"


def _parts(x: str, whole: str, simple: str) -> str:
    """``whole`` of z.h, the part that tokens cover, and ``simple`` of z.r and z.l, the rest up to its last '>' and what is behind."""
    head = f"(SELECT {{'h': h, 't': substr(x, length(h) + 1)}} FROM (SELECT x, regexp_extract(x, {lit(M.plain(M.HEAD))}) AS h FROM (SELECT {x} AS x)))"
    return f"""(SELECT CASE WHEN t = '' THEN {whole} ELSE {whole} || {simple} END
        FROM (SELECT y.h AS h, y.t AS t, split_part(y.t, '>', -1) AS l, left(y.t, length(y.t) - length(split_part(y.t, '>', -1))) AS r FROM (SELECT {head} AS y)))"""


def markup_text(x: str) -> str:
    s = _parts(f"coalesce({x}, '')", f"regexp_replace(h, {lit(M.plain(M.MARKUP))}, ' ', 'g')", f"regexp_replace(r, {lit(M.plain(M.SIMPLE))}, ' ', 'g') || l")
    return clean(decode_entities(s))


def html_to_text(x: str) -> str:
    return markup_text(decode_entities(f"coalesce({x}, '')"))


# --- links ----------------------------------------------------------------------
def safe_link(x: str) -> str:
    scheme = f"lower(regexp_extract(coalesce({x}, ''), '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"
    return f"(CASE WHEN {scheme} IN ('', 'http', 'https') THEN coalesce({x}, '') ELSE '#' END)"


def _remove_dots(segs: str) -> str:
    step = (
        "lambda acc, s: CASE WHEN s = '..' THEN acc[1:greatest(len(acc) - 1, 0)] "
        "WHEN s = '.' THEN acc ELSE list_append(acc, s) END"
    )
    resolved = f"list_reduce({segs}, {step}, CAST([] AS VARCHAR[]))"
    last = f"{segs}[-1]"
    resolved = f"(CASE WHEN {last} IN ('.', '..') THEN list_append({resolved}, '') ELSE {resolved} END)"
    return f"array_to_string({resolved}, '/')"


def resolve_url(base: str, href: str) -> str:
    b = f"regexp_extract(coalesce({base}, ''), {lit(URL_PARTS)}, ['sc', 'nl', 'pa', 'qu', 'fr'])"
    h = f"regexp_extract(coalesce({href}, ''), {lit(URL_PARTS)}, ['sc', 'nl', 'pa', 'qu', 'fr'])"
    hq = f"regexp_extract(coalesce({href}, ''), {lit(r'(?s)^[^?#]*(\?[^#]*)?')}, 1)"
    hf = f"regexp_extract(coalesce({href}, ''), {lit(r'(?s)^[^#]*(#.*)?')}, 1)"
    body = (
        "(CASE WHEN B.sc <> '' THEN B.sc || ':' ELSE '' END) || (CASE WHEN B.nl <> '' THEN '//' || B.nl ELSE '' END)"
    )
    base_dir = "(CASE WHEN string_split(B.pa, '/')[-1] <> '' THEN string_split(B.pa, '/')[1:len(string_split(B.pa, '/')) - 1] ELSE string_split(B.pa, '/') END)"
    rel = f"list_concat({base_dir}, string_split(H.pa, '/'))"
    rel_f = (
        f"(CASE WHEN len({rel}) > 2 THEN list_concat(list_concat({rel}[1:1], "
        f"list_filter({rel}[2:len({rel}) - 1], lambda s: s <> '')), {rel}[len({rel}):len({rel})]) ELSE {rel} END)"
    )

    def with_path(p: str) -> str:
        p1 = f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"
        p2 = f"(CASE WHEN B.nl <> '' AND NOT starts_with({p1}, '/') THEN '/' || {p1} ELSE {p1} END)"
        return f"{body} || {p2} || HQ || HF"

    abs_path = with_path(_remove_dots("string_split(H.pa, '/')"))
    rel_path = with_path(_remove_dots(rel_f))
    expr = (
        f"CASE WHEN HREF = '' THEN BASE "
        f"WHEN H.sc <> '' THEN HREF "
        f"WHEN starts_with(HREF, '//') AND H.nl <> '' THEN B.sc || ':' || HREF "
        f"WHEN H.pa = '' THEN {body} || B.pa || (CASE WHEN HQ <> '' THEN HQ WHEN B.qu <> '' THEN '?' || B.qu ELSE '' END) || HF "
        f"WHEN starts_with(H.pa, '/') THEN {abs_path} "
        f"ELSE {rel_path} END"
    )
    packed = f"{{'B': {b}, 'H': {h}, 'HQ': {hq}, 'HF': {hf}, 'BASE': coalesce({base}, ''), 'HREF': coalesce({href}, '')}}"
    lam = (
        expr.replace("B.", "z.B.").replace("H.", "z.H.").replace("HQ", "z.HQ").replace("HF", "z.HF")
        .replace("HREF", "z.HREF").replace("BASE", "z.BASE")
    )
    return f"list_transform([{packed}], lambda z: {lam})[1]"


_SPACE = r"[ \t\n\r\f]"
_ANCHOR, _ANCHOR_END = r"(?s)^<(?i:a)[ \t\n\r\f/>]", r"(?s)^</[ \t\n\r\f]*(?i:a)[ \t\n\r\f/>]"


def _attr(tag: str, name: str) -> str:
    """Value of the last attribute of that name, its references decoded; '' without value, NULL without attribute."""
    inside = f"regexp_replace({tag}, '^<[^ \t\n\r\f/>]*|>$', '', 'g')"
    found = f"list_filter(regexp_extract_all({inside}, {lit(M.plain(M.ATTRIBUTE))}), lambda a: regexp_matches(a, {lit(f'(?i)^{name}(?:{_SPACE}*=|$)')}))[-1]"
    value = f"regexp_replace({found}, {lit(f'(?s)^[^=]+(?:{_SPACE}*=+{_SPACE}*)?')}, '')"
    return f"CASE WHEN left({value}, 1) IN ('\"', chr(39)) THEN substr({value}, 2, length({value}) - 2) ELSE {value} END"


def page_links_sql(pages: str = "pages") -> str:
    """Tokens of each page as rows; an anchor's text is that of the tokens up to the next token that begins or ends an anchor."""
    found = _parts("coalesce(html, '')", f"regexp_extract_all(h, {lit(M.plain(M.TOKEN))})", f"regexp_extract_all(r, {lit(M.plain(M.SIMPLE_TOKEN))}) || [replace(l, '<', '&lt;')]")
    rows = f"SELECT page_id, page_url, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT page_id, url AS page_url, {found} AS ts FROM {pages})"
    marked = f"SELECT *, regexp_matches(t, {lit(_ANCHOR)}) AS opens, regexp_matches(t, {lit(_ANCHOR)}) OR regexp_matches(t, {lit(_ANCHOR_END)}) AS marks, length(t) > 1 AND left(t, 1) = '<' AS tag FROM ({rows})"
    grouped = f"SELECT *, sum(CAST(marks AS INTEGER)) OVER (PARTITION BY page_id ORDER BY i) AS g FROM ({marked})"
    anchors = f"""SELECT page_id, any_value(page_url) AS page_url, g, bool_or(opens) AS anchor, arg_min(t, i) AS a,
        coalesce(string_agg(CASE WHEN tag THEN ' ' ELSE t END, '' ORDER BY i), '') AS spaced,
        coalesce(string_agg(CASE WHEN NOT tag THEN t END, '' ORDER BY i), '') AS raw_text
      FROM ({grouped}) WHERE g > 0 GROUP BY page_id, g"""
    attrs = f"""SELECT page_id, page_url, row_number() OVER (PARTITION BY page_id ORDER BY g) AS pos, spaced, raw_text,
        {_attr('a', 'href')} AS href0, {_attr('a', 'title')} AS title0, {_attr('a', 'aria-label')} AS label0 FROM ({anchors}) WHERE anchor"""
    return f"""SELECT page_id, page_url, CAST(pos AS BIGINT) AS pos, {decode_entities('href0')} AS href, {clean(decode_entities('spaced'))} AS text, raw_text,
        {decode_entities('title0')} AS title_attr, {decode_entities('label0')} AS aria_label FROM ({attrs})"""
