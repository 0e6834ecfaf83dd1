"""DuckDB oracle SQL for every query with an SQL counterpart.

Each query is one statement: a shared ``WITH`` prefix of fixture views
(the same definitions as ``sources.fixtures``) followed by the query.
DuckDB only evaluates the CTEs a query references.
"""

from __future__ import annotations

from ..constants import (
    CLEARANCE_EXCLUSION_PHRASE,
    EXPORT_CONTROL_PHRASE,
    JOBS_SHEET_COLUMNS,
    PUBLIC_FIELDS,
    RUN_LOG_COLUMNS,
    SNAPSHOTS_KEPT,
    STATUSES,
    SUMMARY_METRICS,
    SUPPORTED_SOURCE_TYPES,
)
from ..sources import fixtures as fx
from . import sqlparts as q

L = q.lit


def _arr(values) -> str:
    return "[" + ", ".join(L(v) for v in values) + "]"


def _pick(values, idx: str) -> str:
    return f"{_arr(values)}[({idx}) % {len(values)} + 1]"


def _postings(shift: int) -> str:
    i = "d.doc_id"
    epoch = f"({fx.EPOCH_BASE} + {i} * 3600)"
    date_text = (
        f"CASE WHEN {i} % 8 = 0 THEN CAST({epoch} AS VARCHAR) "
        f"WHEN {i} % 8 = 1 THEN CAST({epoch} * 1000 + 123 AS VARCHAR) "
        f"ELSE {_pick(fx.DATE_TEXTS, f'{i} % 8 - 2')} END"
    )
    return f"""SELECT {i} AS seq, split_part(d.text, chr(10), 1) AS title, d.source AS company,
      {_pick(fx.LOCATIONS, f'{i} + {shift}')} AS location, coalesce(p.url, '') AS url,
      d.source AS source_name, {_pick(fx.SOURCE_TYPES, i)} AS source_type, d.text AS description,
      {_pick(fx.SALARIES, i)} AS salary, {_pick(fx.EMPLOYMENT_TYPES, i)} AS employment_type,
      {date_text} AS date_posted
    FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id"""


def _normalized(src: str) -> str:
    return f"""SELECT seq, title, company, location, url, source_name, source_type, description, salary,
        employment_type, date_posted, raw_data, job_hash,
        CASE WHEN url <> '' THEN url ELSE job_hash END AS entity_key
    FROM (SELECT *, {q.job_hash('title', 'company', 'url', 'location')} AS job_hash
      FROM (SELECT seq, {q.clean('title')} AS title, {q.clean('company')} AS company,
          {q.clean('location')} AS location, {q.normalize_url('url')} AS url,
          coalesce(source_name, '') AS source_name, coalesce(source_type, '') AS source_type,
          {q.clean('description')} AS description, {q.clean('salary')} AS salary,
          {q.clean('employment_type')} AS employment_type, {q.normalize_date('date_posted')} AS date_posted,
          '{{}}' AS raw_data
        FROM {src}))"""


def _scored(src: str, rules) -> str:
    score, reason = q.score_columns(rules)
    return f"""SELECT * EXCLUDE (_st, _sd, _sc), {score} AS match_score, {reason} AS match_reason
    FROM (SELECT *, _st || ' ' || _sd AS _sc
      FROM (SELECT *, {q.fold('title')} AS _st, {q.fold('description')} AS _sd
        FROM {src} WHERE {q.eligible()}))"""


FIELDS = (
    "title", "company", "location", "url", "source_name", "source_type", "description", "salary",
    "employment_type", "date_posted", "raw_data", "match_score", "match_reason",
)


def _collapsed(src: str) -> str:
    last = ", ".join(f"arg_max({c}, seq) AS {c}" for c in FIELDS)
    return f"""SELECT entity_key, arg_min(job_hash, seq) AS job_hash, min(seq) AS first_seq,
        max(seq) AS last_seq, count(*) AS sightings, {last}
    FROM {src} GROUP BY entity_key"""


def _ts(value: str) -> str:
    return f"TIMESTAMP {L(value)}"


def _first_store(src: str, as_of: str) -> str:
    t = _ts(as_of)
    return f"""SELECT job_hash, entity_key, title, company, location, url, source_name, source_type,
        description, salary, employment_type, date_posted, raw_data, {t} AS date_found, {t} AS last_seen,
        'New' AS status, match_score, match_reason, '' AS notes, {t} AS created_at, {t} AS updated_at
    FROM {src}"""


def _upsert(stored: str, batch: str, as_of: str) -> str:
    t = _ts(as_of)
    fresh = ", ".join(
        f"CASE WHEN b.entity_key IS NOT NULL THEN b.{c} ELSE s.{c} END AS {c}" for c in FIELDS[:11]
    )
    return f"""SELECT coalesce(s.job_hash, b.job_hash) AS job_hash, coalesce(s.entity_key, b.entity_key) AS entity_key,
        {fresh},
        CASE WHEN s.entity_key IS NOT NULL THEN s.date_found ELSE {t} END AS date_found,
        CASE WHEN b.entity_key IS NOT NULL THEN {t} ELSE s.last_seen END AS last_seen,
        CASE WHEN s.entity_key IS NOT NULL THEN s.status ELSE 'New' END AS status,
        CASE WHEN b.entity_key IS NOT NULL THEN b.match_score ELSE s.match_score END AS match_score,
        CASE WHEN b.entity_key IS NOT NULL THEN b.match_reason ELSE s.match_reason END AS match_reason,
        CASE WHEN s.entity_key IS NOT NULL THEN s.notes ELSE '' END AS notes,
        CASE WHEN s.entity_key IS NOT NULL THEN s.created_at ELSE {t} END AS created_at,
        CASE WHEN b.entity_key IS NOT NULL THEN {t} ELSE s.updated_at END AS updated_at,
        s.entity_key IS NULL AS is_new
    FROM {stored} s FULL OUTER JOIN {batch} b ON s.entity_key = b.entity_key"""


def _edits() -> str:
    i = "l.doc_id"
    status = (
        f"CASE WHEN l.toxic = 1 THEN 'Rejected' WHEN l.quality = 1 THEN 'Interested' "
        f"WHEN {i} % 5 = 0 THEN 'Maybe' WHEN {i} % 5 = 1 THEN '' ELSE 'Applied' END"
    )
    return f"""SELECT CAST({i} * 4 + l.quality * 2 + l.toxic AS BIGINT) AS seq, {i} AS doc_id,
        CASE WHEN {i} % 3 = 0 THEN '' ELSE coalesce(n.job_hash, '') END AS job_hash,
        coalesce(p.url, '') AS url, {status} AS status,
        CASE WHEN {i} % 4 = 0 THEN NULL ELSE 'q' || CAST(l.quality AS VARCHAR) || ' t' || CAST(l.toxic AS VARCHAR) END AS notes
    FROM labels l LEFT JOIN n_postings n ON n.seq = {i} LEFT JOIN pages p ON p.page_id = {i}"""


def _edits_clean() -> str:
    return f"""SELECT seq, coalesce(job_hash, '') AS job_hash, {q.normalize_url('url')} AS url,
        coalesce(nullif(status, ''), 'New') AS status, coalesce(notes, '') AS notes
    FROM v_edits"""


def _last_edit(where: str, key: str) -> str:
    return f"""SELECT {key} AS k, max(seq) AS eseq, arg_max(status, seq) AS estatus, arg_max(notes, seq) AS enotes
    FROM e_clean WHERE status IN {q.in_list(STATUSES)} AND {where} GROUP BY {key}"""


def _reviewed(as_of: str) -> str:
    t = _ts(as_of)
    use_h = "(h.eseq IS NOT NULL AND (u.eseq IS NULL OR h.eseq >= u.eseq))"
    return f"""SELECT s.* REPLACE (
        CASE WHEN {use_h} THEN h.estatus WHEN u.eseq IS NOT NULL THEN u.estatus ELSE s.status END AS status,
        CASE WHEN {use_h} THEN h.enotes WHEN u.eseq IS NOT NULL THEN u.enotes ELSE s.notes END AS notes,
        CASE WHEN h.eseq IS NOT NULL OR u.eseq IS NOT NULL THEN {t} ELSE s.updated_at END AS updated_at),
        (h.eseq IS NOT NULL OR u.eseq IS NOT NULL) AS edited
    FROM stored1 s LEFT JOIN e_hash h ON h.k = s.job_hash LEFT JOIN e_url u ON u.k = s.url"""


def _scored_all(src: str, rules) -> str:
    score, reason = q.score_columns(rules)
    return f"""SELECT * EXCLUDE (_st, _sd, _sc), {score} AS match_score, {reason} AS match_reason
    FROM (SELECT *, _st || ' ' || _sd AS _sc
      FROM (SELECT *, {q.fold('title')} AS _st, {q.fold('description')} AS _sd FROM {src}))"""


def _sources() -> str:
    typ = _pick(fx.DIMENSION_TYPES, "idx")
    return f"""SELECT idx AS pos, source AS name, {typ} AS type, idx % 7 <> 6 AS enabled,
        CASE WHEN idx % 3 = 0 THEN NULL ELSE upper(source) END AS company,
        CASE WHEN lower({typ}) = 'html' THEN 'https://' || source || '.example.com/careers' ELSE '' END AS url,
        CASE WHEN lower({typ}) = 'lever' THEN source END AS company_slug,
        CASE WHEN lower({typ}) IN ('ashby', 'greenhouse') THEN source || '-board' END AS board_token,
        'Fixture source ' || source AS notes
    FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS idx FROM documents)"""


def _unsupported() -> str:
    return f"""SELECT name, type, pos, name || ': ValueError: Unsupported source type: ' || lower(coalesce(type, '')) AS error
    FROM v_sources WHERE coalesce(enabled, false) AND lower(coalesce(type, '')) NOT IN {q.in_list(SUPPORTED_SOURCE_TYPES)}"""


def _run_checks(as_of: str, src: str, seq: int) -> str:
    return f"""SELECT s.name AS source_name, {_ts(as_of)} AS last_checked,
        CASE WHEN u.error IS NOT NULL THEN u.error
             ELSE 'Success: ' || CAST(coalesce(c.n, 0) AS VARCHAR) || ' jobs' END AS last_result,
        CAST({seq} AS BIGINT) AS seq
    FROM v_sources s
      LEFT JOIN (SELECT source_name, count(*) AS n FROM {src} GROUP BY source_name) c ON c.source_name = s.name
      LEFT JOIN unsupported u ON u.name = s.name
    WHERE coalesce(s.enabled, false)"""


def _latest(old: str, new: str) -> str:
    return f"""SELECT source_name, arg_max(last_checked, (last_checked, seq)) AS last_checked,
        arg_max(last_result, (last_checked, seq)) AS last_result, arg_max(last_checked, (last_checked, seq)) AS updated_at
    FROM (SELECT * FROM {old} UNION ALL SELECT * FROM {new}) GROUP BY source_name"""


def _runs() -> str:
    return """SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS run_time,
        CAST(count(DISTINCT event_type) AS INTEGER) AS sources_checked, count(*) AS jobs_found,
        count(*) FILTER (WHERE event_type = 'signup') AS new_jobs_added,
        CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0
             THEN CAST(count(*) FILTER (WHERE event_type = 'error') AS VARCHAR) || ' errors' ELSE '' END AS errors,
        max(value) AS duration_seconds
    FROM events GROUP BY 1"""


def _requests() -> str:
    return """SELECT event_id AS seq, 'https://' || event_type || '.Example.com/jobs/' || CAST(user_id AS VARCHAR) AS url,
        user_id % 2 = 0 AS api,
        CASE WHEN event_type = 'error' THEN (CASE WHEN user_id % 3 = 0 THEN 429 WHEN user_id % 3 = 1 THEN 403 ELSE 500 END)
             ELSE 200 END AS status_code,
        CAST(ts AS TIMESTAMP) AS ts
    FROM events"""


def _feed() -> str:
    cols = []
    for c in PUBLIC_FIELDS:
        if c in ("date_found", "last_seen"):
            cols.append(f"coalesce({q.iso(c)}, '') AS {c}")
        elif c == "match_score":
            cols.append(c)
        else:
            cols.append(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}")
    return f"""SELECT {', '.join(cols)}, row_number() OVER (ORDER BY {RANK_ORDER}) AS feed_pos, entity_key
    FROM reviewed WHERE match_score >= 20"""


def _actions() -> str:
    t = "c.turn"
    action = (
        f"CASE WHEN c.role = 'user' THEN (CASE WHEN {t} % 4 = 0 THEN 'applyed' ELSE 'applied' END) "
        f"WHEN c.role = 'assistant' THEN 'not-fit' ELSE 'review' END"
    )
    return f"""SELECT c.conv_id * 1000 + {t} AS seq,
        CASE WHEN {t} % 3 = 0 THEN concat_ws('||', f.title, f.company, f.location, f.url) ELSE f.job_hash END AS job_key,
        {action} AS action
    FROM conversations c JOIN feed_seq f ON f.seq = c.conv_id"""


def ctes() -> list[tuple[str, str]]:
    rules = fx.FIXTURE_RULES
    return [
        ("v_postings", _postings(0)),
        ("v_postings2", _postings(1)),
        ("n_postings", _normalized("v_postings")),
        ("n_postings2", _normalized("v_postings2")),
        ("scored1", _scored("n_postings", rules)),
        ("scored2", _scored("n_postings2", rules)),
        ("batch1", _collapsed("scored1")),
        ("batch2", _collapsed("scored2")),
        ("stored1", _first_store("batch1", fx.AS_OF_FIRST)),
        ("v_edits", _edits()),
        ("e_clean", _edits_clean()),
        ("e_hash", _last_edit("job_hash <> ''", "job_hash")),
        ("e_url", _last_edit("job_hash = '' AND url <> ''", "url")),
        ("reviewed_e", _reviewed(fx.AS_OF_EDITS)),
        ("reviewed", "SELECT * EXCLUDE (edited) FROM reviewed_e"),
        ("stored2_u", _upsert("reviewed", "batch2", fx.AS_OF_SECOND)),
        ("stored2", "SELECT * EXCLUDE (is_new) FROM stored2_u"),
        ("scored_all", _scored_all("n_postings", rules)),
        ("legacy", _first_store("(" + _collapsed("scored_all") + ")", fx.AS_OF_FIRST)),
        ("v_sources", _sources()),
        ("unsupported", _unsupported()),
        ("fetched1", "SELECT p.* FROM v_postings p JOIN v_sources s ON s.name = p.source_name WHERE coalesce(s.enabled, false)"),
        ("fetched2", "SELECT p.* FROM v_postings2 p JOIN v_sources s ON s.name = p.source_name WHERE coalesce(s.enabled, false)"),
        ("checks1", _run_checks(fx.AS_OF_FIRST, "v_postings", 0)),
        ("checks2", _run_checks(fx.AS_OF_SECOND, "v_postings2", 1)),
        ("v_runs", _runs()),
        ("v_requests", _requests()),
        ("v_sightings", """SELECT event_id AS seq, event_type || ':' || CAST(user_id AS VARCHAR) AS entity,
            CAST(ts AS TIMESTAMP) AS run_time, value AS score FROM events"""),
        ("feed", _feed()),
        ("feed_seq", "SELECT f.*, l.seq FROM feed f JOIN (SELECT entity_key, max(seq) AS seq FROM scored1 GROUP BY entity_key) l ON l.entity_key = f.entity_key"),
        ("v_actions", _actions()),
        ("action_map", "SELECT * FROM (SELECT job_key, arg_max(action, seq) AS action FROM v_actions GROUP BY job_key) WHERE action <> 'review'"),
        ("migrated", _migrated()),
        ("buckets", _buckets()),
        ("links", q.page_links_sql()),
    ]


def _migrated() -> str:
    fixed = "SELECT job_key, CASE WHEN action = 'applyed' THEN 'applied' ELSE action END AS action FROM action_map"
    keyed = """SELECT concat_ws('||', title, company, location, url) AS legacy_key, job_hash, feed_pos FROM feed
        WHERE job_hash <> '' AND concat_ws('||', title, company, location, url) <> job_hash"""
    first = f"SELECT legacy_key, arg_min(job_hash, feed_pos) AS prim FROM ({keyed}) GROUP BY legacy_key"
    return f"""SELECT CASE WHEN f.prim IS NOT NULL AND h.job_key IS NULL THEN f.prim ELSE a.job_key END AS job_key, a.action
    FROM ({fixed}) a LEFT JOIN ({first}) f ON f.legacy_key = a.job_key
      LEFT JOIN (SELECT DISTINCT job_key FROM ({fixed})) h ON h.job_key = f.prim"""


def _buckets() -> str:
    key = "CASE WHEN f.job_hash <> '' THEN f.job_hash ELSE concat_ws('||', f.title, f.company, f.location, f.url) END"
    return f"""SELECT f.*, CASE WHEN m.action IN ('applied', 'applyed') THEN 'applied'
            WHEN m.action = 'not-fit' THEN 'not-fit' ELSE 'review' END AS bucket
    FROM feed f LEFT JOIN migrated m ON m.job_key = {key}"""


def with_ctes(body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes()) + "\n" + body


PUBLIC_ISO = ("date_found", "last_seen")
RANK_ORDER = f"{q.status_rank()}, match_score DESC, date_found DESC, job_hash, entity_key"


def _iso_all(cols) -> str:
    return ", ".join(f"{q.iso(c)} AS {c}" if c in ("date_found", "last_seen", "created_at", "updated_at") else c for c in cols)


PURGE_PHRASES = (EXPORT_CONTROL_PHRASE, CLEARANCE_EXCLUSION_PHRASE, "Licensed under the Apache License")
_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LO = "abcdefghijklmnopqrstuvwxyz"


def _phrase(text: str) -> str:
    pat = L("%" + text.translate(str.maketrans(_UP, _LO)) + "%")
    tests = [f"translate({c}, '{_UP}', '{_LO}') LIKE {pat}" for c in ("title", "description", "match_reason")]
    return "(" + " OR ".join(tests) + ")"


def _next_slot(ts: str, slots) -> str:
    from ..functions.dates import parse_slots

    cands = []
    for h, m in parse_slots(slots):
        c = f"(date_trunc('day', {ts}) + INTERVAL {h} HOUR + INTERVAL {m} MINUTE)"
        cands.append(f"(CASE WHEN {c} > {ts} THEN {c} ELSE {c} + INTERVAL 1 DAY END)")
    return q.iso(f"least({', '.join(cands)})")


def _keyword_hits(rules) -> str:
    items = []
    for r in rules:
        for field, col in (("title", "_t"), ("description", "_d"), ("all", "_c")):
            k = r.folded
            test = f"regexp_matches({col}, {L(q.re2_word(k))})" if k else "false"
            items.append(
                f"CASE WHEN {test} THEN {{'section': {L(r.section)}, 'pos': {r.pos}, 'keyword': {L(r.keyword)}, "
                f"'field': {L(field)}}} END"
            )
    arr = "list_filter([" + ", ".join(items) + "], lambda h: h IS NOT NULL)"
    return f"""SELECT seq, h.section AS section, h.pos AS pos, h.keyword AS keyword, h.field AS field
    FROM (SELECT seq, unnest({arr}) AS h
      FROM (SELECT seq, _t, _d, _t || ' ' || _d AS _c
        FROM (SELECT seq, {q.fold('title')} AS _t, {q.fold('description')} AS _d FROM n_postings)))"""


def _salary() -> str:
    i = "doc_id"
    lo = f"(CASE WHEN {i} % 4 = 0 THEN NULL ELSE CAST(({i} % 50) * 1000 AS BIGINT) END)"
    hi = f"(CASE WHEN {i} % 3 = 0 THEN NULL ELSE CAST(({i} % 50) * 1000 + 20000 AS BIGINT) END)"
    cur = f"(CASE WHEN {i} % 5 = 0 THEN 'USD' WHEN {i} % 5 = 1 THEN '' WHEN {i} % 5 = 2 THEN NULL ELSE 'EUR' END)"
    rng = f"concat_ws(' - ', CAST({lo} AS VARCHAR), CAST({hi} AS VARCHAR))"
    out = f"trim(CASE WHEN coalesce({cur}, '') <> '' THEN concat_ws(' ', nullif({rng}, ''), {cur}) ELSE {rng} END)"
    return f"SELECT doc_id, {out} AS salary FROM documents"


def _admission(max_total: int, lim: int, lim_api: int) -> str:
    return f"""SELECT seq, domain, granted,
        CASE WHEN granted THEN 'granted' WHEN cutoff IS NOT NULL AND seq > cutoff THEN 'total' ELSE 'domain' END AS decision
    FROM (SELECT *, dom_ok AND ok_rank <= {max_total} AS granted,
            max(CASE WHEN dom_ok AND ok_rank = {max_total} THEN seq END) OVER () AS cutoff
      FROM (SELECT *, sum(CASE WHEN dom_ok THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ok_rank
        FROM (SELECT *, rn <= {lim} OR (api AND {lim} + ra <= {lim_api}) AS dom_ok
          FROM (SELECT *, sum(CASE WHEN api AND rn > {lim} THEN 1 ELSE 0 END)
                  OVER (PARTITION BY domain ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ra
            FROM (SELECT seq, api, {q.url_domain('url')} AS domain,
                    row_number() OVER (PARTITION BY {q.url_domain('url')} ORDER BY seq) AS rn
                  FROM v_requests)))))"""


def queries() -> dict[str, str]:
    W = with_ctes
    out: dict[str, str] = {}
    out["ranked_postings"] = W(
        f"""SELECT row_number() OVER (ORDER BY {RANK_ORDER}) AS rank, job_hash, title, company, location, url,
            status, match_score, match_reason, notes, {q.iso('date_found')} AS date_found,
            {q.iso('last_seen')} AS last_seen
        FROM reviewed WHERE match_score >= 35"""
    )
    # scalar functions
    out["clean_text"] = W(f"SELECT seq, {q.clean('title')} AS title_clean, {q.clean('description')} AS description_clean FROM v_postings")
    out["fold_text"] = W(f"SELECT seq, {q.fold('title')} AS title_fold, {q.fold('description')} AS description_fold FROM v_postings")
    out["html_text"] = W(f"SELECT page_id, {q.html_to_text('html')} AS text FROM pages")
    out["normalize_url"] = W(f"SELECT page_id, url, {q.normalize_url('url')} AS url_norm FROM pages")
    out["url_domain"] = W(f"SELECT page_id, {q.url_domain('url')} AS domain FROM pages")
    out["normalize_date"] = W(f"SELECT seq, date_posted, {q.normalize_date('date_posted')} AS date_norm FROM v_postings")
    out["job_hash"] = W("SELECT seq, job_hash, entity_key FROM n_postings")
    out["next_slot"] = W(f"SELECT seq, {_next_slot('run_time', ('09:00', '12:00', '16:00', '20:00'))} AS next_slot FROM v_sightings")
    # predicates
    out["us_locations"] = W(f"SELECT seq, location, {q.is_us('location')} AS is_us FROM n_postings")
    out["us_names_only"] = W(f"SELECT seq, location, {q.is_us('location', 'names_only')} AS is_us_ui FROM n_postings")
    out["internships"] = W(f"SELECT seq, employment_type, {q.is_intern('title', 'employment_type')} AS is_intern FROM n_postings")
    out["restricted_language"] = W(
        f"SELECT seq, {q.needs_clearance('title', 'employment_type', 'description')} AS needs_clearance FROM n_postings"
    )
    out["eligible_postings"] = W(f"SELECT seq, job_hash, title, company, location FROM n_postings WHERE {q.eligible()}")
    out["keyword_hits"] = W(_keyword_hits(fx.FIXTURE_RULES))
    out["score_threshold"] = W("SELECT job_hash, match_score FROM reviewed WHERE match_score >= 35")
    purge = " AND ".join(f"NOT coalesce({_phrase(p)}, false)" for p in PURGE_PHRASES)
    out["phrase_purge"] = W(f"SELECT job_hash, title FROM reviewed WHERE {purge}")
    out["hash_purge"] = W(
        """SELECT job_hash, title FROM reviewed r WHERE NOT EXISTS
           (SELECT 1 FROM v_edits e WHERE e.status = 'Rejected' AND e.job_hash <> '' AND e.job_hash = r.job_hash)"""
    )
    out["eligibility_purge"] = W(f"SELECT job_hash, location, employment_type FROM legacy WHERE {q.eligible()}")
    out["search_feed"] = W(
        f"""SELECT job_hash, title, location FROM feed WHERE match_score >= 35
            AND contains(lower(concat_ws(' ', title, company, location, match_reason, employment_type)), 'the')
            AND {q.is_us('location', 'names_only')}"""
    )
    # projections
    out["normalized_postings"] = W("SELECT * FROM n_postings")
    out["salary_text"] = W(_salary())
    pub = ", ".join(c for c in PUBLIC_FIELDS)
    out["public_feed"] = W(f"SELECT {pub} FROM feed")
    sheet = ", ".join(
        f"coalesce({q.iso(c)}, '') AS \"{h}\"" if c in ("date_found", "last_seen")
        else (f"{c} AS \"{h}\"" if c == "match_score" else f"coalesce(CAST({c} AS VARCHAR), '') AS \"{h}\"")
        for h, c in JOBS_SHEET_COLUMNS
    )
    out["export_jobs_sheet"] = W(f"SELECT {sheet} FROM reviewed WHERE match_score >= 35")
    legacy = "concat_ws('||', title, company, location, url)"
    out["job_keys"] = W(
        f"SELECT job_hash, CASE WHEN job_hash <> '' THEN job_hash ELSE {legacy} END AS job_key, {legacy} AS legacy_key FROM feed"
    )
    found = (
        "CASE WHEN date_found = '' THEN 'Unknown date' "
        "WHEN try_strptime(date_found, '%Y-%m-%dT%H:%M:%S+00:00') IS NULL THEN date_found "
        "ELSE strftime(try_strptime(date_found, '%Y-%m-%dT%H:%M:%S+00:00'), '%b %-d, %Y') END"
    )
    out["display_rows"] = W(
        f"""SELECT job_hash, CASE WHEN location <> '' THEN location ELSE 'Location not listed' END AS location_text,
            CASE WHEN status <> '' THEN status ELSE 'New' END AS status_text,
            CASE WHEN match_reason <> '' THEN match_reason ELSE 'Matched configured job criteria.' END AS reason_text,
            'Found ' || ({found}) AS found_text, match_score >= 70 AS high, {q.safe_link('url')} AS link
        FROM feed"""
    )
    out["safe_links"] = W(f"SELECT page_id, pos, href, {q.safe_link('href')} AS safe FROM links")
    runlog = ", ".join(
        (f"{q.iso(c)} AS \"{h}\"" if c == "run_time" else f"{c} AS \"{h}\"") for h, c in RUN_LOG_COLUMNS
    )
    out["export_run_log"] = W(f"SELECT {runlog} FROM v_runs")
    # joins / merge
    out["upsert_postings"] = W(
        f"""SELECT job_hash, entity_key, title, location, status, match_score, notes,
            {q.iso('date_found')} AS date_found, {q.iso('last_seen')} AS last_seen, {q.iso('updated_at')} AS updated_at, is_new
        FROM stored2_u"""
    )
    out["merge_buckets"] = W(
        f"""SELECT job_hash, entity_key, title, location, status, match_score, notes,
            {q.iso('date_found')} AS date_found, {q.iso('last_seen')} AS last_seen, {q.iso('updated_at')} AS updated_at
        FROM stored2_u"""
    )
    out["apply_edits"] = W(f"SELECT job_hash, status, notes, {q.iso('updated_at')} AS updated_at, edited FROM reviewed_e")
    out["edits_clean"] = W("SELECT * FROM e_clean")
    latest = _latest("checks1", "checks2")
    out["latest_checks"] = W(
        f"SELECT source_name, {q.iso('last_checked')} AS last_checked, last_result, {q.iso('updated_at')} AS updated_at FROM ({latest})"
    )
    latest_all = _latest("checks1", "checks2")
    locator = (
        "coalesce(nullif(coalesce(s.url, ''), ''), nullif(coalesce(s.company_slug, ''), ''), "
        "nullif(coalesce(s.board_token, ''), ''), '')"
    )
    out["source_status"] = W(
        f"""SELECT s.name AS "Source Name", coalesce(s.type, '') AS "Source Type", {locator} AS "URL",
            coalesce(s.enabled, false) AS "Enabled", coalesce({q.iso('c.last_checked')}, '') AS "Last Checked",
            coalesce(s.notes, '') AS "Notes"
        FROM v_sources s LEFT JOIN ({latest_all}) c ON c.source_name = s.name"""
    )
    out["source_results"] = W("SELECT source_name, last_result FROM checks1")
    out["unsupported_sources"] = W("SELECT name, type, error FROM unsupported")
    out["union_sources"] = W(
        f"""SELECT p.source_name, lower(s.type) AS source_type, {_strip('p.title')} AS title,
            CASE WHEN lower(s.type) = 'greenhouse' THEN p.url
                 ELSE {_truthy("p.url", "'https://jobs.example.com/apply/' || CAST(p.seq AS VARCHAR)")} END AS url
        FROM v_postings p JOIN v_sources s ON s.name = p.source_name
        WHERE lower(s.type) IN ('lever', 'ashby', 'greenhouse') AND {_strip('p.title')} <> ''
          AND coalesce(s.enabled, false)
        UNION ALL SELECT source_name, source_type, title, url
        FROM ({_html_postings()}) WHERE source_name IN (SELECT name FROM v_sources WHERE coalesce(enabled, false))"""
    )
    out["review_buckets"] = W("SELECT job_hash, bucket FROM buckets")
    out["migrate_actions"] = W("SELECT job_key, action FROM migrated")
    out["apply_actions"] = W("SELECT job_key, action FROM action_map")
    # aggregations
    enum = " UNION ALL ".join(f"SELECT {L(s)} AS status" for s in STATUSES)
    out["status_counts"] = W(
        f"""SELECT coalesce(e.status, c.status) AS status, coalesce(c.n, 0) AS count
        FROM ({enum}) e FULL OUTER JOIN (SELECT status, count(*) AS n FROM reviewed GROUP BY status) c ON c.status = e.status
        UNION ALL SELECT 'Total' AS status, count(*) AS count FROM reviewed"""
    )
    labels = " UNION ALL ".join(
        f"SELECT {i} AS pos, {L(label)} AS Metric, {L(key)} AS status" for i, (label, key) in enumerate(SUMMARY_METRICS)
    )
    counts = f"""SELECT coalesce(e.status, c.status) AS status, coalesce(c.n, 0) AS n
        FROM ({enum}) e FULL OUTER JOIN (SELECT status, count(*) AS n FROM reviewed GROUP BY status) c ON c.status = e.status
        UNION ALL SELECT 'Total', count(*) FROM reviewed"""
    as_of = _ts(fx.AS_OF_SECOND)
    out["summary_metrics"] = W(
        f"""SELECT l.pos, l.Metric, CAST(coalesce(c.n, 0) AS VARCHAR) AS Value FROM ({labels}) l LEFT JOIN ({counts}) c ON c.status = l.status
        UNION ALL SELECT {len(SUMMARY_METRICS)}, 'Last Run Time', {q.iso(as_of)}
        UNION ALL SELECT {len(SUMMARY_METRICS) + 1}, 'Next Expected Run Time', {_next_slot(as_of, ('09:00', '12:00', '16:00', '20:00'))}"""
    )
    out["relevance_score"] = W("SELECT seq, match_score FROM scored1")
    out["match_reason"] = W("SELECT seq, match_reason FROM scored1")
    out["relevance_tokens"] = W("SELECT seq, match_score, match_reason FROM scored1")
    fetched_scored = _scored("(SELECT * FROM (" + _normalized("fetched1") + "))", fx.FIXTURE_RULES)
    out["run_stats"] = W(
        f"""SELECT CAST((SELECT count(*) FROM v_sources WHERE coalesce(enabled, false)) AS INTEGER) AS sources_checked,
            (SELECT count(*) FROM fetched1) AS jobs_found,
            (SELECT count(DISTINCT entity_key) FROM ({fetched_scored})) AS new_jobs_added,
            coalesce((SELECT string_agg(error, chr(10) ORDER BY pos) FROM unsupported), '') AS errors,
            CASE WHEN (SELECT count(*) FROM unsupported) > 0 THEN 1 ELSE 0 END AS run_status"""
    )
    out["feed_summary"] = W(
        """SELECT count(*) AS jobs, count(*) FILTER (WHERE match_score >= 70) AS strong,
            count(DISTINCT CASE WHEN company <> '' THEN company END) AS companies,
            count(*) FILTER (WHERE contains(lower(location), 'remote')) AS remote,
            greatest(0, coalesce(max(match_score), 0)) AS top_score
        FROM feed"""
    )
    out["facets"] = W(
        """SELECT value, row_number() OVER (ORDER BY value) AS pos, 'company' AS facet
            FROM (SELECT DISTINCT company AS value FROM feed WHERE company <> '')
        UNION ALL
        SELECT value, row_number() OVER (ORDER BY value) AS pos, 'status' AS facet
            FROM (SELECT DISTINCT status AS value FROM feed WHERE status <> '')"""
    )
    out["bucket_counts"] = W(
        """SELECT e.bucket, coalesce(c.n, 0) AS count
        FROM (SELECT 'review' AS bucket UNION ALL SELECT 'applied' UNION ALL SELECT 'not-fit') e
          LEFT JOIN (SELECT bucket, count(*) AS n FROM buckets GROUP BY bucket) c ON c.bucket = e.bucket
        UNION ALL SELECT 'total', count(*) FROM buckets"""
    )
    any_phrase = " OR ".join(f"coalesce({_phrase(p)}, false)" for p in PURGE_PHRASES)
    hits = """SELECT count(*) FROM e_clean e WHERE e.status IN {st} AND (
                (e.job_hash <> '' AND EXISTS (SELECT 1 FROM stored1 s WHERE s.job_hash = e.job_hash))
             OR (e.job_hash = '' AND e.url <> '' AND EXISTS (SELECT 1 FROM stored1 s WHERE s.url = e.url)))""".format(
        st=q.in_list(STATUSES)
    )
    out["change_counts"] = W(
        f"""SELECT 'inserted_run1' AS metric, (SELECT count(*) FROM stored1) AS count
        UNION ALL SELECT 'edits_applied', ({hits})
        UNION ALL SELECT 'inserted_run2', (SELECT count(*) FROM stored2_u WHERE is_new)
        UNION ALL SELECT 'updated_run2', (SELECT count(*) FROM stored2_u WHERE NOT is_new AND updated_at = {_ts(fx.AS_OF_SECOND)})
        UNION ALL SELECT 'phrase_deleted', (SELECT count(*) FROM reviewed WHERE {any_phrase})
        UNION ALL SELECT 'eligibility_deleted', (SELECT count(*) FROM legacy WHERE NOT {q.eligible()})"""
    )
    out["feed_manifest"] = W(f"SELECT {q.iso(as_of)} AS generated_at, 20 AS minimum_score, count(*) AS total FROM feed")
    reason = (
        f"CASE WHEN NOT {q.is_us('location')} THEN 'location' "
        f"WHEN {q.is_intern('title', 'employment_type')} THEN 'internship' ELSE 'clearance' END"
    )
    out["skipped_postings"] = W(
        f"SELECT seq, title, company, location, {reason} AS reason FROM n_postings WHERE NOT {q.eligible()}"
    )
    # windows
    out["batch_collapse"] = W("SELECT entity_key, job_hash, first_seq, last_seq, sightings, title, match_score FROM batch1")
    out["request_admission"] = W(_admission(120, 10, 50))
    out["backoff_delays"] = W(
        f"""SELECT seq, domain, CAST(least(rn, 4) AS INTEGER) AS attempt, [60, 120, 300, 600][least(rn, 4)] AS delay_seconds
        FROM (SELECT seq, {q.url_domain('url')} AS domain,
                row_number() OVER (PARTITION BY {q.url_domain('url')} ORDER BY seq) AS rn
              FROM v_requests WHERE status_code = 429)"""
    )
    out["pacing_shortfall"] = W(
        f"""SELECT seq, domain, gap_seconds,
            CASE WHEN prev_ts IS NULL THEN 0.0 ELSE greatest(0.0, (CASE WHEN api THEN 3.0 ELSE 20.0 END) - gap_seconds) END
              AS shortfall_seconds
        FROM (SELECT *, (epoch_us(ts) - epoch_us(prev_ts)) / 1000000.0 AS gap_seconds
          FROM (SELECT seq, api, ts, {q.url_domain('url')} AS domain,
                  lag(ts) OVER (PARTITION BY {q.url_domain('url')} ORDER BY ts, seq) AS prev_ts FROM v_requests))"""
    )
    out["response_classes"] = W(
        """SELECT seq, status_code, CASE WHEN status_code = 403 THEN 'skipped' WHEN status_code = 429 THEN 'backed_off'
            WHEN status_code >= 400 THEN 'error' ELSE 'ok' END AS response_class FROM v_requests"""
    )
    out["expired_snapshots"] = W(
        f"""SELECT version FROM (SELECT epoch(run_time)::BIGINT AS version,
            row_number() OVER (ORDER BY epoch(run_time) DESC) AS age FROM v_runs) WHERE age > {SNAPSHOTS_KEPT}"""
    )
    out["first_last_seen"] = W(
        f"""SELECT entity, {q.iso('min(run_time)')} AS first_seen, {q.iso('max(run_time)')} AS last_seen, count(*) AS sightings
        FROM v_sightings GROUP BY entity"""
    )
    out["stream_first_last_seen"] = out["first_last_seen"]
    out.update(_scan_oracles())
    out["feed_scan"] = W(
        f"SELECT {', '.join(PUBLIC_FIELDS)}, {q.iso(_ts(fx.AS_OF_SECOND))} AS generated_at, 20 AS minimum_score FROM feed"
    )
    out["run_log_append"] = W(
        f"""SELECT {q.iso('run_time')} AS run_time, sources_checked, jobs_found, new_jobs_added, errors, duration_seconds
        FROM v_runs"""
    )
    out["snapshot_write"] = W("SELECT 2 AS version, job_hash, status FROM reviewed")
    differ = "EXISTS (FROM stored1 EXCEPT ALL FROM reviewed) OR EXISTS (FROM reviewed EXCEPT ALL FROM stored1)"
    out["snapshot_changed"] = W(
        "SELECT '1 stored' AS snapshot, (SELECT count(*) FROM stored1) AS rows, true AS changed "
        f"UNION ALL SELECT '2 reviewed', (SELECT count(*) FROM reviewed), {differ} "
        "UNION ALL SELECT '3 reordered', (SELECT count(*) FROM reviewed), false"
    )
    out["sheet_round_trip"] = W("SELECT job_hash, status, notes, match_score >= 35 AS edited FROM reviewed")
    # sorts
    out["sorted_feed"] = W(
        "SELECT job_hash, row_number() OVER (ORDER BY match_score DESC, date_found DESC, feed_pos) AS sort_pos FROM feed"
    )
    # the root collation's order of Unicode text, which 'en' doesn't tailor
    out["sorted_feed_title"] = W(
        "SELECT job_hash, title, row_number() OVER (ORDER BY coalesce(title, '') COLLATE en, feed_pos) AS sort_pos FROM feed"
    )
    out["sorted_feed_company"] = W(
        "SELECT job_hash, company, row_number() OVER (ORDER BY company, feed_pos) AS sort_pos FROM feed"
    )
    out["sorted_feed_newest"] = W(
        "SELECT job_hash, date_found, row_number() OVER (ORDER BY date_found DESC, feed_pos) AS sort_pos FROM feed"
    )
    out["facet_filter"] = W("SELECT job_hash, company, status FROM feed WHERE company = 'src3' AND status = 'New'")
    out["recent_run_logs"] = W(
        f"""SELECT {q.iso('run_time')} AS run_time, sources_checked, jobs_found, new_jobs_added, errors, duration_seconds,
            row_number() OVER (ORDER BY run_time) AS pos
        FROM (SELECT * FROM v_runs ORDER BY run_time DESC LIMIT 200)"""
    )
    out["html_links"] = W(
        f"""SELECT page_id, pos, url, title FROM (
            SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS k FROM (
              SELECT l.page_id, l.pos, {q.resolve_url('l.page_url', 'l.href')} AS url,
                CASE WHEN l.raw_text <> '' THEN l.text
                     ELSE {q.clean("coalesce(nullif(l.title_attr, ''), nullif(l.aria_label, ''), '')")} END AS title
              FROM links l WHERE l.href IS NOT NULL AND l.href <> '') WHERE title <> '') WHERE k = 1"""
    )
    return out


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), {L('^' + q.WS_RUN + '|' + q.WS_RUN + '$')}, '', 'g')"


def _truthy(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def _html_postings() -> str:
    """Postings of the landed pages: the first titled link per page and URL."""
    url = _truthy("p.url", "'https://jobs.example.com/apply/' || CAST(p.seq AS VARCHAR)")
    return f"""SELECT * FROM (SELECT {q.clean('p.title')} AS title, coalesce(s.company, p.source_name, '') AS company, '' AS location,
            {url} AS url, p.source_name, 'html' AS source_type, '' AS description, '' AS salary, '' AS employment_type,
            '' AS date_posted FROM v_postings p LEFT JOIN v_sources s ON s.name = p.source_name
        WHERE lower(s.type) = 'html' AND {q.clean('p.title')} <> ''
        QUALIFY row_number() OVER (PARTITION BY p.source_name, p.seq // 500, {url} ORDER BY p.seq) = 1)"""


def _scan_oracles() -> dict[str, str]:
    """Expected reader output for the payloads landed from the postings fixture."""
    comp = "coalesce(s.company, p.source_name, '')"
    apply_url = "'https://jobs.example.com/apply/' || CAST(p.seq AS VARCHAR)"
    base = "FROM v_postings p LEFT JOIN v_sources s ON s.name = p.source_name"
    i = "p.seq"
    lo = f"(CASE WHEN {i} % 4 = 0 THEN NULL ELSE CAST(({i} % 50) * 1000 AS BIGINT) END)"
    hi = f"(CASE WHEN {i} % 3 = 0 THEN NULL ELSE CAST(({i} % 50) * 1000 + 20000 AS BIGINT) END)"
    cur = f"(CASE WHEN {i} % 5 = 0 THEN 'USD' END)"
    rng = f"concat_ws(' - ', CAST({lo} AS VARCHAR), CAST({hi} AS VARCHAR))"
    sal = f"trim(CASE WHEN coalesce({cur}, '') <> '' THEN concat_ws(' ', nullif({rng}, ''), {cur}) ELSE {rng} END)"
    lever_desc = (
        f"concat_ws(' ', nullif({_truthy(f'CASE WHEN {i} % 2 = 0 THEN p.description END', q.html_to_text(chr(39) + '<p>' + chr(39) + ' || p.description || ' + chr(39) + '</p>' + chr(39)))}, ''), "
        f"nullif({q.html_to_text(f'CASE WHEN {i} % 4 = 1 THEN {L(chr(60) + "ul><li>")} || p.source_name || {L("</li></ul>")} END')}, ''))"
    )
    lever = f"""SELECT * FROM (SELECT {_strip('p.title')} AS title, {comp} AS company, p.location AS location,
            {_truthy("p.url", apply_url)} AS url, p.source_name, 'lever' AS source_type, {lever_desc} AS description,
            CASE WHEN {i} % 6 = 5 THEN '' ELSE {sal} END AS salary, p.employment_type,
            CAST((1700000000 + {i} * 3600) * 1000 AS VARCHAR) AS date_posted
        {base} WHERE lower(s.type) = 'lever') WHERE title <> ''"""
    ashby = f"""SELECT * FROM (SELECT {_strip('p.title')} AS title, {comp} AS company, p.location AS location,
            {_truthy("p.url", apply_url)} AS url, p.source_name, 'ashby' AS source_type,
            {q.html_to_text("'<p>' || p.description || '</p>'")} AS description,
            CASE WHEN {i} % 3 <> 0 THEN p.salary ELSE '' END AS salary, p.employment_type, p.date_posted
        {base} WHERE lower(s.type) = 'ashby') WHERE title <> ''"""
    offices = "array_to_string(list_filter([p.location, '', p.source_name], lambda n: n <> ''), ', ')"
    esc = "replace(replace(replace('<p>' || p.description || '</p>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    greenhouse = f"""SELECT * FROM (SELECT {_strip('p.title')} AS title, {comp} AS company,
            {_truthy(f"CASE WHEN {i} % 3 <> 0 THEN p.location END", offices)} AS location,
            p.url AS url, p.source_name, 'greenhouse' AS source_type, {q.html_to_text(esc)} AS description,
            '' AS salary, '' AS employment_type, p.date_posted
        {base} WHERE lower(s.type) = 'greenhouse') WHERE title <> ''"""
    quarantine = " UNION ALL ".join(
        f"""SELECT name AS source_name, '{k}' AS source_type,
            name || ': CollectorError: Unexpected {k} API response' AS error
        FROM v_sources WHERE pos % 5 = 4 AND lower(type) = '{k}'"""
        for k in ("lever", "ashby", "greenhouse", "html")
    )
    def field(name: str, value: str) -> str:
        # a JSON member, left out when the value is NULL (as the JSON writer does)
        return f"CASE WHEN {value} IS NOT NULL THEN '\"{name}\":' || {value} END"

    loc = (f"CASE WHEN {i} % 2 = 0 THEN to_json(p.location) "
           f"ELSE '{{\"name\":' || to_json(p.location) || '}}' END")
    members = [
        field("title", "to_json(p.title)"),
        field("location", loc),
        field("jobUrl", "to_json(nullif(p.url, ''))"),
        field("applyUrl", f"to_json({apply_url})"),
        field("descriptionHtml", "to_json('<p>' || p.description || '</p>')"),
        field("compensation", f"CASE WHEN {i} % 3 <> 0 THEN to_json(p.salary) END"),
        field("employmentType", "to_json(p.employment_type)"),
        field("publishedAt", "to_json(p.date_posted)"),
    ]
    raw = f"""SELECT * FROM (SELECT p.source_name, {_strip('p.title')} AS title,
            '{{' || concat_ws(',', {', '.join(members)}) || '}}' AS raw_data
        {base} WHERE lower(s.type) = 'ashby') WHERE title <> ''"""
    stream_rows = f"""SELECT * FROM (SELECT p.seq, {_strip('p.title')} AS title, coalesce(s.company, p.source_name) AS company,
            p.location AS location, {_truthy("p.url", apply_url)} AS url, p.source_name, 'lever' AS source_type,
            {lever_desc} AS description, CASE WHEN {i} % 6 = 5 THEN '' ELSE {sal} END AS salary,
            p.employment_type, CAST((1700000000 + {i} * 3600) * 1000 AS VARCHAR) AS date_posted
        {base} WHERE lower(s.type) = 'lever') WHERE title <> ''"""
    stream = f"""SELECT job_hash, entity_key, title, company, location, url, source_name, source_type, description, salary,
            employment_type, date_posted, 'New' AS status, '' AS notes, match_score, match_reason
        FROM ({_collapsed("(" + _scored("(" + _normalized("(" + stream_rows + ")") + ")", fx.FIXTURE_RULES) + ")")})"""
    # two workflow runs over the enabled, type-dispatched sources; edits mark rows scoring 60+
    def with_seq(body: str) -> str:
        return body.replace("SELECT * FROM (SELECT ", "SELECT * FROM (SELECT p.seq, ", 1).replace(
            "WHERE lower(s.type)", "WHERE coalesce(s.enabled, false) AND lower(s.type)", 1)

    rows = " UNION ALL ".join(with_seq(b) for b in (lever, ashby, greenhouse, _html_postings()))
    purge = " AND ".join(
        f"NOT coalesce({_phrase(ph)}, false)" for ph in (EXPORT_CONTROL_PHRASE, CLEARANCE_EXCLUSION_PHRASE)
    )
    entities = _collapsed("(" + _scored("(" + _normalized("(" + rows + ")") + ")", fx.FIXTURE_RULES) + ")")
    workflow = f"""SELECT job_hash, title, company, location,
            CASE WHEN match_score >= 60 THEN 'Interested' ELSE 'New' END AS status,
            CASE WHEN match_score >= 60 THEN 'seen' ELSE '' END AS notes,
            match_score, {q.iso(_ts(fx.AS_OF_FIRST))} AS date_found, {q.iso(_ts(fx.AS_OF_SECOND))} AS last_seen
        FROM ({entities}) WHERE {purge} AND {q.eligible()}"""
    return {
        "workflow_run": with_ctes(workflow),
        "stream_ingest": with_ctes(stream),
        "raw_json": with_ctes(raw),
        "scan_lever": with_ctes(lever),
        "scan_ashby": with_ctes(ashby),
        "scan_greenhouse": with_ctes(greenhouse),
        "scan_html": with_ctes(_html_postings()),
        "quarantine": with_ctes(quarantine),
    }
