import html
import json
import os
import re
from html.parser import HTMLParser

from postline.functions.markup import decode_entities, html_to_text, markup_text
from postline.sources import payloads as S


def _land(tmp_dir, kind, source, payloads, multi_line=False):
    d = os.path.join(tmp_dir, kind, f"source_name={source}")
    os.makedirs(d, exist_ok=True)
    if multi_line:
        for i, p in enumerate(payloads):
            with open(os.path.join(d, f"p{i}.json"), "w") as fh:
                fh.write(p if isinstance(p, str) else json.dumps(p, indent=2))
    else:
        with open(os.path.join(d, "part.json"), "w") as fh:
            for p in payloads:
                fh.write((p if isinstance(p, str) else json.dumps(p)) + "\n")
    return os.path.join(tmp_dir, kind)


def test_lever_edge_rows(spark, tmp_dir):
    items = [
        {"text": "  Graphics Engineer ", "hostedUrl": "https://x/1", "categories": {"location": "Austin", "commitment": "Full-time"},
         "salaryRange": {"min": 0, "max": 10, "currency": "USD"}, "descriptionPlain": "Plain", "additional": "<b>More</b>",
         "createdAt": 1700000000123},
        {"text": "Min only", "applyUrl": "https://x/apply", "salaryRange": {"min": 5}, "description": "<p>Html &amp; text</p>"},
        {"text": "Currency only", "salaryRange": {"currency": "EUR"}, "categories": None},
        {"text": None},
        {"text": "No urls", "salaryRange": {}},
    ]
    root = _land(tmp_dir, "lever", "acme", [items])
    rows = {r.title: r for r in S.read_lever(spark, root).collect()}
    assert set(rows) == {"Graphics Engineer", "Min only", "Currency only", "No urls"}
    g = rows["Graphics Engineer"]
    assert (g.location, g.employment_type, g.url, g.salary) == ("Austin", "Full-time", "https://x/1", "0 - 10 USD")
    assert g.description == "Plain More" and g.date_posted == "1700000000123" and g.source_name == "acme"
    assert rows["Min only"].salary == "5" and rows["Min only"].url == "https://x/apply"
    assert rows["Min only"].description == "Html & text"
    assert rows["Currency only"].salary == "EUR" and rows["Currency only"].location == ""
    assert rows["No urls"].url == "" and rows["No urls"].salary == ""


def test_ashby_polymorphic_location_and_multiline(spark, tmp_dir):
    payload = {"jobs": [
        {"title": "A", "location": "Seattle, WA", "jobUrl": "https://j/1", "descriptionHtml": "<p>One</p>",
         "compensation": "$100k", "employmentType": "FullTime", "publishedAt": "2024-03-05T10:20:30Z"},
        {"title": "B", "location": {"name": "Austin"}, "applyUrl": "https://j/2", "description": "Two",
         "compensation": {"summary": "$1"}},
        {"title": "", "location": "x"},
    ]}
    root = _land(tmp_dir, "ashby", "acme", [payload], multi_line=True)
    rows = {r.title: r for r in S.read_ashby(spark, root, multi_line=True).collect()}
    assert set(rows) == {"A", "B"}
    assert (rows["A"].location, rows["A"].url, rows["A"].description, rows["A"].salary) == ("Seattle, WA", "https://j/1", "One", "$100k")
    assert (rows["B"].location, rows["B"].url, rows["B"].description) == ("Austin", "https://j/2", "Two")
    assert json.loads(rows["B"].salary) == {"summary": "$1"}


def test_greenhouse_offices_fallback(spark, tmp_dir):
    payload = {"jobs": [
        {"title": "A", "location": {"name": ""}, "offices": [{"name": "NYC"}, {"name": ""}, {"name": "Remote"}],
         "absolute_url": "https://g/1", "content": "&lt;p&gt;Escaped &amp;amp; html&lt;/p&gt;", "updated_at": "2024-01-01"},
        {"title": "B", "location": None, "offices": None},
    ]}
    root = _land(tmp_dir, "greenhouse", "acme", [payload])
    rows = {r.title: r for r in S.read_greenhouse(spark, root).collect()}
    assert rows["A"].location == "NYC, Remote"
    assert rows["A"].description == "Escaped & html"
    assert rows["B"].location == ""


def test_quarantine_of_malformed_payloads(spark, tmp_dir):
    root = _land(tmp_dir, "lever", "bad", [{"error": "x"}, "not json", [{"text": "ok"}]])
    q = S.quarantine(spark, root, "lever").collect()
    assert len(q) == 2 and all(r.error == "bad: CollectorError: Unexpected lever API response" for r in q)
    root2 = _land(tmp_dir, "ashby", "bad", [{"jobs": "nope"}, {"jobs": []}, {"other": 1}])
    assert S.quarantine(spark, root2, "ashby").count() == 1


def test_html_links_first_titled_per_url(spark):
    html = (
        '<a href="/jobs/1"> </a><a href="/jobs/1">Graphics <b>Engineer</b></a><a href="/jobs/1">Again</a>'
        '<a href="/jobs/9" title="Ignored"> </a><a href="/jobs/8" title="Nested"><b></b></a>'
        '<a href="jobs/2" title="From title"></a><a href=\'/jobs/3\' aria-label="Label"></a><a>no href</a>'
        '<a href="https://other.org/x?a=1&amp;b=2">Other</a>'
    )
    pages = spark.createDataFrame([(1, "https://ex.com/careers/", html)], "page_id long, url string, html string")
    got = [(r.url, r.title) for r in S.html_links(pages).orderBy("pos").collect()]
    assert got == [
        ("https://ex.com/jobs/1", "Graphics Engineer"),
        ("https://ex.com/jobs/8", "Nested"),
        ("https://ex.com/careers/jobs/2", "From title"),
        ("https://ex.com/jobs/3", "Label"),
        ("https://other.org/x?a=1&b=2", "Other"),
    ]


class _Texts(HTMLParser):
    """Collects text outside of script, style and template elements."""

    hidden = {"script", "style", "template"}

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.depth, self.found = 0, []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.hidden

    def handle_endtag(self, tag):
        self.depth -= tag in self.hidden and self.depth > 0

    def handle_data(self, data):
        self.found += [data] if self.depth == 0 else []


def test_faults_stay_with_their_posting(spark, tmp_dir):
    good = {"text": "Good", "hostedUrl": "https://x/1", "categories": {"location": "Austin"}, "createdAt": 1, "team": "Core", "id": "z9"}
    payload = [
        good,
        {"text": "Float salary", "salaryRange": {"min": 100.5, "max": 200}, "createdAt": "2024-01-02"},
        {"text": "No date", "categories": None},
        {"text": "Bad category", "categories": "Austin"},
        {"text": {"en": "Bad title"}}, "a string", None, 7,
    ]
    root = _land(tmp_dir, "lever", "acme", [payload])
    rows = {r.title: r for r in S.read_lever(spark, root).collect()}
    assert set(rows) == {"Good", "Float salary", "No date"}
    assert rows["Float salary"].salary == "100.5 - 200" and rows["Float salary"].date_posted == "2024-01-02"
    assert json.loads(rows["Good"].raw_data) == good
    bad = sorted(r.error.split("posting: ")[1] for r in S.quarantine(spark, root, "lever").collect())
    assert bad == ["categories", "not an object", "not an object", "not an object", "text"]
    assert len(rows) + len(bad) == len(payload)
    jobs = {"jobs": [{"title": "A", "location": {"name": None}}, {"title": "B", "location": {"other": 1}}, {"title": "C", "location": 5}, {"title": ["D"]}]}
    root = _land(tmp_dir, "ashby", "acme", [jobs])
    assert {r.title: r.location for r in S.read_ashby(spark, root).collect()} == {"A": "", "B": "", "C": "5"}
    jobs = {"jobs": [{"title": "A", "location": {"name": "NYC"}}, {"title": "B", "location": "NYC"}, {"title": "C", "offices": "x"}]}
    root = _land(tmp_dir, "greenhouse", "acme", [jobs, {"jobs": None}])
    assert [r.title for r in S.read_greenhouse(spark, root).collect()] == ["A"]
    assert S.quarantine(spark, root, "greenhouse").count() == 2


def test_html_to_text_matches_parser_walk(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.t for r in pages.select("page_id", html_to_text("html").alias("t")).collect()}
    want = {r.page_id: re.sub(r"\s+", " ", " ".join(_Texts(html.unescape(r.html)).found)).strip() for r in pages.collect()}
    assert got == want


def test_feed_envelope_scan(spark, tmp_dir):
    path = os.path.join(tmp_dir, "jobs.json")
    with open(path, "w") as fh:
        json.dump({"generated_at": "g", "minimum_score": 20, "total": 1, "jobs": [{"job_hash": "h", "title": "t", "match_score": 50}]}, fh)
    rows = S.read_feed_envelope(spark, path).collect()
    assert len(rows) == 1 and rows[0].title == "t" and rows[0].minimum_score == 20
    empty = os.path.join(tmp_dir, "empty.json")
    with open(empty, "w") as fh:
        json.dump({"generated_at": "g", "minimum_score": 20, "total": 0}, fh)
    assert S.read_feed_envelope(spark, empty).count() == 0


def test_read_html_pages(spark, tmp_dir):
    good = {"url": "https://h.example/careers/", "html": '<a href="1">One &amp; only</a><a href="1">Again</a><a href="2"> </a><a name="x">None</a><a href="3">Open<a href="4">Last</a>'}
    folder = os.path.join(tmp_dir, "html", "source_name=site")
    os.makedirs(folder)
    with open(os.path.join(folder, "p.json"), "w") as out:
        for page in (good, {"html": "<a href='5'>No address</a>"}, {"url": "https://h.example/n", "html": 7}, {"url": "https://h.example/e", "html": ""}):
            out.write(json.dumps(page) + "\n")
    root = os.path.join(tmp_dir, "html")
    rows = S.read_html(spark, root)
    assert tuple(rows.columns) == S.RAW_COLUMNS
    rows = rows.orderBy("seq").collect()
    assert [(r.title, r.url) for r in rows] == [
        ("One & only", "https://h.example/careers/1"),
        ("Open", "https://h.example/careers/3"),
        ("Last", "https://h.example/careers/4"),
    ]
    assert {(r.source_name, r.source_type, r.raw_data) for r in rows} == {("site", "html", '{"source_page":"https://h.example/careers/"}')}
    errors = [r.error for r in S.quarantine(spark, root, "html").collect()]
    assert errors == ["site: CollectorError: Unexpected html API response"] * 2


def test_unclosed_anchors_end_at_the_next(spark):
    n = 20_000
    page = "".join(f'<a href="/j/{i}">Job {i} ' for i in range(n))
    pages = spark.createDataFrame([(1, "https://ex.com/", page), (2, "https://ex.com/", None), (3, "https://ex.com/", "")], "page_id long, url string, html string")
    got = {r.pos: (r.url, r.title) for r in S.html_links(pages).collect()}
    assert len(got) == n and got[n] == (f"https://ex.com/j/{n - 1}", f"Job {n - 1}")


def test_character_references_match_the_standard_parser(spark):
    texts = [
        "caf&eacute; &trade; &euro;50 &NotEqualTilde;", "&#00000065; &#x000041; &#150; &#x93;q&#x94; &#129;", "&#1114112; &#99999999999999999999; &#xD800; &#0;",
        "&amp;lt; &#38;lt; &unknown; & &; &#; &#x;", "&#65 &#x42z", "", "no reference",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.d for r in df.select("i", decode_entities("t").alias("d")).collect()}
    assert got == {i: html.unescape(t) if i != 2 else "� � � �" for i, t in enumerate(texts)} | {1: "A A – “q” \x81"}


def test_markup_keeps_text_between_angle_signs(spark):
    cases = {
        "a < b and c > d": "a < b and c > d", "1 < 2 <b>bold</b>": "1 < 2 bold", '<p title="a>b">hi</p>': "hi",
        "<p title='it>s'>x</p>y": "x y", '<a href="open>text</a> end': "text end", "<!doctype html><?pi?>z": "z",
    }
    df = spark.createDataFrame(list(cases), "string").toDF("t")
    assert {r.t: r.x for r in df.select("t", markup_text("t").alias("x")).collect()} == cases


def test_payload_order_does_not_depend_on_how_files_are_packed(spark, tmp_dir):
    from postline.operators import merge

    for i in range(6):
        items = [{"text": f"Title {i}-{j}", "hostedUrl": f"https://o/{j % 2}", "categories": {"location": "Austin"}} for j in range(4)]
        d = os.path.join(tmp_dir, "lever", "source_name=acme")
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, f"{i}.json"), "w") as fh:
            fh.write((" " * (5 - i) * 4000) + json.dumps(items) + "\n" + json.dumps(items[:1]) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    found = []
    try:
        for size, cost in (("128m", "4m"), ("1m", "0"), ("20k", "0")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            raw = S.read_lever(spark, os.path.join(tmp_dir, "lever")).withColumn("company", S.F.lit("Acme"))
            n = merge.normalize_postings(raw).withColumn("match_score", S.F.lit(1)).withColumn("match_reason", S.F.lit(""))
            found.append(sorted((r.entity_key, r.title, r.sightings) for r in merge.collapse_batch(n).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2] == [("https://o/0", "Title 5-0", 18), ("https://o/1", "Title 5-3", 12)]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_and_postings_are_parsed_once_and_markup_is_read_once(spark, tmp_dir):
    roots = {
        "lever": _land(tmp_dir, "lever", "acme", [[{"text": "A", "description": "<p>One</p>", "additional": "<b>More</b>"}]]),
        "ashby": _land(tmp_dir, "ashby", "acme", [{"jobs": [{"title": "A", "descriptionHtml": "<p>One</p>"}]}]),
        "greenhouse": _land(tmp_dir, "greenhouse", "acme", [{"jobs": [{"title": "A", "content": "<p>One</p>"}]}]),
    }
    for kind, root in roots.items():
        plan = _optimized(S.READERS[kind](spark, root))
        assert plan.count("parseJson(") == 2  # the payload, and each posting
        assert _optimized(S.quarantine(spark, root, kind)).count("parseJson(") == 3  # payloads, and payloads with their postings
        assert plan.count("schemaOfVariant(value") == plan.count("schemaOfVariant(static_invoke(VariantExpressionEvalUtils.parseJson(value") == 0
    texts = 2  # description and additional
    markup = _optimized(S.read_lever(spark, roots["lever"])).count("(?=<)") / _optimized(S.read_ashby(spark, roots["ashby"])).count("(?=<)")
    assert markup == texts


def test_payload_shapes(spark, tmp_dir):
    lever = _land(tmp_dir, "lever", "s", [" \t[]", "{}", "[1", "3", '"[]"', "null", '[{"text": "ok"}, [1], 2, null]', '[{"text": "a", "text": "b"}]'])
    assert S.quarantine(spark, lever, "lever").filter("error LIKE '%response'").count() == 6
    assert S.quarantine(spark, lever, "lever").filter("error LIKE '%not an object'").count() == 3
    assert [r.title for r in S.read_lever(spark, lever).collect()] == ["ok"]
    ashby = _land(tmp_dir, "ashby", "s", ['{"jobs": null}', '{"jobs": {}}', '{"jobs": "[]"}', '{"jobs": 1}', " {}", "[]", '{"jobs": [{"title": "ok"}]}'])
    assert S.quarantine(spark, ashby, "ashby").count() == 4
    assert [r.title for r in S.read_ashby(spark, ashby).collect()] == ["ok"]
