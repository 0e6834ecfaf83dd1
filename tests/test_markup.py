"""The markup scanner against the standard library's parser."""

import html
import random
import re
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from postline.functions.markup import decode_entities, html_to_text, markup_text, tokens
from postline.sources import payloads as S

PAGE = "page_id long, url string, html string"


class Walk(HTMLParser):
    """Visible text, and each anchor up to its end tag or the next anchor, as the standard parser sees them."""

    hidden = ("script", "style", "template")

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.depth, self.found, self.anchors, self.open = 0, [], [], False
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.hidden
        if self.depth:
            return
        self.found.append(" ")
        if self.open:
            self.anchors[-1][1].append(" ")
        if tag == "a":
            self.open = True
            self.anchors.append((dict(attrs), []))

    def handle_endtag(self, tag):
        if tag in self.hidden and self.depth:
            self.depth -= 1
        elif tag == "a":
            self.open = False
        self.handle_comment("")

    def handle_comment(self, data):
        if not self.depth:
            self.handle_data(" ")

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data):
        if not self.depth:
            self.found.append(data)
            if self.open:
                self.anchors[-1][1].append(data)


def clean(text):
    return re.sub(r"\s+", " ", text).strip()


def links(spark, pages):
    df = spark.createDataFrame([(i, "https://ex.com/", p) for i, p in enumerate(pages)], PAGE)
    out = {i: [] for i in range(len(pages))}
    for r in S.page_links(df).orderBy("page_id", "pos").collect():
        out[r.page_id].append((r.href, r.title_attr, r.aria_label, r.text))
    return [out[i] for i in range(len(pages))]


def expected(page):
    return [tuple("" if k in a and a[k] is None else a.get(k) for k in S.ANCHOR_ATTRIBUTES) + (clean("".join(t)),) for a, t in Walk(page).anchors]


PAGES = [
    '<a title="a > b" href="/x">Job</a>',
    '<a data-href="/wrong" href="/right">Job</a>',
    '<!-- <a href="/no">Phantom</a> --><a href="/yes">Yes</a>',
    '<script>var x = "<a href=/no>Phantom</a>";</script><style>a > b {}</style><a href="/yes">Yes</a>',
    '<a-box href="/x">Box</a-box><abbr href="/y">Abbr</abbr><A HREF=/z>Upper</A>',
    "<a href='/one'>One <b>bold</b><i title=\"</a>\">it</i></a> tail <a href=/two aria-label=Two></a>",
    '<a href="/1" HREF="/2">Last wins</a><a href>None</a><a href=>Empty</a><a href==x>Equals</a>',
    '<a/href=/slash>Slash</a><a href=/x/>End</a><a b="c"href="/joined">Joined</a><a =x href=y>Sign</a>',
    '<a href="?a=1&amp;b=2&copy=3" title="&quot;q&quot; &#8364;">&lt;b&gt; &amp;amp; &notit; &ampT</a>',
    "<a href='/3'>Open<a href='/4'>Last", "<a href=/5>x</a ><a href=/6>y</A\n>z", "</a><a href=/7>w</a></a>",
    "<template><a href=/no>Hidden</a></template><a href=/8>Shown</a>", "1 < 2 <a href=/9>3 > 2</a> && <", "",
    "<!DOCTYPE html><?pi <a href=/no>?><a href='/multi\nline'>M\n  L</a>", "<a\thref\n=\r'/ws'>W</a>", "<p title='<a href=/no>'>P</p><a href=/10 title='<!-- no -->'>C</a>",
]


def test_links_equal_the_standard_parser(spark):
    assert links(spark, PAGES) == [expected(p) for p in PAGES]
    df = spark.createDataFrame([(i, "https://ex.com/", p) for i, p in enumerate(PAGES[:5])], PAGE)
    assert [(r.page_id, r.url, r.title) for r in S.html_links(df).orderBy("page_id").collect()] == [(0, "https://ex.com/x", "Job"), (1, "https://ex.com/right", "Job"), (2, "https://ex.com/yes", "Yes"), (3, "https://ex.com/yes", "Yes"), (4, "https://ex.com/z", "Upper")]


def test_random_markup_equals_the_standard_parser(spark):
    rnd = random.Random(11)
    bits = ["<a href=/x>", '<a title="p > q" href="/y">', "</a>", "<b>", "</b>", "text", " ", "<!-- c > <a href=n> -->", "<script>if (a < b) '<a href=s>'</script>", "<style>x</style>", "<br/>", "&amp;", "&copy", "&unknown;", "<p class='<a>'>", "1 < 2", "é", "<td a=b c='d' e>", "<!doctype x>", "\n", "<A HREF='/z' aria-label=l>"]
    pages = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(400)]
    assert links(spark, pages) == [expected(p) for p in pages]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    got = {r.i: (r.m, r.h, r.j) for r in df.select("i", markup_text("t").alias("m"), html_to_text("t").alias("h"), F.array_join(tokens("t"), "").alias("j")).collect()}
    assert got == {i: (clean("".join(Walk(p).found)), clean("".join(Walk(html.unescape(p)).found)), p) for i, p in enumerate(pages)}


def test_references_equal_the_standard_library(spark):
    rnd = random.Random(5)
    names = [n for n in html.entities.html5]
    texts = ["AT&ampT &copy 2024 &eacute", "&notit; &notin; &no; &Aacutex &amp;amp &amp&lt", "&#1; &#x7f; &#xFDD0; &#x1FFFE; &#13; &#9;", "&#x110000; &#99999999999; &#xD800; &#0; &#150 &#x80;", "&&amp;&;&#;&#x;", "&" + "x" * 40 + "; &" + "amp" * 20]
    texts += ["".join(rnd.choice(["&" + rnd.choice(names), "&" + rnd.choice(names).rstrip(";"), " ", "x", ";", f"&#{rnd.randrange(0, 1200000)};", f"&#x{rnd.randrange(0, 70000):X}"]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.d for r in df.select("i", decode_entities("t").alias("d")).collect()}
    assert {i: t for i, t in got.items() if t != html.unescape(texts[i])} == {}


def test_unfinished_markup(spark):
    cases = {
        "a <b": "a <b", "a<!-- open": "a", "a<script>x<b>": "a", '<a href="open>text</a> end': "text end", "<p>x</p><a href='never>y<b>z</b> <c": "x y z <c",
        "<b a='1>x</b> it's <i>y</i>": "y", "<b a='1>x</b> its <i>y</i> <script>no</script>!": "x its y !", "<style>p{": "", "</": "</", "<": "<", "x<!": "x<!",
    }
    df = spark.createDataFrame(list(cases), "string").toDF("t")
    assert {r.t: r.x for r in df.select("t", markup_text("t").alias("x")).collect()} == cases


def test_hostile_pages_take_linear_time_and_no_stack(spark):
    n = 100_000
    pages = ["<a href=/x " + 'b="x" ' * n + ">hi</a>", "<script>" * n, "<!--" * n, "<a " * n, '<a b="' * n, "<" * n, "</" * n, "<a href=/y>" * n + "z", "<b " + "'" * n + ">t</b>", " d=\"<e f='>'\"" * n, "<a x" + "='" * n + ">", "<p>" * n + "text", "&" * n, "&amp" * n]
    df = spark.createDataFrame([(i, "https://ex.com/", p) for i, p in enumerate(pages)], PAGE)
    start = time.time()
    got = {r.page_id: r.t for r in df.select("page_id", html_to_text("html").alias("t")).collect()}
    found = {r.page_id: r.n for r in S.page_links(df).groupBy("page_id").agg(F.count("*").alias("n")).collect()}
    assert time.time() - start < 60
    assert (got[0], got[1], got[2], got[5], got[7], got[11]) == ("hi", "", "", "<" * n, "z", "text") and (found[0], found[7]) == (1, n)
