from postline.operators import eligibility as E
from tests.conftest import frame


def _one(spark, col, **kw):
    return frame(spark, [kw]).select(col.alias("x")).first()["x"]


US = {"Hybrid, United States of America": True, "Boise, ID": True, "Reno, Nevada": True, "USA": True,
      "Anywhere": False, "Lyon, France": False, "Berlin": False, "": False}


def test_locations(spark):
    df = frame(spark, [dict(seq=i, location=x) for i, x in enumerate(US)])
    got = {r.location: r.x for r in df.select("location", E.is_us_location("location").alias("x")).collect()}
    assert got == US


def test_location_quirks(spark):
    # trailing dot needs a word character after it; bare upper-case codes match anywhere
    assert not _one(spark, E.is_us_location("location"), location="Remote - U.S.")
    assert _one(spark, E.is_us_location("location"), location="Remote U.S.A")
    assert _one(spark, E.is_us_location("location"), location="Toronto, CA")
    assert not _one(spark, E.is_us_location("location"), location="Toronto, ca")
    # Unicode-aware word edges: a letter next to the word blocks the match
    assert not _one(spark, E.is_us_location("location"), location="éus")
    assert _one(spark, E.is_us_location("location"), location="Washington  DC")


def test_browser_filter_never_matches_state_codes(spark):
    assert not _one(spark, E.is_us_location("location", mode="names_only"), location="Seattle, WA")
    assert _one(spark, E.is_us_location("location", mode="names_only"), location="Austin, Texas")


def test_internships_by_title_or_type_only(spark):
    rows = [("Intern, Tools", "", "", True), ("Tools Programmer", "Internship", "", True), ("Tools Co-op", "", "", True),
            ("Tools Programmer", "", "Guide our interns", False), ("Internal Tools", "", "", False), ("Tools Programmer", "Contract", "", False)]
    df = frame(spark, [dict(seq=i, title=t, employment_type=e, description=d) for i, (t, e, d, _) in enumerate(rows)])
    got = {r.seq: r.x for r in df.select("seq", E.is_internship("title", "employment_type").alias("x")).collect()}
    assert [got[i] for i in range(len(rows))] == [x for *_, x in rows]


def _eligible(spark, **kw):
    df = frame(spark, [kw])
    return df.select(E.is_eligible(df).alias("x")).first()["x"]


CLEARANCE = ("Needs a security clearance.", "You hold an active clearance", "Clearance required",
             "must obtain and maintain a security clearance")
OPEN = ("We clear customs for you.", "Our secret sauce is teamwork.", "Build simulation tools.", "")


def test_clearance_language_makes_a_posting_ineligible(spark):
    rows = [dict(seq=i, title="Tools Programmer", location="Boise, ID", description=d) for i, d in enumerate(CLEARANCE + OPEN)]
    df = frame(spark, rows)
    got = df.select("seq", E.requires_clearance("title", "employment_type", "description").alias("c"), E.is_eligible(df).alias("e")).collect()
    told = {r.seq: (r.c, r.e) for r in got}
    assert [told[i] for i in range(len(rows))] == [(True, False)] * len(CLEARANCE) + [(False, True)] * len(OPEN)


def test_location_and_internship_decide_with_it(spark):
    assert _eligible(spark, title="Tools Programmer", location="Boise, ID")
    assert not _eligible(spark, title="Tools Intern", location="Boise, ID")
    assert not _eligible(spark, title="Tools Programmer", location="Oslo")


def test_folded_variants_agree(spark):
    from postline.operators.merge import flag_batch

    rows = [
        dict(seq=1, title="Engineer", location="Seattle, WA", description="Build tools."),
        dict(seq=2, title="Engineer Intern", location="Seattle, WA"),
        dict(seq=3, title="Engineer", location="Berlin"),
        dict(seq=4, title="Engineer", location="Austin", description="Active clearance needed"),
    ]
    df = frame(spark, rows)
    flags = {r.seq: r.eligible for r in flag_batch(df).collect()}
    assert flags == {1: True, 2: False, 3: False, 4: False}
