from postline.constants import EXPORT_CONTROL_PHRASE
from postline.operators.merge import flag_batch
from postline.operators.scoring import Rule, score_by_tokens, score_postings
from tests.conftest import frame

RULES = [
    Rule("include", 0, "C++", 10.0),
    Rule("include", 1, "Vulkan", 15.0),
    Rule("title_boost", 0, "Rendering Engineer", 30.0),
    Rule("exclude", 0, "Sales", 50.0),
]


def _score(spark, rules=RULES, **kw):
    r = score_postings(frame(spark, [kw]), rules).first()
    return r.match_score, r.match_reason


def test_relevant_job_scores_highly(spark):
    score, reason = _score(spark, title="Rendering Engineer", description="Build Vulkan systems using C++.")
    assert score == 55
    assert "Rendering Engineer" in reason and "Vulkan" in reason
    assert reason == 'Matched: title "Rendering Engineer" +30, "C++" +10, "Vulkan" +15'


def test_exclusion_penalty_clamps_at_zero(spark):
    score, reason = _score(spark, title="Sales Manager")
    assert score == 0
    assert reason == 'No configured positive keywords matched. Penalties: "Sales" -50'


def test_export_control_phrase_penalizes_job(spark):
    score, reason = _score(
        spark, title="Security Engineer",
        description="Must be a U.S. Person due to required access to U.S. export controlled information or facilities.",
    )
    assert score == 0
    assert "export controlled information or facilities" in reason
    assert EXPORT_CONTROL_PHRASE in reason


def test_title_wins_over_description_and_labels(spark):
    rules = [Rule("include", 0, "Vulkan", 15.0)]
    score, reason = _score(spark, rules, title="Vulkan dev", description="Vulkan")
    assert (score, reason) == (22, 'Matched: title "Vulkan" +22.5')  # 22.5 rounds half to even


def test_whole_word_only(spark):
    rules = [Rule("include", 0, "AR", 10.0)]
    assert _score(spark, rules, title="x", description="Our AR team")[0] == 10
    assert _score(spark, rules, title="x", description="Arcade, bar, AR_x")[0] == 0
    assert _score(spark, rules, title="x", description="ÉAR")[0] == 0


def test_token_join_path_matches_literal_path(spark):
    import random

    random.seed(7)
    words = ["rendering", "engineer", "vulkan", "c++", "sales", "graphics", "la", "the", "x"]
    rows = [
        dict(seq=i, title=" ".join(random.choices(words, k=3)), description=" ".join(random.choices(words, k=12)))
        for i in range(60)
    ]
    rules = [
        Rule("include", 0, "C++", 10.0), Rule("include", 1, "Vulkan", 15.0), Rule("include", 2, "graphics", 7.5),
        Rule("title_boost", 0, "Rendering Engineer", 30.0), Rule("exclude", 0, "Sales", 50.0),
    ]
    df = frame(spark, rows)
    a = {r.seq: (r.match_score, r.match_reason) for r in score_postings(df, rules).collect()}
    b = {r.seq: (r.match_score, r.match_reason) for r in score_by_tokens(df, rules).collect()}
    assert a == b


def test_token_path_labels_follow_g_format(spark):
    rules = [Rule("include", 0, "vulkan", 12.3456789), Rule("include", 1, "opengl", 1234567.0),
             Rule("title_boost", 0, "graphics", 0.5), Rule("exclude", 0, "sales", 7.25)]
    rows = [dict(seq=1, title="graphics vulkan", description="opengl sales")]
    df = frame(spark, rows)
    a = score_postings(df, rules).first().match_reason
    b = score_by_tokens(df, rules).first().match_reason
    assert a == b, (a, b)


def test_thousands_of_rules_through_flag_batch(spark):
    """More rules than literal columns take: same scores, also for keywords that begin with no word character or have none."""
    few = [Rule("include", 0, "C++", 10.0), Rule("include", 1, ".NET", 7.0), Rule("include", 2, "++", 3.0), Rule("title_boost", 0, "#1 engineer", 20.0), Rule("exclude", 0, "sales", 4.0)]
    many = few + [Rule("include", 10 + i, f"absent{i}", 1.0) for i in range(5000)]
    df = frame(spark, [
        dict(seq=1, title="#1 Engineer", description="C++ and .NET", location="Austin, TX"),
        dict(seq=2, title="Engineer", description="x ++ y, sales", location="Austin, TX"),
        dict(seq=3, title="C++ Engineer", location="Toronto, Canada"),
        dict(seq=4, title="Plain", location="Austin, TX"),
    ])
    want, got = ({r.seq: (r.eligible, r.match_score, r.match_reason) for r in flag_batch(df, rules).collect()} for rules in (few, many))
    assert got == want
    assert want[1][1] == 37 and want[3] == (False, None, None) and "++" in want[2][2]
