from datetime import datetime, timedelta, timezone

import pytest

from siftlake.functions import query, text
from siftlake.functions.exprs import document_terms, expand_kinds, fuzzy_terms, phrase_terms, regex_literals
from siftlake.operators.browse import ancestor_prefixes
from siftlake.operators.ranking import fuzzy_score
from siftlake.operators.search import SearchParams
from siftlake.streaming.live import CircuitBreaker, collapse_kinds

NOW = datetime(2026, 3, 6, 12, tzinfo=timezone.utc)  # a Friday


def day(stamp):
    return datetime.fromtimestamp(stamp, timezone.utc).date().isoformat()


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("plain words", ("plain words", None, None)),
        ("file:report", ("report", "file", None)),
        ("doc:exact:hello", ("hello", "doc", "exact")),
        ("regex:file: a.b", ("a.b", "file", "regex")),
        ("document:x file:y", ("x y", "file", None)),
        ("http://host", ("http://host", None, None)),
        ("EXACT:Word", ("Word", None, "exact")),
        ('exact:"two words" more', ('"two words" more', None, "exact")),
    ],
)
def test_prefixes(raw, want):
    found = query.parse_prefixes(raw)
    assert (found.query, found.scope, found.match) == want


def test_prefix_kinds_and_sources():
    found = query.parse_prefixes("type:pdf type:image source:nas/a/b/ words")
    assert (found.kinds, found.source, found.path_prefix, found.query) == (["pdf", "image"], "nas", "a/b", "words")
    assert query.parse_prefixes("type:nothing").query == "type:nothing"
    assert query.parse_prefixes("source:").error
    only = query.parse_prefixes("doc:source:nas")
    assert query.parse_prefixes("source:nas type:pdf").only_prefixes and only.query
    assert query.has_searchable_content("file:abc") and not query.has_searchable_content("file:ab") and not query.has_searchable_content("source:nas")


def test_tokens_and_modes():
    assert query.tokenize('a "b c" d"e f') == ["a", '"b c"', 'd"e f']
    assert all(query.from_mode(query.to_mode(s, m)) == (s, m) for s in query.SCOPES for m in query.MATCHES)
    assert query.to_mode("doc", "fuzzy") == "document" and query.from_mode("what") == ("line", "fuzzy")


def test_terms():
    assert phrase_terms("hello world") == ["hello world"] and phrase_terms("ab") == []
    assert fuzzy_terms("to foo") == ["foo"] and fuzzy_terms("plan.index") == ["plan", "index"] and fuzzy_terms("test^query") == ["test", "query"]
    assert document_terms("a,b foo-bar xy") == ["a,b", "foo-bar"]
    assert regex_literals("password") == "password" and regex_literals(r"class\s+Foo") == "class Foo" and regex_literals("^fn") == "fn"
    assert regex_literals(r"fatal.+encountered") == "fatal encountered" and regex_literals("^$.*+?") == "" and regex_literals(r"hello\sworld") == "hello world"
    assert expand_kinds(["image", "pdf"]) == ["dicom", "image", "pdf"]


@pytest.mark.parametrize(
    ("raw", "words", "first", "last"),
    [
        ("notes last week", "notes", "2026-02-23", "2026-03-01"),
        ("notes last weekend", "notes", "2026-02-28", "2026-03-01"),
        ("notes last month", "notes", "2026-02-01", "2026-02-28"),
        ("files last year", "files", "2025-01-01", "2025-12-31"),
        ("files in the last year", "files", "2025-03-06", "2026-03-06"),
        ("artifact in the last two days", "artifact", "2026-03-04", "2026-03-06"),
        ("report yesterday", "report", "2026-03-05", "2026-03-05"),
        ("report between january and february", "report", "2026-01-01", "2026-02-28"),
        ("contract in january", "contract", "2026-01-01", "2026-01-31"),
        ("a report since 2026-02-01", "report", "2026-02-01", "2026-03-06"),
    ],
)
def test_dates(raw, words, first, last):
    found = query.parse_dates(raw, "fuzzy", NOW)
    assert (found.query, day(found.date_from), day(found.date_to)) == (words, first, last)


def test_dates_leave_other_text_alone():
    assert query.parse_dates("the quick brown fox", "fuzzy", NOW) == query.DateQuery("quick brown fox")
    assert query.parse_dates('"the quick" brown fox', "fuzzy", NOW).query == '"the quick" brown fox'
    assert query.parse_dates("the quick fox", "exact", NOW).query == "the quick fox"
    assert query.parse_dates("foo (last|next) week", "doc-regex", NOW) == query.DateQuery("foo (last|next) week")
    assert query.parse_dates("last two days", "fuzzy", NOW) == query.DateQuery("last two days")
    before = query.parse_dates("notes before 2026-01-01", "fuzzy", NOW)
    assert before.date_from is None and day(before.date_to) == "2026-01-01"
    assert query.parse_dates("x between february and january", "fuzzy", NOW).date_from is None
    assert query.previous_weekend(datetime(2026, 3, 7, 9, tzinfo=timezone.utc))[0].day == 28


def test_small_parsers():
    assert query.parse_selection("#L20-30,43") == [(20, 30), (43, 43)] and query.parse_selection("L5") == [(5, 5)] and query.parse_selection("#x") == []
    assert query.format_selection([(20, 30), (43, 43)]) == "#L20-30,43"
    assert query.parse_ttl("30d") == 2_592_000 and query.parse_ttl("12h") == 43_200 and query.parse_ttl("0") == 0
    with pytest.raises(ValueError, match="neither"):
        query.parse_ttl("soon")
    assert query.until_next(query.parse_clock("02:00"), NOW) == timedelta(hours=14)
    assert query.version_at_least("1.2.10", "1.2.9") and not query.version_at_least("1.2", "1.2.1")
    assert len(query.link_code()) == 6
    assert query.include_prefixes(["a/b/*.txt", "c/**"]) == ["a/b", "c"] and query.include_prefixes(["*.txt"]) is None and query.include_prefixes(["!a/b"]) is None
    import re

    assert re.match(query.glob_to_regex("p/**"), "p") and re.match(query.glob_to_regex("**/*.log"), "a/b.log") and not re.match(query.glob_to_regex("*.log"), "a/b.log")


def test_search_params():
    p = SearchParams.from_request([("q", "x"), ("source", "a"), ("source", "b"), ("limit", "900"), ("case_sensitive", "1"), ("path_prefix", "/d/")])
    assert (p.sources, p.limit, p.case_sensitive, p.path_prefix) == (("a", "b"), 500, True, "d")
    for bad in ([("mode", "exact")], [("q", "x"), ("limit", "many")]):
        with pytest.raises(ValueError):
            SearchParams.from_request(bad)


def test_fuzzy_score():
    assert fuzzy_score("report.pdf", "rep") > fuzzy_score("unrelated_rep_file", "rep")
    assert fuzzy_score("hello world", "zzz") is None and fuzzy_score("anything", "") == 0
    assert fuzzy_score("Report", "rep", case_sensitive=True) is None and fuzzy_score("Report", "Rep", case_sensitive=True) > 0
    assert fuzzy_score("src/main.rs", "main src") is not None


def test_tree_prefixes():
    assert ancestor_prefixes("a.zip::b/inner.zip::c/file.txt") == ["", "a.zip::", "a.zip::b/", "a.zip::b/inner.zip::", "a.zip::b/inner.zip::c/"]
    assert ancestor_prefixes("dé/x") == ["", "dé/"]


@pytest.mark.parametrize(("events", "want"), [("CU", "C"), ("CD", "D"), ("DC", "C"), ("UD", "D"), ("DU", "U"), ("DCU", "C"), ("CDU", "U"), ("U", "U")])
def test_collapse(events, want):
    assert collapse_kinds(list(events)) == want


def test_word_wrap():
    assert text.wrap_words("short") == ["short"] and text.wrap_words("a  b", 3) == ["a b"] and text.wrap_words("x" * 7, 3) == ["xxx", "xxx", "x"]
    assert text.wrap_words("aa bb cc", 5) == ["aa bb", "cc"] and text.wrap_words(" " * 9, 3) == [""] and text.wrap_words("long line", 0) == ["long line"]
    assert text.wrap_words("abcdef gh", 3, split_long=False) == ["abcdef", "gh"]
    lines = [(0, "p"), (1, "m"), (2, '{"a":'), (3, "[1,2,], // note"), (4, "}")]
    assert text.normalise(lines, "json") == [(0, "p"), (1, "m"), (2, "{"), (3, '  "a": ['), (4, "    1,"), (5, "    2"), (6, "  ]"), (7, "}")]
    assert text.normalise([(2, "{broken ")], "json") == [(2, "{broken")]
    assert text.normalise([(2, "aa bb cc")], "txt", width=5, exempt=("txt",)) == [(2, "aa bb cc")]


def test_circuit_breaker():
    told = []
    breaker = CircuitBreaker(2, told.append)
    assert breaker.record(False) and not breaker.record(False) and breaker.open and told == [2]
    assert breaker.record(True) and not breaker.open
