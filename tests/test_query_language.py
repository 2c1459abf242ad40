import pytest

from lodeseek import KeywordField, Schema, StoredField, TextField
from lodeseek.errors import QueryError, QuerySyntaxError, TooManyTermsError
from lodeseek.plans.compiler import rewrite
from lodeseek.plans.parser import lex, parse_query
from lodeseek.plans.query import MATCH_NOTHING, BooleanClause, BooleanQuery, MatchAllQuery, Occur, PhraseQuery, PrefixQuery, TermQuery

S = Schema({"id": KeywordField(stored=True), "title": TextField(stored=True), "body": TextField(stored=True), "raw": StoredField()})
T = lambda t, f="body": TermQuery(f, t)


def B(*pairs):
    return BooleanQuery(tuple(BooleanClause(Occur[o], q) for o, q in pairs))


@pytest.mark.parametrize(
    "text, want",
    [
        ("kafka", T("kafka")),
        ("Kafka Replicas", B(("SHOULD", T("kafka")), ("SHOULD", T("replicas")))),
        ("a OR b AND c", B(("SHOULD", T("a")), ("SHOULD", B(("MUST", T("b")), ("MUST", T("c")))))),
        ("a and not b", B(("MUST", T("a")), ("MUST_NOT", T("b")))),
        ("NOT a OR b", B(("MUST_NOT", T("a")), ("SHOULD", T("b")))),
        ("NOT a", B(("MUST_NOT", T("a")))),
        ("NOT (NOT b)", T("b")),
        ("- - b", T("b")),
        ("a AND (NOT b)", B(("MUST", T("a")), ("MUST_NOT", T("b")))),
        ("a AND (NOT b OR NOT c)", B(("MUST", T("a")), ("MUST", B(("MUST_NOT", T("b")), ("MUST_NOT", T("c")))))),
        ("title:body:x", T("x")),
        ("title:(x y)", B(("SHOULD", T("x", "title")), ("SHOULD", T("y", "title")))),
        ("id:doc-1", T("doc-1", "id")),
        ("doc-1", B(("SHOULD", T("doc")), ("SHOULD", T("1")))),
        ("a -b", B(("SHOULD", T("a")), ("MUST_NOT", T("b")))),
        ('"follower replicas"', PhraseQuery("body", ("follower", "replicas"), (0, 1))),
        ('"The one the two"', PhraseQuery("body", ("one", "two"), (0, 2))),
        ('"one"', T("one")),
        (r'"a \"b\" \\"', PhraseQuery("body", ("a", "b"), (0, 1))),
        ("App*", PrefixQuery("body", "app")),
        ("id:App*", PrefixQuery("id", "App")),
    ],
)
def test_parses(text, want):
    assert parse_query(text, S, "body") == want


def test_double_hyphen_is_two_signs():
    assert parse_query("a--b", S, "body") == B(("SHOULD", T("a")), ("SHOULD", T("b")))


@pytest.mark.parametrize("text", ["", "   ", "AND", "a AND", "(a", "()", "a)", "the", '"the"', "the*", "kafka the", '"open', '"a\\x"', '"a\\', "a*b", "*", "a**", "title:-x", "title:NOT x", "nope:x", "raw:x", "title:", ":x", "a-b*", "NOT"])
def test_syntax_errors_tell_where(text):
    with pytest.raises(QuerySyntaxError) as e:
        parse_query(text, S, "body")
    assert 0 <= e.value.offset <= len(text) and str(e.value).endswith("^")


def test_lexing_comes_before_the_default_field():
    with pytest.raises(QuerySyntaxError, match="without its end"):
        parse_query('"x', S, "nope")
    with pytest.raises(QuerySyntaxError, match="default field"):
        parse_query("x", S, "nope")
    with pytest.raises(TypeError):
        lex(3)
    assert [(t.kind, t.text, t.start, t.end) for t in lex("a:b-c")] == [("WORD", "a", 0, 1), ("COLON", ":", 1, 2), ("WORD", "b-c", 2, 5), ("EOF", "", 5, 5)]


@pytest.mark.parametrize(
    "make",
    [
        lambda: TermQuery("", "x"),
        lambda: TermQuery("f", ""),
        lambda: PrefixQuery("f", ""),
        lambda: PhraseQuery("f", ()),
        lambda: PhraseQuery("f", ("a", "")),
        lambda: PhraseQuery("f", ("a", "b"), (0, 0)),
        lambda: PhraseQuery("f", ("a", "b"), (1, 2)),
        lambda: PhraseQuery("f", ("a", "b"), (0,)),
        lambda: PhraseQuery("f", ("a",), slop=1),
        lambda: BooleanQuery(()),
        lambda: BooleanClause("MUST", MatchAllQuery()),
        lambda: BooleanClause(Occur.MUST, "x"),
    ],
)
def test_impossible_queries(make):
    with pytest.raises(QueryError):
        make()


def test_rewrite():
    words = ["app", "apple", "application", "banana"]
    terms = lambda f, p, n: [w for w in words if w.startswith(p)][:n]
    assert rewrite(PrefixQuery("body", "zzz"), terms) == MATCH_NOTHING
    assert rewrite(PrefixQuery("body", "ban"), terms) == T("banana")
    assert rewrite(B(("MUST", PrefixQuery("body", "app"))), terms) == B(("MUST", B(*(("SHOULD", T(w)) for w in words[:3]))))
    with pytest.raises(TooManyTermsError):
        rewrite(PrefixQuery("body", "app"), terms, 2)
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            rewrite(T("a"), terms, bad)
