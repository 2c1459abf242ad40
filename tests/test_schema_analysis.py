import random

import pytest
from pyspark.sql import functions as F

from lodeseek import KeywordField, Schema, StoredField, TextField
from lodeseek.errors import SchemaError
from lodeseek.functions.analysis import Analyzer, KeywordAnalyzer, LowercaseFilter, StandardAnalyzer, StandardTokenizer, StopwordFilter, Token, analyzer_named


def test_schema_is_ordered_and_fingerprinted():
    a = Schema({"b": TextField(boost=2), "a": KeywordField()})
    b = Schema({"a": KeywordField(), "b": TextField(boost=2.0)})
    assert list(a) == ["a", "b"] and a == b and a.fingerprint == b.fingerprint
    assert Schema.from_dict(a.to_dict()) == a
    assert Schema({"a": KeywordField(stored=True), "b": TextField(boost=2)}).fingerprint != a.fingerprint
    assert (a.indexed, a.stored) == (["a", "b"], [])


@pytest.mark.parametrize("boost", [0, -1, float("nan"), float("inf"), True])
def test_bad_boosts(boost):
    with pytest.raises(SchemaError):
        TextField(boost=boost)


def test_bad_schemas_and_documents():
    with pytest.raises(SchemaError):
        Schema({})
    s = Schema({"a": TextField(), "raw": StoredField()})
    assert s.check_document({}) == {} and s.check_document({"a": ""}) == {"a": ""}
    for bad in ({"x": "y"}, {"a": 1}, {"a": None}):
        with pytest.raises(SchemaError):
            s.check_document(bad)
    with pytest.raises(SchemaError):
        Schema.from_dict({"a": {"indexed": True}})


def test_python_tokens():
    an = Analyzer(StandardTokenizer(), (LowercaseFilter(), StopwordFilter({"and"})))
    assert an.analyze("Kafka AND Replicas") == (Token("kafka", 0, 0, 5), Token("replicas", 2, 10, 18))
    assert StandardAnalyzer().analyze("你好 Kafka") == (Token("你好", 0, 0, 2), Token("kafka", 1, 3, 8))
    assert StandardAnalyzer().analyze("the The THE") == ()
    assert KeywordAnalyzer().analyze("") == () and KeywordAnalyzer().analyze("A b") == (Token("A b", 0, 0, 3),)
    with pytest.raises(ValueError):
        analyzer_named("other")
    with pytest.raises(ValueError):
        Token("", 0, 0, 1)


def test_columns_give_what_python_gives(spark):
    rng = random.Random(4)
    texts = ["", "the", "x", " a  b ", "İstanbul İ the end", "snake_case 3rd…", "é́ a", "a" * 500]
    texts += ["".join(rng.choice("ab TheÉß9_-.\n你😀") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for an in (StandardAnalyzer(), KeywordAnalyzer()):
        for i, full, short in rows.select("i", an.column(F.col("t")), an.terms(F.col("t"))).collect():
            want = an.analyze(texts[i])
            assert [tuple(t) for t in full] == [(t.term, t.position, t.start, t.end) for t in want], texts[i]
            assert [tuple(t) for t in short] == [(t.term, t.position) for t in want]
    assert rows.select(StandardAnalyzer().column(F.lit(None).cast("string"))).first()[0] is None
