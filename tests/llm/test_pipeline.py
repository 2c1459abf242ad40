import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lodeseek.llm import langid, packing, quality
from test_dedup import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's output over its predecessor's, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "_"))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_all_but_the_last_have_the_columns_of_documents(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_stage_is_the_plain_decision(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(stages[0], quality.grades(labels))

    def keeps(text):
        score = sum(float(model.weights[i]) * v for i, v in zip(*quality.vector(text), strict=True))
        return bool(text.split()) and model.tails(score)[1] >= 0.5

    assert rows(stages[1]) == [(i, t) for i, t in rows(stages[0]) if keeps(t)]
    clean = labels.where("quality = 1 and toxic = 0").join(stages[0], "doc_id", "left_semi")
    assert clean.join(stages[1], "doc_id", "left_semi").count() >= 0.97 * clean.count()


def test_language_stage_is_the_plain_decision(spark, stages):
    langs, model = langid.fit(stages[1])
    got = {r.doc_id: r.lang for r in stages[2].collect()}
    for r in stages[1].collect():
        ll = langid.TEMPER * model[langid.trigram_buckets(r.text)].sum(0)
        top = np.argsort(-ll)
        if ll[top[0]] - ll[top[1]] > 12:  # beyond what any prior can turn
            assert got.get(r.doc_id) == (None if top[0] == len(langs) else langs[top[0]])


def test_near_duplicate_stage_keeps_the_first_of_each_group(stages):
    parts = plain_components(rows(stages[2]))
    assert rows(stages[3]) == [(i, t) for i, t in rows(stages[2]) if parts[i][1] == i]


def kept_text(data, seen):
    """What is left of a text, each part decoded by itself, as windows of 100 bytes not seen before."""
    gone = bytearray(len(data))
    for s in range(len(data) - 99):
        if data[s : s + 100] in seen:
            gone[s : s + 100] = b"\x01" * 100
        seen.add(data[s : s + 100])
    parts, part = [], bytearray()
    for c, g in zip(data, gone, strict=True):
        if g:
            parts.append(bytes(part))
            part = bytearray()
        else:
            part.append(c)
    return any(gone), "".join(p.decode("utf-8", "ignore") for p in [*parts, bytes(part)])


def test_substring_stage_is_brute_force(stages):
    want, seen = [], set()
    for i, text in rows(stages[3]):
        cut, left = kept_text(text.encode(), seen)
        if left or not cut:
            want.append((i, left))
    assert rows(stages[4]) == want
    assert {r.doc_id: r.n_chars for r in stages[4].where("n_chars is not null").collect()} == {i: len(t) for i, t in want}


def test_packing_stage_holds_every_document(stages):
    slow = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows(stages[4])}
    got = {r.doc_id: r.n for r in stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, stages[5].select(*cols).collect()))


def test_nulls_empty_texts_and_empty_tables(spark, tmp_path):
    """Rows that have no words go at the first stage, a row without an id stays; nothing in gives nothing out."""
    german = "Das ist ein Wort und noch ein Wort mit vielen anderen Worten"
    docs = spark.createDataFrame([(1, None, "de", None, None), (2, "", None, "s", 0), (None, german, "de", "s", len(german)), (4, "Ein ganz anderer Satz steht hier", "de", "s", 32)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash")).withColumn("_t", F.lit(0))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, docs.limit(0)):
        out = given
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, str(tmp_path))
        assert sorted((r.doc_id, r.start) for r in out.collect()) == ([] if given is not docs else [(4, 0)]) if None not in [r.doc_id for r in out.collect()] else sorted(str(r.doc_id) for r in out.collect()) == ["4", "None"]


def test_rows_without_an_id_of_their_own_are_judged(spark):
    """Ids that are missing or have several texts: each text is a document, dropped or kept by what it says."""
    words = lambda a, n: " ".join(f"w{(a * 131 + k * k) % 977}" for k in range(n))
    given = [(None, words(1, 80)), (None, words(2, 80)), (None, words(2, 80)), (3, words(2, 80)), (4, words(4, 80)), (4, words(5, 80)), (5, words(5, 80) + " end"), (None, words(6, 80)), (None, words(6, 80) + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()), key=str)
    either = [sorted([given[0], given[3], given[4], given[6], x], key=str) for x in (given[7], given[8])]
    assert got in either
    rows_ = [(None, "Das ist ein Wort", "de"), (None, "123 456", "de"), (7, "987 654", "en"), (7, "That is the word", "en"), (8, "These are words", None), (9, "Und noch ein Wort", "de")] * 2
    docs = spark.createDataFrame([(i, t, x, None, 1) for i, t, x in rows_], docs.schema)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.language_stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(i, t) for i, t, _ in rows_ if not t[0].isdigit()], key=str)


def test_entry_has_all_queries_and_lives_without_them(tmp_path):
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
    subprocess.run(["cp", "-r", __spark_entry__.__file__, f"{__spark_entry__.__file__.rsplit('/', 1)[0]}/lodeseek", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "lodeseek/llm")], check=True)
    left = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert left.stdout.split()[-1] == "0"


def test_repeated_rows_pass_the_near_duplicate_stage_once(spark):
    text = "one two three four five six seven eight"
    given = [(1, text, "en", "b", 39), (1, text, "en", "a", 39), (1, text, "en", "b", 39), (2, text, "en", "s", 39), (3, "another text of five words", "en", "s", 26), (4, "first of two texts here", "en", "s", 23), (4, "and this is the second one", "en", "s", 26), (5, "this has no words in common", None, None, None), (5, "this has no words in common", None, None, None), (None, "without any id at all", "en", "s", 21), (None, "without any id at all", "en", "s", 21)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted([given[1], *given[4:7], *given[7:8], given[9]], key=str)
