import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import langid, quality
from lodeseek.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def test_thresholds_are_ordered_and_tails_fall():
    rng = np.random.default_rng(0)
    words = ["good", "fine", "trash", "!!junk!!"]
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        text = " ".join(rng.choice(words[:2], 8)) + (" trash" if g == 0 else " !!junk!! !!JUNK!!" if g == 1 else "")
        rows.append(quality.vector(text))
        grades.append(g)
    m = quality.fit(rows, np.array(grades))
    assert m.thresholds[0] < m.thresholds[1]
    score = lambda t: sum(float(m.weights[i]) * v for i, v in zip(*quality.vector(t), strict=True))
    bad, poor, good = (score(t) for t in ("good fine fine good trash", "good fine fine !!junk!! !!JUNK!!", "good fine fine good"))
    assert bad < m.thresholds[0] < poor < m.thresholds[1] < good
    assert m.tails(good)[0] > m.tails(good)[1] > 0.5


def plain_loss(rows, grades, weights, thresholds, l2):
    """Mean negative log-likelihood of the cumulative-link model, and the penalty, by the formula."""
    total = 0.0
    for (ids, vals), g in zip(rows, grades, strict=True):
        s = sum(weights.get(int(i), 0.0) * v for i, v in zip(ids, vals, strict=True))
        at_least = [1.0, *(1 / (1 + np.exp(t - s)) for t in thresholds), 0.0]
        total -= np.log(at_least[g] - at_least[g + 1])
    return total / len(rows) + l2 / 2 * sum(w * w for w in weights.values())


def test_fit_is_the_maximum_of_the_likelihood():
    """An independent check: at the fitted point all numeric derivatives of the plain formula vanish, and no step away is better."""
    rng = np.random.default_rng(6)
    rows, grades = [], []
    for _ in range(240):
        ids = np.flatnonzero(rng.random(6) < 0.5).astype(np.int32)
        rows.append((ids, rng.uniform(0.5, 1.5, len(ids))))
        score = sum((i - 2.5) * 0.8 * v for i, v in zip(*rows[-1], strict=True)) + rng.logistic()
        grades.append(int(score > -1) + int(score > 1.5))
    grades, l2 = np.array(grades), 1e-2
    m = quality.fit(rows, grades, l2=l2, rounds=6000, rate=0.02, least_chi2=0)
    w, t = dict(m.weights), np.array(m.thresholds)
    best = plain_loss(rows, grades, w, t, l2)
    assert len(w) == 6 and t[0] < t[1]
    for k in [*w, "t0", "t1"]:
        moved = []
        for d in (1e-4, -1e-4):
            w2, t2 = dict(w), t.copy()
            if k in w2:
                w2[k] += d
            else:
                t2[int(k[1])] += d
            moved.append(plain_loss(rows, grades, w2, t2, l2))
        assert abs(moved[0] - moved[1]) / 2e-4 < 2e-4 and min(moved) > best - 1e-9


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = quality.grades(labels).where(F.col("doc_id") % 3 != 0)
    rest = labels.where(F.col("doc_id") % 3 == 0)
    model = quality.train(docs, seen)
    got = quality.score(docs.join(rest, "doc_id"), model).select("quality", "toxic", "kept").toPandas()
    share = got.groupby(["quality", "toxic"])["kept"].mean()
    assert share[1, 0] > 0.98 and share[0, 0] < 0.1 and share[1, 1] < 0.08


def test_scores_are_those_of_the_plain_sum_and_nulls(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, None), (3, ""), (4, " \n"), (1, "good text here"), (None, "good")], "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("_c0", F.lit(1)).withColumn("_t", F.lit(2))
    ratings = spark.createDataFrame([(1, 2), (None, 1), (2, None), (3, 0), (3, 1), (9, 7)], "doc_id long, grade int")
    model = quality.train(docs, ratings)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 6 and {"_c0", "_t", "expected_grade", "tail_probs", "kept"} <= set(rows[0].asDict())
    for r in rows:
        if r.doc_id in (2, 3, 4):
            assert (r.expected_grade, r.tail_probs, r.kept) == (0.0, [0.0, 0.0], False)
    none = quality.train(docs, ratings.limit(0))
    assert none.weights is None and [r.kept for r in quality.score(docs, none).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [True, True, True, False, False, False]
    assert quality.score(docs.limit(0), none).count() == 0
    real = quality.Model(np.random.default_rng(1).standard_normal(1 << quality.BITS), np.array([-1.0, 1.0]))
    for r in quality.score(docs.where("text like 'good%'"), real).collect():
        want = sum(float(real.weights[i]) * v for i, v in zip(*quality.vector(r.text), strict=True))
        assert r.tail_probs == pytest.approx(real.tails(want), abs=1e-12)


def plain_fusion(rows, langs):
    """The posterior in plain Python. rows: dicts of host, parent, declared, suffix, letters, ll."""
    k = len(langs) + 1
    soft = lambda x: np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
    for r in rows:
        p = soft(r["ll"])
        r["vote"] = int(p.argmax()) if r["letters"] and p.max() >= langid.VOTE_AT else -1
    voted = [r for r in rows if r["vote"] >= 0]
    count = lambda key, value: np.array([sum(r["vote"] == i and r[key] == value for r in voted) for i in range(k)], float)
    smooth = lambda n, prior, s: (n + s * prior) / (n.sum() + s)
    overall = smooth(np.array([sum(r["vote"] == i for r in voted) for i in range(k)], float), np.full(k, 1 / k), float(k))
    out = []
    for r in rows:
        prior = overall
        if r["host"] is not None and count("host", r["host"]).sum():
            n = count("host", r["host"])
            if r["vote"] >= 0:
                n[r["vote"]] -= 1
            up = smooth(count("parent", r["parent"]), overall, 20.0) if r["parent"] is not None else overall
            prior = smooth(n, up, 5.0)
        logs = np.array(r["ll"]) + np.log(prior)
        for key in ("declared", "suffix"):
            if r[key] is not None and count(key, r[key]).sum():
                logs = logs + np.log(smooth(count(key, r[key]), overall, 20.0) / overall)
        p = soft(logs)
        out.append((([*langs, "und"][int(p.argmax())] if r["letters"] else "und"), round(float(p.max()), 6) if r["letters"] else 1.0))
    return out


def test_fusion_is_that_of_plain_python(spark):
    rng = np.random.default_rng(8)
    langs, rows = ["de", "en"], []
    for i in range(150):
        ll = [0.0, 0.0, -8.0]
        ll[int(rng.integers(0, 2))] = -float(rng.choice([0.1, 1.0, 9.0]))
        host = rng.choice(["a.x.org", "b.x.org", "c.y.de", None], p=[0.5, 0.2, 0.2, 0.1])
        rows.append({"id": i, "host": host, "parent": None if host is None else host[2:], "declared": rng.choice(["de", "en", None]), "suffix": None if host is None else host.rsplit(".", 1)[1], "letters": bool(rng.random() < 0.95), "ll": ll})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "id int, host string, parent string, declared string, suffix string, letters boolean, ll array<double>")
    got = {r.id: (r.lang, r.posterior) for r in langid.fuse(df, langs).collect()}
    for i, (lang, p) in enumerate(plain_fusion(rows, langs)):
        assert got[i][1] == pytest.approx(p, abs=2e-6) and (got[i][0] == lang or abs(p - 0.5) < 1e-4)


def test_trigrams_of_long_texts_are_cut_without_loss():
    text = "Über den Wolken 12 " * 60000
    model = np.random.default_rng(0).standard_normal((langid.BUCKETS, 2))
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([text, "", None]), pa.array([1, 2, 3])], names=["text", "id"])
    (out,) = langid.likelihoods(model)(iter([b]))
    whole = model[langid.trigram_buckets(text)].sum(0)
    assert out["ll"].to_pylist()[0] == pytest.approx((langid.TEMPER * (whole - whole.max())).tolist(), rel=1e-9)
    assert out["ll"].to_pylist()[1:] == [[0.0, 0.0]] * 2


@pytest.mark.parametrize("text", ["", "a", "ab 1c", "Straße İi " * 50, "x" * 999])
def test_stretches_of_trigrams_are_the_whole(monkeypatch, text):
    low = f" {text} ".lower()
    whole = langid.trigram_buckets(text)
    for chunk in (1, 2, 7, 100):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.array_equal(langid.trigram_buckets(text), whole)
    assert len(whole) == sum(not any("0" <= c <= "9" for c in low[i : i + 3]) for i in range(len(low) - 2))


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    rows = [(1, "viele worte", "de")] * 500 + [(1, "alle worte", "de"), (2, "the words", "en"), (3, "more words", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.fit(docs, sample_per_lang=10)
    once = langid.fit(spark.createDataFrame([rows[500], *rows[501:]], docs.schema), sample_per_lang=10)
    assert got[0] == once[0] == ["de", "en"] and np.array_equal(got[1], once[1])


def test_open_tags_are_read_in_linear_time(spark):
    pages = spark.createDataFrame([(1, "http://h.de/", "<p>Wort " + "<" * 200_000), (2, "http://h.de/", "Wort " + "<!-- " * 60_000), (3, "http://h.de/", "Wort " + "<script " * 40_000), (4, None, "a < b <b>und</b> c")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in langid.of_pages(pages).collect()}
    assert got[1].split()[0] == got[2].split()[0] == got[3].split()[0] == "Wort" and got[2].split() == ["Wort"] and got[4].split() == ["a", "<", "b", "und", "c"]


def test_language_id_finds_the_languages(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    langs, model = langid.fit(docs.where("doc_id % 4 > 0"))
    rows = langid.of_documents(docs).unionByName(langid.of_pages(pages))
    got = langid.identify(rows, langs, model, ["doc_id", "page_id"], Scratch(spark, "t"))
    held = got.join(docs.where("doc_id % 4 = 0").select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    assert (held.lang == held.truth).mean() > 0.98 and held.kept.mean() > 0.98
    told = got.join(pages.select("page_id", F.regexp_extract("html", 'lang="(..)"', 1).alias("truth")), "page_id").toPandas()
    assert (told.lang == told.truth).mean() > 0.9 and len(told) == 250


def test_language_id_of_nothing_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, "s", None), (2, "", None, "en"), (3, "12 34", "s", "en"), (None, "ein wort", "s", "de"), (5, "the word", "s", "en"), (5, "the word", "s", "en")], "doc_id long, text string, source string, lang string").withColumn("host", F.lit("clash")).withColumn("ll", F.lit(0))
    for given in (docs, docs.limit(0)):
        langs, model = langid.fit(given)
        got = langid.identify(langid.of_documents(given), langs, model, ["doc_id", "page_id"], Scratch(spark, "t")).collect()
        assert len(got) == given.count() and all(r.lang == "und" and not r.kept for r in got if r.doc_id in (1, 2, 3))
    odd = spark.createDataFrame([(1, None, None), (2, "no url", "<p>text"), (3, "http://u@H.Example.DE:80/x", "<html lang=de><script>x</script>Wort")], "page_id long, url string, html string")
    p = {r.page_id: r for r in langid.of_pages(odd).collect()}
    assert (p[3].host, p[3].parent, p[3].suffix, p[3].declared, p[3].text.strip()) == ("h.example.de", "example.de", "de", "de", "Wort") and p[1].host is None and p[2].declared is None


@pytest.mark.parametrize("cells", [langid.CELLS, 70 << 12])
def test_every_labelled_language_has_a_model(spark, monkeypatch, cells):
    """70 languages of words of their own, the rarest ones as short as three documents; 'und' is the commonest label."""
    monkeypatch.setattr(langid, "CELLS", cells)
    rng = np.random.default_rng(3)
    names, rows = [f"l{i:02d}" for i in range(70)], []
    for i, name in enumerate(names):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)]
        rows += [(" ".join(rng.choice(words, 60)), name) for _ in range(3 + (70 - i) // 10)]
    rows += [("12 34", "und")] * 30
    docs = spark.createDataFrame([(i, t, None, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, source string, lang string")
    langs, model = langid.fit(docs)
    assert langs == names and model.shape == (langid.buckets_for(70), 71) and model.size <= max(cells, 71 << 12) + (1 << 16)
    got = {r.doc_id: (r.lang, r.kept) for r in langid.identify(langid.of_documents(docs), langs, model, ["doc_id", "page_id"], Scratch(spark, "t")).collect()}
    assert got == {i: (x, x != "und") for i, (_, x) in enumerate(rows)}
