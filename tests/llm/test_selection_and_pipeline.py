"""Quality classifier, mixture, the pipeline's stages and the registered queries."""

import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tallywick.llm import mixture, ordinal_quality, queries
from tallywick.session import table

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    model = ordinal_quality.fit(docs, labels.filter("doc_id % 4 <> 0"), ordinal_quality.rated_grade())
    assert model.thresholds[0] < model.thresholds[1]
    held = ordinal_quality.score(docs, model, grade=2).join(labels.filter("doc_id % 4 = 0"), "doc_id")
    got = {r.g: r for r in held.groupBy(ordinal_quality.rated_grade().alias("g")).agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.avg("expected_grade").alias("e")).collect()}
    assert got[2].kept > 0.95 and got[0].kept < 0.15 and got[1].kept < 0.3
    assert got[0].e < got[1].e < got[2].e


def test_classifier_edges(spark, make):
    rows = [(i, "good words here" if i % 2 else "bad stuff only") for i in range(60)] + [(90, None), (91, ""), (92, "x " * 300_000), (1, "good words here"), (None, "good")]
    docs = make(rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, None), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = ordinal_quality.fit(docs, labels, ordinal_quality.rated_grade())
    scored = ordinal_quality.score(docs, model, grade=2)
    assert scored.count() == len(rows) and scored.select("keep").distinct().count() == 2
    kept = ordinal_quality.selected(docs, model, grade=2)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.filter("doc_id < 60").collect()} == set(range(1, 60, 2))
    assert {r.keep for r in kept.select("keep").distinct().collect()} == {"own keep"}
    for some, share in ((labels.limit(0), 1), (labels.filter("quality = 1"), 1), (labels.filter("quality = 0"), 0)):
        only = ordinal_quality.fit(docs, some, ordinal_quality.rated_grade())
        assert ordinal_quality.selected(docs, only, grade=2).count() == share * len(rows)
    assert ordinal_quality.selected(make([]), model).count() == 0


def test_capitals_count_over_the_whole_text():
    f = ordinal_quality.Features(20)
    a, b = "UPPER CASE " * 1000, "lower case words " * 900
    assert f.of(a + b).tolist() == f.of(b + a).tolist()
    marked = set(f.of(a + b).tolist()) - {f.of(w)[0] for w in (a + b).split()} - set(f.of(a.lower() + b).tolist())
    assert len(marked) == 1 and ordinal_quality.capitals(a + b) == 9000
    assert ordinal_quality.capitals("\u0130Ab") == 2 and ordinal_quality.capitals("") == 0


def brute_tails(text, model):
    """Tail probabilities of a text from the definition: distinct tokens, hashed, summed."""
    found = {t for t in re.findall(r"\w+|[^\w\s]+", text.lower())}
    if text.isupper():
        found.add("\x00upper")
    elif sum(c != c.lower() for c in text) * 3 > len(text):
        found.add("\x00capitals")
    slots = {xxhash.xxh32_intdigest(t.encode()) % 2**model.bits for t in found}
    score = sum(float(model.weights[s]) for s in slots)
    return [1 / (1 + math.exp(t - score)) for t in model.thresholds]


def test_quality_query_against_brute_force(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = ordinal_quality.fit(docs, labels, ordinal_quality.rated_grade())
    got = {r.doc_id: r for r in queries.op7_ordinal_quality(spark, DATA).collect()}
    for r in docs.collect():
        tails = brute_tails(r.text or "", model)
        assert (r.doc_id in got) == (tails[1] >= 0.5)
        if r.doc_id in got:
            assert abs(got[r.doc_id].tail_probability - tails[1]) < 1e-5 and abs(got[r.doc_id].expected_grade - sum(tails)) < 1e-5


def test_the_fit_is_bounded(spark, make):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(40)] * 3 + [(1, "a shorter text")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    seen = []
    real = ordinal_quality.train_ordinal
    ordinal_quality.train_ordinal = lambda offsets, ids, grades, *a, **k: seen.append((len(grades), len(ids))) or real(offsets, ids, grades, *a, **k)
    try:
        ordinal_quality.fit(make(rows), labels, ordinal_quality.rated_grade())
        ordinal_quality.fit(make(rows), labels, ordinal_quality.rated_grade(), max_features=500)
    finally:
        ordinal_quality.train_ordinal = real
    assert seen[0][0] == 40 and seen[1][1] <= 500


def test_gradient_by_differences():
    """The fit lowers the cumulative logit loss to where no single weight improves it."""
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 16, 5)).astype(np.int32) for _ in range(400)]
    grades = np.array([min(2, int(3 in s) + int(5 in s)) for s in sets])
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    m = ordinal_quality.train_ordinal(offsets, np.concatenate(sets), grades, 4, rounds=800, min_z=0)

    def loss(w, t):
        score = np.array([w[s].sum() for s in sets])
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        sig = lambda x: 1 / (1 + np.exp(-x))
        with np.errstate(over="ignore"):
            p = sig(score - edge[grades]) - sig(score - edge[grades + 1])
        return -np.log(p).mean() + 1e-4 * (w**2).sum()

    base = loss(m.weights.astype(float), m.thresholds)
    for j in range(16):
        for d in (-0.3, 0.3):
            w = m.weights.astype(float)
            w[j] += d
            assert loss(w, m.thresholds) > base - 1e-3


def test_raking_meets_its_targets(spark):
    rng = random.Random(1)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", rng.randint(1, 9999)) for a in range(5) for b in range(3) for c in range(2)], "a string, b string, c string, tokens bigint")
    out = mixture.rake(cells, ["a", "b", "c"], tempering=0.5).toPandas()
    total = out.tokens.sum()
    for d in "abc":
        share = out.groupby(d).tokens.sum() ** 0.5
        got = (out.tokens * out.weight).groupby(out[d]).sum() / total
        assert np.allclose(got, share / share.sum(), atol=1e-8)
    cells2 = spark.createDataFrame([(float(w), int(t)) for w, t in zip(out.weight, out.tokens, strict=True)], "weight double, tokens bigint")
    c = mixture.calibrate(cells2, 0.8)
    assert abs((out.tokens * np.minimum(1, c * out.weight)).sum() / total - 0.8) < 1e-9


def test_raking_to_given_targets(spark):
    rng = random.Random(4)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", rng.randint(1, 9999)) for a in range(6) for b in range(4)], "a string, b string, tokens bigint")
    raked = mixture.rake(cells, ["a", "b"], targets={"a": {"s1": 0.5, "s2": 0.1, "none such": 0.3}, "b": {f"l{i}": 1 + i for i in range(4)}})
    got = {(r.dimension, r.category): r for r in mixture.marginals(raked, ["a", "b"]).collect()}
    assert max(r.residual for r in got.values()) <= 1e-9
    assert abs(got["a", "s1"].reached - 0.5) < 1e-8 and abs(got["a", "s2"].reached - 0.1) < 1e-8
    rest = {k: v for (d, k), v in got.items() if d == "a" and k not in ("s1", "s2")}
    own = {r.a: r.n**0.5 for r in cells.groupBy("a").agg(F.sum("tokens").alias("n")).collect() if r.a in rest}
    assert all(abs(rest[k].reached - 0.4 * own[k] / sum(own.values())) < 1e-8 for k in rest)
    assert all(abs(got["b", f"l{i}"].reached - (1 + i) / 10) < 1e-8 for i in range(4))
    # targets that cannot be met: the only cell of a category lies in a category of no weight
    odd = spark.createDataFrame([("x", "u", 5), ("y", "v", 5)], "a string, b string, tokens bigint")
    raked = mixture.rake(odd, ["a", "b"], targets={"a": {"x": 0.9, "y": 0.1}, "b": {"u": 0.2, "v": 0.8}}, most=16)
    assert max(r.residual for r in mixture.marginals(raked, ["a", "b"]).collect()) > 0.1


def test_mixture_edges(spark, make):
    rows = [(i, "some words " * (i % 7)) for i in range(300)] + [(None, None), (5, "some words"), (1000, "w " * 400_000)]
    docs = make(rows).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))).withColumn("lang", F.lit(None).cast("string"))
    out = mixture.mix(docs, queries.mixture_dims(), mixture.word_count(), keep_share=0.7)
    assert out.filter("probability is null or weight is null or probability > 1").count() == 0
    again = mixture.drawn(docs.repartition(7), queries.mixture_dims(), mixture.word_count(), keep_share=0.7)
    assert again.columns == docs.columns and sorted(str(r.doc_id) for r in again.collect()) == sorted(str(r.doc_id) for r in out.collect())
    assert mixture.drawn(make([]), queries.mixture_dims(), mixture.word_count()).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_edge_rows(spark, make, tmp_path, stage):
    name, f = corpus_pipeline.STAGES[stage]
    base = str(tmp_path)
    table(spark, DATA, "benchmark").write.parquet(f"{base}/benchmark.parquet")
    table(spark, DATA, "labels").write.parquet(f"{base}/labels.parquet")
    rows = [(1, "plain prose of several words"), (1, "plain prose of several words"), (2, None), (3, ""), (None, "no id at all here"), (4, "w " * 200_000), (5, "plain prose of several words")]
    for docs in (make(rows), make([])):
        out = f(spark, docs, base)
        if name == "token_binary":
            assert out.count() == docs.count()
        else:
            assert out.columns == docs.columns and out.count() <= docs.count()
            if name == "ngram_jaccard_join" and docs.count():
                assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "4", "None"]


def test_pipeline_against_each_stage(spark):
    docs, names = table(spark, DATA, "documents"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixture", "token_binary"]
    final = corpus_pipeline.run(spark, DATA)
    ids = {r.doc_id for r in final.collect()}
    labels = {r.doc_id: r for r in table(spark, DATA, "labels").collect()}
    toxic = [k for k in labels if labels[k].toxic == 1]
    assert sum(k in ids for k in toxic) < 0.3 * len(toxic)  # 400 ratings teach few of the words
    assert final.agg(F.sum("n_tokens")).first()[0] == final.selectExpr("max(start + n_tokens)").first()[0]
    assert docs.filter(F.col("doc_id").isin(list(ids))).count() == len(ids)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    df = queries.queries()[name](spark, DATA).select(names)

    def norm(rows):
        return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)

    assert norm(map(tuple, df.collect())) == norm(found.fetchall())


def test_entry_lists_all_corpus_queries():
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(q.startswith(f"op{n}_") for q in found) for n in range(1, 11))
