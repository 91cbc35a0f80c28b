"""Nulls, empty and long texts, repeated rows, clashing names and empty tables, for each operator and each stage of the pipeline."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docketspark.llm import jaccard, minhash, mixing, packing, quality, topk, urls
from docketspark.llm.common import table

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SHORT = "a few words that stand here and nowhere else in all of the others"
ROWS = [(1, None, "s"), (2, "", None), (3, " \t\n", "s"), (None, SHORT + " no id", "s"), (5, SHORT, "t"), (5, SHORT, "t"), (6, SHORT, "s"), (7, LONG, "s"), (8, "é" * 50_000, None), (9, "one", "t")]
#: Names that operators use within.
CLASH = ["rid", "size", "key", "id", "n", "host", "salt", "trust", "score", "lot", "width", "_0", "y", "fingerprint", "class_id", "component_id", "target", "taken", "shard", "piece", "length"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(i, t, "en", s) for i, t, s in ROWS], "doc_id long, text string, lang string, source string")
    return d.withColumns({c: F.lit(7) for c in CLASH}).repartition(3).persist()


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    """A folder with labels of the small tables, and these documents."""
    folder = str(tmp_path_factory.mktemp("sf"))
    table(spark, "/root/testdata/sf0.001", "labels").write.parquet(f"{folder}/labels.parquet")
    return folder


IDS = Counter(i for i, _, _ in ROWS)


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_fingerprint(docs):
    out = minhash.fingerprint(docs, lots=2, classes=minhash.classes_of(docs)).collect()
    assert ids(out) == IDS and {r["class_id"] for r in out if r["doc_id"] in (5, 6)} == {5} and {r["n_chars"] for r in out if r["doc_id"] in (1, 2)} == {0}
    assert minhash.fingerprint(docs.limit(0), classes=minhash.classes_of(docs.limit(0))).count() == 0


def test_mix(docs):
    out = mixing.mix_sources(docs, block=8).collect()
    assert ids(out) == IDS and all(r["taken"] <= 3 * r["size"] for r in out) and {r["size"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(docs.where("doc_id < 4")).agg(F.sum("taken")).first()[0] == 0


def test_pack(docs):
    out = packing.pack(docs).collect()
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == IDS and {r["length"] for r in out if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(docs.limit(0)).count() == 0


def test_quality(spark, docs, sf):
    labels = table(spark, sf, "labels")
    out = quality.quality(docs, labels.limit(0)).collect()
    assert ids(out) == IDS and all(0 <= r["score"] <= 1 for r in out)
    assert quality.quality(docs.limit(0), labels).count() == 0
    twice = labels.unionByName(labels).withColumns({c: F.lit(1) for c in ("score", "y", "id", "text")})
    d = table(spark, "/root/testdata/sf0.001", "documents")
    one, two = (sorted((r["doc_id"], round(r["score"], 9)) for r in quality.quality(d, x).collect()) for x in (labels, twice))
    assert one == two and len(one) == d.count()


def test_jaccard_join(docs):
    out = jaccard.jaccard_join(docs).collect()
    assert ids(out) == IDS and {r["component_id"] for r in out if r["doc_id"] in (5, 6)} == {5}
    assert {(r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] in (1, 2, 3)} == {(0, 1), (0, 2), (0, 3)}
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0


def test_top_k(spark):
    v = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, []), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (None, [9.0, 9.0]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, [1.0] * 2)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("score", "lot", "width", "shard", "rid", "floor", "block")})
    out = [tuple(r) for r in topk.top_k(d).orderBy("query_id", "rank").collect()]
    assert [(q, r, i) for q, r, i, _ in out] == [(0, 1, 1), (0, 2, 1), (0, 3, 4)]
    assert topk.top_k(d.limit(0)).count() == 0


def test_url_filter(spark):
    rows = [(1, None, None), (2, "", "<a href='http://x.org/'>x</a>"), (3, "no scheme", None), (None, "http://example.org/es/1", None), (5, "HTTPS://A.ORG?q", "<a href='//b.com/de/'>"), (5, "HTTPS://A.ORG?q", "<a href='//b.com/de/'>"), (6, "x://", "y" * 100_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in CLASH})
    out = urls.filter_urls(d).collect()
    assert Counter(r["page_id"] for r in out) == Counter(i for i, _, _ in rows)
    by = {r["page_id"]: (r["host"], r["path"], r["verdict"]) for r in out}
    assert by[1] == by[2] == by[3] == by[6] == ("", "", "allow") and by[None] == ("example.org", "/es/1", "block") and by[5][:2] == ("a.org", "")
    assert urls.filter_urls(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.spread(d, d, 1.0)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, sf, name, stage):
    out = stage(spark, docs, sf)
    rows = out.collect()
    assert stage(spark, docs.limit(0), sf).count() == 0
    if name == "pack":
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == IDS
        return
    assert out.columns == docs.columns and all(r[c] == 7 for r in rows for c in CLASH)
    if name == "jaccard_join":
        assert ids(rows) == Counter([1, 2, 3, None, 5, 7, 8, 9])
    elif name == "toxicity":
        assert ids(rows) == IDS
    else:
        assert set(ids(rows)) <= set(IDS)
