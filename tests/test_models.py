"""Forests against a plain walk, staged rounds, search, variants, and the registry of versions."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketspark.config import MODEL_INPUTS
from docketspark.operators import experiments, history, metrics, model, serving, trees
from docketspark.plans.serving import MODEL
from docketspark.sources import versions
from docketspark.sources.store import hadoop_path

DAY = dt.date(2020, 1, 1)


def walked(forest, row):
    """One row, tree by tree and node by node."""
    total = 0.0
    for at in forest.roots:
        while at >= 0:
            x, kind = row[forest.feature[at]], int(forest.kind[at])
            unknown, how = x is None or math.isnan(x), kind >> 2 & 3
            if kind & 1:
                words = forest.words[forest.first[at] : forest.last[at]]
                left = not unknown and 0 <= int(x) < 32 * len(words) and bool(int(words[int(x) // 32]) >> int(x) % 32 & 1)
            else:
                v = 0.0 if unknown and how != 2 else x
                missing = unknown if how == 2 else how == 1 and abs(v) <= 1e-35
                left = bool(kind & 2) if missing else v <= forest.threshold[at]
            at = (forest.left if left else forest.right)[at]
        total += forest.leaf[~at]
    return 1 / (1 + math.exp(-forest.sigmoid * total))


def random_forest(rng, n_trees, width):
    """Trees of any shape with all kinds of nodes, in the text format."""
    blocks = []
    for t in range(n_trees):
        nodes = int(rng.integers(0, 12))
        left, right = [0] * nodes, [0] * nodes
        for i in range(1, nodes):  # each node hangs below an earlier one
            while True:
                side, parent = (left, right)[rng.integers(2)], int(rng.integers(i))
                if side[parent] == 0:
                    side[parent] = i
                    break
        leaves = iter(range(nodes + 1))
        left = [c or ~next(leaves) for c in left]
        right = [c or ~next(leaves) for c in right]
        kinds = [int(rng.choice([0, 1, 2, 4, 6, 8, 10])) for _ in range(nodes)]
        edges, words, thresholds = [0], [], []
        for k in kinds:
            if k & 1:
                thresholds.append(len(edges) - 1)
                words += [int(x) for x in rng.integers(0, 2**32, int(rng.integers(1, 4)))]
                edges.append(len(words))
            else:
                thresholds.append(float(rng.choice([-1, 0, 0.5, 33, 60])))
        rows = {"num_leaves": [nodes + 1], "split_feature": rng.integers(0, width, nodes), "threshold": thresholds, "decision_type": kinds, "left_child": left, "right_child": right}
        rows |= {"leaf_value": np.round(rng.normal(size=nodes + 1), 3), "cat_boundaries": edges, "cat_threshold": words}
        blocks.append(f"Tree={t}\n" + "\n".join(f"{k}={' '.join(map(str, v))}" for k, v in rows.items()) + "\n")
    return "tree\nobjective=binary sigmoid:0.5\nfeature_names=" + " ".join(f"f{i}" for i in range(width)) + "\n\n" + "\n\n".join(blocks) + "\nend of trees\n\nfeature_importances:\nf0=1\n"


def test_a_forest_equals_a_plain_walk(spark):
    rng = np.random.default_rng(8)
    text = random_forest(rng, 60, 5)
    forest = trees.parse_text_model(text)
    pool = [None, float("nan"), 0.0, -0.0, 1e-36, -1.0, -0.5, 0.5, 1.0, 31.0, 32.0, 33.5, 95.0, 96.0, 1e300, float("inf"), -float("inf")]
    rows = [tuple(pool[i] for i in rng.integers(0, len(pool), 5)) for _ in range(300)] + [(None,) * 5]
    fits = [tuple(x if x is None or abs(x) < 2**31 else 5.0 for x in r) for r in rows]
    want = [walked(forest, r) for r in fits]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(fits)], "i int, " + ", ".join(f"f{i} double" for i in range(5)))
    got = {r["i"]: r["p"] for r in d.select("i", trees.probability(forest).alias("p")).collect()}
    assert [got[i] for i in range(len(fits))] == pytest.approx(want)
    again = trees.parse_text_model(trees.text_model(forest))
    x = np.array([[np.nan if v is None else v for v in r] for r in rows], float)
    assert again.probability(x) == pytest.approx(forest.probability(x)) and again.names == forest.names and len(again) == 60
    assert np.isfinite(forest.probability(x)).all() and len(forest.probability(x[:0])) == 0


def test_prefixes_and_stages(spark):
    forest = trees.parse_text_model(random_forest(np.random.default_rng(2), 7, 3))
    d = spark.createDataFrame([(1, 0.2, None, 5.0), (0, -3.0, 2.0, float("nan"))], "y int, f0 double, f1 double, f2 double")
    out = {(r["y"], r["trees"]): r["score"] for r in trees.staged(d, forest, ["y"]).collect()}
    for n in range(1, 8):
        for y, row in ((1, [0.2, np.nan, 5.0]), (0, [-3.0, 2.0, np.nan])):
            assert out[(y, n)] == pytest.approx(forest.prefix(n).probability(np.array([row]))[0])
    assert model.stopped([0.1, 0.3, 0.2, 0.3, 0.9], 2) == 2 and model.stopped([0.1, 0.3, 0.2, 0.3, 0.9], 3) == 5 and model.stopped([0.5], 4) == 1


@pytest.fixture(scope="module")
def table(spark):
    d = spark.range(3000).select(
        (F.col("id") % 17).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, (F.col("id") * 31 % 101).cast("double")).alias("b"), (F.xxhash64("id") % 7).cast("double").alias("noise"),
        F.col("id"), (((F.col("id") % 17 > 9) & (F.col("id") * 31 % 101 < 60)) | (F.col("id") % 97 == 0)).cast("int").alias("y"), (F.col("id") % 3).alias("part"),
    )
    return d.persist()


def test_fitted_trees_score_as_spark_does(spark, table):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    names = ["a", "b", "noise"]
    full = table.select(*[F.coalesce(n, F.lit(-1.0)).alias(f"{n}_") for n in names], *names, "y", "id")
    v = VectorAssembler(inputCols=[f"{n}_" for n in names], outputCol="features").transform(full)
    spark_model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=5, maxDepth=3, seed=1).fit(v)
    forest = trees.forest_of(spark_model, names)
    both = spark_model.transform(v).select(F.get(vector_to_array("probability"), F.lit(1)).alias("p"), trees.probability(forest).alias("q"))
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def test_training_keeps_the_best_round_and_repeats(spark, table):
    train, validation = table.where("part = 0"), table.where("part = 1")
    fitted = model.fit_trees(train, validation, ["a", "b", "noise"], rounds=8, patience=3, depth=3)
    scored = fitted.score(validation)
    assert metrics.average_precision(scored).first()["ap"] == pytest.approx(fitted.validation_ap) and fitted.validation_ap > 0.8
    assert len(fitted.forest) == fitted.trees <= 8 and [n for n, _ in fitted.importance(2)] in (["a", "b"], ["b", "a"])
    again = model.fit_trees(train, validation, ["a", "b", "noise"], rounds=8, patience=3, depth=3)
    assert again.validation_ap == fitted.validation_ap and again.trees == fitted.trees


def test_search_variants_ablation_and_selection(spark, table):
    found = model.random_search(table, F.col("part") == 0, F.col("part") == 1, ["a", "b"], n=3, rounds=2, lists={"depth": (1, 3), "step": (0.1, 0.3)})
    assert len(found) == 3 and [f.validation_ap for _, f in found] == sorted((f.validation_ap for _, f in found), reverse=True)
    assert sorted(map(str, (s for s, _ in found))) == sorted(map(str, model.draws({"depth": (1, 3), "step": (0.1, 0.3)}, 3)))
    assert model.draws(model.SEARCH) == model.draws(model.SEARCH) != model.draws(model.SEARCH, seed=1) and len({json.dumps(s) for s in model.draws(model.SEARCH)}) > 12
    out = model.ablation(table.where("part = 0"), table.where("part = 1"), ["a", "b", "noise"], {"noise": ["noise"], "signal": ["a", "b"]}, rounds=2, depth=2)
    assert list(out) == ["all", "without noise", "without signal"] and out["without signal"].validation_ap < out["all"].validation_ap
    assert model.select(out) in ("all", "without noise") and model.select(out, quarantined=("a",)) == "without signal"
    with pytest.raises(ValueError):
        model.select(out, quarantined=("a", "noise"))


def requests(spark, **more):
    row = {"OrgaoDestinatario": "B", "DataRegistro": "05/09/2026", "Esfera": "3-MEDIUM", "Profissao": "x", **more}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))


def test_every_input_has_the_models_name(spark):
    forest = trees.parse_text_model(MODEL)
    art = serving.Artifact(0.1, 0.5, {"B": 0.4}, births={"B": "2026-01-01"}, codes={"Esfera": {"3-MEDIUM": 34}}, features=list(MODEL_INPUTS))
    d = serving.model_inputs(serving.request_features(requests(spark, DataNascimento="05/09/2000"), art), forest.names)
    row = d.first()["inputs"].asDict()
    assert list(row) == list(MODEL_INPUTS) and row["Esfera"] == 34 and row["orgao_rate"] == 0.4 and row["idade"] == 26.0 and row["reg_dow"] == 5 and row["OrgaoDestinatario"] is None
    assert row["n_pedidos_previos"] == -1 and row["prev_reenc_rate_solicitante"] == -1 and row["dias_desde_primeiro_pedido_do_orgao"] == 247 and row["Profissao"] is None and row["uf_match"] == 0
    p = serving.responses(requests(spark, DataNascimento="05/09/2000"), art, forest).first()["probabilidade_reencaminhamento"]
    assert p == pytest.approx(walked(forest, list(row.values())), abs=1e-6)


@pytest.mark.parametrize("fields", [{}, {"Esfera": "never seen"}, {"DataRegistro": "31/02/2026"}, {"DataNascimento": "05/09/1800"}, {"OrgaoDestinatario": "?"}, {"n_pedidos_previos": float("nan")}])
def test_unknown_inputs_are_scored(spark, fields):
    forest = trees.parse_text_model(MODEL)
    art = serving.Artifact(0.1, 0.5, {"B": 0.4}, codes={"Esfera": {"3-MEDIUM": 34}})
    f = serving.model_inputs(serving.request_features(requests(spark, **fields), art), forest.names).first()["inputs"]
    assert serving.responses(requests(spark, **fields), art, forest).first()["probabilidade_reencaminhamento"] == pytest.approx(walked(forest, list(f)), abs=1e-6)


def art_of(**more):
    return serving.Artifact(0.1, 0.5, {}, features=list(MODEL_INPUTS), codes={"Esfera": {"x": 1}}, **more)


def tables_of(spark, *rows):
    return spark.createDataFrame(list(rows), "agency string, rate double, rate_90 double, rate_365 double, born date")


def test_a_version_is_seen_when_it_is_whole(spark, tmp_path, monkeypatch):
    root, forest = str(tmp_path / "models"), trees.parse_text_model(MODEL)
    tables = tables_of(spark, ("B", 0.4, 0.5, None, DAY), ("A", 0.1, None, None, None))
    with pytest.raises(FileNotFoundError):
        versions.load(spark, root)
    first = versions.publish(spark, root, art_of(), forest, tables, {"task": "t"}, {"ap": 0.2}, [{"model": "m", "ap": 0.25}])
    assert versions.publish(spark, root, art_of(), forest, tables.orderBy("agency")) == first  # the same content
    real = versions.write_text

    def dies(s, path, text):
        if path.endswith(versions.MANIFEST):
            raise OSError("gone")
        real(s, path, text)

    monkeypatch.setattr(versions, "write_text", dies)
    with pytest.raises(OSError):
        versions.publish(spark, root, art_of(version="2"), forest, tables)
    monkeypatch.undo()
    assert len(versions.folders(spark, root)) == 2 and versions.finished(spark, root) == [first]
    v = versions.load(spark, root)
    assert v.manifest["labels"] == {"task": "t"} and v.artifact == art_of() and len(v.forest) == 4 and v.manifest["n_features"] == 31
    assert sorted(r["agency"] for r in v.tables.collect()) == ["A", "B"] and "0.2500" in versions.read_text(spark, v.path + "/report.md")
    third = versions.publish(spark, root, art_of(version="3"), forest, tables)
    assert third.startswith("000003-") and versions.load(spark, root).artifact.version == "3" and versions.load(spark, root, first).artifact.version == "1"
    p, fs = hadoop_path(spark, f"{root}/{third}/model.txt")
    fs.delete(p, False)
    versions.write_text(spark, f"{root}/{third}/model.txt", trees.text_model(forest.prefix(2)))
    with pytest.raises(ValueError, match="manifest"):
        versions.load(spark, root)


def test_personal_data_are_never_published(spark, tmp_path):
    root, forest, tables = str(tmp_path), trees.parse_text_model(MODEL), tables_of(spark, ("B", 0.4, None, None, None))
    with pytest.raises(ValueError, match="e_mail"):
        versions.publish(spark, root, art_of(rationale="ask a.b@c.org"), forest, tables)
    with pytest.raises(ValueError, match="tables"):
        versions.publish(spark, root, art_of(), forest, tables_of(spark, ("123.456.789-01", 0.4, None, None, None)))
    with pytest.raises(ValueError, match="inputs"):
        versions.publish(spark, root, serving.Artifact(0.1, 0.2, {}, features=["x"]), forest, tables)
    with pytest.raises(ValueError, match="cpf"):
        serving.save_artifact(spark, art_of(rationale="123.456.789-01"), str(tmp_path / "a"))
    assert versions.folders(spark, root) == []


def test_tables_by_agency_are_frames(spark):
    rows = [("x", "a", DAY + dt.timedelta(i), i % 2, i) for i in range(200)] + [("x", "only later", DAY + dt.timedelta(300), 1, 900), ("x", None, DAY, 1, 901)]
    log = spark.createDataFrame(rows, "requester string, agency string, reg date, y int, id int")
    out = {r["agency"]: r for r in serving.agency_tables(log.where("id < 100"), log).collect()}
    assert set(out) == {"a", "only later"} and out["a"]["rate"] == pytest.approx(0.5, abs=0.01) and out["only later"]["rate"] is None and out["only later"]["born"] == DAY + dt.timedelta(300)
    scored = serving.score_baseline(spark.createDataFrame([("only later", DAY), ("a", DAY)], "agency string, reg date"), serving.build_artifact(log.where("id < 100"), 0.4), serving.agency_tables(log.where("id < 100"), log))
    assert {r["agency"]: r["agency_known"] for r in scored.collect()} == {"only later": False, "a": True}


def test_the_audit_finds_planted_leaks(spark):
    rows = [("p", "x", DAY + dt.timedelta(10 * i), i % 2, i) for i in range(30)] + [("q", "x", DAY + dt.timedelta(i), 1, 100 + i) for i in range(160)]
    log = spark.createDataFrame(rows, "requester string, agency string, reg date, y int, id int")

    def featurize(df):
        own = history.matured_history(df, ["requester"], "prev")
        return history.unlagged_history(history.matured_history(own, ["requester"], "short", lag=59), ["requester"], ["id"])

    out = {r["feature"]: r["changed"] for r in experiments.causality_audit(log, featurize, ["id"], ["prev", "short", "leaky_sum"], [DAY + dt.timedelta(d) for d in (70, 119, 150)]).collect()}
    assert out["prev"] == 0 and out["leaky_sum"] > 0 and out["short"] > 0  # one day too early is found, too
    one = history.matured_history(log, ["requester"], "prev")
    two = experiments.history_by_asof(log, ["requester"], "prev")
    both = experiments.alignment_audit(one, log.join(two, ["requester", "reg"]), ["id"], ["prev", "prev_den"]).collect()
    assert all(r["differ"] == r["only_one"] == r["only_two"] == 0 and r["n"] == 190 for r in both)
