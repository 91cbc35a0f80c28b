"""Scoring as a caller sees it: forbidden fields, histories, dates, labels, health, personal data."""

import pytest
from pyspark.sql import functions as F

from docketspark.functions.columns import personal_data
from docketspark.operators import serving
from docketspark.operators.serving import HISTORY

ART = serving.Artifact(0.1, 0.2, {"A – Org": 0.1999999, "B": 0.5}, {"B": 0.6}, {}, {"B": "2020-01-01"}, grid=[0.0, 1.0], image=[0.0, 0.5], codes={"Esfera": {"Federal": 3}})
SCHEMA = "OrgaoDestinatario string, DataRegistro string, DataNascimento string, Esfera string, UF string, UF_sol string, " + ", ".join(f"{h} double" for h in HISTORY)


def asked(spark, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (14 - len(r)) for r in rows], SCHEMA)


def test_requests_get_every_input(spark):
    rows = (
        (" B ", "05/09/2026", "05/09/1996", "Federal", "DF", "DF", 4.0, 2.0, 2.0, 7.0, 1.0, 4.0, 0.0, 0.0),
        ("none", "31/02/2026", None, "x", None, None, 1.0),
        ("A – Org", "05/09/2026", "05/09/2020", None, "SP", "DF"),
    )
    a, b, c = sorted(serving.request_features(asked(spark, *rows), ART).collect(), key=lambda r: r["OrgaoDestinatario"] != "B" and (r["OrgaoDestinatario"] != "none") + 1)
    assert (a["orgao_rate"], a["orgao_rate_movel_90d"], a["orgao_rate_movel_365d"]) == (0.5, 0.6, 0.1) and a["uf_match"] == 1 and a["idade"] == 30.0
    assert (a["reg_month"], a["reg_dow"], a["reg_day"]) == (9, 5, 5) and a["prev_reenc_rate_solicitante"] == 0.25 and a["prev_reenc_rate_neste_orgao"] == -1 and a["code_Esfera"] == 3
    assert b["reg_month"] is None and b["code_Esfera"] == -1 and b["uf_match"] == 0 and b["partial_history_ignored"] and not b["history_given"] and b["n_pedidos_previos"] == -1
    assert c["idade"] is None and c["uf_match"] == 0 and not c["partial_history_ignored"] and c["orgao_rate_movel_90d"] == 0.1


def test_the_raw_probability_meets_the_threshold(spark):
    out = serving.responses(asked(spark, ("A – Org", "05/09/2026"), ("B", None)), ART, F.col("orgao_rate"))
    assert len(out.columns) == 11
    low, high = out.orderBy("orgao_rate_historica").collect()
    assert low["probabilidade_reencaminhamento"] == 0.2 and low["alerta"] == "BAIXO RISCO" and high["alerta"] == "ALTO RISCO" and high["probabilidade_calibrada"] == 0.25


@pytest.mark.parametrize("name", ["protocolo_seq", "FoiReencaminhado", "PrazoAtendimento"])
def test_forbidden_inputs_raise(spark, name):
    with pytest.raises(ValueError, match=name):
        serving.request_features(asked(spark, ("B", "05/09/2026")).withColumn(name, F.lit("x")), ART)


def test_health_and_json():
    h = serving.Artifact.from_json(ART.to_json()).health(trees=4)
    assert len(h) == 14 and h["n_trees"] == 4 and h["embedded_organ_tables"] == ["organ_rate", "organ_rate_movel_90d", "organ_birth"] and "protocolo_seq" in h["excluded_leakage_fields"]


def test_artifact_files(spark, tmp_path):
    path = str(tmp_path / "artifact")
    serving.save_artifact(spark, ART, path, apply=True)
    assert serving.load_artifact(spark, path) == ART


def test_personal_data(spark):
    texts = {"a 123.456.789-01 b": ["cpf"], "x 12345678901": ["eleven_digits"], "123456789012": [], "to me.you+z@ex-a.org.": ["e_mail"], "me@host": [], "IdSolicitante": ["requester"], '"DataNascimento": "1990': ["birth_date"], '"DataNascimento"': []}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", personal_data(F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] for r in rows} == texts
