"""Scoring with an artifact, and refreshing its tables. Training and serving share the column functions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.config import FORBIDDEN_INPUTS
from docketspark.functions.columns import age, calendar, day, interpolated, personal_data, ratio, smoothed, trimmed
from docketspark.operators import encode
from docketspark.operators.trees import Forest, probability
from docketspark.sources.requests import check_inputs

#: The eight history inputs; they count only all together.
HISTORY = (
    "n_pedidos_previos", "n_pedidos_previos_neste_orgao", "n_orgaos_distintos_previos", "dias_desde_ultimo_pedido",
    "prev_reenc_solicitante", "prev_reenc_solicitante_den", "prev_reenc_neste_orgao", "prev_reenc_neste_orgao_den",
)
RATIOS = {"prev_reenc_rate_solicitante": HISTORY[4:6], "prev_reenc_rate_neste_orgao": HISTORY[6:8]}
ALLOWED_KEYS = frozenset("base_rate threshold rates rates_90 rates_365 births grid image features version codes queue_fraction rationale train_years data_snapshot".split())


@dataclass
class Artifact:
    """What scoring needs: tables by agency, the threshold, the calibration curve. No requester data."""

    base_rate: float
    threshold: float
    rates: dict[str, float]
    rates_90: dict[str, float] = field(default_factory=dict)
    rates_365: dict[str, float] = field(default_factory=dict)
    births: dict[str, str] = field(default_factory=dict)
    grid: list[float] = field(default_factory=list)
    image: list[float] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    version: str = "1"
    codes: dict[str, dict[str, int]] = field(default_factory=dict)
    queue_fraction: float | None = None
    rationale: str | None = None
    train_years: list[int] = field(default_factory=list)
    data_snapshot: str | None = None

    def to_json(self) -> str:
        content = asdict(self)
        if set(content) - ALLOWED_KEYS:
            raise ValueError("the artifact has keys that aren't allowed")
        return json.dumps(content, ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Artifact:
        content = json.loads(text)
        if set(content) - ALLOWED_KEYS:
            raise ValueError("the artifact has keys that aren't allowed")
        return Artifact(**content)

    def check(self, model_features: list[str]) -> None:
        if self.features != model_features:
            raise ValueError("the artifact's inputs aren't the model's")

    def tables(self, spark: SparkSession) -> DataFrame:
        """The tables by agency, a row per agency."""
        names = sorted({*self.rates, *self.rates_90, *self.rates_365, *self.births})
        rows = [(n, self.rates.get(n), self.rates_90.get(n), self.rates_365.get(n), self.births.get(n)) for n in names]
        return spark.createDataFrame(rows, "agency string, rate double, rate_90 double, rate_365 double, born string").withColumn("born", F.to_date("born"))

    def health(self, trees: int) -> dict:
        """Where the artifact comes from, what callers may give and what is refused."""
        tables = {"organ_rate": self.rates, "organ_rate_movel_90d": self.rates_90, "organ_rate_movel_365d": self.rates_365, "organ_birth": self.births}
        return {
            "model_tag": self.version, "n_trees": trees, "n_features": len(self.features), "features": self.features, "threshold": self.threshold, "queue_fraction": self.queue_fraction,
            "caller_supplied_features": list(HISTORY), "caller_supplied_default": -1.0, "caller_supplied_rationale": self.rationale, "embedded_organ_tables": [k for k, v in tables.items() if v],
            "contains_personal_data": False, "excluded_leakage_fields": sorted(FORBIDDEN_INPUTS), "train_years": self.train_years, "data_snapshot": self.data_snapshot,
        }


def check_no_personal_data(spark: SparkSession, text: str) -> None:
    """Raises if the text holds what looks like personal data, naming the kinds but not the values."""
    found = spark.createDataFrame([(text,)], "t string").select(personal_data(F.col("t"))).first()[0]
    if found:
        raise ValueError(f"the artifact holds personal data: {', '.join(found)}")


def save_artifact(spark: SparkSession, artifact: Artifact, path: str, apply: bool = False) -> str:
    """Writes the artifact as one JSON file where Spark can write; without `apply` it only returns the text. Personal data raise."""
    text = artifact.to_json()
    check_no_personal_data(spark, text)
    if apply:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    return Artifact.from_json("\n".join(r["value"] for r in spark.read.text(path).collect()))


def with_tables(df: DataFrame, tables: DataFrame, base: float) -> DataFrame:
    """Adds the agency's rates (the base rate for unknown agencies), its age and whether it is known."""
    names = {c: f"_{c}" for c in ("agency", "rate", "rate_90", "rate_365", "born")}
    t = tables.select(*[F.col(c).alias(a) for c, a in names.items()])
    out = df.withColumn("agency", trimmed(F.col("agency").cast("string"))).join(t, F.col("agency") == F.col("_agency"), "left")
    for c in ("rate", "rate_90", "rate_365"):
        out = out.withColumn(c, F.coalesce(f"_{c}", F.lit(base)))
    return out.withColumn("agency_age", F.datediff("reg", "_born")).withColumn("agency_known", F.col("_rate").isNotNull()).drop(*names.values())


def with_history(df: DataFrame) -> DataFrame:
    """The history inputs if all eight are there, else -1 each; derived ratios; two flags."""
    given = [F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in HISTORY]
    some = sum((g.isNotNull().cast("int") for g in given), F.lit(0))
    full = some == len(HISTORY)
    # the flags come first: they look at the inputs, which the next step replaces
    out = df.withColumns({"history_given": full, "partial_history_ignored": (some > 0) & ~full})
    out = out.withColumns({c: F.when(F.col("history_given"), g).otherwise(F.lit(-1.0)) for c, g in zip(HISTORY, given, strict=True)})
    for name, (part, whole) in RATIOS.items():
        out = out.withColumn(name, F.coalesce(F.when((F.col(whole) > 0) & (F.col(part) >= 0), F.col(part) / F.col(whole)), F.lit(-1.0)))
    return out


def transform(df: DataFrame, artifact: Artifact, tables: DataFrame | None = None) -> DataFrame:
    """Requests (agency, reg and optional inputs) with every feature; forbidden inputs raise."""
    return with_history(with_tables(check_inputs(df), artifact.tables(df.sparkSession) if tables is None else tables, artifact.base_rate))


def request_features(requests: DataFrame, artifact: Artifact, tables: DataFrame | None = None) -> DataFrame:
    """Requests in their own field names with every input of the model; the request's fields are trimmed.

    `tables` are the tables by agency as a frame (Spark joins them by their size); else the artifact's own.

    Codes of categories that the artifact doesn't know are -1, dates that are none give null. A field that is
    only known after the decision raises.
    """
    given = check_inputs(requests)
    given = given.select(*[trimmed(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in given.dtypes])
    for c in ("UF", "UF_sol", "DataNascimento"):
        given = given if c in given.columns else given.withColumn(c, F.lit(None).cast("string"))
    given = given.withColumns({"agency": F.coalesce("OrgaoDestinatario", F.lit("")), "reg": day(F.col("DataRegistro"))})
    out = with_history(with_tables(given, artifact.tables(given.sparkSession) if tables is None else tables, artifact.base_rate))
    out = out.withColumnsRenamed({"rate": "orgao_rate", "rate_90": "orgao_rate_movel_90d", "rate_365": "orgao_rate_movel_365d", "agency_age": "dias_desde_primeiro_pedido_do_orgao"})
    parts = calendar(F.col("reg"))
    out = out.withColumns({
        "reg_month": parts["month"], "reg_dow": parts["weekday"], "reg_day": parts["day"], "idade": age(F.col("reg"), day(F.col("DataNascimento"))),
        "uf_match": F.coalesce((F.col("UF") == F.col("UF_sol")) & (F.col("UF") != ""), F.lit(False)).cast("int"),
    })
    for name, codes in artifact.codes.items():
        value = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in given.columns else F.lit("")
        code = F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), value) if codes else F.lit(None).cast("int")
        out = out.withColumn(f"code_{name}", F.coalesce(code, F.lit(-1)))
    return out


def model_inputs(features: DataFrame, names: list[str]) -> DataFrame:
    """Adds `inputs`, a struct of doubles with the model's names in the model's order, from request_features: categories by their code, other
    inputs by their number. What neither the request nor the tables give is null; text where a number is due, too."""

    def value(name: str) -> Column:
        if f"code_{name}" in features.columns:
            return F.col(f"code_{name}").cast("double")
        return F.col(name).try_cast("double") if name in features.columns else F.lit(None).cast("double")

    return features.withColumn("inputs", F.struct(*[value(n).alias(n) for n in names]))


def responses(requests: DataFrame, artifact: Artifact, model: Column | Forest, tables: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """One answer of eleven fields per request. The raw probability meets the threshold; the calibrated one is for reading only.

    The model is a forest, which gets its inputs by name, or a column over request_features. `keep` carries columns of the request.
    """
    out = request_features(requests, artifact, tables)
    if isinstance(model, Forest):
        out = model_inputs(out, model.names)
        model = probability(model, lambda n: F.col("inputs")[n])
    out = out.withColumn("_raw", model)
    shown = F.round(interpolated(F.col("_raw"), artifact.grid, artifact.image), 6) if artifact.grid else F.lit(None).cast("double")
    return out.select(
        *(keep or []), F.round("_raw", 6).alias("probabilidade_reencaminhamento"), risk(F.col("_raw"), artifact.threshold).alias("alerta"), F.lit(artifact.threshold).alias("threshold"),
        shown.alias("probabilidade_calibrada"), F.lit(True).alias("calibrada_apenas_para_leitura"), F.col("agency_known").alias("orgao_conhecido"),
        F.round("orgao_rate", 6).alias("orgao_rate_historica"), F.round("orgao_rate_movel_90d", 6).alias("orgao_rate_movel_90d"), F.lit(round(artifact.base_rate, 6)).alias("base_rate_coorte"),
        F.col("history_given").alias("historico_informado"), F.col("partial_history_ignored").alias("historico_parcial_ignorado"),
    )


def risk(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, "ALTO RISCO").otherwise("BAIXO RISCO")


def score_batch(df: DataFrame, artifact: Artifact, model: Column, tables: DataFrame | None = None) -> DataFrame:
    """Probability, calibrated value (display only), risk label and flags per request."""
    out = transform(df, artifact, tables).withColumn("_raw", model)
    shown = interpolated(F.col("_raw"), artifact.grid, artifact.image) if artifact.grid else F.col("_raw")
    out = out.withColumn("probability", F.round("_raw", 6)).withColumn("calibrated", F.round(shown, 6))
    return out.withColumn("risk", risk(F.col("_raw"), artifact.threshold)).drop("_raw")


def score_baseline(df: DataFrame, artifact: Artifact, tables: DataFrame | None = None) -> DataFrame:
    out = with_tables(check_inputs(df), artifact.tables(df.sparkSession) if tables is None else tables, artifact.base_rate)
    return out.withColumn("probability", F.round("rate", 6)).withColumn("risk", risk(F.col("rate"), artifact.threshold))


def refresh_tables(log: DataFrame, base: float, windows: tuple[int, ...] = (90, 365), lag_days: int = 60, prior: float = 20.0) -> DataFrame:
    """Per agency: smoothed rates of the windows that end `lag_days` before the last day, and the first day.

    With lag_days 60 labels have matured; 0 counts labels of the last days as they are. An
    agency without requests in a window has the base rate.
    """
    end = log.agg(F.date_sub(F.max("reg"), lag_days).alias("_end"))
    d = log.crossJoin(F.broadcast(end))
    inside = {w: (F.col("reg") > F.date_sub("_end", w)) & (F.col("reg") <= F.col("_end")) for w in windows}
    sums = [x for w in windows for x in (F.count_if(inside[w]).alias(f"n_{w}"), F.sum(F.when(inside[w], F.col("y")).otherwise(0)).alias(f"y_{w}"))]
    out = d.groupBy("agency").agg(F.min("reg").alias("born"), *sums)
    return out.select("agency", "born", *[smoothed(F.col(f"y_{w}"), F.col(f"n_{w}"), F.lit(base), prior).alias(f"rate_{w}") for w in windows])


def key_changes(old: DataFrame, new: DataFrame, key: str = "agency") -> DataFrame:
    """Keys of two tables: in both (intersect), only in the old one, only in the new one (except); (key, change)."""
    a, b = old.select(key), new.select(key)
    return (
        a.intersect(b).withColumn("change", F.lit("common")).unionByName(a.subtract(b).withColumn("change", F.lit("gone")))
        .unionByName(b.subtract(a).withColumn("change", F.lit("new")))
    )


def agency_tables(train: DataFrame, log: DataFrame, prior: float = 50.0, windows: tuple[int, int] = (90, 365), train_days: str | None = None, lag: int = 60) -> DataFrame:
    """(agency, rate, rate_90, rate_365, born): the artifact's tables as a frame, a row per agency of the training rows or the log.

    Nothing passes the driver but the base rate. `rate` is null for agencies without training rows.
    """
    rates = encode.smoothed_rate(train, ["agency"], prior).select("agency", "rate")
    if train_days:
        inside, ones = F.expr(train_days), F.sum(F.when(F.expr(train_days), F.col("y")))
        base = log.agg(F.coalesce(ratio(ones, F.count_if(inside)), F.lit(0.0)).alias("_base"))
    else:
        base = log.sparkSession.range(1).select(F.lit(encode.base_rate(train)).alias("_base"))
    # the rates of an agency's last day only; no other day's window is summed
    ends = log.groupBy("agency").agg(F.max("reg").alias("_last"), F.min("reg").alias("born"))
    near = {w: F.col("reg").between(F.date_sub("_last", lag + w - 1), F.date_sub("_last", lag)) for w in windows}
    sums = [x for w in windows for x in (F.count_if(near[w]).alias(f"n_{w}"), F.coalesce(F.sum(F.when(near[w], F.col("y"))), F.lit(0)).alias(f"y_{w}"))]
    latest = log.join(ends, "agency").groupBy("agency").agg(F.max("_last").alias("_last"), F.min("born").alias("born"), *sums).crossJoin(F.broadcast(base))
    rolled = [F.when(F.col("_last").isNotNull(), smoothed(F.col(f"y_{w}"), F.col(f"n_{w}"), F.col("_base"), 20.0)).alias(n) for w, n in zip(windows, ("rate_90", "rate_365"), strict=True)]
    latest = latest.select("agency", *rolled, "born")
    both = rates.alias("r").join(latest.alias("l"), F.col("r.agency") == F.col("l.agency"), "full")
    agency = F.coalesce("r.agency", "l.agency").cast("string").alias("agency")
    return both.select(agency, "r.rate", "l.rate_90", "l.rate_365", "l.born").where("agency is not null")


def build_artifact(train: DataFrame, threshold: float, features: list[str] | None = None, **more) -> Artifact:
    """The artifact's scalars; its tables by agency are agency_tables, a frame."""
    return Artifact(encode.base_rate(train), threshold, {}, features=features or [], **more)


def report(rows: list[dict]) -> str:
    """A Markdown table of metric rows."""
    if not rows:
        return ""
    names = list(rows[0])
    shown = [[f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows]
    return "\n".join("| " + " | ".join(x) + " |" for x in [names, ["---"] * len(names), *shown])
