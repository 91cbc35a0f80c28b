"""A registry of models in one folder: a version is a folder of its own, complete once its manifest is there.

    {root}/{number}-{hash}/artifact.json   scalars, codes, calibration
                           model.txt       the trees
                           tables/         tables by agency, Parquet
                           report.md       metrics as a Markdown table
                           manifest.json   written last: hash of all content, labels, metadata

A writer that dies leaves a folder without a manifest, which no reader sees.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.functions.columns import personal_data
from docketspark.operators.serving import Artifact, check_no_personal_data, report
from docketspark.operators.trees import Forest, parse_text_model, text_model
from docketspark.sources.store import hadoop_path

MANIFEST = "manifest.json"


@dataclass
class Version:
    path: str
    artifact: Artifact
    forest: Forest
    tables: DataFrame
    manifest: dict


def table_digest(tables: DataFrame) -> str:
    """A digest of the rows in any order, summed by the executors."""
    rows = F.xxhash64(*[F.col(c) for c in sorted(tables.columns)]).cast("decimal(20,0)")
    n, total = tables.agg(F.count("*"), F.coalesce(F.sum(rows), F.lit(0))).first()
    return f"{n}:{total}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = hadoop_path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of all versions, unfinished ones too, oldest first."""
    p, fs = hadoop_path(spark, root)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def finished(spark: SparkSession, root: str) -> list[str]:
    def there(name: str) -> bool:
        p, fs = hadoop_path(spark, f"{root}/{name}/{MANIFEST}")
        return fs.exists(p)

    return [n for n in folders(spark, root) if there(n)]


def publish(
    spark: SparkSession, root: str, artifact: Artifact, forest: Forest, tables: DataFrame, labels: dict | None = None, metadata: dict | None = None, metrics: list[dict] | None = None
) -> str:
    """Writes a new version and returns its name; where the newest finished version has the same content, that one's.

    The artifact must name the model's inputs; text and tables must not hold personal data.
    """
    artifact.check(forest.names)
    content, trees = artifact.to_json(), text_model(forest)
    check_no_personal_data(spark, content)
    if not tables.where(F.size(personal_data(F.col("agency"))) > 0).isEmpty():
        raise ValueError("the tables hold personal data")
    digest = sha256("\0".join([content, trees, table_digest(tables)]).encode()).hexdigest()
    done = finished(spark, root)
    if done and done[-1].endswith(digest[:16]):
        return done[-1]
    last = max((int(n.split("-")[0]) for n in folders(spark, root) if n.split("-")[0].isdigit()), default=0)
    name = f"{last + 1:06d}-{digest[:16]}"
    where = f"{root}/{name}"
    tables.write.parquet(f"{where}/tables")
    write_text(spark, f"{where}/artifact.json", content)
    write_text(spark, f"{where}/model.txt", trees)
    write_text(spark, f"{where}/report.md", report(metrics or []))
    manifest = {"name": name, "hash": digest, "labels": labels or {}, "metadata": metadata or {}, "n_features": len(forest.names), "n_trees": len(forest)}
    write_text(spark, f"{where}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False, sort_keys=True))
    return name


def load(spark: SparkSession, root: str, name: str | None = None) -> Version:
    """A finished version, the newest if none is named; content that isn't what the manifest says raises."""
    done = finished(spark, root)
    if not done or (name is not None and name not in done):
        raise FileNotFoundError(f"no finished version {name or ''} in {root}")
    where = f"{root}/{name or done[-1]}"
    content, trees, manifest = read_text(spark, f"{where}/artifact.json"), read_text(spark, f"{where}/model.txt"), json.loads(read_text(spark, f"{where}/{MANIFEST}"))
    tables = spark.read.parquet(f"{where}/tables")
    if sha256("\0".join([content, trees, table_digest(tables)]).encode()).hexdigest() != manifest["hash"]:
        raise ValueError(f"the content of {where} isn't what its manifest says")
    return Version(where, Artifact.from_json(content), parse_text_model(trees), tables, manifest)
