"""Stored correction models: bias tables and tree pipelines with their feature lists, listed by a registry that is a snapshot table.

A model's artefacts are written below ``artefacts/<name>`` first; its registry row is committed last, so a model is listed only when it is
whole. The kind of a model is told by the artefacts that are there. Loading checks the format version, and that the stored feature list, the
pipelines' own inputs and the features the code would compute agree in names and order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mlcorrect as Ml
from ..session import children
from . import snapshots
from .tables import load_bias, save_bias

VERSION = 2
REGISTRY = "scope string, version int, trained_utc timestamp, features array<string>, stations array<string>, targets array<string>"


@dataclass
class StoredModel:
    name: str
    scope: str
    kind: str
    trained_utc: datetime
    table: DataFrame | None = None
    trees: dict[str, PipelineModel] = field(default_factory=dict)
    stations: list[str] = field(default_factory=list)

    def predict(self, paired: DataFrame, fallback: bool = False) -> DataFrame:
        """Corrected values beside the originals, by the branch of the model's kind."""
        return Ml.correct_cycle(paired, self.kind, self.table, self.trees, self.stations, fallback)


def _at(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/artefacts/{name}"


def _register(spark: SparkSession, store: str, name: str, scope: str, trained: datetime, features: list[str], stations: list[str], targets: list[str]) -> None:
    row = spark.createDataFrame([(name, scope, VERSION, trained, features, stations, targets)], "name string, " + REGISTRY)
    snapshots.replace_parts(row, f"{store.rstrip('/')}/registry", ["name"])


def save_bias_model(store: str, name: str, scope: str, table: DataFrame, trained: datetime) -> None:
    save_bias(table, f"{_at(store, name)}/bias")
    _register(table.sparkSession, store, name, scope, trained, [], [], [])


def save_tree_model(spark: SparkSession, store: str, name: str, scope: str, trees: dict[str, PipelineModel], stations: list[str], trained: datetime) -> None:
    features = Ml.feature_columns(stations)
    for target, model in trees.items():
        Ml.check_features(model, features)
        model.write().overwrite().save(f"{_at(store, name)}/trees-{target}")
    _register(spark, store, name, scope, trained, features, stations, sorted(trees))


def registry(spark: SparkSession, store: str) -> DataFrame:
    """name, scope, version, trained_utc, features, stations, targets of every listed model."""
    return snapshots.load(spark, f"{store.rstrip('/')}/registry", REGISTRY, ["name"])


def artefacts(spark: SparkSession, store: str) -> DataFrame:
    """name, has_bias, n_boosters of every folder of artefacts, as found on disk; ``detect_arch`` names the kinds."""
    root = f"{store.rstrip('/')}/artefacts"
    rows = []
    for name in children(spark, root):
        parts = children(spark, f"{root}/{name}")
        rows.append((name, "bias" in parts, sum(p.startswith("trees-") for p in parts)))
    return spark.createDataFrame(rows, "name string, has_bias boolean, n_boosters int")


def load_model(spark: SparkSession, store: str, name: str) -> StoredModel:
    row = registry(spark, store).where(F.col("name") == name).first()
    if row is None:
        raise KeyError(f"no model {name!r} in {store}")
    if row.version != VERSION:
        raise ValueError(f"{name}: format version {row.version}, expected {VERSION}")
    parts = children(spark, _at(store, name))
    if "bias" in parts:
        return StoredModel(name, row.scope, "baseline", row.trained_utc, load_bias(spark, f"{_at(store, name)}/bias"))
    trees = {}
    for target in row.targets:
        if f"trees-{target}" not in parts:
            raise ValueError(f"{name}: the trees of {target} are not stored")
        trees[target] = PipelineModel.load(f"{_at(store, name)}/trees-{target}")
        Ml.check_features(trees[target], list(row.features))
    if not trees:
        raise ValueError(f"{name}: no artefacts")
    if list(row.features) != Ml.feature_columns(list(row.stations)):
        raise ValueError(f"{name}: stored features differ from the ones computed now")
    return StoredModel(name, row.scope, "ML", row.trained_utc, None, trees, list(row.stations))


def load_all(spark: SparkSession, store: str, keep: Callable[[str], bool] = lambda name: True) -> list[StoredModel]:
    """Every listed model whose name passes, oldest first: one short row each is read on the driver."""
    names = [r.name for r in registry(spark, store).select("name", "trained_utc").orderBy("trained_utc", "name").collect()]
    return [load_model(spark, store, n) for n in names if keep(n)]
