"""The product as stages of a Spark ML pipeline: merged rows in, probability and decision out.

    Pipeline(stages=[FeatureEstimator(), EnsembleEstimator()]).fit(merged)

The fitted ``PipelineModel`` is saved and loaded like any other. Features of the rows that a feature
stage was fitted on must not know their labels: given the very DataFrame of its fit, as a pipeline does, the fitted
stage answers with the out-of-fold features; other rows get those of its ``mode``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from creditfeat import schemas
from creditfeat.plans.features import FeatureFit
from creditfeat.plans.modelling import TreeParams
from creditfeat.plans.risk_model import Scorer


class _Writer(MLWriter):
    """Params and what is fitted, each part by the stage itself."""

    def __init__(self, stage: Any) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        extra = {"fitted": json.dumps(self.stage._fitted.meta())}
        DefaultParamsWriter.saveMetadata(self.stage, path, spark, extraMetadata=extra)
        self.stage._save_parts(spark, f"{path}/parts")


class _Reader(MLReader):
    def __init__(self, kind: type, restore: Callable) -> None:
        super().__init__()
        self.kind, self.restore = kind, restore

    def load(self, path: str) -> Any:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        fitted = self.restore(self.sparkSession, f"{path}/parts", json.loads(metadata["fitted"]))
        stage = self.kind(fitted)
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class FeatureModel(Model, MLReadable, MLWritable):
    """``mode``: 'full_fit' for new rows, 'fold_mean' for held-out rows."""

    mode: Param[str] = Param(Params._dummy(), "mode", "full_fit or fold_mean", TypeConverters.toString)

    def __init__(self, fitted: FeatureFit, source: DataFrame | None = None, training: DataFrame | None = None) -> None:
        super().__init__()
        self._fitted, self._source, self._training = fitted, source, training
        self._setDefault(mode="full_fit")

    @property
    def names(self) -> list[str]:
        return self._fitted.names

    def setMode(self, value: str) -> FeatureModel:
        return self._set(mode=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self._source is not None and dataset is self._source:
            return self._training
        return self._fitted.transform(dataset, self.getOrDefault(self.mode))

    def _save_parts(self, spark, path: str) -> None:
        for name, table in self._fitted.tables(spark).items():
            table.write.parquet(f"{path}/{name}")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls, FeatureFit.restore)


class FeatureEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Folds, codes, encodings, evidence and neighbour rates, fitted on merged rows with labels."""

    neighbours: Param[list[int]] = Param(Params._dummy(), "neighbours", "sizes of neighbourhoods", TypeConverters.toListInt)
    folds: Param[int] = Param(Params._dummy(), "folds", "number of folds", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, neighbours: list[int] | None = None, folds: int | None = None) -> None:
        super().__init__()
        self._setDefault(neighbours=list(schemas.NEIGHBOURS), folds=5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        ks, folds = self.getOrDefault(self.neighbours), self.getOrDefault(self.folds)
        fitted, training = FeatureFit.fit(dataset, ks, folds)
        return FeatureModel(fitted, dataset, training)


class EnsembleModel(Model, MLReadable, MLWritable):
    """Adds ``prob`` and ``decision``."""

    def __init__(self, fitted: Scorer) -> None:
        super().__init__()
        self._fitted = fitted

    @property
    def threshold(self) -> float:
        return self._fitted.threshold

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._fitted.add(dataset).withColumn("decision", self._fitted.decided("prob"))

    def _save_parts(self, spark, path: str) -> None:
        self._fitted.trees(spark).write.parquet(f"{path}/models")
        for i, m in enumerate(self._fitted.calibrators):
            m.write().save(f"{path}/calibrators-{i}")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls, Scorer.restore)


class EnsembleEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Trees, weights, curves and threshold, fitted on rows with key, label, fold and features. ``trees``: the
    settings of the middle member, those not named being the defaults."""

    trees: Param[str] = Param(Params._dummy(), "trees", "TreeParams as JSON", TypeConverters.toString)
    moreTrees: Param[list[int]] = Param(Params._dummy(), "moreTrees", "trees the other members add", TypeConverters.toListInt)
    weightSteps: Param[int] = Param(Params._dummy(), "weightSteps", "steps of the weight grid", TypeConverters.toInt)

    def __init__(
        self, params: TreeParams | None = None, more_trees: tuple[int, int] = (500, 200), weight_steps: int = 10
    ) -> None:
        super().__init__()
        self._setDefault(trees=json.dumps(asdict(params or TreeParams())), moreTrees=list(more_trees), weightSteps=weight_steps)

    def _fit(self, dataset: DataFrame) -> EnsembleModel:
        skip = (schemas.KEY, schemas.LABEL, "fold", "split")
        names = [c for c in dataset.columns if c not in skip]
        settings = TreeParams(**json.loads(self.getOrDefault(self.trees)))
        more, steps = self.getOrDefault(self.moreTrees), self.getOrDefault(self.weightSteps)
        return EnsembleModel(Scorer.fit(dataset, names, settings, (more[0], more[1]), steps))
