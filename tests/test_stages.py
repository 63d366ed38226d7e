"""The product as one pipeline model."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

import __spark_entry__ as entry
from creditfeat import schemas
from creditfeat.catalog.fixtures import raw_sources
from creditfeat.operators.folds import with_split
from creditfeat.plans.features import FeatureFit
from creditfeat.plans.modelling import TreeParams
from creditfeat.plans.preparation import clean_sources, merge_sources
from creditfeat.plans.stages import EnsembleEstimator, FeatureEstimator
from creditfeat.staging import stage

KEY, LABEL = schemas.KEY, schemas.LABEL


def test_pipeline_is_fitted_saved_and_loaded(spark, tmp_path):
    merged = merge_sources(clean_sources(raw_sources(spark, entry.SMOKE_DIR)))
    parted = stage(with_split(merged, KEY, LABEL), "parted")
    train, test = (parted.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    trees = TreeParams(max_depth=3, n_estimators=8, learning_rate=0.2)
    pipeline = Pipeline(stages=[FeatureEstimator(neighbours=[5, 20]), EnsembleEstimator(trees, (2, 2), 2)])
    model = pipeline.fit(train)
    features, ensemble = model.stages
    # In the fit the trees saw out-of-fold features, which new rows don't get.
    own = features.transform(train)
    assert {"fold", "knn_oof_20", "state_target_oof"} <= set(own.columns)
    assert own.count() == train.count() and "fold" not in features.transform(test).columns
    _, want = FeatureFit.fit(train, [5, 20])
    key = lambda df: sorted((r[KEY], r.fold, round(r.knn_oof_20, 9), round(r.state_target_oof, 9)) for r in df.collect())
    assert key(own) == key(want)

    fresh = test.drop(LABEL)
    scored = {r[KEY]: r for r in model.transform(fresh).collect()}
    path = str(tmp_path / "pipeline")
    model.write().save(path)
    again = PipelineModel.load(path)
    loaded = {r[KEY]: r for r in again.transform(fresh).collect()}
    assert scored.keys() == loaded.keys() and len(scored) == test.count()
    for k, r in scored.items():
        assert 0 <= r.prob <= 1 and loaded[k].prob == pytest.approx(r.prob)
        assert r.decision == loaded[k].decision == int(r.prob >= ensemble.threshold)
    # The mode is a param of the fitted stage and is kept.
    held = again.stages[0].setMode("fold_mean")
    held.write().save(str(tmp_path / "features"))
    kept = type(held).load(str(tmp_path / "features"))
    assert kept.getOrDefault(kept.mode) == "fold_mean" and kept.names == features.names
    a, b = ({r[KEY]: r.state_target_oof for r in m.transform(fresh).collect()} for m in (features, kept))
    assert a != b
    assert type(pipeline.getStages()[0].copy()) is FeatureEstimator
