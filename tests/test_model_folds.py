"""The registered comparison tables tune on as many inner folds as the operators' default."""

import inspect

import pytest

from terrafold.plans import catalog, training
from terrafold.plans.catalog import models


class Called(Exception):
    pass


@pytest.mark.parametrize("name", ["component_out_of_fold", "baseline_out_of_fold", "satellite_pair_out_of_fold"])
def test_inner_folds(spark, monkeypatch, name):
    signature = inspect.signature(getattr(training, name))

    def called(*args, **kwargs):
        raise Called(signature.bind(*args, **kwargs).arguments["inner_folds"])

    monkeypatch.setattr(models, name, called)
    monkeypatch.setattr(models, "_development", lambda spark, sf_dir: None)
    query = f"model_{name}" if name != "satellite_pair_out_of_fold" else "model_satellite_pair"
    with pytest.raises(Called) as found:
        catalog.queries()[query](spark, "")
    assert found.value.args == (signature.parameters["inner_folds"].default,) == (4,)
