"""Learned queries are handed the whole job: every mechanism, rate, family, imputer and grid point."""

import pytest

from imputeflow.functions.scalars import MISSING_RATES
from imputeflow.operators import classify
from imputeflow.operators.families import TreeSizes
from imputeflow.operators.mice import CLASSIC_SIZES
from imputeflow.plans import classic, compare, policy, queries

ALL = {(m, r) for m in ("mcar", "mar", "mnar") for r in MISSING_RATES}


class Handed(Exception):
    pass


@pytest.fixture
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def handed(monkeypatch):
    """Calls a query until the named function is called, and gives that call's arguments."""
    def run(module, name, query, spark, sf_dir):
        def stop(*args, **named):
            raise Handed(args, named)

        monkeypatch.setattr(module, name, stop)
        with pytest.raises(Handed) as got:
            queries.queries()[query](spark, sf_dir)
        return got.value.args
    return run


@pytest.mark.parametrize("query", ["family_scores", "method_comparison", "method_report"])
def test_policies_learn_from_every_scenario_and_family(handed, spark, sf_dir, query):
    args, named = handed(policy, "score_families", query, spark, sf_dir)
    assert set(args[1]) == ALL and not {"only", "sizes"} & set(named) and len(args) == 3


def test_selector_has_its_studied_size(handed, spark, sf_dir, monkeypatch):
    made = policy.MetaSelector.__init__
    seen = []
    monkeypatch.setattr(policy.MetaSelector, "__init__", lambda self, *a, **k: (made(self, *a, **k), seen.append(self))[0])
    handed(policy.MetaSelector, "fit", "meta_cv", spark, sf_dir)
    assert [s.num_trees for s in seen] == [200]


def test_comparison_covers_all_scenarios(handed, spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "_family_scores", lambda s, d: None)
    args, named = handed(compare, "compare_methods", "method_comparison", spark, sf_dir)
    assert set(args[1]) == ALL and not named and len(args) == 5


def test_classic_scores_cover_all_imputers(handed, spark, sf_dir):
    args, _ = handed(classic, "score_tables", "classic_scores", spark, sf_dir)
    assert set(args[1]) == ALL
    assert set(args[3]) == {"mean", "median", "SVD", "MF", "KNN", "LR_MICE", "GB_MICE", "RF_MICE"}
    assert args[3]["RF_MICE"].sizes == CLASSIC_SIZES and args[3]["RF_MICE"].max_iter == 5


def test_classification_covers_all_lists_and_the_grid(spark, sf_dir, monkeypatch):
    grids = []
    monkeypatch.setattr(classic, "cut_lineage", lambda df: df)
    monkeypatch.setattr(queries.amp, "scenario_tables", lambda df, spec: dict.fromkeys(ALL, df))
    monkeypatch.setattr(classic, "classic_imputers", lambda spec: {n: Same() for n in ("mean", "GB_MICE")})
    monkeypatch.setattr(classic, "holdout_cv", lambda train, test, spec, trees, depths, folds, *rest: grids.append(
        (tuple(trees), tuple(depths), folds)) or {"accuracy": 1.0, "auc": 1.0})
    tables = queries.queries()["resample_then_classify"](spark, sf_dir).where("metric = 'auc'").collect()
    assert {r["name"] for r in tables} == {f"{n} {m} {r}" for n in ("mean", "GB_MICE") for m, r in ALL}
    assert set(grids) == {(*classify.RESAMPLED_GRID, 5)}


class Same:
    def fit_transform(self, df):
        return df


def test_given_policies_name_every_family():
    every = {"LR", "BR", "RF", "ET", "GB"}
    assert set(queries.BY_RATE) == set(MISSING_RATES) and set(queries.BY_RATE.values()) == every
    assert set(queries.BY_RATE_COL) == {(r, j) for r in MISSING_RATES for j in range(8)}
    assert {imp for (r, _), imp in queries.BY_RATE_COL.items() if r == 0.2} == every


def test_defaults_are_the_studied_sizes():
    assert TreeSizes().rf_trees == 300 and TreeSizes().gb_rounds == 200
