import pytest

from imputeflow.operators import amputate as amp
from imputeflow.operators.metrics import cell_rmse, paired_cells, repeated_keys
from imputeflow.operators.simple import SimpleImputer
from imputeflow.plans import policy
from imputeflow.spec import TableSpec

SPEC = TableSpec("k", ("a", "b"), "y")
RATES = (0.2, 0.5)


def table(spark, keys):
    rows = [(k, float(i % 17) if i % 11 else None, float(i * i % 23), "xy"[i % 2]) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "k string, a double, b double, y string").repartition(3).persist()


@pytest.mark.parametrize("keys", ["own", "odd"])
def test_carried_truth_gives_the_scores_of_the_join(spark, keys):
    """Keys that repeat (with other values), and null keys, too."""
    names = [f"r{i}" for i in range(120)] if keys == "own" else [None if i % 13 == 0 else f"r{i % 70}" for i in range(120)]
    truth = table(spark, names)
    fills = {"mean": SimpleImputer(SPEC, "mean"), "median": SimpleImputer(SPEC, "median")}
    found = [policy.score_imputers(truth, amp.scenario_tables(truth, SPEC, RATES, carry=c), SPEC, lambda rate: fills).collect()
             for c in (False, True)]
    plain, carried = ({(r.mech, r.rate, r.imp, r["col"]): pytest.approx(r.rmse) for r in rows} for rows in found)
    assert carried == plain and len(plain) == 24


def test_scores_of_a_scenario_move_no_row(spark):
    truth = table(spark, [f"r{i}" for i in range(120)])
    repeated = repeated_keys(truth, "k")
    (masked,) = amp.scenario_tables(truth, SPEC, (0.2,), ("mcar",), carry=True).values()
    imputed = SimpleImputer(SPEC).fit_transform(masked)
    plan = paired_cells(truth, masked, imputed, SPEC, repeated)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]
    assert cell_rmse(truth, masked, imputed, SPEC, repeated).count() == 2
