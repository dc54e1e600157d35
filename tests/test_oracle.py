"""Every registered query against its SQL, and the known numbers of the small tables."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from stayline.plans.oracle import ORACLE_SQL as SQL
from stayline.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) is None


def test_only_model_fitting_lacks_sql():
    assert set(QUERIES) - set(SQL) == {"linear_probe", "displacement_probe"}
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_linear_probe_separates_rows(spark):
    rows = {r["held_out"]: r for r in QUERIES["linear_probe"](spark, SF).collect()}
    assert len(rows) == 2 and all(r["classes"] == 10 for r in rows.values())
    assert rows[False]["macro_auroc"] > 0.7


def test_displacement_probe_fits_its_own_folds(spark):
    rows = {(r["split"], r["task"]): r["macro_auroc"] for r in QUERIES["displacement_probe"](spark, SF).collect()}
    assert {task for _, task in rows} == {"onset", "resolution"} and {split for split, _ in rows} == {"train", "val", "test"}
    assert all(rows["train", task] > 0.6 for task in ("onset", "resolution"))


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["macro_auroc"] == pytest.approx(0.4209719374193058, abs=1e-8)


def test_known_numbers(spark):
    def rows(name):
        return [r.asDict() for r in QUERIES[name](spark, SF).collect()]

    assert {r["pair_type"]: r["pairs"] for r in rows("pair_type_counts")} == {
        "within_stay": 603,
        "cross_stay": 382,
    }
    assert {r["value"]: r["cells"] for r in rows("transition_values")} == {-1: 1258, 0: 5360, 1: 1262}
    sizes = {r["split"]: (r["monitoring"], r["triage"]) for r in rows("check_split_sizes")}
    assert sizes == {"train": (889, 343), "val": (51, 28), "test": (60, 26)}
    assert sum(r["rows"] for r in rows("stray_codes")) == 393
    assert not any(r["mismatch"] for r in rows("check_stay_agreement"))
    interval = rows("bootstrap_auroc_blocks")[0]
    assert interval["mean"] == pytest.approx(0.42687951)
    assert (interval["lo"], interval["hi"]) == (0.38561143, 0.46984951)
