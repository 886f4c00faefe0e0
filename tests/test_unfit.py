"""Features that training cannot use, with how many values they have."""

import pytest

from assaylake.operators import contracts

NAN, INF = float("nan"), float("inf")


def unfit(spark, rows):
    found = contracts.unfit_matrix(spark.createDataFrame(rows, "train boolean, values array<double>"), "train")
    assert found.columns == ["pos", "n_not_finite", "n_values", "varies"]
    return sorted(tuple(r) for r in found.collect())


def test_distinct_values_of_unfit_features_are_counted(spark):
    rows = [
        (True, [1.0, 1.0, NAN, 0.0, None, 5.0, INF]), (True, [1.0, 2.0, NAN, -0.0, 3.0, 6.0, 1.0]), (True, [1.0, 3.0, 4.0, 0.0, 3.0, 7.0, -INF]),
        (False, [2.0, 4.0, 9.0, 8.0, 7.0, NAN, 1.0]), (None, [3.0, 4.0, 9.0, 8.0, 7.0, 1.0, 1.0]),
    ]
    assert unfit(spark, rows) == [(0, 0, 1, False), (2, 2, 2, False), (3, 0, 1, False), (4, 1, 1, False), (5, 1, 3, True), (6, 2, 3, False)]


def test_without_training_rows_no_feature_has_values(spark):
    assert unfit(spark, [(False, [1.0, NAN]), (None, [2.0, 1.0])]) == [(0, 0, 0, False), (1, 1, 0, False)]


def test_a_missing_vector_is_an_error(spark):
    with pytest.raises(Exception, match="a vector is missing"):
        unfit(spark, [(True, [1.0]), (True, None)])
