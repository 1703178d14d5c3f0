from kinfold.plans.names import spare_names


def test_spare_names(spark):
    assert spare_names(["a", "_b", "B"], "a", "b", "c", "c") == ["_a", "__b", "c", "_c"]
    assert spare_names(spark.range(1), "ID", "x") == ["_ID", "x"]
