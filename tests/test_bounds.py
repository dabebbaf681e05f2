import pytest

from tesselark import storage
from tesselark.operators import balance, partition


def test_too_many_rows_for_the_driver_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(storage, "DRIVER_ROWS", 3)
    weight = lambda n: spark.createDataFrame([(0, s, 1) for s in range(n)], "rank int, sbar int, n long")
    sets = lambda n: spark.createDataFrame([(s, [0]) for s in range(n)], "sbar int, ranks array<int>")
    assert balance.plan(weight(3), sets(3), 1) == []
    for w, s in ((weight(4), sets(3)), (weight(3), sets(4))):
        with pytest.raises(ValueError, match="DRIVER_ROWS"):
            balance.plan(w, s, 1)
    elem = lambda n: spark.createDataFrame([(c,) for c in range(n)], "class_id int")
    assert set(partition.class_partition(elem(3), 2)) == {0, 1, 2}
    with pytest.raises(ValueError, match="DRIVER_ROWS"):
        partition.class_partition(elem(4), 2)
