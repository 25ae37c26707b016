import os

from tessera.llm.spill import noted, removed, saved


def test_tables_go_but_for_those_that_are_read(spark):
    paths = []
    with noted(paths):
        a, b = saved(spark.range(3).toDF("a"), "one"), saved(spark.range(4).toDF("b"), "two")
    c = saved(spark.range(5).toDF("c"), "three")  # not noted
    assert len(paths) == 2 and all(os.path.isdir(p) for p in paths)
    left = removed(spark, paths, b.where("b > 0").join(c, b.b == c.c))
    assert left == paths[1:] and not os.path.exists(paths[0]) and os.path.isdir(paths[1])
    assert b.count() == 4 and c.count() == 5
    assert removed(spark, left, spark.range(1)) == [] and not os.path.exists(paths[1])
    assert removed(spark, [], a) == []
