import os

from setweave import runtime


def test_stash_and_clean(spark):
    df = runtime.stash(spark.range(5).withColumnRenamed("id", "n"), "five")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path) and spark.sparkContext.applicationId in path
    runtime.clean(spark)
    assert not os.path.exists(path)


def test_without_the_optional_part():
    import importlib
    import sys

    import __spark_entry__ as e

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("setweave.llm")}
    sys.modules["setweave.llm"] = None
    try:
        bare = importlib.reload(e)
        assert {"p1_found", "expand_set"} <= set(bare.queries()) and not any(n.startswith("p2_") for n in bare.queries())
        assert set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        del sys.modules["setweave.llm"]
        sys.modules.update(kept)
        importlib.reload(e)


def test_every_query_of_the_core_is_well_formed():
    from setweave.plans import registry

    queries = registry.queries()
    assert len(queries) > 140 and set(registry.oracle_sql()) <= set(queries)
    assert sum(len(m.QUERIES) for m in registry.MODULES) == len(queries)
