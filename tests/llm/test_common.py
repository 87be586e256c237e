import os
import time

from tessera.llm.common import stored


def test_stored_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    here = lambda: {x for top in manager.localDirs() for _, _, names in os.walk(top.getPath()) for x in names if x.startswith("shuffle_") and x.endswith(".data")}
    before = here()
    kept = stored(spark.range(20_000).groupBy("id").count().repartition(3))
    wait = time.time() + 5
    while (left := here() - before) and time.time() < wait:
        time.sleep(0.2)
    assert not left
    assert kept.count() == 20_000
