"""A staged table leaves no shuffle files behind, even while its plan is still held."""

import time

from pyspark.sql import functions as F

from probspark.llm._util import Staged


def test_shuffles_of_a_staged_table_go_at_once(spark):
    def files():
        on_disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {on_disk.apply(i).getName() for i in range(on_disk.size())}

    before = files()
    df = spark.range(20_000, numPartitions=3).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    made = Staged(df, "counts")
    left, until = {"?"}, time.time() + 10
    while left and time.time() < until:  # the files are deleted beside the query
        left = {f for f in files() - before if f.startswith("shuffle_")}
        time.sleep(0.2)
    assert not left
    assert made.df.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    made.drop()
