"""Line dedup moves whole texts once, compressed, and does not join them."""

import random

import pytest

pytest.importorskip("zstandard")

from probspark.llm import lines  # noqa: E402


def written(spark) -> int:
    """Bytes of shuffle files that all stages so far have written."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_travel_once_and_compressed(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(f"{rng.getrandbits(48):012x}" for _ in range(20)) for _ in range(40)) + ("\none line that all have" if i % 2 else ""), f"s{i % 3}", 7) for i in range(400)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where there are many removed lines
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
        gone = docs.selectExpr("doc_id as doc", "xxhash64(text) as h", "40 as line").where("doc % 2 = 1 and doc > 1").localCheckpoint()
        monkeypatch.setattr(lines, "removed_lines", lambda d, least=0.8: (None, gone))
        start = written(spark)
        got = lines.dedup_lines(docs).collect()
        moved = written(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    cut = lambda i, t: i % 2 == 1 and i > 1 and t.rsplit("\n", 1)[0]
    want = [(i, cut(i, t) or t, s, len(cut(i, t)) if cut(i, t) else n) for i, t, s, n in rows]
    assert sorted(map(tuple, got)) == want
    assert moved < 0.7 * sum(len(t) for _, t, _, _ in rows)
