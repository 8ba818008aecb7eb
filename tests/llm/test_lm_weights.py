"""The mixing weights are learnt from all training documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("zstandard")

from probspark.llm import lm  # noqa: E402
from probspark.llm._util import Staged  # noqa: E402


def test_weights_of_the_last_step_are_of_all_training_documents(spark):
    texts = [f"the cat {i} sat on the mat and the dog {i % 7} sat by the door of house {i * 31 % 17}" for i in range(60)]
    known = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("h"))
    known = known.where(F.pmod(F.col("h"), F.lit(16)) != 0).localCheckpoint()
    rows = known.collect()
    model, phrases, sent = lm.train(known.repartition(3), Staged(lm.vocabulary(known.select("text")), "vocabulary").df)
    plain = lm.Model(model.tree, model.table).ready()
    started = plain.weights[0].copy()
    sums = lm._empty_sums()
    plain.learn([r["text"] for r in rows], sums)  # no text is in the first step's block
    want = plain.refined(sums)
    assert all(np.allclose(x, y, atol=2e-6) for x, y in zip(model.weights, want)) and not np.allclose(model.weights[0], started, atol=1e-3)
