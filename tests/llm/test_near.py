"""The pipeline's near-duplicate stage links by SimHash fingerprints as well as by exact Jaccard similarity."""

import random

import pytest

pytest.importorskip("xxhash")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from probspark.llm import simhash  # noqa: E402


def test_links_of_both_kinds(spark):
    r = random.Random(3)
    loop = [f"w{r.randrange(10**6)}" for _ in range(9)]
    other = [f"v{r.randrange(10**6)}" for _ in range(6)]
    # shingles that are repeated decide the fingerprint, those that occur once only the set
    a, b = " ".join(loop * 40), " ".join(loop * 40 + other)
    base = [f"u{r.randrange(10**6)}" for _ in range(300)]
    c, d = " ".join(base), " ".join(base[:150] + ["x", *base[151:]])
    texts = [b, a, c, d, "one two three four five six seven", "", None]
    fp = [simhash.fingerprint(t, 5) for t in texts]
    assert (fp[0] ^ fp[1]).bit_count() <= 4
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2)
    kept = corpus_pipeline.near_stage(spark, rows, "")
    assert kept.columns == rows.columns and sorted(x["doc_id"] for x in kept.collect()) == [0, 2, 4, 5]
