"""The pipeline's stages on a small folder of tables."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from .test_operators import ROWS, prose

    docs = [(i, t, "en", s, len(t or "")) for i, t, s in ROWS] + [(1000 + i, " ".join(f"{w}### {w}&&&" for w in prose(30).split()), "en", "s0", 9) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], int(d[0] < 1000)) for d in docs if d[0] is not None], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(now.count())
        assert (now.columns == columns) == (name != "pieces")
    kept = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/quality").collect()}
    assert sum(i in kept for i in range(1000, 1040)) <= 4 and len({i for i, _, _ in ROWS} - kept) <= 4
    assert seen[1] == seen[0] and seen[2] < seen[1] and seen[4] == seen[3] > 0
    assert now.where("text_crc32 <> decoded_crc32").count() == 0


def test_near_stage_finds_all_pairs_of_jaccard_080(spark):
    import random

    r = random.Random(8)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    texts = []
    for least in (0.8, 0.85, 0.9):  # pairs just above and just below: words changed one by one
        for _ in range(40):
            base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(60, 400))]
            now = edited = list(base)
            while jaccard(shingles(" ".join(base)), shingles(" ".join(now))) >= least:
                edited, now = now, list(now)
                now[r.randrange(len(now))] = f"x{r.randrange(10**6)}"
            texts += [" ".join(base), " ".join(edited)] + ([" ".join(now)] if least == 0.8 else [])
    hub = [f"h{i}" for i in range(200)]  # edits of one text, of which many resemble only that
    for i in range(60):
        w = list(hub)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(200)] = f"y{i}"
        texts.append(" ".join(w))
    texts += [" ".join(hub), " ".join(hub).upper(), "", None, "one two", "One  two", "one two three", "a b c d e f g h", "a b c d e f g h i"]
    sets = [shingles(t or "") for t in texts]
    up = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.near_stage(spark, d, "")
    assert kept.columns == d.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(up))
    assert corpus_pipeline.near_stage(spark, d.where("1 = 0"), "").count() == 0
