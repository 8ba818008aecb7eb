"""Every registered query on small folders: awkward rows, clashing columns, empty tables, very long texts."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from probspark.llm import lines, mixing, passages, quality, shingles, simhash  # noqa: E402
from probspark.llm.queries import QUERIES  # noqa: E402

from .test_operators import PASSAGE, ROWS, prose, words  # noqa: E402

#: Names that operators use inside, and a few that their results have.
CLASH = ["h", "d", "n", "k", "t", "s", "pos", "line", "hash", "removed", "size", "component", "node", "rep", "spans", "cluster", "word", "c", "e", "rid", "kind", "key", "group", "score", "teaches"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
COLUMNS = {
    "op1_tokens": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op2_simhash": {"doc_id", "fingerprint", "component_id"},
    "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op4_embeddings": {"vec_id", "n_links", "component_id", "kept"},
    "op5_lm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op6_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_lines": {"doc_id", "n_lines", "n_removed", "removed"},
    "op8_pieces": {"doc_id", "n_pieces", "ids_crc32", "text_crc32", "decoded_crc32"},
    "op9_passages": {"doc_id", "first_doc_id", "n_removed", "removed_words"},
    "op10_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
}


def folder(spark, path, rows, vectors):
    spark.createDataFrame([(i, t, "en", s, len(t or ""), *["own"] * len(CLASH)) for i, t, s in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(k % 7 != 0), 0) for k, (i, _, _) in enumerate(rows) if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    v = np.random.default_rng(0).normal(size=(12, 16))
    vectors = [(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(3, v[3].tolist(), 1), (None, v[0].tolist(), 0), (50, None, None)]
    return folder(spark, tmp_path_factory.mktemp("small"), ROWS, vectors)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("nothing"), [], [])


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, nothing, name):
    got = QUERIES[name](spark, small)
    assert COLUMNS[name] <= set(got.columns)
    n = got.count()
    assert 0 < n < len(ROWS) if name == "op9_passages" else n == (15 if name == "op4_embeddings" else len(ROWS))
    first = sorted(map(str, got.collect()))
    assert first == sorted(map(str, QUERIES[name](spark, small).collect()))  # reruns agree
    none = QUERIES[name](spark, nothing)
    assert none.count() == 0 and none.columns == got.columns


def test_clashing_columns_come_back_as_they_were(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    feats = quality.features(d)
    model = quality.fit(quality.training_rows(feats, spark.read.parquet(f"{small}/labels.parquet")))
    outs = [lines.dedup_lines(d), simhash.keep_first(d), shingles.keep_first(d), mixing.mixed(d), passages.remove_repeats(d), quality.keep(d, model)]
    for out in outs:
        assert out.columns == d.columns
        assert {tuple(r[c] for c in CLASH) for r in out.select(*CLASH).distinct().collect()} == {("own",) * len(CLASH)}
    for f in (lines.dedup_lines, simhash.keep_first, shingles.keep_first, mixing.mixed, passages.remove_repeats):
        assert f(d.where("1 = 0")).count() == 0


def test_pipeline_on_empty_tables(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_pipeline_stages_against_brute_force(spark, small):
    """What each stage keeps of its own input: lines and near duplicates by brute force, quality and mixing by their own rules."""
    now = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()]
        out = stage(spark, now, small).cache()
        if name == "quality":
            labels = spark.read.parquet(f"{small}/labels.parquet")
            model = quality.fit(quality.training_rows(quality.features(now), labels))
            want = sorted(str(r) for r in rows if model.score(np.array([quality.statistics(r[1])]))[0] >= 0.3)
            assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == want
        elif name == "line_dedup":
            seen, want = [], {}
            for i, t in sorted({(i if i is not None else -1, t or "") for i, t in rows}):
                kept = []
                for x in t.split("\n"):
                    s = frozenset(words(x))
                    if not (s and any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen)):
                        kept.append(x)
                    if s:
                        seen.append(s)
                want[i] = "\n".join(kept)
            assert {(-1 if r["doc_id"] is None else r["doc_id"]): r["text"] or "" for r in out.collect()} == want
        elif name == "near_dedup":
            sets = []
            for _, t in rows:
                w = words(t)
                sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
            up = list(range(len(rows)))
            for j in range(len(rows)):
                for i in range(j):
                    if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                        a, b = up[i], up[j]
                        up = [min(a, b) if x in (a, b) else x for x in up]
            last = 1 << 62
            best = {}
            for (i, _), g in zip(rows, up):
                best[g] = min(best.get(g, last), last if i is None else i)
            assert sorted(last if r["doc_id"] is None else r["doc_id"] for r in out.collect()) == sorted(best.values())
        elif name == "mixing":
            taken = {}
            for r in mixing.mix(now).collect():
                taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["copies"]
            got = {}
            for r in out.collect():
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
            assert got == {k: v for k, v in taken.items() if v}
        else:
            import sentencepiece as sp

            from probspark.llm.pieces import model_path

            s = sp.SentencePieceProcessor(model_file=model_path())
            want = sorted(str((i, s.encode(t or ""))) for i, t in rows)
            assert sorted(str((r["doc_id"], list(r["ids"]))) for r in out.collect()) == want
            break
        now = out


def test_very_long_texts(spark, tmp_path):
    """A text of 150,000 words beside short ones: whole texts count, and a passage at its very end is found."""
    r = random.Random(5)
    long = " ".join("".join(r.choice(["ba", "ko", "ti", "rem", "su"]) for _ in range(r.randint(2, 6))) for _ in range(150_000))
    rows = [(1, long + "\n" + PASSAGE, "a"), (2, "short " + PASSAGE, "a"), (3, "x" * 300_000, "b"), (4, long + "\n" + PASSAGE, "b"), *[(10 + i, prose(30), "a") for i in range(30)]]
    path = folder(spark, tmp_path, rows, [(1, [1.0, 2.0], 1)])
    got = {name: {x["doc_id"]: x for x in q(spark, path).collect()} for name, q in QUERIES.items() if name != "op4_embeddings"}
    n = 150_000 + len(words(PASSAGE))
    assert got["op5_lm"][1]["n_tokens"] == n + 1 and got["op6_mixing"][1]["size"] == n
    assert got["op2_simhash"][4]["component_id"] == 1 and got["op2_simhash"][1]["fingerprint"] == f"{simhash.fingerprint(rows[0][1]):016x}"
    assert got["op7_lines"][4]["n_removed"] == 2 and got["op7_lines"][1]["n_removed"] == 0
    assert got["op9_passages"][2]["n_removed"] > 0 and got["op9_passages"][4]["removed_words"] == f"0-{n}"
    assert all(x["text_crc32"] == x["decoded_crc32"] for x in got["op8_pieces"].values())
    assert got["op10_media"][1]["n_bytes"] == len(rows[0][1].encode()) and got["op1_tokens"][3]["n_tokens"] > 1000
    assert set(got["op3_quality"]) == {i for i, *_ in rows}
