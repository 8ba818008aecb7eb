"""Ends of a passage that is everywhere: no task gets them all, and the spans are those of comparing all of them at once."""

import random

import pyarrow as pa

from probspark.llm import passages

R = random.Random(33)


def fresh(n):
    return [f"v{R.randrange(10**9)}" for _ in range(n)]


def test_no_key_gets_all_ends_of_a_frequent_passage():
    after, parts = fresh(20), 4
    ends = pa.list_(pa.struct([("at", pa.int32()), ("side", pa.int8()), ("cluster", pa.int64()), ("pos", pa.int64()), ("many", pa.int8())]))
    batches = []
    for k in range(3):
        ids = list(range(k * 500, k * 500 + 500))
        texts = [" ".join([*fresh(4), *after, *fresh(9)]) for _ in ids]
        one = {"at": 4, "side": 1, "cluster": 77, "pos": 4, "many": 1}
        batches.append(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts), pa.array([[one]] * 500, ends)], ["doc", "h", "text", "ends"]))
    sent = list(passages._around("ends", parts)(batches))
    keys: dict = {}
    for b in sent:
        part = pa.RecordBatch.from_arrays([b.column("part"), b.column("blob")], ["part", "blob"])
        columns = passages._AROUND if b.column("part")[0].as_py() < parts else passages._NODES
        for a, starts in passages.gathered([part], columns, "key"):
            for key in a["key"].tolist():
                keys[key] = keys.get(key, 0) + 1
    assert max(keys.values()) <= 3  # once a slice
    rows = sorted((r for b in sent for r in zip(b.column("part").to_pylist(), b.column("blob").to_pylist())), key=lambda r: r[0])
    got: dict = {}
    for b in passages._reaching(parts)([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])]):
        for doc, reach in zip(b.column("doc").to_pylist(), b.column("reach").to_pylist()):
            got[doc] = max(got.get(doc, 0), reach)
    assert got == {i: 20 for i in range(1, 1500)}


def test_spans_are_the_same_either_way(spark, monkeypatch):
    passage, tails = fresh(70), [fresh(30) for _ in range(4)]
    texts = []
    for i in range(400):
        tail = R.choice(tails)[: R.randint(0, 30)]
        head = R.choice(tails)[R.randint(0, 30) :]
        texts.append(" ".join([*fresh(R.randint(0, 40)), *head, *passage[R.randint(0, 3) :], *tail, *fresh(R.randint(0, 40)), *(passage if i % 7 == 0 else [])]))
    rows = [(None if i % 50 == 0 else R.randrange(300), t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = []
    for many in (1 << 40, 20, 0):
        monkeypatch.setattr(passages, "MANY", many, raising=False)
        got.append(sorted(map(str, passages.repeats(docs).collect())))
    assert len(got[0]) > 300 and got[0] == got[1] == got[2]
