"""Passages against brute force: similar paragraphs whatever their first words, and removal of whole repeated spans."""

import random
from itertools import combinations

from probspark.llm import passages

R = random.Random(21)


def fresh(n):
    return [f"v{R.randrange(10**9)}" for _ in range(n)]


def test_similar_paragraphs_meet_whatever_their_first_word(spark):
    texts = []
    for _ in range(40):
        base = fresh(20)
        texts += [base, [*fresh(1), *base[1:]], [*base[1:], *fresh(1)]]  # first word edited, shifted by one
        base = fresh(24)
        texts += [base, [base[0], *fresh(1), *base[2:]], [*base[:-1], *fresh(1)], [*base[1:], *fresh(1)]]
        base = fresh(60)
        texts += [base, [*fresh(1), *base]]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    owner, pos, _, rows, *_ = passages._paragraphs(texts)
    sets = [frozenset(r.tolist()) for r in rows]
    must = set()
    for i, j in combinations(range(len(sets)), 2):
        shared = len(sets[i] & sets[j])
        if owner[i] != owner[j] and shared and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
            must.add(((owner[i], pos[i]), (owner[j], pos[j])))
    cluster = {(r["doc"], r["pos"]): r["cluster"] for r in passages.occurrences(docs).collect()}
    found = sum(a in cluster and cluster[a] == cluster.get(b) for a, b in must)
    assert len(must) > 300 and found >= 0.98 * len(must)


def test_whole_repeated_span_goes(spark):
    texts, want = [], []
    for k in range(120):
        p = fresh((51, 52, 60, 75, 120, 400)[k % 6])
        for copy in range(3):  # in the middle, at the start and at the end
            head, tail = fresh(0 if (k + copy) % 5 == 1 else R.randint(1, 70)), fresh(0 if (k + copy) % 5 == 2 else R.randint(1, 70))
            texts.append(" ".join([*head, *p, *tail]))
            want.append((len(head), len(head) + len(p)) if copy else None)
    texts.append(" ".join(texts[0].split()[:40]))  # an earlier document has but a part of a passage, another all of it
    rows = [(i + 1, t) for i, t in enumerate(texts[:-1])] + [(0, texts[-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [(x["a"], x["b"]) for x in r["spans"]] for r in passages.repeats(docs).collect()}
    for i, span in enumerate(want):
        if span is None:
            assert i < 3 or got[i + 1] == []
        else:  # a paragraph that is similar, not equal, may hang over by two words; the part in document 0 may begin before
            spare = 2 if i >= 3 else 70
            assert len(got[i + 1]) == 1
            (a, b), (want_a, want_b) = got[i + 1][0], span
            assert want_a - spare <= a <= want_a and want_b <= b <= want_b + 2
