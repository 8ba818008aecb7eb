"""Scores of the language model against a slow reference that goes word by word and bit by bit."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from probspark.llm import lm
from probspark.llm._util import split_words

from .test_operators import ROWS, docs, empty, words  # noqa: F401

R = random.Random(3)


def texts_of(n):
    vocabulary = ["".join(R.choice("aeiou") + R.choice("bdgklmnrst") for _ in range(R.randint(1, 4))) for _ in range(400)]
    out = []
    for _ in range(n):
        out.append(" ".join(R.choice(vocabulary[: R.choice([12, 60, 400])]) for _ in range(R.randint(1, 300))))
    return [*out, out[0], out[1] + " end", "", None, "Zebra ZEBRA zebra " + "x" * 300, "ünï çödé"]


@pytest.fixture(scope="module")
def trained(spark):
    rows = list(enumerate(texts_of(90)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = {}
    keep = lm.train

    def train(*args):
        seen["model"] = out = keep(*args)
        return out

    lm.train = train
    try:
        scored = {r["doc_id"]: r for r in lm.score(df).collect()}
    finally:
        lm.train = keep
    return rows, seen["model"][0].ready(), scored


def level(n):
    return min(4, int(math.log2(max(n, 0) + 1) * 0.5 + 0.75))


def slow_score(text, learnt, model, phrases, vocabulary):
    """Natural logarithm of a text's probability, from the counts in the model's table, the phrases' and the words'."""
    t, table, (path_w, spell_w) = model.tree, model.table, model.weights
    w = lm.Words([text or ""])
    head, leaf = t.leaves(w)
    last, one, two = t.contexts(w, leaf)
    a = table[: lm._AT[1]].reshape(-1, lm._ROWS_A)
    b = table[lm._AT[1] : lm._AT[2]].reshape(-1, lm.GROUPS)
    c = table[lm._AT[2] : lm._AT[3]].reshape(-1, lm.GROUPS)
    spell = table[lm._AT[3] : lm._AT[4]].reshape(-1, 256)
    shift, bend, path = np.zeros(4), np.full(4, 200.0), []
    slope, curve, bound = np.zeros(4), np.zeros(4), lm.FIRST
    for i in range(len(leaf)):
        if i == bound:  # weights move after FIRST words, and whenever their number has doubled
            bend += 4 * curve
            shift += slope / bend
            slope, curve, bound = np.zeros(4), np.zeros(4), 2 * bound
        logp = 0.0
        for s in range(t.first[leaf[i]], t.first[leaf[i]] + t.depth[leaf[i]]):
            x, gate = [float(t.odds[s])], 0
            for counts, context, node, bounds, share in ((a, last[i], t.node[s], t.bounds, t.share), (b, one[i], t.group_node[s], t.group_bounds, t.group_share), (c, two[i], t.group_node[s], t.group_bounds, t.group_share)):
                lo, mid, hi = bounds[node // 2]
                if lo == hi:
                    x.append(0.0)
                    gate = gate * lm._LEVELS + 5
                    continue
                left, right = counts[context, lo:mid].sum(), counts[context, mid:hi].sum()
                n, other, p = (right, left, 1 - share[node // 2]) if node % 2 else (left, right, share[node // 2])
                n = max(n - learnt, 0)
                odds = math.log((n + lm._PRIOR * p) / (other + lm._PRIOR * (1 - p)))
                x.append(min(4095, max(-4096, round(odds * lm._STEP))) / lm._STEP)
                gate = gate * lm._LEVELS + level(n + other)
            q = 1 / (1 + math.exp(-min(20, max(-20, float(np.dot(x, path_w[gate] + shift))))))
            logp += math.log(q)
            slope += (1 - q) * np.array(x)
            curve += q * (1 - q) * np.array(x) ** 2
        path.append(logp)
    starts, keys = t.phrases(w, leaf)
    total = sum(phrases.values())
    met = (sum(n for n in phrases.values() if n > 1) + 0.5) / (total + 1)
    score = 0.0
    for k, s, e in zip(keys.view(np.int64).tolist(), starts, [*starts[1:], len(leaf)]):
        n = phrases.get(k, 0) - learnt
        score += np.logaddexp(sum(path[s:e]) + math.log(1 - met), math.log(met * n / total) if n > 0 else -math.inf)
    for i, token in enumerate([*words(text), b"\n"]):
        u, mass = t.unknown[leaf[i]], t.mass[leaf[i]]
        if u == 0:
            continue
        if n := vocabulary[token]:
            score += math.log((1 - u) * n / mass)
            continue
        score += math.log(u)
        letters = token + b" "
        for j in range(int(t.given[leaf[i]]), len(letters)):
            lo = 0
            back = [letters[j - k] if j >= k else 0 for k in (1, 2, 3, 4)]
            slots, all_ = [back[0]], back[0]
            for k in range(1, 4):
                all_ |= back[k] << 8 * k
                slots.append(int(lm._mix(np.array([all_], np.uint64) * lm._M[5])[0] >> np.uint64(65 - lm.SPELL[k].bit_length())))
            for bit in range(8):
                half = 128 >> bit
                x, gate, taken_one = [], 0, letters[j] >= lo + half
                for slot, at in zip(slots, lm._SPELL_AT):
                    low, high = spell[slot + at, lo : lo + half].sum(), spell[slot + at, lo + half : lo + 2 * half].sum()
                    n, other = (high, low) if taken_one else (low, high)
                    x.append(math.log((n + 0.1) / (other + 0.1)))
                    gate = gate * lm._LEVELS + level(n + other)
                score -= math.log1p(math.exp(-min(30, max(-30, float(np.dot(x, spell_w[gate]))))))
                lo += half * taken_one
    return score


def test_score_against_the_slow_reference(trained):
    rows, model, scored = trained
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    vocabulary, phrases = Counter(), Counter()
    for i, t in rows:
        if not out(i):
            vocabulary.update([*words(t), b"\n"])
            w = lm.Words([t or ""])
            phrases.update(model.tree.phrases(w, model.tree.leaves(w)[1])[1].view(np.int64).tolist())
    n, v = sum(vocabulary.values()), len(vocabulary)
    checked = 0
    for i, t in rows:
        r = scored[i]
        assert np.isclose(r["base_score"], sum(math.log10((vocabulary[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*words(t), b"\n"]))
        if i % 5 == 0 or out(i) or i >= 90:
            assert np.isclose(r["score"] * math.log(10), slow_score(t, int(not out(i)), model, phrases, vocabulary), rtol=1e-4, atol=1e-3)
            checked += 1
    assert checked > 25 and any(out(i) for i, _ in rows)
    # a text that occurs twice is known from its other copy, one that occurs once gets no credit for itself
    per = {i: scored[i]["bits_per_byte"] for i, t in rows if t}
    assert max(per[0], per[90]) < 0.6 * np.median(list(per.values()))


def test_leaves_are_a_distribution(trained):
    """In any context the probabilities of all leaves add up to one."""
    _, model, _ = trained
    t = model.tree
    n = len(t.mass)
    for context in range(3):
        w = lm.Words(["kiba", "dodi", ""])
        _, leaf = t.leaves(w)
        ctx = t.contexts(w, leaf)
        every = np.arange(n)
        fixed = [np.full(n, x[min(context * 2, len(leaf) - 1)]) for x in ctx]
        keep, t.contexts = t.contexts, lambda *_: fixed
        try:
            xs, gate, d = model.decisions(w, every, np.zeros(n, bool))
        finally:
            t.contexts = keep
        z = sum(x.astype(float) * model.weights[0][gate, i] for i, x in enumerate(xs))
        # decisions with counts on both sides: with quantised odds the two sides' probabilities may differ from 1 by a step
        logs = np.bincount(np.repeat(every, d), -np.log1p(np.exp(-z)), n)
        assert abs(np.exp(logs).sum() - 1) < 0.02


def test_score_depends_on_no_partitions(spark, docs, empty):  # noqa: F811
    one = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(docs.repartition(1)).collect()}
    many = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(docs.repartition(7)).collect()}
    assert one.keys() == many.keys() and all(np.isclose(one[k], many[k], rtol=1e-9) for k in one)
    assert lm.score(empty).count() == 0


def test_index_finds_all_and_no_others():
    v = np.unique(np.random.default_rng(0).integers(1, 1 << 63, 5000, dtype=np.uint64))
    x = lm.Index(v[::2])
    assert x.find(v[::2]).tolist() == list(range(len(v[::2]))) and set(x.find(v[1::2]).tolist()) == {-1}
    assert lm.Index(v[:0]).find(v[:5]).tolist() == [-1] * 5


def test_words_and_keys():
    texts = ["Ab c\nabc", "", " é"]
    w = lm.Words(texts)
    assert w.n.tolist() == [4, 1, 2] and w.text.tolist() == [0, 0, 0, 0, 1, 2, 2]
    assert w.keys(np.arange(7)).tolist() == [97 << 12 | 98 << 4, 99 << 12, 97 << 12 | 98 << 4 | 99 & 15, 0, 0, 0xC3 << 12 | 0xA9 << 4, 0]
    assert split_words(["a"])[3][0] == lm.Words(["A"]).h[0]
