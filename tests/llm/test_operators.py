"""Each operator against a brute-force version on a small table that holds nulls, empties, ties, copies and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

tk = pytest.importorskip("public_tokenizers")

from probspark.llm import embeddings, lines, lm, media, mixing, passages, pieces, quality, simhash, tokens  # noqa: E402
from probspark.llm._util import connected, run_pairs, whole_runs, word_hashes  # noqa: E402

R = random.Random(4)
SYL = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ß"]


def word():
    return "".join(R.choice(SYL) for _ in range(R.randint(1, 4)))


def prose(n):
    out = []
    for i in range(n):
        w = R.choice(["the", "of", "and", "to"]) if R.random() < 0.3 else word()
        out.append(w + ("." if R.random() < 0.1 else "") + ("\n" if R.random() < 0.06 else " "))
    return "".join(out).strip()


PASSAGE = " ".join(word() + word() for _ in range(55))


def build():
    t = [prose(R.randint(5, 150)) for _ in range(60)]
    t += [t[0], t[1], t[2] + " extra", t[3].replace("the", "The", 1), "", None, " ", "\n\n", "one", "One two", "A  double  space\tand\r\nreturn"]
    t += [prose(40) + " " + PASSAGE + " " + prose(30), prose(25) + " " + PASSAGE, "<|endoftext|> in text", " ".join(["x"] * 50), prose(3000)]
    rows = [(i * 3, x, f"s{i % 4}" if i % 9 else None) for i, x in enumerate(t)]
    return [*rows, (3, t[1], "s1"), (None, "null id text here", "s2")]


ROWS = build()
TEXTS = {i: t for i, t, _ in ROWS}
SCHEMA = "doc_id long, text string, source string, lang string, size long, component_id long, h string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "en", 7, 8, "h", len(t or "")) for i, t, s in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("1 = 0")


def words(t):
    return (t or "").encode().lower().split()


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_word_hashes_are_those_of_the_words():
    texts = [t or "" for _, t, _ in ROWS]
    h, of, line, n = word_hashes(texts)
    flat = [w for t in texts for w in words(t)]
    assert len(h) == len(flat) and len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    assert of.tolist() == [i for i, t in enumerate(texts) for _ in words(t)]
    assert line.tolist() == [k for k, x in enumerate(y for t in texts for y in t.split("\n")) for _ in words(x)]
    assert n.tolist() == [t.count("\n") + 1 for t in texts]


def test_components(spark):
    g = np.random.default_rng(0).integers(0, 80, (60, 2)).tolist() + [[100 + i, 101 + i] for i in range(40)] + [[200, 300 + i] for i in range(50)]
    edges = spark.createDataFrame([tuple(map(int, e)) for e in g] + [(5, 5), (None, 3)], "a long, b long")
    want = roots(400, [e for e in g])
    got = {r["node"]: r["component"] for r in connected(edges, "a", "b").df.collect()}
    assert got == {i: want[i] for a, b in g if a != b for i in (a, b)}
    assert connected(edges.where("1 = 0"), "a", "b").df.count() == 0


def test_run_pairs():
    got = [tuple(p) for i, j in run_pairs(np.array([0, 3, 4]), 6, 2) for p in zip(i.tolist(), j.tolist())]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (4, 5)]
    assert list(whole_runs([], ["a"], ["a"])) == []


# ---- 1 ----


def test_tokens(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tk.path("byte_bpe_50k.json")
    blocks, dictionary = tokens.write_tokens(docs, path, 2)
    t = Tokenizer.from_file(path)
    rows = tokens.read_tokens(blocks.df, dictionary).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] != 3:
            assert np.frombuffer(r["ids"], "<u4").tolist() == [*t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
    at = 0
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]
    assert tokens.read_document(blocks.df, dictionary, 30) == [*t.encode(TEXTS[30], add_special_tokens=False).ids, 2]
    assert tokens.read_document(blocks.df, dictionary, 31) is None
    blob = bytes(blocks.df.first()["blob"])
    with pytest.raises(ValueError):
        tokens.Block(blob, dictionary + b"x")
    with pytest.raises(ValueError):
        tokens.Block(b"?" + blob[1:], dictionary)
    none, d = tokens.write_tokens(empty, path, 2)
    assert tokens.read_tokens(none.df, d).count() == 0


# ---- 2 ----


def test_simhash(docs, empty):
    import xxhash

    def slow(t):
        w = words(t)
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum((2 * sum(v >> k & 1 for v in h) > len(h)) << k for k in range(64))

    f = [slow(t) for _, t, _ in ROWS]
    assert f == [simhash.fingerprint(t) for _, t, _ in ROWS]
    up = roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4])
    low = defaultdict(list)
    for i, (d, _, _) in enumerate(ROWS):
        low[up[i]].append(d)
    want = sorted((repr(d), f[i], min(x for x in low[up[i]] if x is not None) if any(x is not None for x in low[up[i]]) else None) for i, (d, _, _) in enumerate(ROWS))
    got = sorted((repr(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_first(docs, words=4)
    assert kept.columns == docs.columns and kept.count() == len(low)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("m", [5, 6, 8])
def test_pigeonring_loses_no_pair(m):
    ring, rng = simhash.Ring(m, 4), np.random.default_rng(m)
    for flips in range(0, 7):
        for _ in range(200):
            d = np.uint64(sum(1 << int(b) for b in rng.choice(64, flips, replace=False)))
            keys = [k for k, (mask, _) in enumerate(ring.keys) if not int(d) & (mask % (1 << 64))]
            found = any(ring.passes(np.array([d]), np.array([k]))[0] for k in keys)
            assert found == (flips <= 4)


# ---- 3 ----


def test_quality(spark, docs, empty):
    good = [(i, prose(R.randint(8, 80))) for i in range(300)]
    bad = [(1000 + i, " ".join(word() + R.choice(["###", "&&&", "$$$"]) for _ in range(R.randint(8, 60)))) for i in range(120)]
    d = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5000, None), (5001, 7)], "doc_id long, quality int")
    scored, model = quality.classify(d, labels)
    rows = {r["doc_id"]: r for r in scored.collect()}
    out = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0 and i < 5000]
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and len(rows) == 422
    assert np.mean([rows[i]["predicted"] == (i < 1000) for i in out]) > 0.97
    # the moments are those of the training rows, and the density difference is that of plain linear algebra
    tr = [(quality.statistics(t), int(i < 1000)) for i, t in [*good, *bad] if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([a for a, _ in tr]), np.array([b for _, b in tr])
    pooled = np.maximum(sum((y == k).mean() * np.var(x[y == k], 0) for k in (0, 1)), 0.1)
    ll = []
    z = np.array(quality.statistics(good[0][1]))
    for k in (0, 1):
        c = 0.9 * np.cov(x[y == k].T, bias=True) + 0.1 * np.diag(pooled) + 0.1 * np.eye(x.shape[1])
        v = z - x[y == k].mean(0)
        ll.append(math.log((y == k).mean()) - 0.5 * v @ np.linalg.solve(c, v) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.isclose(rows[0]["score"], 1 / (1 + math.exp(-(ll[1] - ll[0]) / 2)), atol=1e-6)
    kept = quality.keep(d, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["predicted"]}
    none, _ = quality.classify(empty, labels.where("1 = 0"))
    assert none.count() == 0


# ---- 4 ----


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    x = np.concatenate([base, base[:10] + 0.2 * rng.normal(size=(10, 64)), base[10:20] * 3, np.repeat(base[:1], 6, 0), base[5] + 0.12 * rng.normal(size=(60, 64))]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i < 60 else 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, x[0].tolist(), None), (904, [], 0), (905, [1.0, 2.0], 0), (906, [None, 1.0], 0)]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = [(i, j) for i in range(len(x)) for j in range(i) if rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.93]
    n = Counter(k for p in links for k in p)
    up = roots(len(x), links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    assert got == {i: (n[i], up[i], up[i] == i) for i in range(len(x))} | {i: (0, i, True) for i, *_ in odd}
    assert embeddings.near_vectors(df.where("1 = 0")).count() == 0
    # rows with one vec_id are vectors of their own, in one label or two; labels need not be numbers, nor vectors single
    a, b = rng.normal(size=64), rng.normal(size=64)
    again = [(5, a, "x"), (6, a + 1e-3, "x"), (5, b, "y"), (9, b + 1e-3, "y"), (5, a + 2e-3, "x"), (7, a, "y"), (7, a, "y")]
    got = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist(), g) for i, v, g in again], "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(5, 1, 5), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 1, 7), (7, 1, 7), (9, 1, 5)]


def test_lattice():
    v = embeddings.minimal_vectors()
    assert len({tuple(r) for r in v}) == 240 and np.allclose((v**2).sum(1), 2)
    y = np.random.default_rng(0).normal(size=(300, 8)) * 3
    c = embeddings.nearest_e8(y)
    d = ((y - c) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all() and (d[:, None] <= ((y[:, None] - c[:, None] - v) ** 2).sum(2) + 1e-9).all()


# ---- 5 ----


def test_language_model(spark, docs, empty):
    rows = lm.score(docs).collect()
    assert len(rows) == len(ROWS)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter()
    for i, t, _ in ROWS:
        if not out(i):
            c.update([*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    for r in rows:
        if r["doc_id"] == 3:
            continue
        w = [*words(TEXTS[r["doc_id"]]), b"\n"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n)
        assert np.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert -8 * 20 * len(w) < r["score"] < 0
    assert lm.score(empty).count() == 0


# ---- 6 ----


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    size = defaultdict(int)
    for _, t, s in ROWS:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, goal, todo = 1.5 * sum(size.values()), {}, set(names)
    while todo:
        level = left / sum(weight[s] for s in todo)
        full = {s for s in todo if weight[s] * level > 2 * size[s]}
        for s in full or todo:
            goal[s] = 2 * size[s] if full else weight[s] * level
        left -= sum(goal[s] for s in full)
        todo -= full or todo
    taken = defaultdict(int)
    for r in got:
        assert np.isclose(r["target"], goal[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
    for s in names:
        sized = sorted(len(words(t)) for _, t, q in ROWS if q == s)
        if sized[-1] < sum(sized) / 2:  # a text of most of its source cannot be made up for
            assert abs(taken[s] - goal[s]) <= sized[-1] / 2 + 1  # large ones move first, so a smaller one is left to the landing
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    m = mixing.mixed(docs)
    assert m.columns == docs.columns and m.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).count() == 0 == mixing.mixed(empty).count()


def test_inclusion_is_unbiased_and_balanced():
    """Over many seeds every unit is taken as often as its probability says, by large moves, flights and landing alike."""
    sizes = [400, 90, 60, 7, 7, 5, 3, 3, 2, 1, 1, 0]
    large = [s for s in sizes if s > 50]
    hits, totals, n, pi = np.zeros(len(sizes)), [], 6000, 0.3
    for seed in range(n):
        rng = random.Random(seed)
        got, now = mixing._first_moves([float(s) for s in large], float(sum(sizes) - sum(large)), pi, rng)
        units = [[k, s, now] for k, s in enumerate(sizes) if s <= 50]
        active = []
        for u in units:
            if 0 < u[2] < 1:
                active.append(u)
            while len(active) == 3:
                mixing._fly(active, rng)
                active = [x for x in active if 0 < x[2] < 1]
        mixing._land(active, rng)
        take = np.array(got + [u[2] for u in units])
        assert set(take) <= {0.0, 1.0}
        hits += take
    assert np.abs(hits / n - pi).max() < 5 * (pi * (1 - pi) / n) ** 0.5
    even = [1000 + 7 * (k % 13) for k in range(600)]  # without a large unit the words taken are the target but for the last document
    for seed in range(20):
        rng, active, taken = random.Random(seed), [], 0.0
        units = [[k, s, pi] for k, s in enumerate(even)]
        for u in units:
            active.append(u)
            while len(active) == 3:
                mixing._fly(active, rng)
                active = [x for x in active if 0 < x[2] < 1]
        mixing._land(active, rng)
        assert abs(sum(s * u[2] for s, u in zip(even, units)) - pi * sum(even)) <= max(even)


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    units = [[None, s, 0.4] for s in (5, 9, 2)]
    before = (sum(u[1] * u[2] for u in units), sum(u[2] for u in units))
    mixing._fly(units, rng)
    assert np.allclose(before, (sum(u[1] * u[2] for u in units), sum(u[2] for u in units)))
    assert any(u[2] in (0.0, 1.0) for u in units)


# ---- 7 ----


def test_lines(docs, empty):
    seen, want = [], {}
    order = sorted({(i if i is not None else -math.inf, t or "") for i, t, _ in ROWS}, key=lambda x: x[0])
    for i, t in order:
        gone = []
        for k, x in enumerate(t.split("\n")):
            s = frozenset(words(x))
            if s and any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen):
                gone.append(k)
            if s:
                seen.append(s)
        want[i] = (t.count("\n") + 1, gone)
    rows = lines.decisions(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(want[-math.inf if r["doc_id"] is None else r["doc_id"]] == (r["n_lines"], r["removed"]) for r in rows)
    cut = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    for i, t in TEXTS.items():
        g = want[-math.inf if i is None else i][1]
        assert cut[i] == (t if not g else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g))
    assert lines.dedup_lines(empty).count() == 0


# ---- 8 ----


def test_pieces(docs, empty):
    import sentencepiece as sp

    path = tk.path("piece_bpe_32k.model")
    s, t = sp.SentencePieceProcessor(model_file=path), pieces.Transducer(path)
    r = random.Random(8)
    texts = [x for _, x, _ in ROWS if x] + ["".join(r.choice("abcdeéß th en  \n\t你好ﬁz.,;019 aaaa") for _ in range(r.randint(1, 40))) for _ in range(500)]
    for x in texts:
        assert t.encode(x).tolist() == s.encode(x)
        assert t.decode(s.encode(x)) == s.decode(s.encode(x)) == x
    rows = pieces.round_trip(docs, path, keep_ids=True).collect()
    assert len(rows) == len(ROWS) and all(x["text_crc32"] == x["decoded_crc32"] and x["n_pieces"] == len(x["ids"]) for x in rows)
    back = {x["doc_id"]: x["text"] for x in pieces.decode(pieces.encode(docs, path), path).collect()}
    assert back == {i: x or "" for i, x in TEXTS.items()}
    assert pieces.encode(empty, path).count() == 0


# ---- 9 ----


def test_passages(docs, empty):
    got = {r["doc_id"]: r for r in passages.repeats(docs).collect()}
    share = defaultdict(set)
    for i, t in TEXTS.items():
        w = words(t)
        for k in range(len(w) - 50):
            share[tuple(w[k : k + 51])].add(i)
    must = set().union(*[s for s in share.values() if len(s) > 1])
    loose = defaultdict(set)
    for i, t in TEXTS.items():
        w = words(t)
        for k in range(max(1, len(w) - 4)):
            loose[tuple(w[k : k + 5])].add(i)
    may = set().union(*[s for s in loose.values() if len(s) > 1])
    holders = [i for i, t in TEXTS.items() if t and PASSAGE in t]
    assert len(holders) == 2 and set(holders) <= must <= set(got) <= may
    late = got[max(holders)]
    assert late["n_removed"] > 0 and late["first_doc_id"] == min(holders)
    cut = {r["doc_id"]: r["text"] for r in passages.remove_repeats(docs).collect()}
    assert len(words(cut[max(holders)])) <= len(words(TEXTS[max(holders)])) - 24 and cut[min(holders)] == TEXTS[min(holders)]
    assert passages.repeats(empty).count() == 0


# ---- 10 ----


def test_media(docs, empty):
    stored = media.text_media(docs)
    rows = media.media_features(stored).collect()
    assert len(rows) == len(ROWS)
    by_text = defaultdict(set)
    for r in rows:
        b = (TEXTS[r["doc_id"]] or "").encode()
        p = b + b" " * (192 if not b else -len(b) % 192)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["payload_sha256"]) == (len(b), len(p), zlib.crc32(p[-16:]), hashlib.sha256(p).hexdigest())
        by_text[p].add((r["dhash"], bytes(r["tile"]), r["media_sha256"]))
        img = np.frombuffer(p, np.uint8).reshape(-1, 64, 3).astype(float)
        if len(img) < 60:  # by hand: means over areas, pixels cut where an edge runs through them
            def means(h, w):
                rows_, cols_ = (np.clip(np.minimum.outer((np.arange(k) + 1) * n / k, np.arange(n) + 1) - np.maximum.outer(np.arange(k) * n / k, np.arange(n)), 0, None) * k / n for k, n in ((h, len(img)), (w, 64)))
                return np.einsum("ih,hwc,jw->ijc", rows_, img, cols_)

            grey = np.round(means(8, 9).mean(2), 6)
            bits = "".join(str(int(grey[i, j + 1] > grey[i, j])) for i in range(8) for j in range(8))
            assert r["dhash"] == f"{int(bits, 2):016x}"
            tile = np.load(__import__("io").BytesIO(bytes(r["tile"])))
            assert np.abs(tile - means(16, 16)).max() <= 0.5 + 1e-6
    assert all(len(v) == 1 for v in by_text.values())
    broken = media.media_features(stored.sparkSession.createDataFrame([(1, 0, None), (2, 5, b"P6\n9 9\n255\nx"), (3, 0, b"")], "doc_id long, n_bytes long, media binary")).collect()
    assert len(broken) == 3 and all(r["payload_sha256"] is None and r["dhash"] is None for r in broken)
    assert media.media_features(media.text_media(empty)).count() == 0


def test_images():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(a)) == a).all() and (media.decode(media.encode_bmp(a)) == a).all()
    assert (media.decode(media.encode_ppm(a[:, :, :1])) == a[:, :, :1]).all()
    assert media.decode(b"P1 # c\n3 2\n1 0 1\n0 1 0")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n\xa0\x40")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n9\n3 4")[:, :, 0].tolist() == [[3, 4]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3")[0, 0].tolist() == [1, 2, 3]
    for bad in (b"", b"P6\n9 9\n255\nxx", b"BM" + bytes(60), b"GIF"):
        with pytest.raises(ValueError):
            media.decode(bad)
    fine = np.kron(a, np.ones((4, 6, 1)))
    assert np.allclose(media.area_resize(fine, 7, 5), a)
    assert np.allclose(media.area_resize(a, 3, 2).mean((0, 1)), a.mean((0, 1)))
    assert np.load(__import__("io").BytesIO(media.npy_tile(a, 4))).shape == (4, 4, 3) and len(media.dhash(a)) == 16
