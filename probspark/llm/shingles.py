"""Near-duplicate texts by an exact set-similarity join of their five-word shingles.

A text is the set of its shingles (A-Z lower-cased words, separated by ASCII white space; a text of fewer words is one
shingle).  Texts with a Jaccard similarity of ``least`` or more are linked, and no such pair is lost: shingles are ordered by
rarity, and two sets can only be similar if they share a shingle of their prefixes.  There each set is first compared with
the bucket's set of the smallest hash, which joins most of a large group as it is the same in most of its buckets; then all
pairs of what are still different components pass a length and a positional filter.  Pairs are compared by the parity of
their shingles in 1,024 buckets, a bound of what they do not share, and what is left shingle by shingle.

SimHash alone does not find these pairs: at Jaccard 0.8 fingerprints differ by about 10 bits and often by 16, and pigeonring
segments for so many bits are three or four bits long, so that nearly all pairs would meet.  keep_first() takes the links of
both: fingerprints of few differing bits, and sets that are similar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Staged, by_size, connected, distinct, exchanged, fan_out, gathered, packed, parts_of, release, scattered, unpacked, whole_runs, word_hashes
from .lines import _CHUNK, _MIX, _MIX2, LEVELS, _gather, _need, _set_hash, _sets, _sides, _summed
from .passages import _FLAGS, _flags, _mixed
from .simhash import first_rows, hashed_fingerprints, roots

SHINGLE = 5
#: Shingle frequencies are counted in 2^SKETCH_BITS buckets: a fixed size to broadcast (a byte each).  Any order gives the same links.
SKETCH_BITS = 22
#: A shingle's postings beyond this are dealt out in pairs of blocks.
BLOCK = 4096
#: Buckets whose parity stands for a set.
PARITY = 1024
_SLICE = 1 << 20
_M = np.random.default_rng(5).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _shingles(texts: list[str]):
    """(text of each shingle, index of each among the distinct hashes, these hashes)."""
    flat, doc, _, _ = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    end = np.cumsum(n)
    left = np.repeat(end, n) - np.arange(len(flat))
    padded = np.append(flat, np.zeros(SHINGLE, np.uint64))
    s = np.zeros(len(flat), np.uint64)
    for k in range(SHINGLE):
        s += np.where(left > k, padded[k : k + len(flat)] * _M[k], np.uint64(0))
    at = np.flatnonzero((left >= SHINGLE) | (left == np.repeat(n, n)))
    values, ids = distinct(_mixed(s[at]))
    return doc[at], ids, values


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _first(batches):
    """Texts with their set hashes, set sizes and parities (kind 0; 0 is the set of a text without words), and this task's shingle counts in chunks (kind 1)."""
    names = ["kind", "doc_id", "h", "hash", "k", "chunk"]
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for b in batches:
        for (docs, hs), texts in by_size(b, ["doc_id", "h"], most=_SLICE):
            doc, ids, hashes = _shingles(texts)
            rank, start, one, _ = _sets(doc, ids)
            np.add.at(sketch, _bucket(hashes), np.bincount(rank, minlength=len(hashes)).astype(np.uint32))
            sets = np.zeros(len(texts), np.int64)
            sets[one] = _set_hash(hashes[rank], start).view(np.int64)
            k = np.zeros(len(texts), np.int64)
            k[one] = np.diff(np.append(start, len(rank)))
            at = np.repeat(np.arange(len(texts)), k) * PARITY + (hashes[rank] >> np.uint64(65 - PARITY.bit_length())).astype(np.int64)
            odd = np.packbits((np.bincount(at, minlength=len(texts) * PARITY) & 1).astype(np.uint8).reshape(-1, PARITY), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int8)), pa.array(docs, pa.int64()), pa.array(hs, pa.int64()), pa.array(sets), pa.array(k), pa.array([x.tobytes() for x in odd], pa.binary())], names)
    chunks = sketch.reshape(-1, _CHUNK)
    at = np.flatnonzero(chunks.any(1))
    zero = np.zeros(len(at), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int8) + np.int8(1)), pa.array(zero), pa.array(zero), pa.array(at), pa.array(zero), pa.array([chunks[i].tobytes() for i in at], pa.binary())], names)


def _postings(levels: np.ndarray, least: float, parts: int):
    """Of each distinct set of a slice that can resemble another at all, its prefix shingles, scattered by shingle and pair of blocks."""
    counts = np.exp2(np.arange(256) / LEVELS) - 1
    usual = 2 * counts[levels].mean()  # what a bucket of rare shingles holds by chance is no frequency

    def run(batches):
        for b in batches:
            for _, texts in by_size(b, [], most=_SLICE):
                doc, ids, hashes = _shingles(texts)
                order = np.lexsort((hashes, levels[_bucket(hashes)]))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                r, start, _, k = _sets(doc, rank[ids])
                h = hashes[order][r]
                sets = _set_hash(h, start)
                _, one = np.unique(sets, return_index=True)
                one = one[k[one] / (k[one] + 1) >= least - 1e-9]
                if not len(one):
                    continue
                if k[one].max() >> 22:
                    raise ValueError("a text of more than 4 million different shingles")
                size = (k - _need(k, least) + 1)[one]
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                word, own = h[np.repeat(start[one], size) + pos], np.repeat(one, size)
                excess = np.maximum(counts[levels[_bucket(word)]] - usual, 1)
                nb = np.ceil(np.sqrt(excess / BLOCK)).astype(np.int64)
                blk = ((sets[own] >> np.uint64(20)) % nb.astype(np.uint64)).astype(np.int64)
                many = np.repeat(np.arange(len(nb)), nb)
                other = np.arange(len(many)) - np.repeat(np.cumsum(nb) - nb, nb)
                lo, hi = np.minimum(blk[many], other), np.maximum(blk[many], other)
                own = own[many]
                key = (word[many] + (lo << 32 | hi).astype(np.uint64) * _MIX2) * _MIX
                key ^= key >> np.uint64(31)
                meta = k[own] << 40 | pos[many] << 18 | np.where(lo == hi, 0, 1 + (blk[many] == hi))
                yield scattered(key, parts, {"key": key, "hash": sets[own], "meta": meta})

    return run


def _fits(a, i, j, least: float) -> np.ndarray:
    """Which pairs of postings pass the length and the positional filter."""
    k, pos = a["meta"] >> 40, a["meta"] >> 18 & (1 << 22) - 1
    ok = np.minimum(k[i], k[j]) >= _need(np.maximum(k[i], k[j]), least)
    return ok & (np.minimum(k[i] - pos[i], k[j] - pos[j]) >= _need(k[i] + k[j], least / (1 + least)))


def _met(least: float):
    """Postings of shingles in two sets or more, each set once; hub is the set with the smallest hash, or the own one if they cannot be similar."""

    def run(batches):
        for a, starts in gathered(batches, ["key", "hash", "meta"], "key"):
            n = len(a["key"])
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            order = np.lexsort((a["hash"], run_of))
            r, h = run_of[order], a["hash"][order]
            new = np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))
            order, r = order[new], r[new]
            some = np.bincount(r, minlength=len(starts))[r] > 1
            order, r = order[some], r[some]
            if not len(order):
                continue
            a = {c: v[order] for c, v in a.items()}
            begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            hub = np.repeat(begin, np.diff(np.append(begin, len(r))))  # rows of a run ascend by hash
            at = np.arange(len(r))
            hub = np.where(_fits(a, at, hub, least), hub, at)
            yield pa.RecordBatch.from_arrays([*[pa.array(a[c]) for c in ("key", "hash", "meta")], pa.array(a["hash"][hub])], ["key", "hash", "meta", "hub"])

    return run


def _crossing(least: float, most: int = 1 << 20):
    """Pairs of sets of different components that meet at a shingle and pass the filters."""
    def run(batches):
        for a, starts in whole_runs(batches, ["key", "comp", "hash", "meta"], ["key"]):
            n = len(a["key"])
            end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
            new = np.append(True, a["comp"][1:] != a["comp"][:-1])
            new[starts] = True
            own = np.append(np.flatnonzero(new), n)
            after = own[np.cumsum(new)]  # first row of the run's next component
            side = _sides(a["meta"])
            total = np.cumsum(end - after)
            at = 0
            while at < n:
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
                m = (end - after)[at:to]
                i = np.repeat(np.arange(at, to), m)
                j = after[i] + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
                ok = _fits(a, i, j, least) & ((side[i] == 0) | (side[i] != side[j]))
                x, y = a["hash"][i[ok]], a["hash"][j[ok]]
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                if len(both):
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])
                at = to

    return run


def _plausible(least: float):
    """Of pairs those that may be similar by the parities of their sets."""

    def run(batches):
        for b in batches:
            odd = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in ("xa", "xb")]
            both = b.column("ka").to_numpy() + b.column("kb").to_numpy()
            differ = np.bitwise_count(odd[0] ^ odd[1]).sum(1, dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array(differ <= both - 2 * _need(both, least / (1 + least))))

    return run


def _members(flags: np.ndarray):
    """Sets of the texts whose set hash is flagged: all that are wanted, and a few more that the join drops."""

    def run(batches):
        for b in batches:
            for _, texts in by_size(b, [], most=_SLICE):
                doc, ids, hashes = _shingles(texts)
                r, start, _, k = _sets(doc, ids)
                h = hashes[r]
                sets = _set_hash(h, start)
                f = (sets % np.uint64(_FLAGS)).astype(np.int64)
                at = np.flatnonzero(flags[f >> 3] >> (7 - (f & 7)).astype(np.uint8) & 1)
                found, one = np.unique(sets[at], return_index=True)
                at = at[one]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array([packed(h[start[i] : start[i] + k[i]]) for i in at], pa.binary())], ["hash", "shingles"])

    return run


def _similar(least: float):
    """Rows (a, salt, other, b, shingles) sorted by a and salt, the set of a itself first: the b that are similar to their a."""

    def run(batches):
        now, mine = None, None
        for batch in batches:
            a, b, own = (batch.column(c).to_pylist() for c in ("a", "b", "other"))
            found = []
            for i, x in enumerate(batch.column("shingles")):
                x = np.unique(unpacked(x.as_buffer()))
                if not own[i]:
                    now, mine = a[i], x
                elif a[i] == now:
                    shared = len(np.intersect1d(mine, x, assume_unique=True))
                    if shared >= least * (len(mine) + len(x) - shared) - 1e-9:
                        found.append(i)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in found], pa.int64()) for c in (a, b)], ["a", "b"])

    return run


def components(documents: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """((doc_id, h, hash), (hash, group)): texts by their sets, and sets linked at a Jaccard similarity of ``least`` or more,
    directly or through others; sets that are not named are a group of their own.

    h is the text's hash.  Texts without any word (null or empty) have one set.  Rows alike in doc_id and text, and texts
    with one set, are linked by it; an empty table has neither.
    """
    spark, n = documents.sparkSession, fan_out(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    first = Staged(docs.mapInArrow(_first, "kind byte, doc_id long, h long, hash long, k long, chunk binary"), "shingled").df
    chunks = first.where("kind = 1").select("hash", "chunk").repartition(n, "hash").sortWithinPartitions("hash")
    levels = _gather(chunks.mapInArrow(_summed, "hash long, chunk binary"), 1 << SKETCH_BITS, np.uint8)
    posts = docs.select("text").mapInArrow(_postings(levels, least, parts_of(spark)), "part int, blob binary")
    met = Staged(exchanged(posts).mapInArrow(_met(least), "key long, hash long, meta long, hub long"), "met")
    odd = first.where("kind = 0 and k > 0").select("hash", "k", "chunk")

    def plausible(pairs: DataFrame) -> Staged:
        ends = pairs.select(F.col("a").alias("hash")).unionByName(pairs.select(F.col("b").alias("hash"))).distinct()
        known = Staged(odd.join(ends, "hash", "left_semi").dropDuplicates(["hash"]), "parities")
        x, y = (known.df.select(F.col("hash").alias(c), F.col("k").alias(f"k{c}"), F.col("chunk").alias(f"x{c}")) for c in "ab")
        out = Staged(pairs.join(x, "a").join(y, "b").select("a", "b", "ka", "kb", "xa", "xb").mapInArrow(_plausible(least), "a long, b long"), "plausible")
        known.drop()
        return out

    def similar(pairs: DataFrame) -> Staged:
        """Of pairs (a, b) the similar ones; a set travels once for each pair it is b of, and once as a."""
        wanted = pairs.select(F.col("a").alias("content")).unionByName(pairs.select(F.col("b").alias("content"))).distinct()
        members = docs.select("text").mapInArrow(_members(_flags(wanted)), "hash long, shingles binary")
        members = Staged(members.join(wanted.withColumnRenamed("content", "hash"), "hash", "left_semi").dropDuplicates(["hash"]), "sets")
        size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))  # a hub of many is dealt out
        own = size.join(members.df.withColumnRenamed("hash", "a"), "a")
        x = own.select("a", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("salt"), F.lit(False).alias("other"), F.lit(None).cast("long").alias("b"), "shingles")
        y = pairs.join(size, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("nb")).cast("int")).join(members.df.withColumnRenamed("hash", "b"), "b")
        y = y.select("a", "salt", F.lit(True).alias("other"), "b", "shingles")
        order = ["a", "salt"]
        out = Staged(x.unionByName(y).repartition(n, *order).sortWithinPartitions(*order, "other").mapInArrow(_similar(least), "a long, b long"), "near")
        members.drop()
        return out

    hubs = Staged(met.df.where("hub <> hash").select(F.col("hub").alias("a"), F.col("hash").alias("b")).distinct(), "hubs")
    likely = plausible(hubs.df)
    near = similar(likely.df)
    del posts
    release(spark)
    comp = connected(near.df, "a", "b")
    left = met.df.join(comp.df.withColumnRenamed("node", "hash"), "hash", "left").select("key", F.coalesce("component", "hash").alias("comp"), "hash", "meta")
    left = left.repartition(n, "key").sortWithinPartitions("key", "comp")
    rest = left.mapInArrow(_crossing(least), "a long, b long").distinct().join(hubs.df, ["a", "b"], "left_anti")
    crossing = Staged(rest, "crossing")
    last = plausible(crossing.df)
    more = similar(last.df)
    linked = connected(near.df.unionByName(more.df), "a", "b").df.withColumnRenamed("node", "hash")
    for x in (met, hubs, likely, near, comp, crossing, last, more):
        x.drop()
    return first.where("kind = 0").select("doc_id", "h", "hash"), linked.withColumnRenamed("component", "group")


def _joined(rows: DataFrame, groups: DataFrame, fps: DataFrame, root: DataFrame) -> DataFrame:
    """(hash, group): the groups (hash, group) of the sets of rows (h, hash), joined where a component of fingerprints has texts of several."""
    of = fps.select("h", "fp").distinct().join(root.select("fp", "root"), "fp").select("h", "root")
    pairs = rows.select("h", "hash").distinct().join(of, "h").join(groups, "hash", "left")
    pairs = Staged(pairs.select(F.coalesce("group", "hash").alias("g"), "root").distinct(), "both")
    several = pairs.df.groupBy("root").agg(F.min("g").alias("first"), F.max("g").alias("last")).where("first < last").select("root", "first")
    comp = connected(pairs.df.join(several, "root"), "g", "first").df
    pairs.drop()
    alone = comp.select(F.col("node").alias("hash"), F.col("node").alias("group")).join(groups, "hash", "left_anti")
    named = groups.select("hash", "group").unionByName(alone)
    return named.join(comp.withColumnRenamed("node", "group"), "group", "left").select("hash", F.coalesce("component", "group").alias("group"))


def keep_first(documents: DataFrame, least: float = 0.8, most: int = 4) -> DataFrame:
    """One document of each group, with the smallest doc_id (null ids last); columns as they are.

    Texts are linked by SimHash fingerprints of ``most`` or fewer differing bits (of the same shingles, repeats included), and
    by sets of a Jaccard similarity of ``least`` or more; a group is what links of either kind reach.  Of several rows with
    that doc_id the one whose text has the smallest hash stays, once.
    """
    fps = hashed_fingerprints(documents, SHINGLE)
    root = roots(fps.df.select("doc_id", "fp"), most)
    release(documents.sparkSession)
    rows, groups = components(documents, least)
    return first_rows(documents, rows, "hash", _joined(rows, groups, fps.df, root.df), "group")
