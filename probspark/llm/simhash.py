"""SimHash near-duplicates with a pigeonring filter."""

from __future__ import annotations

import uuid
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Forest, Staged, connected, cut, deal_blocks, fan_out, run_pairs, whole_runs

BITS = 64
#: A bucket with more fingerprints is dealt out in pairs of blocks of about this many.
BLOCK = 1024
#: Shingles whose bits are counted at a time.
PART = 1 << 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text: a bit is set if it is in over half of the hashes of its shingles.

    A-Z are lower-cased, words are separated by ASCII white space, shingles are ``words`` words joined by spaces, repeats
    included; a text of fewer words is one shingle, and one without words has fingerprint 0.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        h = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(w) - words + 1].tolist()
        digest = xxhash.xxh64_digest
        h = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist())])
    n, count = len(h) // 8, np.zeros(BITS, np.int64)
    for at in range(0, n, PART):  # bits of some shingles at a time, however long the text
        bits = np.unpackbits(np.frombuffer(h, np.uint8, 8 * min(PART, n - at), 8 * at)).reshape(-1, BITS)
        whole = len(bits) // 255 * 255  # sums of 255 bits stay within a byte
        count += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches):
        for b in cut(batches):
            f = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long, a row for each row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints(words), "doc_id long, fp long")


class Ring:
    """Pigeonring over ``m`` consecutive segments of the fingerprint for at most ``most`` differing bits.

    If two fingerprints differ in ``most`` bits or fewer, then from some segment of the ring on every chain of l segments
    differs in l * most / m bits or fewer.  Such a chain leaves m - most segments equal, and they can be chosen so that
    calling all others different still keeps within the budgets from the same start.  So there is one index key for each
    choice of m - most equal segments, with the starts that suit it; a bucket's pairs have to pass the chain's budgets from
    one of these starts, and then the full check.
    """

    def __init__(self, m: int, most: int):
        self.m, self.most = m, most
        edge = [BITS * i // m for i in range(m + 1)]
        self.segment = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(m)]
        self.budget = [l * most // m for l in range(1, m + 1)]
        self.keys = []
        for equal in combinations(range(m), m - most):
            other = [int(i not in equal) for i in range(m)]
            starts = [s for s in range(m) if all(sum(other[(s + i) % m] for i in range(l)) <= self.budget[l - 1] for l in range(1, m + 1))]
            mask = sum(self.segment[i] for i in equal)
            self.keys.append((mask - (1 << 64) if mask >> 63 else mask, starts))

    @staticmethod
    def tuned(n: int, most: int) -> Ring:
        """The number of segments with the fewest keys and chance pairs together for n fingerprints; any gives the same links."""
        cost = lambda m: comb(m, most) * (1 + n / 2.0 ** (BITS * (m - most) / m))
        return Ring(min(range(most + 1, most + 9), key=cost), most)

    def passes(self, diff: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which of the differences (unsigned 64-bit) of pairs found by ``key`` stay within the budgets and the limit."""
        part = [np.bitwise_count(diff & np.uint64(s)) for s in self.segment]
        ok = np.zeros(len(diff), bool)
        for k in np.unique(key):
            at = np.flatnonzero(key == k)
            for s in self.keys[k][1]:
                live, total = at[~ok[at]], 0
                for l in range(self.m):
                    total = part[(s + l) % self.m][live] + total
                    keep = total <= self.budget[l]
                    live, total = live[keep], total[keep]
                ok[live] = True
        ok[ok] = np.bitwise_count(diff[ok]) <= self.most
        return ok


def _links(ring: Ring):
    columns = ["key", "part", "bi", "bj", "blk", "fp"]

    def run(batches):
        for a, starts in whole_runs(batches, columns, columns[:4]):
            forest, fp = Forest(), a["fp"].view(np.uint64)
            for i, j in run_pairs(starts, len(fp)):
                ok = (a["bi"][i] == a["bj"][i]) | (a["blk"][i] != a["blk"][j])
                i, j = i[ok], j[ok]
                ok = ring.passes(fp[i] ^ fp[j], a["key"][i])
                for x, y in zip(a["fp"][i[ok]].tolist(), a["fp"][j[ok]].tolist()):
                    forest.join(x, y)
            links = forest.links()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return run


def roots(fps: DataFrame, most: int = 4, segments: int | None = None) -> Staged:
    """(fp, rep, root) of each different fingerprint of rows (doc_id, fp): its smallest doc_id, and one fingerprint for each component.

    Equal fingerprints are one node, so copies make no pairs; a bucket hands on a spanning tree of its links, and large
    buckets are dealt out in pairs of blocks.
    """
    spark = fps.sparkSession
    nodes = Staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fps")
    ring = Ring(segments, most) if segments else Ring.tuned(nodes.df.count(), most)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col("fp").bitwiseAND(F.lit(mask)).alias("part")) for k, (mask, _) in enumerate(ring.keys)])).alias("x")
    rows = nodes.df.select("fp", keys).select("x.key", "x.part", "fp")
    dealt = deal_blocks(rows, ["key", "part"], ["fp"], BLOCK)
    order = ["key", "part", "bi", "bj"]
    dealt = dealt.repartition(fan_out(spark), *order).sortWithinPartitions(*order)
    comp = connected(dealt.mapInArrow(_links(ring), "a long, b long"), "a", "b")
    return Staged(nodes.df.join(comp.df.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")), "roots")


def components(fps: DataFrame, most: int = 4, segments: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp), linked at ``most`` or fewer differing bits.

    component_id is the smallest doc_id reachable; null doc_ids take part and never are that id unless a component has no other.
    """
    root = roots(fps, most, segments)
    first = root.df.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = root.df.join(first, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(documents: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of whole texts; see fingerprint() and components()."""
    return components(Staged(fingerprints(documents, words), "simhash").df, most)


def keep_first(documents: DataFrame, words: int = 5, most: int = 4) -> DataFrame:
    """One document of each component, with the smallest doc_id (null ids last); columns as they are.

    Of several rows with that doc_id the one whose text has the smallest hash stays, once.
    """
    fps = hashed_fingerprints(documents, words).df
    comp = components(fps.select("doc_id", "fp"), most).select("fp", "component_id").distinct()
    return first_rows(documents, fps, "fp", comp, "component_id")


def first_rows(documents: DataFrame, rows: DataFrame, key: str, groups: DataFrame, group: str) -> DataFrame:
    """Of each group of the rows (doc_id, h, key) the documents' row with the smallest doc_id (null last) and text hash h, once.

    ``groups`` names the group of a key; a key that it does not name is a group of its own.  Rows of one key, which copies
    can make many, are reduced to their first before anything is joined.
    """
    tag = uuid.uuid4().hex[:8]  # names that no column of the documents has
    d, h = f"d_{tag}", f"h_{tag}"
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    last = F.lit((1 << 63) - 1)
    best = rows.groupBy(key).agg(F.min(F.struct(F.coalesce("doc_id", last).alias(d), F.col("h").alias(h))).alias("b"))
    best = best.join(groups, key, "left").groupBy(F.coalesce(F.col(group), F.col(key)).alias("g"), F.col(group).isNull().alias("own")).agg(F.min("b").alias("b")).select(f"b.{d}", f"b.{h}")
    out = documents.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), last), h: text}).join(best, [d, h], "left_semi")
    return out.dropDuplicates([d, h]).select(*documents.columns)


def hashed_fingerprints(documents: DataFrame, words: int) -> Staged:
    """(doc_id, h, fp) of each row: the hash and the fingerprint of its whole text."""
    h = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    return Staged(keyed.mapInArrow(_hashed_fingerprints(words), "doc_id long, h long, fp long"), "simhash")


def _hashed_fingerprints(words: int):
    def run(batches):
        for b in cut(batches):
            f = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(f.view(np.int64))], ["doc_id", "h", "fp"])

    return run


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; nulls, empties and repeated rows as in fingerprint() and components()."""
    d = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
