"""Embedding near-duplicates by E8 lattice hashing."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import Forest, Staged, connected, deal_blocks, exchanged, fan_out, gathered, parts_of, run_pairs, scattered, whole_runs

#: A cell with more entries is dealt out in pairs of blocks of about this many.
BLOCK = 2048
SKETCH_WORDS = 2


def nearest_d8(y: np.ndarray) -> np.ndarray:
    """Closest point of D8 (whole coordinates, even sum) to each row: round, and if the sum is odd, round the worst the other way."""
    z = np.rint(y)
    odd = np.flatnonzero(z.sum(1) % 2)
    e = y - z
    k = np.abs(e).argmax(1)[odd]
    z[odd, k] += np.where(e[odd, k] >= 0, 1.0, -1.0)
    return z


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Closest point of E8, the union of D8 and D8 shifted by one half in all coordinates."""
    a, b = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to neighbouring cells."""
    whole = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    half = [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half, float)


@dataclass(frozen=True)
class Lattice:
    """``tables`` random projections to eight dimensions, scaled by ``scale`` and decoded to E8; ``probes`` neighbouring cells each.

    With the defaults two vectors of cosine 0.93 miss each other in all tables about once in 10^5 pairs.  ``sketch`` is the
    largest number of differing signs, of 128 random hyperplanes, that a pair may have to be compared in full: at cosine 0.93
    more is a chance of about 10^-8.  Sums run coordinate by coordinate, so that codes do not depend on how rows are batched.
    """

    tables: int = 10
    probes: int = 8
    scale: float = 7.0
    sketch: int = 39
    seed: int = 8

    def _project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = x.shape[1]
        rng = np.random.default_rng((self.seed, d))
        g = [np.linalg.qr(rng.normal(size=(max(d, 8), 8)))[0][:d] * self.scale for _ in range(self.tables)]
        g = np.hstack([*g, rng.normal(size=(d, 64 * SKETCH_WORDS))])
        y = np.zeros((len(x), g.shape[1]))
        for k in range(d):
            y += x[:, k : k + 1] * g[k]
        signs = np.packbits(y[:, 8 * self.tables :] > 0, axis=1).view(np.int64)
        return y[:, : 8 * self.tables], signs

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit rows: codes of the own cells (n, tables), of the probed ones (n, tables, probes), and the sketches."""
        y, signs = self._project(x)
        steps = minimal_vectors()
        mix = np.random.default_rng(self.seed).integers(1, 1 << 62, 8) | 1
        own, probed = [], []
        hashed = lambda z: ((2 * z).astype(np.int64) * mix).sum(-1)
        step = hashed(steps)
        for t in range(self.tables):
            z = y[:, 8 * t : 8 * t + 8]
            c = nearest_e8(z)
            r = z - c
            near = np.zeros((len(x), len(steps)))
            for k in range(8):
                near += r[:, k : k + 1] * steps[:, k]
            top = np.argsort(-near, axis=1, kind="stable")[:, : self.probes]
            own.append(hashed(c) * 31 + t)
            probed.append((hashed(c)[:, None] + step[top]) * 31 + t)  # a sum of hashes is the hash of the sum
        return np.stack(own, 1), np.stack(probed, 1), signs


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(vectors: list):
    n = np.array([len(v) for v in vectors])
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield at, _unit([vectors[i] for i in at])


_MIX = np.random.default_rng(88).integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)


def _key(group: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """A key of 63 bits for a group's cell (whose code holds its table), shifted by one."""
    x = group.view(np.uint64) * _MIX[0] + cell.view(np.uint64) * _MIX[1]
    x ^= x >> np.uint64(31)
    x *= _MIX[2]
    return (x ^ (x >> np.uint64(29))) << np.uint64(1)


def _entries(lattice: Lattice, parts: int):
    """The own and the probed cells of each vector, scattered by cell; the key's lowest bit tells own ones."""

    def run(batches):
        for b in batches:
            rep, group = b.column("rep").to_numpy(), b.column("grp").to_numpy()
            vectors = b.column("embedding").to_pylist()
            for at, x in _by_length(vectors):
                own, probed, signs = lattice.codes(x)
                code = np.concatenate([own[:, :, None], probed], 2)
                per = code[0].size
                is_own = np.zeros(code.shape, np.uint64)
                is_own[:, :, 0] = 1
                key = _key(np.repeat(group[at], per), code.ravel()) | is_own.ravel()
                yield scattered(key, parts, {"key": key, "rep": np.repeat(rep[at], per), **{f"s{k}": np.repeat(signs[:, k], per) for k in range(SKETCH_WORDS)}})

    return run


def _likely(lattice: Lattice):
    """Of the entries of each cell those with a partner in it whose sketch is near enough; of large cells all."""
    names = ["key", "rep", *[f"s{k}" for k in range(SKETCH_WORDS)]]

    def run(batches):
        for a, starts in gathered(batches, names, "key", 1):
            length = np.diff(np.append(starts, len(a["rep"])))
            keep = np.repeat(length > BLOCK, length)
            small = (length > 1) & (length <= BLOCK)
            at = np.flatnonzero(np.repeat(small, length))
            own = a["key"] & 1 == 1
            for i, j in run_pairs(np.cumsum(length[small]) - length[small], len(at), 1 << 17):
                i, j = at[i], at[j]
                ok = (own[i] | own[j]) & (a["rep"][i] != a["rep"][j])
                i, j = i[ok], j[ok]
                far = sum(np.bitwise_count((a[s][i] ^ a[s][j]).view(np.uint64)).astype(np.int32) for s in names[2:])
                keep[i[far <= lattice.sketch]] = True
                keep[j[far <= lattice.sketch]] = True
            yield pa.RecordBatch.from_arrays([pa.array(a["key"][keep] >> 1), pa.array(a["rep"][keep])], ["key", "rep"])

    return run


def _verified(lattice: Lattice, least: float):
    """Links counted once, in the first table in which a pair meets and in one of its cells there; hands on sums and trees."""
    keys = ["key", "bi", "bj"]

    def run(batches):
        for a, starts in whole_runs(batches, [*keys, "blk", "rep", "grp", "mult", "embedding"], keys):
            n = len(a["rep"])
            own, probed = np.zeros((n, lattice.tables), np.int64), np.zeros((n, lattice.tables, lattice.probes), np.int64)
            lengths = np.array([len(v) for v in a["embedding"]])
            x = np.zeros((n, max(lengths, default=0)))
            for at, u in _by_length(a["embedding"]):
                x[at, : u.shape[1]] = u
                own[at], probed[at], _ = lattice.codes(u)
            links, forest = np.zeros(n, np.int64), Forest()
            for i, j in run_pairs(starts, n, 1 << 14):
                ok = ((a["bi"][i] == a["bj"][i]) | (a["blk"][i] != a["blk"][j])) & (a["rep"][i] != a["rep"][j]) & (a["grp"][i] == a["grp"][j]) & (lengths[i] == lengths[j])
                i, j = i[ok], j[ok]
                ok = (x[i] * x[j]).sum(1) >= least
                i, j = i[ok], j[ok]
                swap = a["rep"][i] > a["rep"][j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                same = own[i] == own[j]
                ij = (probed[j] == own[i][:, :, None]).any(2)
                ji = (probed[i] == own[j][:, :, None]).any(2)
                first = (same | ij | ji).argmax(1)
                r = np.arange(len(i))
                cell = np.where(same[r, first] | ij[r, first], own[i, first], own[j, first])
                ok = (_key(a["grp"][i], cell) >> np.uint64(1)).view(np.int64) == a["key"][i] & ((1 << 63) - 1)
                ok &= (same | ij | ji).any(1)
                i, j = i[ok], j[ok]
                np.add.at(links, i, a["mult"][j])
                np.add.at(links, j, a["mult"][i])
                for p, q in zip(a["rep"][i].tolist(), a["rep"][j].tolist()):
                    forest.join(p, q)
            at = np.flatnonzero(links)
            tree = forest.links()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a["rep"][at], np.array([p for p, _ in tree], np.int64)])), pa.array([None] * len(at) + [q for _, q in tree], pa.int64()), pa.array(np.concatenate([links[at], np.zeros(len(tree), np.int64)]))],
                ["rep", "to", "n"],
            )

    return run


def near_vectors(embeddings: DataFrame, least: float = 0.93, lattice: Lattice = Lattice()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding, label), linked within a label at a cosine of ``least`` or more.

    Equal vectors of a label are hashed once and linked to each other without making pairs; each other pair is looked at
    where its lattice cells meet and verified in double precision.  Vectors that are null, empty, zero, or hold null or
    non-finite components, and those without label or vec_id, link with nothing; vectors of different lengths do not meet.
    Rows with one vec_id are vectors of their own, which share that id; labels may be of any type.  Single-precision
    vectors stay so until their cosine; all others are double.  Other columns play no part; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    whole = isinstance(embeddings.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string")))
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("grp"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("embedding"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda c: c != 0) & F.col("grp").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    v = Staged(v.withColumn("sound", sound), "vectors").df
    d = v.where("sound").groupBy("grp", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("mult"))
    d = Staged(d.withColumn("rep", F.monotonically_increasing_id()), "distinct").df  # numbered once, as written
    entries = exchanged(d.mapInArrow(_entries(lattice, parts_of(spark)), "part int, blob binary"))
    likely = Staged(entries.mapInArrow(_likely(lattice), "key long, rep long").distinct(), "likely")
    order = ["key", "bi", "bj"]
    met = deal_blocks(likely.df.join(d.select("rep", "grp", "mult", "embedding"), "rep"), ["key"], ["rep"], BLOCK).repartition(fan_out(spark), *order).sortWithinPartitions(*order)
    found = Staged(met.mapInArrow(_verified(lattice, least), "rep long, to long, n long"), "links")
    likely.drop()
    comp = connected(found.df.where("to is not null").select("rep", "to"), "rep", "to").df
    count = found.df.groupBy("rep").agg(F.sum("n").alias("n"))
    named = d.join(count, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    smallest = d.select("rep", "first").join(comp.withColumnRenamed("node", "rep"), "rep").groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component", "left")
    named = named.select("grp", "embedding", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    linked = v.where("sound").join(named, ["grp", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = v.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; nulls, broken and repeated rows as in near_vectors()."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
