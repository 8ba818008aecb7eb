"""Shared helpers: staged tables in the cluster's shared folder, text normalisation, components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zlib
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and 0x09-0x0D; bytes.split() splits at just these.
SPACES = " \t\n\r\x0b\x0c"


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only on one machine, where no cluster names one, is a folder of our own made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="probspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Staged:
    """A DataFrame written as Parquet in the shared folder: lineage ends here, and lost executors lose nothing."""

    made: list | None = None  # those of the present scope, see scratch()

    def __init__(self, df: DataFrame, name: str, sort_codec: str = "zstd"):
        self.spark, self.gone = df.sparkSession, False
        if Staged.made is not None:
            Staged.made.append(self)
        self.path = f"{shared_root(self.spark)}/probspark/{name}-{uuid.uuid4().hex}"
        with shuffles_freed(self.spark):
            df.write.option("compression", sort_codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; call it only when nothing still has to read them."""
        if self.gone:
            return
        self.gone = True
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is finished: it does so once the driver's collector has found the plans gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What runs within has its shuffle files deleted as soon as it has ended, without waiting for the driver's collector."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def scratch():
    """Tables staged within are dropped at its end but for those that are taken out of the list it gives."""
    before, Staged.made = Staged.made, []
    try:
        yield Staged.made
    finally:
        made, Staged.made = Staged.made, before
        for x in made:
            x.drop()


def remainder(column: str, n: int):
    """crc32 of an id written as text, modulo n (null ids: -1, so in no fold)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(-1))


def held(doc_id, n: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == 0


def fan_out(spark: SparkSession) -> int:
    """Number of partitions for a shuffle named by hand: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected(edges: DataFrame, a: str, b: str) -> Staged:
    """Components of an undirected graph of longs: rows (node, component), component the smallest node reachable.

    Contraction: each round points every node to its smallest neighbour, follows those pointers, and rewrites the edges
    between the trees that result, until no edge is left.  A round is a few aggregations and equi-joins: partial minima
    before the shuffle and joins that the adaptive planner can split keep a hub with most of the edges from landing in one
    task.  Rounds are written to the shared folder; each at least halves the nodes that still have edges.
    Nodes without an edge to another node are not returned.  Null ends are dropped.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v and u is not null and v is not null").distinct()
    e = Staged(e, "edges")
    member: Staged | None = None
    while not e.df.isEmpty():
        up = e.df.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("p"))
        up = Staged(up, "up")  # every p < node: a forest whose roots have no smaller neighbour
        jump = up
        while True:
            q = jump.df.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            nxt = Staged(jump.df.join(q, "p", "left").select("node", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "jump")
            if jump is not up:
                jump.drop()
            moved = not nxt.df.where("moved").isEmpty()
            jump = nxt
            if not moved:
                break
        up.drop()
        to = jump.df.select("node", "p")
        m = to.select("node", F.col("p").alias("component"))
        if member is not None:
            old = member.df.join(to.withColumnsRenamed({"node": "component"}), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
            m = old.unionByName(m.join(member.df.select("node"), "node", "left_anti"))
        new = Staged(m, "member")
        left = e.df.join(to.select(F.col("node").alias("u"), F.col("p").alias("pu")), "u", "left").select(F.coalesce("pu", "u").alias("u"), "v")
        left = left.join(to.select(F.col("node").alias("v"), F.col("p").alias("pv")), "v", "left").select("u", F.coalesce("pv", "v").alias("v"))
        left = left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
        nxt = Staged(left, "edges")
        for x in (e, jump, member):
            if x is not None:
                x.drop()
        e, member = nxt, new
    e.drop()
    if member is None:
        spark = edges.sparkSession
        return Staged(spark.createDataFrame([], "node long, component long"), "member")
    roots = member.df.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    out = Staged(member.df.unionByName(roots.join(member.df.select("node"), "node", "left_anti")), "components")
    member.drop()
    return out


def deal_blocks(rows: DataFrame, keys: list[str], within: list[str], most: int) -> DataFrame:
    """Cut groups of more than ``most`` rows into blocks so that every pair of a group still meets in some task.

    Adds ``blk`` (the row's block in its group) and (``bi``, ``bj``), the pair of blocks it is sent to: a group of n rows in
    b = ceil(n / most) blocks sends each row to b pairs of blocks, and no task holds more than about two blocks.  Pairs of
    rows are to be looked at where bi = bj, or where their ``blk`` differ.
    """
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > most)
    at = rows.join(hot, keys, "left").withColumn("nb_", F.ceil(F.coalesce("n_", F.lit(1)) / most).cast("int"))
    at = at.withColumn("blk", F.pmod(F.xxhash64(*within), F.col("nb_")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb_") - 1))
    at = at.select(*rows.columns, "blk", other.alias("o_"))
    return at.select(*rows.columns, "blk", F.least("blk", "o_").alias("bi"), F.greatest("blk", "o_").alias("bj"))


def whole_runs(batches, columns: list[str], keys: list[str]):
    """Turns Arrow batches sorted by ``keys`` into dicts of numpy arrays that never cut a run of equal keys; also gives each row's run."""
    import numpy as np

    carry = None

    def runs(a):
        n = len(a[keys[0]])
        new = np.zeros(n, bool)
        new[:1] = True
        for k in keys:
            new[1:] |= a[k][1:] != a[k][:-1]
        return np.flatnonzero(new)

    for b in batches:
        a = {c: b.column(c).to_numpy(zero_copy_only=False) for c in columns}
        if carry is not None:
            a = {c: np.concatenate([carry[c], a[c]]) for c in columns}
        starts = runs(a)
        if not len(starts):
            continue
        cut = starts[-1]
        carry = {c: v[cut:] for c, v in a.items()}
        if cut:
            yield {c: v[:cut] for c, v in a.items()}, starts[:-1]
    if carry is not None and len(carry[columns[0]]):
        yield carry, runs(carry)


def run_pairs(starts, n: int, most: int = 1 << 20):
    """Index pairs (i, j), i < j, of rows in the same run, in arrays of about ``most`` at a time."""
    import numpy as np

    length = np.diff(np.append(starts, n))
    yield from near_pairs(np.repeat(starts + length, length), most)


def near_pairs(end, most: int = 1 << 20):
    """Index pairs (i, j), i < j < end[i], in arrays of about ``most`` at a time."""
    import numpy as np

    left = end - np.arange(len(end)) - 1
    lag, i, held_i, held_j, held = 1, np.flatnonzero(left > 0), [], [], 0
    while len(i):
        held_i.append(i)
        held_j.append(i + lag)
        held += len(i)
        if held >= most:
            yield np.concatenate(held_i), np.concatenate(held_j)
            held_i, held_j, held = [], [], 0
        lag += 1
        i = i[left[i] >= lag]
    if held:
        yield np.concatenate(held_i), np.concatenate(held_j)


#: Bytes of a word's or a shingle's hash in a set that travels: two of different hash agree in them once in 10^12.
SHORT = 5


def packed(h) -> bytes:
    """The upper 40 bits of each hash."""
    import numpy as np

    return np.ascontiguousarray((h >> np.uint64(64 - 8 * SHORT)).view(np.uint8).reshape(-1, 8)[:, :SHORT]).tobytes()


def unpacked(x):
    """The hashes of packed()."""
    import numpy as np

    out = np.zeros((len(x) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(x, np.uint8).reshape(-1, SHORT)
    return out.view(np.uint64).ravel()


def scattered(key, parts: int, columns: dict):
    """Rows of a slice as one binary row a part: (part, blob), the part by the key's high bits, a blob the columns one after the other.

    What is exchanged by a key in millions of small rows goes through the shuffle as a few rows of arrays; see gathered().
    All columns are 64 bits wide, the key among them.
    """
    import numpy as np
    import pyarrow as pa

    part = (key >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint32), kind="stable")
    part = part[order]
    edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
    cols = [np.ascontiguousarray(c[order]).view(np.uint8).reshape(-1, 8) for c in columns.values()]
    blobs = [b"".join(c[a:b].tobytes() for c in cols) for a, b in zip(edge, edge[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def gathered(batches, columns: list[str], key: str, shift: int = 0):
    """The other side of scattered(), of rows sorted by part: of each part the columns (int64) sorted by the key, and where its runs start.

    The lowest ``shift`` bits of the key do not part runs.
    """
    import numpy as np

    def whole(blobs):
        n = len(columns)
        parts = [np.frombuffer(b, np.int64).reshape(n, -1) for b in blobs]
        x = np.concatenate(parts, 1)
        order = np.argsort(x[columns.index(key)], kind="stable")
        a = {c: x[i][order] for i, c in enumerate(columns)}
        k = a[key] >> shift
        return a, np.flatnonzero(np.append(True, k[1:] != k[:-1]))

    now, held = None, []
    for b in batches:
        for p, blob in zip(b.column("part").to_pylist(), b.column("blob")):
            if p != now:
                if held:
                    yield whole(held)
                now, held = p, []
            held.append(blob.as_buffer())
    if held:
        yield whole(held)


def exchanged(df: DataFrame) -> DataFrame:
    """Rows of scattered(), each part in one task."""
    return df.repartition(fan_out(df.sparkSession), "part").sortWithinPartitions("part")


def parts_of(spark: SparkSession) -> int:
    """Parts for scattered(): a few a partition, so that one is small and partitions are even."""
    return 4 * fan_out(spark)


class Forest:
    """Union-find over a task's own links, so that it hands on a tree instead of every link."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self):
        return [(x, self.find(x)) for x in list(self.up)]


def cut(batches, text: str = "text", most: int = 2 << 20):
    """Arrow batches cut into slices of about ``most`` bytes of text, so that what is made of one stays small beside it."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


def by_size(batch, columns: list[str], text: str = "text", most: int = 2 << 20):
    """Slices of an Arrow batch as lists, each of about ``most`` bytes of text; null texts become empty."""
    for part in cut([batch], text, most):
        yield [part.column(c).to_pylist() for c in columns], [t or "" for t in part.column(text).to_pylist()]


#: Bytes that are looked at together: few enough for their running sums to stay in a core's cache.
_SEGMENT = 1 << 16
_hashing: dict = {}


def split_words(texts: list[str]):
    """All words of some texts without making an object of each: (all texts' bytes, first byte and end of each word, its hash, its line among all lines, lines of each text).

    Words are lower-cased (A-Z) for the hash and separated by ASCII white space, lines by line feeds.  A word's 64-bit hash
    is a polynomial of random values of its bytes, got from running sums, and mixed.
    """
    import numpy as np

    raw = [t.encode() for t in texts]
    lines = np.fromiter((r.count(b"\n") + 1 for r in raw), np.int64, len(raw))
    whole = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if not _hashing:
        rng = np.random.default_rng(11)
        value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        value[65:91] = value[97:123]
        _hashing.update(value=value, base=int(rng.integers(1 << 40, 1 << 63)) | 1, power=np.zeros(0, np.uint64))
    value = _hashing["value"]
    space = lambda x: (x == 32) | (x - np.uint8(9) < 5)
    hashes, line_of, starts, ends, at, before = [], [], [], [], 0, 0
    while at < len(whole):
        to = min(len(whole), at + _SEGMENT)
        gap = space(whole[at:to])
        while to < len(whole) and not gap.any():
            to = min(len(whole), 2 * to - at)
            gap = space(whole[at:to])
        cut = len(gap) - int(gap[::-1].argmax())  # after the last white space; the text ends in a line feed
        x, gap = whole[at : at + cut], gap[:cut]
        _powers(cut)
        total = np.empty(cut + 1, np.uint64)
        total[0] = 0
        np.cumsum(value[x] * _hashing["power"][:cut], out=total[1:])
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.append(0, edge)
        start, end = edge[0::2], edge[1::2]
        h = (total[end] - total[start]) * _hashing["inverse"][start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        hashes.append(h ^ (h >> np.uint64(32)))
        feed = np.flatnonzero(x == 10)
        line_of.append(np.searchsorted(feed, start) + before)
        starts.append(start + at)
        ends.append(end + at)
        before += len(feed)
        at += cut
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return whole, joined(starts, np.int64), joined(ends, np.int64), joined(hashes, np.uint64), joined(line_of, np.int64), lines


def hashed_spans(x, start, stop):
    """64-bit hashes of the spans [start, stop) of an array of bytes, case and all; spans ascend."""
    import numpy as np

    if not _hashing:
        split_words([""])
    if "cased" not in _hashing:
        _hashing["cased"] = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
    out, at, k = np.empty(len(start), np.uint64), 0, 0
    while k < len(start):
        to = max(k + 1, int(np.searchsorted(stop, start[k] + _SEGMENT, "right")))
        at = int(start[k])
        n = int(stop[to - 1]) - at
        _powers(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_hashing["cased"][x[at : at + n]] * _hashing["power"][:n], out=total[1:])
        s, e = start[k:to] - at, stop[k:to] - at
        h = (total[e] - total[s]) * _hashing["inverse"][s]
        h ^= h >> np.uint64(32)
        out[k:to] = h * np.uint64(0xD6E8FEB86659FD93)
        k = to
    return out


def _powers(n: int) -> None:
    """Powers of the hashing base, and their inverses, up to the n-th."""
    import numpy as np

    if len(_hashing["power"]) <= n:
        base, n = _hashing["base"], max(n, _SEGMENT)
        _hashing["power"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]), dtype=np.uint64)
        _hashing["inverse"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(base, -1, 1 << 64)))]), dtype=np.uint64)


def word_hashes(texts: list[str]):
    """(hash of each word, its text, its line among all lines, number of lines of each text); see split_words()."""
    import numpy as np

    _, _, _, hashes, line_of, lines = split_words(texts)
    text_of = np.repeat(np.arange(len(texts)), lines)
    return hashes, text_of[line_of], line_of, lines


def distinct(x):
    """(sorted distinct values, index of each element among them) of an array."""
    import numpy as np

    order = np.argsort(x)
    y = x[order]
    new = np.ones(len(y), bool)
    new[1:] = y[1:] != y[:-1]
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return y[new], inverse
