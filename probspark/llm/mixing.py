"""Mixing sources to target weights by balanced sampling (the cube method)."""

from __future__ import annotations

import random
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import Staged, cut, fan_out

#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: A block of the flight phase holds about so many documents.
BLOCK = 4096
#: Documents of more than this share of their source's words are decided first: there are fewer than 1 / LARGE of them.
LARGE = 0.01


def _sizes(batches):
    for b in cut(batches):
        n = [0 if t is None else len(t.encode().split()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64()), b.column("t")], ["doc_id", "source", "size", "t"])


def _keyed(documents: DataFrame) -> list:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t")]


def sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, t): words of each whole text, and its hash; null and empty texts have 0 words."""
    docs = documents.select(*_keyed(documents), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_sizes, "doc_id long, source string, size long, t long")


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target): the water level that shares ``share`` of all sizes by weight, no source over ``most`` times its own.

    One row a source, so windows over the whole of it are cheap.  The level is the largest of the levels found by taking the
    sources with the smallest limit for their weight as full: each of them is a lower bound, and one is exact.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    s = by_source.withColumn("weight", weight).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _step(up: float, down: float, rng: random.Random) -> float:
    """One of the two ends of a move, so that nothing moves on average."""
    return up if rng.random() * (up + down) < down else -down


def _settled(x: float) -> float:
    return 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x


def _fly(units: list, rng: random.Random) -> list:
    """One move of up to three units [row, size, pi] in the null-space of the two balancing totals; one of them, at least, is decided.

    With three units the direction is the cross product of (1, 1, 1) and the sizes; with two of one size it keeps both
    totals as well.
    """
    if len(units) == 3:
        a, b, c = (x[1] for x in units)
        u = (b - c, c - a, a - b)
        if u == (0, 0, 0):
            u = (1, -1, 0)
    else:
        u = (1, -1)
    up = min(((1 - x[2]) / d if d > 0 else -x[2] / d) for x, d in zip(units, u) if d)
    down = min((x[2] / d if d > 0 else -(1 - x[2]) / d) for x, d in zip(units, u) if d)
    return _moved(units, u, _step(up, down, rng))


def _pair(a: list, b: list, rng: random.Random) -> None:
    """Move two units in the null-space of the word total alone; one of them, at least, is decided."""
    d = (b[1] or 1, -(a[1] or 1))
    up = min((1 - a[2]) / d[0], b[2] / -d[1])
    down = min(a[2] / d[0], (1 - b[2]) / -d[1])
    _moved([a, b], d, _step(up, down, rng))


def _moved(units: list, direction, step: float) -> list:
    for x, d in zip(units, direction):
        x[2] = _settled(min(1.0, max(0.0, x[2] + step * d)))
    if not any(x[2] in (0.0, 1.0) for x in units):  # rounding only: decide the nearest
        x = min(units, key=lambda x: min(x[2], 1 - x[2]))
        x[2] = float(round(x[2]))
    return units


def _land(units: list, rng: random.Random) -> None:
    """Decide the last units of a source: give up the document total and move on, then draw the last one by its probability.

    So a source ends within its last document of its target, and every document is taken as often as it should on average.
    """
    if len(units) == 2:
        _pair(*units, rng)
    for x in units:
        if 0 < x[2] < 1:
            x[2] = float(rng.random() < x[2])


def _first_moves(sizes: list, rest: float, pi: float, rng: random.Random) -> tuple[list, float]:
    """Decide large units of one source, largest first: each moves against all later ones together.

    That direction, one for the unit and minus its share of their words for the others, is in the null-space of the word
    total, and the others go on having one probability.  ``rest`` are the words of the units that are not large; returns the
    decisions and the probability of those.
    """
    out = []
    left = rest + sum(sizes)
    for s in sizes:
        left -= s
        if 0 < pi < 1 and left > 0:
            up, down = min(1 - pi, pi * left / s), min(pi, (1 - pi) * left / s)
            x = _step(up, down, rng)
            own, pi = _settled(pi + x), _settled(min(1.0, max(0.0, pi - x * s / left)))
        else:
            own = pi
        out.append(float(rng.random() < own) if 0 < own < 1 else own)
    return out, pi


def _large(batches):
    """Decisions on large units, sorted by source, size and hash; and, with size -1, each source's probability of the others."""
    names = ["doc_id", "source", "t", "size", "pi"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())

    def decided(units):
        _, source, _, _, pi, rest = units[0]
        rng = random.Random(xxhash.xxh64_intdigest(repr(("large", source))))
        got, pi = _first_moves([float(u[3]) for u in units], rest, pi, rng)
        return [(u[0], source, u[2], u[3], x) for u, x in zip(units, got)] + [(None, source, 0, -1, pi)]

    held: list = []
    for b in batches:
        out = []
        for row in zip(*(b.column(c).to_pylist() for c in (*names, "rest"))):
            if held and held[-1][1] != row[1]:
                out += decided(held)
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*decided(held)), kinds)], names)


def _flight(last: bool, salt: int):
    """Streams rows sorted by (source, block): at most three undecided documents are held at a time."""

    def settle(active: list, rng) -> list:
        while len(open_ := [x for x in active if x[2] not in (0.0, 1.0)]) == 2 and open_[0][1] == open_[1][1]:
            _fly(open_, rng)
        if last:
            _land(open_, rng)
        return active

    def run(batches):
        key, active, rng, out = None, [], None, []
        for b in batches:
            for doc, source, block, t, size, pi in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "block", "t", "size", "pi"))):
                if key != (source, block):
                    out += settle(active, rng)
                    key, active = (source, block), []
                    rng = random.Random(xxhash.xxh64_intdigest(repr(key), salt))
                unit = [(doc, source, t), size, pi]
                if pi <= 0.0 or pi >= 1.0:
                    out.append(unit)
                    continue
                active.append(unit)
                while len(active) == 3:
                    _fly(active, rng)
                    out += [x for x in active if x[2] in (0.0, 1.0)]
                    active = [x for x in active if x[2] not in (0.0, 1.0)]
            yield _rows(out)
            out = []
        yield _rows(out + settle(active, rng))

    return run


_FLOWN = "doc_id long, source string, t long, size long, pi double"


def _rows(out: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
    cols = zip(*((*x[0], x[1], x[2]) for x in out)) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["doc_id", "source", "t", "size", "pi"])


def cube_sample(units: DataFrame) -> DataFrame:
    """Decide inclusion of units (doc_id, source, t, size, pi): pi becomes 0 or 1.

    Within each source the sum of sizes and the number of units stay at their expected values but for the last two units.
    A source is dealt into blocks of about ``BLOCK`` units by a hash, so no source is one task; a block leaves two
    undecided at most, which are dealt again, until two are left in each source: a round cuts them by a factor of about
    BLOCK / 2.  Random moves are seeded by source, block and round and taken in a fixed order, by size and hash, so reruns
    and retries agree; units alike in all columns are interchangeable.  Sizes of 0 and null sources are units and a source
    like others; an empty table gives no rows.
    """
    spark = units.sparkSession
    todo = units.select("doc_id", "source", "t", "size", "pi")
    done, salt, old = None, 0, None
    while True:
        n = todo.where("pi > 0 and pi < 1").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        last = n.where(F.col("n") > BLOCK).isEmpty()
        dealt = todo.join(n.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        blocks = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(1)) / BLOCK))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "t", F.lit(salt)), blocks)).drop("n")
        dealt = dealt.repartition(fan_out(spark), "source", "block").sortWithinPartitions("source", "block", F.desc("size"), "t", "doc_id")
        flown = Staged(dealt.mapInArrow(_flight(last, salt), _FLOWN), "flight")
        decided = flown.df.where("pi <= 0 or pi >= 1")
        done = decided if done is None else done.unionByName(decided)
        if last:
            return done
        todo, salt, old = flown.df.where("pi > 0 and pi < 1"), salt + 1, flown


def mix(documents: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Rows (doc_id, source, size, t, source_size, target, copies): how often the mix takes each document; t is its text's hash.

    Every document is taken floor(r) or floor(r) + 1 times, r being its source's target over its size; which, a balanced
    sample decides, on average r times.  Documents of more than LARGE of their source's words, fewer than 1 / LARGE, move
    first, each against all others of the source; the others fly in blocks.  Null sources are one source, weighed last; null
    and empty texts have size 0.  Repeated rows are units of their own.  An empty table gives no rows.
    """
    spark = documents.sparkSession
    sized = Staged(sizes(documents), "sizes").df
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = F.when(rate > most - 1e-12, F.lit(float(most))).otherwise(rate)
    goal = Staged(targets(sized, share, most, weights).withColumnRenamed("source", "s").withColumn("r", rate), "targets").df
    at = sized.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("pi", F.col("r") - F.floor("r"))
    is_large = F.col("size") > F.col("source_size") * LARGE
    large = at.where(is_large)
    words = large.groupBy("source").agg(F.sum("size").alias("n")).withColumnRenamed("source", "s")
    large = large.join(words, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rest", (F.col("source_size") - F.col("n")).cast("double"))
    large = large.repartition(fan_out(spark), "source").sortWithinPartitions("source", F.desc("size"), "t", "doc_id")
    first = Staged(large.select("doc_id", "source", "t", "size", "pi", "rest").mapInArrow(_large, _FLOWN), "large").df
    moved = first.where("size = -1").select(F.col("source").alias("s"), F.col("pi").alias("now"))
    others = at.where(~is_large).join(moved, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("pi", F.coalesce("now", "pi"))
    chosen = cube_sample(others.select("doc_id", "source", "t", "size", "pi")).unionByName(first.where("size >= 0"))
    out = chosen.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return out.select("doc_id", "source", "size", "t", "source_size", "target", (F.floor("r") + F.col("pi")).cast("long").alias("copies"))


def mixed(documents: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """The mix itself: documents repeated as often as it takes them, columns as they are.

    Rows alike in doc_id, source and text share their copies: as many as the mix takes of them together, dealt out evenly.
    """
    m = mix(documents, share, most, weights).groupBy("doc_id", "source", "t").agg(F.sum("copies").alias("k"), F.count(F.lit(1)).alias("n"))
    tag = uuid.uuid4().hex[:8]  # names that no column of the documents has
    name = lambda c: f"{c}_{tag}"
    m = Staged(m.where("k > 0").select(*[F.col(c).alias(name(c)) for c in ("doc_id", "source", "t", "k", "n")]), "copies").df
    d, s, t = _keyed(documents)
    on = d.eqNullSafe(F.col(name("doc_id"))) & s.eqNullSafe(F.col(name("source"))) & (t == F.col(name("t")))
    once = documents.join(m.where(F.col(name("n")) == 1), on).withColumn(name("c"), F.col(name("k")).cast("int"))
    again = documents.join(m.where(F.col(name("n")) > 1), on)
    at = F.row_number().over(Window.partitionBy(*[name(c) for c in ("doc_id", "source", "t")]).orderBy(name("t")))
    k, n = F.col(name("k")), F.col(name("n"))
    again = again.withColumn(name("i"), at).withColumn(name("c"), (F.floor(k / n) + (F.col(name("i")) <= k % n).cast("int")).cast("int")).drop(name("i"))
    both = once.unionByName(again)
    return both.withColumn(name("e"), F.explode(F.array_repeat(F.lit(0), F.col(name("c"))))).select(*documents.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: nulls, empties and repeated rows as in mix(); columns other than doc_id, source and text play no part."""
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
