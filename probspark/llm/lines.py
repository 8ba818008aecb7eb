"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased, separated by ASCII white space).  A line goes if an earlier line, by
(doc_id, line number), has a Jaccard similarity of ``least`` or more; lines without words stay.  Equal sets are found by
128 bits of hash.  For different sets, words are ordered by rarity and two sets can only be similar if they share a word of their
prefixes; pairs met there pass a length filter, a positional filter and a parity filter (a bound of the symmetric difference
from 128 parity bits), and then the sets themselves are compared.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import SHORT, Staged, by_size, cut, distinct, exchanged, fan_out, gathered, near_pairs, packed, parts_of, release, run_pairs, scattered, shuffles_freed, unpacked, whole_runs, word_hashes

#: Word frequencies are counted in 2^SKETCH_BITS buckets: a fixed size to broadcast (a byte each), whatever the corpus.
#: Any common order of words gives the same result; rare words first just give the fewest pairs.
SKETCH_BITS = 22
_CHUNK = 4096
#: Frequencies are kept as levels of one byte, so many to a doubling: enough for 2^42.
LEVELS = 6
#: A word's postings beyond this are dealt out in pairs of blocks.
BLOCK = 1024
_FLAGS = 1 << 23
#: Characters of text that are looked at together.
_SLICE = 1 << 20
#: Bytes of text that are dealt out to parts together.
_SENT = 4 << 20


def _documents(documents: DataFrame) -> DataFrame:
    """(doc, h, text): null doc_ids are the smallest long here; h tells texts with one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def _split(texts: list[str]):
    """(document of each line, number in it, line of each word, index of each word among the distinct ones, their hashes)."""
    h, _, line, lines = word_hashes(texts)
    values, ids = distinct(h)
    doc = np.repeat(np.arange(len(lines)), lines)
    return doc, np.arange(len(doc)) - np.repeat(np.cumsum(lines) - lines, lines), line, ids, values


def _sets(line: np.ndarray, rank: np.ndarray):
    """Distinct words of each line in rank order: (rank of each, start of each line that has words, those lines, set sizes)."""
    bits = int(rank.max(initial=0)).bit_length()
    if bits + int(line.max(initial=0)).bit_length() > 63:
        raise ValueError("too many words and lines in one slice")
    key = np.sort((line << bits) | rank)
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    line, rank = key >> bits, key & ((1 << bits) - 1)
    start = np.flatnonzero(np.diff(line, prepend=-1))
    return rank, start, line[start], np.diff(np.append(start, len(line)))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _set_hash(hashes: np.ndarray, start: np.ndarray, mix: np.uint64 = _MIX) -> np.ndarray:
    x = hashes * mix
    x ^= x >> np.uint64(29)
    return np.add.reduceat(x * mix, start) if len(start) else x[:0]


_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _first(batches):
    """Lines with their set hashes (kind 0), and this task's word counts in chunks of buckets (kind 1)."""
    names = ["kind", "doc", "h", "line", "hash", "more", "chunk"]
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for b in batches:
        for (docs, hs), texts in by_size(b, ["doc", "h"], most=_SLICE):
            doc, no, words, ids, hashes = _split(texts)
            np.add.at(sketch, (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.bincount(ids, minlength=len(hashes)).astype(np.uint32))
            rank, start, line, _ = _sets(words, ids)
            sets, more = (_set_hash(hashes[rank], start, mix).view(np.int64) for mix in (_MIX, _MIX2))
            d = doc[line]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(line), np.int8)), pa.array(np.array(docs)[d]), pa.array(np.array(hs)[d]), pa.array(no[line].astype(np.int32)), pa.array(sets), pa.array(more), pa.nulls(len(line), pa.binary())], names)
    chunks = sketch.reshape(-1, _CHUNK)
    at = np.flatnonzero(chunks.any(1))
    zero = np.zeros(len(at), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int8) + np.int8(1)), pa.array(zero), pa.array(zero), pa.array(zero.astype(np.int32)), pa.array(at), pa.array(zero), pa.array([chunks[i].tobytes() for i in at], pa.binary())], names)


def _summed(batches):
    """Sums chunks sorted by number and turns counts into levels of one byte."""
    now, total = None, None

    def row():
        level = np.minimum(255, np.round(LEVELS * np.log2(1.0 + total))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["hash", "chunk"])

    for b in batches:
        for k, c in zip(b.column("hash").to_pylist(), b.column("chunk").to_pylist()):
            if k != now:
                if now is not None:
                    yield row()
                now, total = k, np.zeros(_CHUNK, np.int64)
            total += np.frombuffer(c, np.uint32)
    if now is not None:
        yield row()


def _need(k, least: float):
    return np.ceil(least * k - 1e-9).astype(np.int64)


def _postings(levels: np.ndarray, least: float, parts: int):
    """Of each distinct set of a slice that can resemble another at all, its prefix words, scattered by word and pair of blocks.

    A word that was counted once in all lines is in no other set, and is left out.
    """

    def run(batches):
        for b in batches:
            for _, texts in by_size(b, [], most=_SLICE):
                _, _, words, ids, hashes = _split(texts)
                level = levels[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((hashes, level))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                r, start, _, k = _sets(words, rank[ids])
                if not len(start):
                    continue
                h = hashes[order][r]
                sets = _set_hash(h, start)
                bit = np.uint64(1) << (h & np.uint64(63))
                high = (h >> np.uint64(6) & np.uint64(1)).astype(bool)
                p0, p1 = (np.bitwise_xor.reduceat(np.where(high == v, bit, np.uint64(0)), start) for v in (False, True))
                _, one = np.unique(sets, return_index=True)
                one = one[k[one] / (k[one] + 1) >= least - 1e-9]
                size = (k - _need(k, least) + 1)[one]
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(start[one], size) + pos
                mine = np.repeat(one, size)
                seen = level[order][r[at]] > LEVELS  # in more than one place
                at, pos, mine = at[seen], pos[seen], mine[seen]
                # of a frequent word's postings no task gets all: they go to pairs of about sqrt(frequency / BLOCK) blocks
                most = np.exp2((level[order][r[at]].astype(np.float64) + 1) / LEVELS)
                nb = np.maximum(1, np.ceil(np.sqrt(most / BLOCK))).astype(np.int64)
                blk = ((sets[mine] >> np.uint64(20)) % nb.astype(np.uint64)).astype(np.int64)
                many = np.repeat(np.arange(len(nb)), nb)
                other = np.arange(len(many)) - np.repeat(np.cumsum(nb) - nb, nb)
                lo, hi = np.minimum(blk[many], other), np.maximum(blk[many], other)
                own = mine[many]
                key = (h[at][many] + (lo << 32 | hi).astype(np.uint64) * _MIX2) * _MIX
                key ^= key >> np.uint64(31)
                meta = k[own] << 40 | pos[many] << 18 | np.where(lo == hi, 0, 1 + (blk[many] == hi))
                yield scattered(key, parts, {"key": key, "hash": sets[own], "p0": p0[own], "p1": p1[own], "meta": meta})

    return run


_COLUMNS = ["key", "hash", "p0", "p1", "meta"]


def _sides(meta: np.ndarray):
    """0: within one block, where all pairs are looked at; 1 and 2: the two blocks of a pair of blocks, where those across are."""
    return meta & 3


def _by_length(a: dict, starts: np.ndarray, k: np.ndarray, least: float):
    """Rows of each run in the order of their set sizes, and for each where those end that are not too large for it."""
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k))))
    both = run << 24 | k
    order = np.argsort(both, kind="stable")
    limit = np.floor(k[order] / least + 1e-9).astype(np.int64)
    return {c: v[order] for c, v in a.items()}, k[order], np.searchsorted(both[order], run[order] << 24 | np.minimum(limit, (1 << 24) - 1), "right")


def _plausible(least: float):
    """Of each word's postings those with a partner that passes the length, positional and parity filters."""

    def run(batches):
        for a, starts in gathered(batches, _COLUMNS, "key"):
            a, k, end = _by_length(a, starts, a["meta"] >> 40, least)
            keep = np.zeros(len(k), bool)
            after, side = k - (a["meta"] >> 18 & (1 << 22) - 1), _sides(a["meta"])
            for i, j in near_pairs(end, 1 << 17):
                both = k[i] + k[j]
                share = _need(both, least / (1 + least))
                ok = np.minimum(after[i], after[j]) >= share
                i, j, both, share = i[ok], j[ok], both[ok], share[ok]
                odd = np.bitwise_count((a["p0"][i] ^ a["p0"][j]).view(np.uint64)).astype(np.int64) + np.bitwise_count((a["p1"][i] ^ a["p1"][j]).view(np.uint64))
                ok = (odd <= both - 2 * share) & (a["hash"][i] != a["hash"][j]) & ((side[i] == 0) | (side[i] != side[j]))
                keep[i[ok]] = True
                keep[j[ok]] = True
            yield pa.RecordBatch.from_arrays([pa.array(a["key"][keep]), pa.array(a["hash"][keep]), pa.array(side[keep].astype(np.int8))], ["key", "hash", "side"])

    return run


def _flag(doc: np.ndarray, h: np.ndarray, line: np.ndarray) -> np.ndarray:
    x = (doc.view(np.uint64) * _MIX ^ h.view(np.uint64)) * _MIX2 + line.astype(np.uint64)
    x ^= x >> np.uint64(29)
    return ((x * _MIX) >> np.uint64(64 - (_FLAGS.bit_length() - 1))).astype(np.int64)


def _flag_rows(batches):
    bits = np.zeros(_FLAGS, bool)
    for b in batches:
        bits[_flag(*(b.column(c).to_numpy() for c in ("doc", "h", "line")))] = True
    chunks = np.packbits(bits).reshape(-1, _CHUNK)
    at = np.flatnonzero(chunks.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([chunks[i].tobytes() for i in at], pa.binary())], ["hash", "chunk"])


def _flags_joined(batches):
    chunks: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column("hash").to_pylist(), b.column("chunk").to_pylist()):
            chunks[k] = chunks.get(k, 0) | np.frombuffer(c, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], ["hash", "chunk"])


def _members(flags: np.ndarray):
    """The words of the lines whose flag is set: all that are wanted, and a few more that the join drops."""

    def run(batches):
        for b in batches:
            for (docs, hs), texts in by_size(b, ["doc", "h"], most=_SLICE):
                split = [t.split("\n") for t in texts]
                n = np.fromiter(map(len, split), np.int64, len(split))
                of = np.repeat(np.arange(len(n)), n)
                line = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                doc, h = np.array(docs, np.int64)[of], np.array(hs, np.int64)[of]
                f = _flag(doc, h, line)
                at = np.flatnonzero(flags[f >> 3] >> (7 - (f & 7)).astype(np.uint8) & 1)
                if not len(at):
                    continue
                w, own, _, _ = word_hashes([split[i][k] for i, k in zip(of[at].tolist(), line[at].tolist())])
                order = np.lexsort((w, own))
                w, own = w[order], own[order]
                new = np.append(True, (w[1:] != w[:-1]) | (own[1:] != own[:-1])) if len(w) else np.zeros(0, bool)
                w, own = w[new], own[new]
                cut = np.searchsorted(own, np.arange(len(at) + 1))
                sets = [packed(w[a:b]) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(h[at]), pa.array(line[at].astype(np.int32)), pa.array(sets, pa.binary())], ["doc", "h", "line", "words"])

    return run


def _verified(least: float):
    """First lines of the sets for which some earlier set of a word's postings is similar; for each the search ends at the first."""
    columns = ["key", "side", "doc", "h", "line", "words"]

    def run(batches):
        gone: set[tuple] = set()
        for a, starts in whole_runs(batches, columns, ["key"]):
            n = len(a["key"])
            size = np.fromiter(map(len, a["words"]), np.int64, n) // SHORT
            flat = unpacked(b"".join(a["words"]))
            parity = np.bitwise_xor.reduceat(np.uint64(1) << (flat & np.uint64(63)), np.cumsum(size) - size)
            order = np.lexsort((a["line"], a["h"], a["doc"]))
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            at = list(zip(a["doc"].tolist(), a["h"].tolist(), a["line"].tolist()))
            sets: dict[int, frozenset] = {}
            found = []
            for i, j in run_pairs(starts, n, 1 << 17):
                both = size[i] + size[j]
                ok = np.bitwise_count(parity[i] ^ parity[j]) <= both - 2 * _need(both, least / (1 + least))
                ok &= (a["side"][i] == 0) | (a["side"][i] != a["side"][j])
                i, j = i[ok], j[ok]
                late = rank[i] > rank[j]
                for p, q in zip(np.where(late, j, i).tolist(), np.where(late, i, j).tolist()):
                    if at[q] in gone or at[p] == at[q]:
                        continue
                    for x in (p, q):
                        if x not in sets:
                            sets[x] = frozenset(unpacked(a["words"][x]).tolist())
                    shared = len(sets[p] & sets[q])
                    if shared >= least * (len(sets[p]) + len(sets[q]) - shared) - 1e-9:
                        gone.add(at[q])
                        found.append(at[q])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["doc", "h", "line"])
            if len(gone) > 1_000_000:
                gone.clear()

    return run


def _gather(rows: DataFrame, width: int, kind) -> np.ndarray:
    """The chunks of a fixed-size array, collected: at most 2^SKETCH_BITS bytes."""
    out = np.zeros((width // _CHUNK, _CHUNK), kind)
    with shuffles_freed(rows.sparkSession):
        for r in rows.collect():
            out[r["hash"]] = np.frombuffer(r["chunk"], kind)
    return out.ravel()


def removed_lines(documents: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(lines, gone): (doc, h, line) of all lines with words, and of those that an earlier line resembles."""
    spark, n = documents.sparkSession, fan_out(documents.sparkSession)
    docs = _documents(documents)
    first = Staged(docs.mapInArrow(_first, "kind byte, doc long, h long, line int, hash long, more long, chunk binary"), "lines").df
    lines = first.where("kind = 0").select("doc", "h", "line", "hash", "more")
    chunks = first.where("kind = 1").select("hash", "chunk").repartition(n, "hash").sortWithinPartitions("hash")
    levels = _gather(chunks.mapInArrow(_summed, "hash long, chunk binary"), 1 << SKETCH_BITS, np.uint8)
    posts = docs.select("text").mapInArrow(_postings(levels, least, parts_of(spark)), "part int, blob binary")
    likely = Staged(exchanged(posts).mapInArrow(_plausible(least), "key long, hash long, side byte").distinct(), "plausible")
    del posts, chunks
    release(spark)
    reps = Staged(lines.groupBy("hash", "more").agg(F.min(F.struct("doc", "h", "line")).alias("at"), F.count(F.lit(1)).alias("n")).select("hash", "more", "at.doc", "at.h", "at.line", "n"), "reps").df
    wanted = Staged(reps.join(likely.df.select("hash").distinct(), "hash").select("hash", "doc", "h", "line"), "wanted")
    flags = wanted.df.mapInArrow(_flag_rows, "hash long, chunk binary").repartition(n, "hash").mapInArrow(_flags_joined, "hash long, chunk binary")
    members = docs.mapInArrow(_members(_gather(flags, _FLAGS // 8, np.uint8)), "doc long, h long, line int, words binary").dropDuplicates(["doc", "h", "line"])
    members = Staged(members.join(wanted.df, ["doc", "h", "line"]), "members")
    met = likely.df.join(members.df, "hash").repartition(n, "key").sortWithinPartitions("key")
    near = Staged(met.mapInArrow(_verified(least), "doc long, h long, line int").distinct(), "similar").df
    for x in (likely, wanted, members):
        x.drop()
    del flags, met, likely, wanted, members
    release(spark)
    copies = reps.where("n > 1").select("hash", "more", F.col("doc").alias("d0"), F.col("h").alias("h0"), F.col("line").alias("l0"))
    later = lines.join(copies, ["hash", "more"]).where(F.struct("doc", "h", "line") > F.struct(F.col("d0").alias("doc"), F.col("h0").alias("h"), F.col("l0").alias("line"))).select("doc", "h", "line")
    return lines, near.unionByName(later).distinct()


def decisions(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, h, n_lines, removed): for each document its number of lines and the ascending numbers of those removed.

    Null and empty texts have one line without words.  Rows alike in doc_id and text are one document, whose decisions hold
    for each of them; different texts with one doc_id follow each other in a fixed order.
    """
    _, gone = removed_lines(documents, least)
    by_doc = Staged(gone.groupBy("doc", "h").agg(F.sort_array(F.collect_list("line")).alias("removed")), "removed").df
    docs = _documents(documents).select("doc", "h", F.length(F.regexp_replace("text", "[^\n]+", "")).alias("n_"))
    d = docs.join(by_doc, ["doc", "h"], "left")
    return d.select(F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "h", (F.col("n_") + 1).cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents with the removed lines cut from their texts; other columns, n_chars (if there) counted anew.

    Null texts without a removed line stay null; a document may lose all its lines and then has an empty text.  Whole rows
    meet their removed lines in one exchange, in which they travel compressed.
    """
    spark = documents.sparkSession
    _, gone = removed_lines(documents, least)
    tag = uuid.uuid4().hex[:8]  # names that no column of the documents has
    doc, h, less = (f"{c}_{tag}" for c in ("doc", "h", "less"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), h: F.xxhash64(text), "text": F.col("text").cast("string")})
    rows = "part int, kind byte, blob binary"
    sent = gone.mapInArrow(_lines_sent(parts_of(spark)), rows).unionByName(keyed.mapInArrow(_texts_sent(doc, h, parts_of(spark)), rows))
    met = sent.repartition(fan_out(spark), "part").sortWithinPartitions("part", "kind")
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in documents.schema.fields]
    out = met.mapInArrow(_cut_out(doc, h, less), T.StructType([*fields, T.StructField(less, T.BooleanType())]))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(less), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)


def _spread(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = (doc.view(np.uint64) * _MIX ^ h.view(np.uint64)) * _MIX2
    x ^= x >> np.uint64(29)
    return x * _MIX


def _lines_sent(parts: int):
    """Removed lines (kind 0), scattered by document."""

    def run(batches):
        for b in batches:
            a = {c: b.column(c).to_numpy().astype(np.int64) for c in ("doc", "h", "line")}
            sent = scattered(_spread(a["doc"], a["h"]), parts, a)
            yield pa.RecordBatch.from_arrays([sent.column("part"), pa.array(np.zeros(sent.num_rows, np.int8)), sent.column("blob")], ["part", "kind", "blob"])

    return run


def _texts_sent(doc: str, h: str, parts: int):
    """Whole rows (kind 1), scattered in the same way: what a slice has for a part is one compressed Arrow stream."""

    def run(batches):
        small = zstandard.ZstdCompressor(level=3)
        for b in cut(batches, most=_SENT):
            part = ((_spread(b.column(doc).to_numpy(), b.column(h).to_numpy()) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, b = part[order], b.take(pa.array(order))
            edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            blobs = []
            for i, j in zip(edge, edge[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as stream:
                    stream.write_batch(b.slice(i, j - i))
                blobs.append(small.compress(sink.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), pa.array(np.ones(len(blobs), np.int8)), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])

    return run


def _cut_out(doc: str, h: str, less: str):
    """The rows of each part, their texts without the removed lines, and whether any was removed."""

    def run(batches):
        now, gone, whole = None, {}, zstandard.ZstdDecompressor()
        for b in batches:
            for part, kind, blob in zip(b.column("part").to_pylist(), b.column("kind").to_pylist(), b.column("blob")):
                if part != now:
                    now, gone = part, {}
                if kind == 0:
                    for d, x, k in zip(*np.frombuffer(blob.as_buffer(), np.int64).reshape(3, -1).tolist()):
                        gone.setdefault((d, x), set()).add(k)
                    continue
                for rows in pa.ipc.open_stream(whole.decompress(blob.as_buffer())):
                    lost = [gone.get(x) for x in zip(rows.column(doc).to_pylist(), rows.column(h).to_pylist())]
                    texts = rows.column("text").to_pylist()
                    for i, lines in enumerate(lost):
                        if lines:
                            texts[i] = "\n".join(x for k, x in enumerate((texts[i] or "").split("\n")) if k not in lines)
                    names = [c for c in rows.schema.names if c not in (doc, h)]
                    columns = [pa.array(texts, pa.string()) if c == "text" else rows.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(x) for x in lost], pa.bool_())], [*names, less])

    return run


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the removed lines of each document; nulls, empties, ties and repeated rows as in decisions()."""
    d = decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))
