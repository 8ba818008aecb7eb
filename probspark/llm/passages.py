"""Substring dedup by MinHash banding of paragraphs that are cut by content.

Passages repeat in the middle of lines, so paragraphs do not follow line ends: a paragraph is ``length`` words from an anchor
on, and an anchor is the smallest five-word shingle hash of some ``window`` consecutive ones.  Anchors depend on the words
around them alone, so any passage of ``length + window`` - 1 words has the same paragraphs wherever it stands: with the
defaults every passage of over 50 words that is repeated word by word is found.

Paragraphs do not cover the texts.  What few words stand between two neighbouring ones that are both repeated goes with
them, and where a run of repeated paragraphs ends it is extended word by word as far as some earlier document with a
paragraph of its cluster goes on alike, ``window`` - 1 words at most.  That covers the whole passage: what a repeated passage
has beyond its last common paragraph or before its first is never longer, as a window of shingles more would have a common
anchor.
"""

from __future__ import annotations

import re
import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import Forest, Staged, by_size, connected, cut, exchanged, fan_out, gathered, parts_of, run_pairs, scattered, word_hashes

SHINGLE = 5
LENGTH, WINDOW = 24, 28
#: Bands of two rows each: a pair at Jaccard 0.8 shares one with probability 1 - (1 - 0.64)^4 = 0.98, equal paragraphs always.
BANDS, ROWS = 4, 2
#: Words to which a repeated paragraph is extended on either side at most.
REACH = WINDOW - 1
#: Paragraphs under one band key beyond this are dealt out in pairs of blocks.
BLOCK = 1024
#: Bits of a band key that hold the parity of the paragraph's shingles.
PARITY = 24
#: Ends of clusters with more occurrences than this are compared prefix by prefix, of which a slice sends each once.
MANY = 4096
_SLICE = 1 << 20
_FLAGS = 1 << 23
_CHUNK = 4096
_M = np.random.default_rng(9).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _documents(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M[62]
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _paragraphs(texts: list[str]):
    """Of a slice of texts: (text of each paragraph, first word, words, shingle hashes as rows padded with the first, content hash,
    first word among the padded words of the slice, these words' hashes)."""
    flat, doc, _, _ = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(n + WINDOW) - (n + WINDOW)
    w = np.zeros(int((n + WINDOW).sum()) + LENGTH + WINDOW, np.uint64)
    at = np.arange(len(flat)) + np.repeat(begin - (np.cumsum(n) - n), n)
    w[at] = flat
    s = np.zeros(len(w) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        s += w[k : len(s) + k] * _M[k]
    s = _mixed(s)
    left = np.zeros(len(s), np.int64)  # words from each position to its text's end
    left[at] = np.repeat(begin + n, n) - at
    owner = np.full(len(s), -1)
    owner[at] = doc
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    edge = np.full(WINDOW - 1, top)
    ranked = np.concatenate([edge, np.where(left >= SHINGLE, s, top), edge])
    low = _sliding(ranked, WINDOW, np.minimum)
    low[_sliding(ranked, WINDOW, np.maximum) == top] = 0  # windows that reach beyond a text choose no anchor
    high = _sliding(low, WINDOW, np.maximum)
    anchor = (s == high[: len(s)]) & (left >= LENGTH)
    anchor[begin[n >= SHINGLE]] = True
    a = np.flatnonzero(anchor)
    size = np.minimum(left[a], LENGTH)
    k = np.arange(LENGTH - SHINGLE + 1)
    rows = np.where(k[None, :] <= (size - SHINGLE)[:, None], s[np.minimum(a[:, None] + k, len(s) - 1)], s[a][:, None])
    content = _mixed((rows * _M[8 : 8 + len(k)]).sum(1, dtype=np.uint64) + size.astype(np.uint64))
    return owner[a], a - begin[owner[a]], size, rows, content, a, (n, w)


def _bands(rows: np.ndarray) -> np.ndarray:
    """Band keys (paragraphs, BANDS): each from ROWS minima of permuted shingle hashes."""
    out = []
    for b in range(BANDS):
        key = np.full(len(rows), b, np.uint64)
        for r in range(ROWS):
            p = rows * _M[40 + b * ROWS + r]
            key = _mixed(key * _M[60] + (p ^ (p >> np.uint64(32))).min(1))
        out.append(key)
    return np.stack(out, 1)


def _parity(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each paragraph one bit of PARITY flipped a shingle: two that share all but d of theirs differ in d bits at most."""
    bit = np.uint64(1) << ((rows * _M[58] >> np.uint64(40)) % np.uint64(PARITY))
    own = np.arange(rows.shape[1])[None, :] <= (size - SHINGLE)[:, None]
    return np.bitwise_xor.reduce(np.where(own, bit, np.uint64(0)), 1)


class Seen:
    """The contents that a task has met, each with its first document."""

    def __init__(self):
        self.content, self.doc, self.told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def find(self, content: np.ndarray) -> np.ndarray:
        """Place of each content, or -1."""
        at = np.searchsorted(self.content, content)
        hit = np.append(self.content, np.uint64(0))[at] == content
        hit &= at < len(self.content)
        return np.where(hit, at, -1)

    def add(self, content: np.ndarray, doc: np.ndarray) -> None:
        if len(content):
            all_ = np.concatenate([self.content, content])
            order = np.argsort(all_, kind="stable")
            self.content, self.doc = all_[order], np.concatenate([self.doc, doc])[order]
            self.told = np.concatenate([self.told, np.zeros(len(content), bool)])[order]


def _banded(parts: int):
    """Each paragraph of a task's texts, once, scattered by its band keys, whose lowest bits are its parity."""

    def run(batches):
        seen = Seen()
        for b in batches:
            for _, texts in by_size(b, [], most=_SLICE):
                _, _, size, rows, content, *_ = _paragraphs(texts)
                content, one = np.unique(content, return_index=True)
                new = seen.find(content) < 0
                content, one = content[new], one[new]
                seen.add(content, np.zeros(len(content), np.int64))
                low = np.uint64((1 << PARITY) - 1)
                band = _bands(rows[one]) & ~low | _parity(rows[one], size[one])[:, None]
                yield scattered(band.ravel(), parts, {"band": band.ravel(), "content": np.repeat(content, BANDS)})

    return run


#: A bit for each hash of a band key under which similar paragraphs may meet, and a byte for how many do: fixed sizes to
#: broadcast.  What a bit lets through by chance is a group without a similar pair, and a byte that is too large deals a
#: group out in more blocks than it needs.
_BAND_BITS, _BAND_SIZES = 26, 20


def _may_meet(least: float):
    """Of a task's band keys those with two contents that may be similar by their parity, and the sizes of large groups, in chunks."""
    most = int((LENGTH - SHINGLE + 1) * 2 * (1 - least) / (1 + least) + 1e-9)  # shingles that a similar pair does not share

    def run(batches):
        bits, sizes = np.zeros((1 << _BAND_BITS) // 8, np.uint8), np.zeros(1 << _BAND_SIZES, np.uint8)

        def mark(f):
            np.bitwise_or.at(bits, f >> 3, np.uint8(128) >> (f & 7).astype(np.uint8))

        for a, _ in gathered(batches, ["band", "content"], "band", PARITY):
            order = np.lexsort((a["content"], a["band"]))  # several tasks may have sent one content
            band, content = a["band"][order], a["content"][order]
            new = np.append(True, (band[1:] != band[:-1]) | (content[1:] != content[:-1]))
            band, content = band[new], content[new]
            key = (band.view(np.uint64) >> np.uint64(PARITY)).view(np.int64)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            length = np.diff(np.append(starts, len(band)))
            small, large = (length > 1) & (length <= BLOCK), length > BLOCK
            at = np.flatnonzero(np.repeat(small, length))
            for i, j in run_pairs(np.cumsum(length[small]) - length[small], len(at), 1 << 17):
                i, j = at[i], at[j]
                ok = np.bitwise_count((band[i] ^ band[j]).view(np.uint64)) <= most  # keys are alike but for the parity
                mark(_band_hash(key[i[ok]], _BAND_BITS))
            hot = _band_hash(key[starts[large]], _BAND_SIZES)
            np.maximum.at(sizes, hot, np.minimum(255, np.ceil(6 * np.log2(length[large]))).astype(np.uint8))
            mark(_band_hash(key[starts[large]], _BAND_BITS))
        chunks = np.concatenate([bits, sizes]).reshape(-1, _CHUNK)
        at = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([chunks[i].tobytes() for i in at], pa.binary())], ["k", "chunk"])

    return run


def _band_hash(key: np.ndarray, bits: int) -> np.ndarray:
    return (key.view(np.uint64) * _M[57] >> np.uint64(64 - bits)).astype(np.int64)


def _widest(batches):
    """The chunks of all tasks in one: bits joined, sizes at their largest."""
    chunks: dict = {}
    edge = (1 << _BAND_BITS) // 8 // _CHUNK
    for b in batches:
        for k, c in zip(b.column("k").to_pylist(), b.column("chunk").to_pylist()):
            c = np.frombuffer(c, np.uint8)
            chunks[k] = c if k not in chunks else chunks[k] | c if k < edge else np.maximum(chunks[k], c)
    yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], ["k", "chunk"])


_WIDE = (LENGTH - SHINGLE + 1 + 1) // 2
_MEETING = ["band", "content", *[f"s{k}" for k in range(_WIDE)]]


def _meeting(flags: np.ndarray, parts: int):
    """Under each band key where similar paragraphs may meet, the paragraphs with their shingles (32 bits of hash each).

    Keys of many paragraphs are dealt out in pairs of blocks; the lowest bits of a key tell a row's side.
    """
    bits, sizes = flags[: (1 << _BAND_BITS) // 8], flags[(1 << _BAND_BITS) // 8 :]

    def run(batches):
        seen = Seen()
        for b in batches:
            for _, texts in by_size(b, [], most=_SLICE):
                _, _, _, rows, content, *_ = _paragraphs(texts)
                content, one = np.unique(content, return_index=True)
                new = seen.find(content) < 0
                content, rows = content[new], rows[one[new]]
                seen.add(content, np.zeros(len(content), np.int64))
                key = (_bands(rows) >> np.uint64(PARITY)).ravel()
                own = np.repeat(np.arange(len(content)), BANDS)
                f = _band_hash(key, _BAND_BITS)
                on = np.flatnonzero(bits[f >> 3] >> (7 - (f & 7)).astype(np.uint8) & 1)
                key, own = key[on], own[on]
                level = sizes[_band_hash(key, _BAND_SIZES)].astype(np.float64)
                nb = np.where(level > 0, np.ceil(np.exp2(level / 6) / BLOCK), 1).astype(np.int64)
                blk = ((content[own] >> np.uint64(20)) % nb.astype(np.uint64)).astype(np.int64)
                many = np.repeat(np.arange(len(nb)), nb)
                other = np.arange(len(many)) - np.repeat(np.cumsum(nb) - nb, nb)
                lo, hi = np.minimum(blk[many], other), np.maximum(blk[many], other)
                side = np.where(lo == hi, 0, 1 + (blk[many] == hi)).astype(np.uint64)
                band = _mixed(key[many] * _M[60] + (lo << 32 | hi).astype(np.uint64)) & ~np.uint64(3) | side
                own = own[many]
                short = (_mixed(rows) >> np.uint64(32)).astype(np.uint32)
                wide = np.concatenate([short, short[:, :1]], 1)[:, : 2 * _WIDE] if short.shape[1] % 2 else short
                wide = np.ascontiguousarray(wide).view(np.uint64)[own]
                yield scattered(band, parts, {"band": band, "content": content[own], **{f"s{k}": wide[:, k] for k in range(_WIDE)}})

    return run


def _shared(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different shingles the rows of x and of y share; ``first`` marks the different ones of x."""
    found = np.zeros(x.shape, bool)
    for k in range(y.shape[1]):
        found |= x == y[:, k : k + 1]
    return (found & first).sum(1)


def _linked(least: float):
    """Links of contents that meet and are similar, as trees."""

    def run(batches):
        for a, _ in gathered(batches, _MEETING, "band", 2):
            order = np.lexsort((a["content"], a["band"]))  # several tasks may have sent one content
            band, content = a["band"][order], a["content"][order]
            new = np.append(True, (band[1:] != band[:-1]) | (content[1:] != content[:-1]))
            band, content, order = band[new], content[new], order[new]
            rows = np.stack([a[c][order] for c in _MEETING[2:]], 1).view(np.uint32)
            by = np.sort(rows, 1)
            size = 1 + (by[:, 1:] != by[:, :-1]).sum(1)
            first = np.ones(rows.shape, bool)
            for k in range(1, rows.shape[1]):
                first[:, k] = (rows[:, :k] != rows[:, k : k + 1]).all(1)
            bit = np.where(first, np.uint64(1) << (rows & np.uint32(63)).astype(np.uint64), np.uint64(0))
            parity = np.bitwise_xor.reduce(bit, 1)
            side, key = band & 3, band >> 2
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            forest = Forest()
            for i, j in run_pairs(starts, len(key), 1 << 15):
                both = size[i] + size[j]
                need = np.ceil(both * least / (1 + least) - 1e-9).astype(np.int64)
                ok = (np.bitwise_count(parity[i] ^ parity[j]) <= both - 2 * need) & ((side[i] == 0) | (side[i] != side[j])) & (content[i] != content[j])
                i, j, need = i[ok], j[ok], need[ok]
                ok = _shared(rows[i], rows[j], first[i]) >= need
                for x, y in zip(content[i[ok]].tolist(), content[j[ok]].tolist()):
                    forest.join(x, y)
            links = forest.links()
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


#: What an occurrence is sent for: the task's first of its content, to be kept if others tell of another document; a word
#: that there is another document; or one that is known to be repeated.
FIRST, TOLD, KNOWN = 0, 1, 2


def _occurring(parts: int):
    """Each paragraph's occurrences: document, text, and place: first word, number in the text and length in one number.

    The first of a task goes to its content's part, and so does one word if another document of the task has it too; all
    further ones are known to be repeated and go anywhere.  So of a paragraph that is everywhere a part gets two rows a task.
    """

    def run(batches):
        seen = Seen()
        for b in batches:
            for (docs, hs), texts in by_size(b, ["doc", "h"], most=_SLICE):
                owner, pos, size, _, content, *_ = _paragraphs(texts)
                begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
                number = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
                doc, h = np.array(docs, np.int64)[owner], np.array(hs, np.int64)[owner]
                _, one = np.unique(content, return_index=True)
                one = one[seen.find(content[one]) < 0]
                kind = np.full(len(content), KNOWN)
                kind[one] = FIRST
                seen.add(content[one], doc[one])
                at = seen.find(content)
                other = np.flatnonzero((seen.doc[at] != doc) & ~seen.told[at])
                _, some = np.unique(content[other], return_index=True)
                other = other[some]
                seen.told[at[other]] = True
                row = np.concatenate([np.arange(len(content)), other])
                kind = np.concatenate([kind, np.full(len(other), TOLD)])
                spread = _mixed(content[row]) + np.where(kind == KNOWN, _mixed(h[row].view(np.uint64)), np.uint64(0))
                yield scattered(_mixed(spread), parts, {"content": content[row], "doc": doc[row], "h": h[row], "at": kind << 62 | pos[row] << 32 | number[row] << 8 | size[row]})

    return run


def _repeated(flags: np.ndarray):
    """The occurrences of contents in two documents or more, or whose flag is set (all that are similar to others, and a few more)."""
    names = ["content", "doc", "h", "at"]

    def run(batches):
        for a, _ in gathered(batches, names, "content"):
            kind = a["at"] >> 62 & 3
            a["at"] &= (1 << 62) - 1
            own = kind != KNOWN
            starts = np.flatnonzero(np.append(True, np.diff(a["content"][own]) != 0)) if own.any() else np.zeros(0, np.int64)
            keep = kind == KNOWN
            if len(starts):
                doc, content = a["doc"][own], a["content"][own]
                many = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
                f = (content[starts].view(np.uint64) % np.uint64(_FLAGS)).astype(np.int64)
                many |= (flags[f >> 3] >> (7 - (f & 7)).astype(np.uint8) & 1).astype(bool)
                keep[own] = np.repeat(many, np.diff(np.append(starts, len(doc)))) & (kind[own] == FIRST)
            yield pa.RecordBatch.from_arrays([pa.array(a[c][keep]) for c in names], names)

    return run


def _some(flags: np.ndarray):
    """The texts whose flag is set."""

    def run(batches):
        for b in batches:
            f = (b.column("h").to_numpy().view(np.uint64) % np.uint64(_FLAGS)).astype(np.int64)
            yield b.filter(pa.array((flags[f >> 3] >> (7 - (f & 7)).astype(np.uint8) & 1).astype(bool)))

    return run


_CHAIN = (REACH + 1) // 2
_AROUND = ["key", "doc", "h", "at", *[f"c{k}" for k in range(_CHAIN)]]
_NODES = ["key", "doc", "h", "at"]


def _around(wanted: str, parts: int):
    """The words beyond each wanted end, as 32-bit hashes of the first one, two, ... of them, scattered by cluster, side and first word.

    ``wanted`` is the column of a text's ends (place, side, cluster, pos, many).  Ends of clusters that are everywhere (many)
    have parts of their own, from ``parts`` on, see _nodes().
    """

    def run(batches):
        for b in batches:
            for (docs, hs, ends), texts in by_size(b, ["doc", "h", wanted], most=_SLICE):
                w, of, _, _ = word_hashes(texts)
                begin = np.searchsorted(of, np.arange(len(texts) + 1))
                n = np.fromiter(map(len, ends), np.int64, len(ends))
                text = np.repeat(np.arange(len(texts)), n)
                flat = [e for x in ends for e in x]
                at, side, cluster, pos, many = (np.array([e[c] for e in flat], np.int64) for c in ("at", "side", "cluster", "pos", "many"))
                left = np.where(side == 1, begin[text + 1] - begin[text] - at, at)
                some = np.flatnonzero(left > 0)
                if not len(some):
                    continue
                text, at, side, cluster, pos, many, left = (x[some] for x in (text, at, side, cluster, pos, many, left))
                k = np.arange(2 * _CHAIN)
                doc, h = np.array(docs, np.int64)[text], np.array(hs, np.int64)[text]
                for own in np.array_split(np.arange(len(at)), -(-len(at) // _ENDS)):
                    reach = np.minimum(left[own], REACH)
                    place = begin[text[own]][:, None] + np.where(side[own][:, None] == 1, at[own][:, None] + k, at[own][:, None] - 1 - k)
                    x = np.where(k < reach[:, None], w[np.clip(place, 0, len(w) - 1)], np.uint64(0))
                    chain = np.cumsum(x * _M[: len(k)], 1, dtype=np.uint64)
                    start = _mixed(cluster[own].view(np.uint64) * _M[61] + side[own].astype(np.uint64))
                    all_ = many[own] > 0
                    few = np.flatnonzero(~all_)
                    if len(few):
                        key = _mixed(start[few] + x[few, 0])
                        short = (_mixed(chain[few]) >> np.uint64(32)).astype(np.uint32)
                        short[k >= reach[few][:, None]] = 0  # no word: 0 is never met with another's
                        wide = np.ascontiguousarray(short).view(np.uint64)
                        at_ = pos[own[few]] << 1 | side[own[few]]
                        yield scattered(key, parts, {"key": key, "doc": doc[own[few]], "h": h[own[few]], "at": at_, **{f"c{i}": wide[:, i] for i in range(_CHAIN)}})
                    all_ = np.flatnonzero(all_)
                    if len(all_):
                        yield _nodes(start[all_], chain[all_], reach[all_], doc[own[all_]], h[own[all_]], pos[own[all_]] << 1 | side[own[all_]], parts)

    return run


#: Ends of a slice that are looked at together, for memory.
_ENDS = 1 << 15


def _nodes(start: np.ndarray, chain: np.ndarray, reach: np.ndarray, doc: np.ndarray, h: np.ndarray, at: np.ndarray, parts: int) -> pa.RecordBatch:
    """Of ends of frequent clusters the prefixes of the words beyond them that no earlier document here has, and what is known here.

    A prefix is sent for the smallest document with it alone: for the others the answer is known, and so it is for all
    shorter ones, as whoever has a prefix has these too.  So one that is everywhere is a row or so a slice.
    """
    told = np.zeros(len(doc), np.int64)  # words that an earlier document here has too
    key, end, words = [], [], []
    live = np.arange(len(doc))
    for r in range(REACH):
        live = live[reach[live] > r]
        if not len(live):
            break
        node = _mixed(start[live] + _mixed(chain[live, r] + np.uint64(r)))
        order = np.lexsort((doc[live], node))
        live, node = live[order], node[order]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        least = np.repeat(doc[live[first]], np.diff(np.append(first, len(live))))
        later = doc[live] > least
        told[live[later]] = r + 1
        key.append(node[~later])
        end.append(live[~later])
        words.append(np.full(len(key[-1]), r + 1))
    known = np.flatnonzero(told)
    key = np.concatenate([*key, _mixed(h[known].view(np.uint64) + at[known].astype(np.uint64) * _M[60])])
    row = np.concatenate([*end, known])
    what = at[row] << 8 | np.concatenate([*words, told[known]]) << 1
    what[len(row) - len(known) :] |= 1
    out = scattered(key, parts, {"key": key, "doc": doc[row], "h": h[row], "at": what})
    part = pa.array(out.column("part").to_numpy() + np.int32(parts))
    return pa.RecordBatch.from_arrays([part, out.column("blob")], ["part", "blob"])


_REACH = ["doc", "h", "pos", "side", "reach"]


def _reached(doc: np.ndarray, h: np.ndarray, at: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array(at >> 1), pa.array((at & 1).astype(np.int8)), pa.array(reach.astype(np.int32))], _REACH)


def _reaching(parts: int):
    """How many words of each end's an earlier document of its cluster has too, if any: (doc, h, pos, side, reach).

    An end of a frequent cluster may have several rows, of which the largest reach holds.
    """

    def halves(batches):
        for b in batches:
            at = int(np.searchsorted(b.column("part").to_numpy(), parts))
            yield from ((k, x) for k, x in enumerate((b.slice(0, at), b.slice(at))) if x.num_rows)

    def run(batches):
        for many, group in groupby(halves(batches), lambda x: x[0]):  # rows are sorted by part
            yield from (_by_nodes if many else _by_chains)(b for _, b in group)

    return run


def _by_nodes(batches):
    for a, starts in gathered(batches, _NODES, "key"):
        known = a["at"] & 1 > 0
        doc = np.where(known, np.iinfo(np.int64).max, a["doc"])
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc))))
        at = np.flatnonzero(known | (a["doc"] > least))
        yield _reached(a["doc"][at], a["h"][at], a["at"][at] >> 8, a["at"][at] >> 1 & 127)


def _by_chains(batches):
    for a, starts in gathered(batches, _AROUND, "key"):
        chain = np.stack([a.pop(c) for c in _AROUND[4:]], 1).view(np.uint32)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(a["doc"]))))
        doc, out, live = a["doc"], np.zeros(len(run), np.int32), np.arange(len(run))
        for r in range(REACH):
            live = live[chain[live, r] != 0]
            if not len(live):
                break
            live = live[np.lexsort((chain[live, r], run[live]))]
            start = np.flatnonzero(np.append(True, (np.diff(run[live]) != 0) | (np.diff(chain[live, r]) != 0)))
            first, last = np.minimum.reduceat(doc[live], start), np.maximum.reduceat(doc[live], start)
            size = np.diff(np.append(start, len(live)))
            out[live[doc[live] > np.repeat(first, size)]] = r + 1
            live = live[np.repeat(first < last, size)]
        at = np.flatnonzero(out)
        yield _reached(doc[at], a["h"][at], a["at"][at], out[at])


def _flag_rows(batches):
    bits = np.zeros(_FLAGS, bool)
    for b in batches:
        bits[b.column("f").to_numpy()] = True
    chunks = np.packbits(bits).reshape(-1, _CHUNK)
    at = np.flatnonzero(chunks.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([chunks[i].tobytes() for i in at], pa.binary())], ["k", "chunk"])


def _joined(batches):
    chunks: dict = {}
    for b in batches:
        for k, c in zip(b.column("k").to_pylist(), b.column("chunk").to_pylist()):
            chunks[k] = chunks.get(k, 0) | np.frombuffer(c, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int64()), pa.array([c.tobytes() for c in chunks.values()], pa.binary())], ["k", "chunk"])


def _flags(contents: DataFrame) -> np.ndarray:
    """A fixed-size bit set (1 MB) of content hashes: what it lets through is a superset, and an exact join follows."""
    f = contents.select(F.col("content").bitwiseAND(F.lit(_FLAGS - 1)).alias("f"))
    chunks = f.mapInArrow(_flag_rows, "k long, chunk binary").repartition(fan_out(contents.sparkSession), "k").mapInArrow(_joined, "k long, chunk binary")
    out = np.zeros((_FLAGS // 8 // _CHUNK, _CHUNK), np.uint8)
    for r in chunks.collect():
        out[r["k"]] = np.frombuffer(r["chunk"], np.uint8)
    return out.ravel()


def clusters(documents: DataFrame, least: float = 0.8) -> Staged:
    """(node, component): paragraphs by content that are similar to others, and their components."""
    spark = documents.sparkSession
    n, docs = fan_out(spark), _documents(documents)
    bands = exchanged(docs.select("text").mapInArrow(_banded(parts_of(spark)), "part int, blob binary"))
    chunks = bands.mapInArrow(_may_meet(least), "k long, chunk binary").repartition(n, "k").mapInArrow(_widest, "k long, chunk binary")
    flags = np.zeros((((1 << _BAND_BITS) // 8 + (1 << _BAND_SIZES)) // _CHUNK, _CHUNK), np.uint8)
    for r in chunks.toLocalIterator():
        flags[r["k"]] = np.frombuffer(r["chunk"], np.uint8)
    met = exchanged(docs.select("text").mapInArrow(_meeting(flags.ravel(), parts_of(spark)), "part int, blob binary"))
    return connected(met.mapInArrow(_linked(least), "a long, b long"), "a", "b")


def occurrences(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc, h, pos, n, cluster, first_doc, a, b): every paragraph of a cluster that occurs in two documents or more.

    Clusters are the components of paragraphs that are equal or have a Jaccard similarity of ``least`` or more over their
    five-word shingles; ``first_doc`` is the smallest doc_id with one.  Repeats within a document alone are left alone.
    Texts of fewer than five words have no paragraph; those of fewer words than a paragraph are one.  Rows with one doc_id
    are one document here, h (the text's hash) tells their texts apart; null doc_ids are the smallest long.  Words a to b are
    the paragraph, what stands between it and a repeated neighbour, and at the ends of a run of repeated paragraphs what an
    earlier document with one of the cluster has too, word by word.
    """
    spark = documents.sparkSession
    docs = _documents(documents)
    comp = clusters(documents, least).df
    flags = _flags(comp.select(F.col("node").alias("content")))
    found = exchanged(docs.mapInArrow(_occurring(parts_of(spark)), "part int, blob binary")).mapInArrow(_repeated(flags), "content long, doc long, h long, at long")
    place = [F.shiftright("at", 32).alias("pos"), F.shiftright("at", 8).bitwiseAND((1 << 24) - 1).alias("number"), F.col("at").bitwiseAND(255).alias("n")]
    found = Staged(found.distinct().select("content", "doc", "h", *place), "occurring")
    equal = found.df.groupBy("content").agg(F.min("doc").alias("equal_doc"))
    named = equal.join(comp.withColumnRenamed("node", "content"), "content", "left").select("content", "equal_doc", F.coalesce("component", "content").alias("cluster"))
    named = Staged(named, "named")  # so that the join can split a content with most of the occurrences
    found = Staged(found.df.join(named.df, "content").drop("content"), "found")
    whole = found.df.groupBy("cluster").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), (F.count(F.lit(1)) > MANY).cast("byte").alias("many")).where("first_doc < last_doc").drop("last_doc")
    text, later = Window.partitionBy("doc", "h").orderBy("number"), F.col("doc") > F.col("first_doc")
    # a neighbour that an earlier document has word by word ends where it ends there; one that is similar may hang over
    equal = F.when(F.col("doc") > F.col("equal_doc"), F.col("number"))
    whole = Staged(whole, "whole")  # for the same reason
    rows = found.df.join(whole.df, "cluster").withColumns({
        "before": F.when(F.lag(equal).over(text) == F.col("number") - 1, F.lag(F.col("pos") + F.col("n")).over(text)),
        "after": F.when(F.lead(equal).over(text) == F.col("number") + 1, F.lead("pos").over(text)),
    })
    rows = Staged(rows, "repeated")
    found.drop()
    # clusters at the ends of runs in later documents, and for those the words around all their occurrences
    ends = [rows.df.where(later & F.col(c).isNull()).select("cluster", F.lit(side).cast("byte").alias("side")) for side, c in enumerate(("before", "after"))]
    ends = Staged(ends[0].unionByName(ends[1]).distinct(), "ends").df
    at = F.when(F.col("side") == 0, F.col("pos")).otherwise(F.col("pos") + F.col("n"))
    wanted = rows.df.join(ends, "cluster").groupBy("doc", "h").agg(F.collect_list(F.struct(at.cast("int").alias("at"), "side", "cluster", "pos", "many")).alias("ends"))
    wanted = Staged(wanted, "wanted")
    some = docs.mapInArrow(_some(_flags(wanted.df.select(F.col("h").alias("content")))), docs.schema)  # most texts need no shuffle
    around = some.join(wanted.df, ["doc", "h"])
    keys = exchanged(around.mapInArrow(_around("ends", parts_of(spark)), "part int, blob binary"))
    reach = keys.mapInArrow(_reaching(parts_of(spark)), "doc long, h long, pos long, side byte, reach int").groupBy("doc", "h", "pos")
    reach = reach.agg(F.max(F.when(F.col("side") == 0, F.col("reach"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("reach"))).alias("right"))
    reach = Staged(reach, "reach").df
    wanted.drop()
    out = rows.df.join(reach, ["doc", "h", "pos"], "left")
    a = F.when(F.col("before").isNull(), F.col("pos") - F.coalesce("left", F.lit(0))).otherwise(F.col("pos"))
    b = F.when(F.col("after").isNull(), F.col("pos") + F.col("n") + F.coalesce("right", F.lit(0))).otherwise(F.greatest("after", F.col("pos") + F.col("n")))
    return out.select("doc", "h", F.col("pos").cast("int").alias("pos"), F.col("n").cast("int").alias("n"), "cluster", "first_doc", a.cast("int").alias("a"), b.cast("int").alias("b"))


def repeats(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, h, n_repeated, n_removed, spans, first_doc_id): a row for each text that holds a repeated paragraph.

    A paragraph goes, with the repeated words around it, unless the document is the first of its cluster; n_removed counts
    the paragraphs that go.  ``spans`` are the removals as half-open ranges of
    words, merged; ``first_doc_id`` is the smallest doc_id that shares a cluster with the document.  Documents without
    repeats have no row.
    """
    o = occurrences(documents, least)
    later = F.col("doc") > F.col("first_doc")
    spans = F.sort_array(F.collect_set(F.when(later, F.struct("a", "b"))))
    g = o.groupBy("doc", "h").agg(F.size(F.collect_set("pos")).cast("long").alias("n_repeated"), F.size(F.collect_set(F.when(later, F.col("pos")))).cast("long").alias("n_removed"), F.min("first_doc").alias("first_doc"), spans.alias("raw"))
    start = F.array().cast("array<struct<a:int,b:int>>")

    def fold(acc, x):
        top = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["a"].alias("a"), F.greatest(top["b"], x["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= x["a"]), joined).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate("raw", start, fold)
    back = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return g.select(back("doc").alias("doc_id"), "h", "n_repeated", "n_removed", merged.alias("spans"), back("first_doc").alias("first_doc_id"))


def _without(column: str):
    word = re.compile("[^ \t\n\r\x0b\x0c]+")

    def run(batches):
        for b in cut(batches):
            texts = b.column("text").to_pylist()
            for i, spans in enumerate(b.column(column).to_pylist()):
                if spans:
                    at = [m.span() for m in word.finditer(texts[i])]
                    out, done = [], 0
                    for s in spans:
                        out.append(texts[i][done : at[s["a"]][0]])
                        done = at[s["b"] - 1][1]
                    texts[i] = "".join([*out, texts[i][done:]])
            names = [c for c in b.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names)

    return run


def remove_repeats(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents without the words of later occurrences; other columns as they are."""
    tag = uuid.uuid4().hex[:8]  # names that no column of the documents has
    doc, h, spans = (f"{c}_{tag}" for c in ("doc", "h", "spans"))
    r = repeats(documents, least).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(doc), F.col("h").alias(h), F.col("spans").alias(spans))
    keyed = documents.withColumn("text", F.col("text").cast("string")).withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), h: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    d = keyed.join(r, [doc, h], "left").select(*documents.columns, spans)
    return d.mapInArrow(_without(spans), d.drop(spans).schema)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and removed words of each document that has any; nulls, empties and repeated rows as in occurrences()."""
    r = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["a"].cast("string"), s["b"].cast("string"))), ",")
    return r.select("doc_id", "first_doc_id", "n_repeated", "n_removed", spans.alias("removed_words"))
