"""Language-model scoring by online logistic context mixing.

A text is its words (A-Z lower-cased, separated by ASCII white space) and an end.  A word is coded in binary decisions along
a code tree whose leaves are the most frequent words and bins of the other words, by their first letters.  Each decision is
predicted from several contexts: none, the last very frequent word, the word before, and the two words before (hashed), each
giving odds from its counts; a mixer adds them on the logistic scale with weights that a gate chooses, the gate being how
much the contexts have seen.  Weights are refined by a Newton step over all training documents, from where a first step
over every 64th of them, by a hash of the text, has brought them, and then online within each document, from its own past, as it is scored.  So a score
depends neither on partitions nor on the order of documents.

A word in a bin is coded by its share of the bin or, unknown, spelled: the bits of its bytes are mixed in the same way from
the one to four bytes before.  Last, the leaves of a phrase, from one content-chosen place to the next, are mixed
with a phrase predictor, which knows the phrases of all training documents by their counts: its weight is the share of
training phrases that occur elsewhere too.  The phrase counts and the vocabulary grow with the corpus and stay in the
cluster; what tasks hold (tree, context counts, frequent words) has a fixed size.

Training documents are scored without the counts that they themselves left in the contexts and phrases, so that a text
that occurs once gets no credit for having been seen, and one that occurs twice does.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Staged, by_size, fan_out, remainder, split_words

#: Words with a leaf of their own, and bins for all others, at most.
LEAF_WORDS, BINS = 6000, 2000
#: Leaves stand in groups of neighbours, which the word contexts predict; so many at most.
GROUPS = 512
#: Contexts: very frequent words and none; hash slots of the word before and of the two before.
ANCHORS, ONE, TWO = 256, 2048, 4096
#: So many of the most frequent words at most are looked up in memory; all others go through a join.
HEAD = 1 << 18
#: Slots of the one, two, three and four bytes before a byte.
SPELL = (256, 2048, 4096, 8192)
#: A phrase ends where the hash of the last three words is a multiple of this.
PHRASE = 16
#: Of the training documents every so many-th, by hash, is in the Newton step of each round; the last round has all of them.
BLOCKS = (64, 1)
#: A document's own weights are refined after so many words, and whenever their number has doubled.
FIRST = 64
_CHUNK = 4096
_ROWS_A = LEAF_WORDS + BINS
_SIZES = (ANCHORS * _ROWS_A, ONE * GROUPS, TWO * GROUPS, sum(SPELL) * 256)
_AT = np.concatenate([[0], np.cumsum(_SIZES)]).tolist()
_TOTAL = -(-_AT[-1] // _CHUNK) * _CHUNK
_END = np.uint64(0x9E3779B97F4A7C15)
_M = np.random.default_rng(55).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
_SPELL_AT = np.concatenate([[0], np.cumsum(SPELL)]).tolist()
_PRIOR = 0.4  # weight of the order-0 odds in those of a context
_KEYS = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M[0]
    return x ^ (x >> np.uint64(29))


class Words:
    """The tokens of a slice of texts, each text's end included: hashes, texts, bytes."""

    def __init__(self, texts: list[str]):
        self.raw, start, end, h, line, lines = split_words(texts)
        text = np.repeat(np.arange(len(texts)), lines)[line]
        n = np.bincount(text, minlength=len(texts)) + 1
        self.ends = np.cumsum(n) - 1  # of each text
        self.begins = self.ends - n + 1
        size = int(n.sum())
        at = np.arange(len(h)) + text
        self.text = np.repeat(np.arange(len(texts)), n)
        self.h = np.full(size, _END)
        self.h[at] = h
        self.start, self.end = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.start[at], self.end[at] = start, end
        self.n = n

    def keys(self, at: np.ndarray) -> np.ndarray:
        """The first letters of the tokens ``at``, as a number of 20 bits; an end has none."""
        start, end, key = self.start[at], self.end[at], np.zeros(len(at), np.int64)
        for k, bits in enumerate((8, 8, 4)):
            b = np.where(start + k < end, self.raw[np.minimum(start + k, max(0, len(self.raw) - 1))], 0).astype(np.int64) if len(self.raw) else key
            b = np.where((b >= 65) & (b <= 90), b + 32, b)
            key = key << bits | (b if bits == 8 else b & 15)
        return key


class Index:
    """64-bit values to their positions, or -1: open addressing, looked up for whole arrays."""

    def __init__(self, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(values)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.values = np.append(values, np.uint64(0))
        mask, at, todo = (1 << self.bits) - 1, self._home(values), np.arange(len(values))
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = todo[free][::-1]
            left = self.slots[at] != todo
            todo, at = todo[left], at[left] + 1 & mask

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h * _M[1] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        mask, at = (1 << self.bits) - 1, self._home(h)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.values[out] != h))
        at = at[open_]
        while len(open_):
            at = at + 1 & mask
            got = self.slots[at]
            out[open_] = got
            more = (got >= 0) & (self.values[got] != h[open_])
            open_, at = open_[more], at[more]
        return out


@dataclass
class Tree:
    """The code tree: leaves in the order of their keys, groups of neighbours, and each leaf's decisions from the root on."""

    index: Index  # of the head words
    head_c: np.ndarray
    head_leaf: np.ndarray
    bin_of: np.ndarray  # of each key
    mass: np.ndarray  # training tokens of each leaf
    unknown: np.ndarray  # of each bin, the share of tokens that are unknown words; 0 for words
    given: np.ndarray  # letters that all words of a bin begin with, two at most
    anchor: np.ndarray
    tokens: int
    types: int
    group: np.ndarray = field(init=False)  # of each leaf
    bounds: np.ndarray = field(init=False)  # (first leaf, first on the right, end) of each decision
    group_bounds: np.ndarray = field(init=False)  # the same in groups, of decisions between groups; the first is no decision
    share: np.ndarray = field(init=False)  # of the left side, by counts alone
    group_share: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)  # of each leaf the first step of its path, and their number
    depth: np.ndarray = field(init=False)
    node: np.ndarray = field(init=False)  # of each step: twice the decision, plus 1 for the right side
    group_node: np.ndarray = field(init=False)
    odds: np.ndarray = field(init=False)

    def __post_init__(self):
        m = self.mass + 0.5
        cum = np.concatenate([[0.0], np.cumsum(m)])
        # groups of about equal mass: a leaf's group is that of its middle, numbered without gaps
        g = np.floor((cum[:-1] + cum[1:]) / 2 / cum[-1] * GROUPS).astype(np.int64)
        self.group = np.cumsum(np.append(0, np.diff(g) != 0))
        edge = np.append(np.flatnonzero(np.append(True, np.diff(self.group) != 0)), len(m))  # first leaf of each group
        paths: list[list[tuple]] = [[] for _ in m]
        bounds, shares, group_bounds, group_shares = [], [], [(0, 0, 0)], [0.5]
        todo = [(0, len(m), 0, len(edge) - 1)]  # leaves and groups
        while todo:
            lo, hi, glo, ghi = todo.pop()
            if hi - lo < 2:
                continue
            half = (cum[lo] + cum[hi]) / 2
            across = ghi - glo > 1
            if across:
                gmid = int(np.abs(cum[edge[glo + 1 : ghi]] - half).argmin()) + glo + 1
                mid = int(edge[gmid])
            else:
                mid = int(np.abs(cum[lo + 1 : hi] - half).argmin()) + lo + 1
            left = (cum[mid] - cum[lo]) / (cum[hi] - cum[lo])
            node, group_node = len(bounds), len(group_bounds) if across else 0
            bounds.append((lo, mid, hi))
            shares.append(left)
            if across:
                group_bounds.append((glo, gmid, ghi))
                group_shares.append(left)
            for a, b, right, share in ((lo, mid, 0, left), (mid, hi, 1, 1 - left)):
                step = (2 * node + right, 2 * group_node + right, np.log(share / (1 - share)))
                for leaf in range(a, b):
                    paths[leaf].append(step)
            todo += [(lo, mid, glo, gmid), (mid, hi, gmid, ghi)] if across else [(lo, mid, glo, ghi), (mid, hi, glo, ghi)]
        self.bounds, self.group_bounds = np.array(bounds, np.int64).reshape(-1, 3), np.array(group_bounds)
        self.share, self.group_share = np.array(shares), np.array(group_shares)
        self.depth = np.array([len(p) for p in paths], np.int32)
        self.first = (np.cumsum(self.depth) - self.depth).astype(np.int32)
        flat = np.array([x for p in paths for x in p], np.float64).reshape(-1, 3)
        self.node, self.group_node, self.odds = flat[:, 0].astype(np.int32), flat[:, 1].astype(np.int32), flat[:, 2].astype(np.float32)

    def leaves(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(head word or -1, leaf) of each token."""
        head = self.index.find(w.h)
        leaf = self.head_leaf[head]
        tail = np.flatnonzero(head < 0)
        leaf[tail] = self.bin_of[w.keys(tail)]
        return head, leaf

    def contexts(self, w: Words, leaf: np.ndarray) -> list[np.ndarray]:
        """The last very frequent word before each token in its text, the word before and the two before, as numbers."""
        n, i = len(leaf), np.arange(len(leaf))
        begin = np.zeros(n, bool)
        begin[w.begins] = True
        anchor = self.anchor[leaf].astype(np.int64)
        before = np.append(0, anchor[:-1])
        before[begin] = 0
        at = np.where((before > 0) | begin, i, 0)
        last = before[np.maximum.accumulate(at)] if n else before
        one = np.append(np.uint64(0), w.h[:-1])
        one[begin] = 0
        two = np.append(np.uint64(0), one[:-1])
        two[begin] = 0
        a = (one * _M[2] >> np.uint64(65 - ONE.bit_length())).astype(np.int64)
        b = (_mix(one * _M[3] + two * _M[4]) >> np.uint64(65 - TWO.bit_length())).astype(np.int64)
        return [last, a, b]

    def phrases(self, w: Words, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first token of each phrase, hash of its leaves); a text's first phrase begins with the text."""
        h = w.h
        three = h.copy()
        three[2:] = _mix(h[2:] * _M[5] + h[1:-1] * _M[6] + h[:-2] * _M[7])
        stop = three % np.uint64(PHRASE) == 0
        stop[1:] &= h[1:] != h[:-1]
        i = np.arange(len(h))
        stop &= i - w.begins[w.text] >= 2
        starts = np.zeros(len(h) + 1, bool)
        starts[1:] = stop
        starts[w.begins] = True
        starts = np.flatnonzero(starts[:-1])
        base = int(_M[2])
        power = np.cumprod(np.append(np.uint64(1), np.full(len(h), np.uint64(base))), dtype=np.uint64)
        inverse = np.cumprod(np.append(np.uint64(1), np.full(len(h), np.uint64(pow(base, -1, 1 << 64)))), dtype=np.uint64)
        total = np.append(np.uint64(0), np.cumsum(_mix((leaf + 1).astype(np.uint64) * _M[3]) * power[:-1], dtype=np.uint64))
        ends = np.append(starts[1:], len(h))
        return starts, _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M[4]) if len(starts) else total[:0]


def _spelled(w: Words, at: np.ndarray):
    """(bytes of the words ``at`` with their closing spaces, word of each, place in it, slots of the one, two and three bytes before)."""
    n = w.end[at] - w.start[at] + 1
    of = np.repeat(np.arange(len(at)), n)
    pos = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    x = w.raw[np.minimum(w.start[at][of] + pos, len(w.raw) - 1)].astype(np.int64)
    x = np.where((x >= 65) & (x <= 90), x + 32, x)
    x[pos == (n - 1)[of]] = 32
    back = [np.where(pos >= k, np.append(np.zeros(k, np.int64), x[:-k])[: len(x)], 0) for k in range(1, len(SPELL) + 1)]
    slots, all_ = [back[0]], back[0].astype(np.uint64)
    for k in range(1, len(SPELL)):
        all_ = all_ | back[k].astype(np.uint64) << np.uint64(8 * k)
        slots.append((_mix(all_ * _M[5]) >> np.uint64(65 - SPELL[k].bit_length())).astype(np.int64))
    return x, of, pos, slots


def _alike(x: np.ndarray, slots: list[np.ndarray]):
    """Of each bit the different decisions of some letters: (bit, letter, slots, how many letters decide just so)."""
    key = slots[0].astype(np.int64)
    for s, size in zip(slots[1:], SPELL[1:]):
        key = key * size + s
    key = np.sort(key << 8 | x)
    for b in range(8 if len(key) else 0):
        short = key >> (7 - b)  # the slots and the letter's bits up to this one
        first = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        left, at = key[first] >> 8, []
        for size in SPELL[:0:-1]:
            at.append(left % size)
            left = left // size
        yield b, key[first] & 255, [left, *at[::-1]], np.diff(np.append(first, len(key))).astype(np.float64)


def _unfamiliar(w: Words, head: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """One token for each different word outside the head among the tokens ``mine``."""
    at = np.flatnonzero((head < 0) & mine & (w.end > w.start))
    _, one = np.unique(w.h[at], return_index=True)
    return at[one]


class Sent:
    """A value sent to the workers once, compressed; each worker process unpacks it once."""

    held: dict = {}

    def __init__(self, spark: SparkSession, value):
        self.name = uuid.uuid4().hex
        self.data = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5)))

    def get(self):
        if self.name not in Sent.held:
            Sent.held.clear()
            Sent.held[self.name] = pickle.loads(zstandard.ZstdDecompressor().decompress(self.data.value))
        return Sent.held[self.name]

    def drop(self) -> None:
        self.data.destroy()


def _counted(sent: Sent):
    """A task's context counts, as (chunk, places in it, counts), and its phrases."""
    names = ["k", "at", "n", "phrase", "times"]

    def run(batches):
        tree, table = sent.get(), np.zeros(_TOTAL, np.int32)
        for b in batches:
            for _, texts in by_size(b, [], most=1 << 20):
                w = Words(texts)
                head, leaf = tree.leaves(w)
                group = tree.group[leaf]
                last, one, two = tree.contexts(w, leaf)
                for k, i in enumerate((last * _ROWS_A + leaf, one * GROUPS + group, two * GROUPS + group)):
                    _add(table[_AT[k] : _AT[k + 1]], i)
                x, _, _, slots = _spelled(w, _unfamiliar(w, head, np.ones(len(head), bool)))
                for s, before in zip(slots, _SPELL_AT):
                    _add(table[_AT[3] : _AT[4]], (s + before) * 256 + x)
                _, phrase = tree.phrases(w, leaf)
                phrase, n = np.unique(phrase, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), *[pa.nulls(len(n), pa.binary())] * 2, pa.array(phrase.view(np.int64)), pa.array(n.astype(np.int64))], names)
        chunks = table.reshape(-1, _CHUNK)
        for part in np.array_split(np.flatnonzero(chunks.any(1)), 16):
            rows = [(int(k), (at := np.flatnonzero(chunks[k])).astype("<u2").tobytes(), chunks[k][at].astype("<u4").tobytes()) for k in part]
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], *[pa.nulls(len(rows), pa.int64())] * 2], names)

    return run


def _add(table: np.ndarray, i: np.ndarray) -> None:
    if len(i) * 4 > len(table):
        table += np.bincount(i, minlength=len(table))
    else:
        v, n = np.unique(i, return_counts=True)
        table[v] += n


def _summed(batches):
    now, total = None, None

    def row():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([total[at].astype("<i8").tobytes()], pa.binary())], ["k", "at", "n"])

    for b in batches:
        for k, at, n in zip(*(b.column(c).to_pylist() for c in ("k", "at", "n"))):
            if k != now:
                if now is not None:
                    yield row()
                now, total = k, np.zeros(_CHUNK, np.int64)
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
    if now is not None:
        yield row()


_LEVELS = 6
#: Gates of the tree: levels of three contexts; of the spelling: levels of four contexts.
_GATES = (_LEVELS**3, _LEVELS ** len(SPELL))
#: Log-odds are kept in steps of 1 / _STEP with the level of their counts above them.
_STEP = 256


def _level(n: np.ndarray) -> np.ndarray:
    """0 to 4 by how much was counted; 5 is for decisions that a context says nothing about."""
    return np.minimum(4, np.log2(np.maximum(n, 0) + 1) * 0.5 + 0.75).astype(np.int64)


def _codes(counts: np.ndarray, bounds: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(2, contexts, decisions * 2): what a context says for each side, with all counts and without one of that side's own."""
    cum = np.zeros((len(counts), counts.shape[1] + 1), np.int64)
    np.cumsum(counts, 1, out=cum[:, 1:])
    out = np.empty((2, len(counts), len(bounds), 2), np.uint16)
    lo, mid, hi = bounds.T
    for at in range(0, len(counts), 64):  # some contexts at a time, for memory
        c = cum[at : at + 64]
        left, right = c[:, mid] - c[:, lo], c[:, hi] - c[:, mid]
        for own in (0, 1):
            for side, taken, other, p in ((0, left, right, share), (1, right, left, 1 - share)):
                n = np.maximum(taken - own, 0)
                x = np.log((n + _PRIOR * p) / (other + _PRIOR * (1 - p)))
                out[own, at : at + 64, :, side] = (_level(n + other) << 13) + np.clip(np.rint(x * _STEP) + 4096, 0, 8191).astype(np.int64)
    none = hi == lo
    out[:, :, none, :] = (5 << 13) + 4096
    return out.reshape(2, len(counts), -1)


class Model:
    """Tree, context counts and weights: scores slices of texts."""

    def __init__(self, tree: Tree, table: np.ndarray):
        self.tree, self.table = tree, table
        self.weights = (np.tile([0.1, 0.6, 0.2, 0.1], (_GATES[0], 1)), np.tile([0.1, 0.2, 0.3, 0.4], (_GATES[1], 1)))

    def __getstate__(self):
        return self.tree, self.table

    def __setstate__(self, state):
        self.__init__(*state)
        self.ready()
        self.table = None

    def ready(self) -> Model:
        """What scoring looks up, made from the counts."""
        t, counts = self.tree, [self.table[_AT[k] : _AT[k + 1]] for k in range(4)]
        self.codes = [_codes(c.reshape(-1, w), b, s) for c, w, b, s in zip(counts, (_ROWS_A, GROUPS, GROUPS), (t.bounds, t.group_bounds, t.group_bounds), (t.share, t.group_share, t.group_share))]
        self.spell = np.zeros((sum(SPELL), 257), np.int64 if self.table.dtype == np.int64 else np.int32)
        np.cumsum(counts[3].reshape(-1, 256), 1, out=self.spell[:, 1:])
        return self

    def decisions(self, w: Words, leaf: np.ndarray, learnt: np.ndarray, order: np.ndarray | None = None):
        """Of every decision: (inputs, signed so that larger favours what was decided; gate), and the decisions of each token.

        ``learnt`` tells which tokens the counts hold; their own are taken out.  Tokens go by ``order``, if there is one.
        """
        t = self.tree
        contexts = t.contexts(w, leaf)
        if order is not None:
            leaf, learnt, contexts = leaf[order], learnt[order], [c[order] for c in contexts]
        n = t.depth[leaf]
        step = np.arange(n.sum()) + np.repeat(t.first[leaf] - (np.cumsum(n) - n), n)
        nodes = (t.node.take(step), t.group_node.take(step))
        xs, gate = [t.odds.take(step)], None
        for codes, context, node in zip(self.codes, contexts, (0, 1, 1)):
            at = np.repeat((learnt * codes.shape[1] + context) * codes.shape[2], n)
            at += nodes[node]
            code = codes.ravel().take(at)
            x = (code & 8191).astype(np.float32)
            x -= 4096
            x *= np.float32(1 / _STEP)
            xs.append(x)
            level = code >> 13
            gate = level if gate is None else gate * np.uint16(_LEVELS) + level
        return xs, gate.astype(np.int64), n

    def letters(self, x: np.ndarray, slots: list[np.ndarray], b: int, own: int):
        """The same (inputs and gates) of the bit ``b`` of letters ``x`` of words that are spelled; ``own`` is what each has counted itself."""
        flat = self.spell.ravel()
        lo = x >> (8 - b) << (8 - b)
        one = x >= lo + (128 >> b)
        xs, gate = [], 0
        for s, before in zip(slots, _SPELL_AT):
            i = (s + before) * 257 + lo
            low, all_ = flat[i + (128 >> b)] - flat[i], flat[i + (256 >> b)] - flat[i]
            taken = np.where(one, all_ - low, low)
            other = all_ - taken
            taken = np.maximum(taken - own, 0)
            xs.append(np.log((taken + 0.1) / (other + 0.1)).astype(np.float32))
            gate = gate * _LEVELS + _level(taken + other)
        return xs, gate

    def spelling(self, w: Words, at: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each of the words ``at`` given its bin, letter by letter.

        The first letters that all words of the bin share are given with it.
        """
        x, of, pos, slots = _spelled(w, at)
        out = np.zeros(len(at))
        open_ = pos >= self.tree.given[self.tree.bin_of[w.keys(at)]][of]
        for b in range(8):
            xs, gate = self.letters(x, slots, b, 0)
            z = sum(x * self.weights[1][gate, i] for i, x in enumerate(xs))
            out -= np.bincount(of, np.log1p(np.exp(-np.clip(z, -30, 30))) * open_, len(at))
        return out

    def path(self, w: Words, leaf: np.ndarray, learnt: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token's leaf; weights move within each text as it goes on.

        After FIRST words, and whenever their number has doubled, a text's own shift of the weights is refined by its
        decisions since the time before.
        """
        pos = np.arange(len(leaf)) - w.begins[w.text]
        part = np.where(pos < FIRST, 0, np.log2(np.maximum(pos, 1) / FIRST).astype(np.int8) + 1).astype(np.int8)
        order = np.argsort(part, kind="stable")  # tokens by part and text, so that each step is one stretch of decisions
        xs, gate, n = self.decisions(w, leaf, learnt, order)
        logs = np.zeros(len(leaf))
        if not len(gate):
            return logs
        z = np.zeros(len(gate), np.float32)
        for x, col in zip(xs, self.weights[0].T.astype(np.float32)):
            z += x * col.take(gate)
        begin = np.cumsum(n) - n  # first decision of each token
        shift, bend = np.zeros((len(w.n), len(xs))), np.full((len(w.n), len(xs)), 200.0)
        text, edge = w.text[order], np.searchsorted(part[order], np.arange(int(part.max()) + 2))
        for s, (lo, hi) in enumerate(zip(edge, edge[1:])):
            runs = lo + np.flatnonzero(np.append(True, np.diff(text[lo:hi]) != 0))  # a text's tokens of this part are neighbours
            texts, first = text[runs], begin[runs]
            at = slice(begin[lo], begin[hi] if hi < len(begin) else len(z))
            size = np.diff(np.append(first, at.stop))
            texts, first, size = texts[size > 0], first[size > 0] - at.start, size[size > 0]
            if s:
                for x, moved in zip(xs, shift[texts].T.astype(np.float32)):
                    z[at] += x[at] * np.repeat(moved, size)
            q = 1 / (1 + np.exp(-np.clip(z[at], -20, 20)))
            z[at] = np.log(q)
            if hi < len(order) and len(first):
                wrong = 1 - q
                curve = q * wrong
                for i, x in enumerate(xs):
                    bend[texts, i] += np.add.reduceat(curve * x[at] * x[at], first) * len(xs)
                    shift[texts, i] += np.add.reduceat(wrong * x[at], first) / bend[texts, i]
        some = n > 0
        logs[order[some]] = np.add.reduceat(z, begin[some], dtype=np.float64)
        return logs

    def learn(self, texts: list[str], out: list) -> None:
        """Adds the slopes and curvatures of all texts' decisions, and of the letters of their less frequent words, to ``out``."""
        w = Words(texts)
        head, leaf = self.tree.leaves(w)
        every = np.ones(len(leaf), bool)
        xs, gate, _ = self.decisions(w, leaf, every)
        self._add_slopes(out[0], self.weights[0], xs, gate)
        x, _, _, slots = _spelled(w, _unfamiliar(w, head, every))
        for b, x, slots, times in _alike(x, slots):
            self._add_slopes(out[1], self.weights[1], *self.letters(x, slots, b, 1), times)

    @staticmethod
    def _add_slopes(out: tuple, weights: np.ndarray, xs: list, gate: np.ndarray, times: np.ndarray | None = None) -> None:
        """Adds decisions, each as many times as ``times`` says, to the slopes and curvatures of their gates."""
        order = np.argsort(gate.astype(np.uint16), kind="stable")  # decisions of a gate are neighbours, and have one set of weights
        x = np.empty((len(xs), len(gate)))
        for i, v in enumerate(xs):
            x[i] = v.take(order)
        if times is not None:
            times = times.take(order)
        edge = np.append(0, np.cumsum(np.bincount(gate, minlength=len(weights))))
        for g in np.flatnonzero(np.diff(edge)):
            v, wt = x[:, edge[g] : edge[g + 1]], weights[g]
            q = v[0] * wt[0]
            for i in range(1, len(v)):
                q += v[i] * wt[i]
            np.clip(q, -20, 20, out=q)
            np.exp(np.negative(q, out=q), out=q)
            q += 1
            np.divide(1, q, out=q)
            wrong = 1 - q
            q *= wrong
            q += 1e-5
            if times is not None:
                n = times[edge[g] : edge[g + 1]]
                wrong *= n
                q *= n
            out[0][g] += np.einsum("in,n->i", v, wrong)
            for i in range(len(v)):
                bent = v[i] * q
                for j in range(i, len(v)):
                    total = np.einsum("n,n->", bent, v[j])
                    out[1][g, i, j] += total
                    if j > i:
                        out[1][g, j, i] += total

    def refined(self, sums: list) -> tuple[np.ndarray, np.ndarray]:
        """Weights after a Newton step from summed slopes and curvatures, rounded, so that the order of sums does not show."""
        out = []
        for w, (slope, curve) in zip(self.weights, sums):
            step = np.linalg.solve(curve + np.eye(w.shape[1]) * 50, slope[:, :, None])[:, :, 0]
            out.append(np.round(w + np.clip(step, -1, 1), 6))
        return tuple(out)


def _empty_sums() -> list:
    return [(np.zeros((g, d)), np.zeros((g, d, d))) for g, d in zip(_GATES, (4, len(SPELL)))]


def _learnt(sent: Sent, weights):
    def run(batches):
        model, sums = sent.get(), _empty_sums()
        model.weights = weights
        for b in batches:
            for _, texts in by_size(b, [], most=1 << 20):
                model.learn(texts, sums)
        out = np.concatenate([x.ravel() for pair in sums for x in pair])
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["i", "v"])

    return run


def _vocabulary(batches):
    """(word, key, c): the words of a task's slices by hash, with their counts."""
    held: list = []

    def merged():
        h, key, c = (np.concatenate(x) for x in zip(*held))
        v, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        return v, key[first], np.bincount(inverse, c, len(v)).astype(np.int64)

    def rows(h, key, c):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key.astype(np.int32)), pa.array(c)], ["word", "key", "c"])

    size = 0
    for b in batches:
        for _, texts in by_size(b, [], most=1 << 20):
            w = Words(texts)
            order = np.argsort(w.h)
            h = w.h[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else order
            held.append((h[new], w.keys(order[new]), np.diff(np.append(new, len(h)))))
            size += len(new)
            if size > 3_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield rows(*held[0])
                    held, size = [], 0
    if held:
        yield rows(*merged())


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, key, c) of rows (text): every word, and the end, by its 64-bit hash, its first letters, and how often it occurs."""
    return texts.mapInArrow(_vocabulary, "word long, key int, c long").groupBy("word").agg(F.min("key").alias("key"), F.sum("c").alias("c"))


def grow(vocab: DataFrame) -> Tree:
    """The code tree of a vocabulary (word, key, c): what reaches the driver are the HEAD words and a row for each key."""
    total = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = vocab.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    word, c, key = (head.column(k).to_numpy().astype(np.int64) for k in ("word", "c", "key"))
    h = word.view(np.uint64)
    if len(head) > LEAF_WORDS:
        edge = int(c[LEAF_WORDS]), int(word[LEAF_WORDS])
        beyond = (F.col("c") < edge[0]) | ((F.col("c") == edge[0]) & (F.col("word") >= edge[1]))
        rest = vocab.where(beyond).groupBy("key").agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    else:
        rest = []
    mass, once = np.zeros(_KEYS), np.zeros(_KEYS)
    for r in rest:
        mass[r["key"]], once[r["key"]] = r["c"], r["once"]
    # bins of about equal mass; every key is in one, so that any word has a leaf
    cum = np.cumsum(mass)
    bins = np.zeros(_KEYS, np.int64) if not cum[-1] else np.minimum((cum - mass / 2) / cum[-1] * BINS, BINS - 1).astype(np.int64)
    bins = np.cumsum(np.append(0, np.diff(bins) != 0))
    n = int(bins[-1]) + 1
    first_key = np.append(0, np.flatnonzero(np.diff(bins)) + 1)
    words = min(len(head), LEAF_WORDS)
    order = np.lexsort((np.append(h[:words], np.zeros(n, np.uint64)), np.append(np.ones(words), np.zeros(n)), np.append(key[:words], first_key)))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    leaf_mass, unknown = np.zeros(len(order)), np.zeros(len(order))
    leaf_mass[place[:words]] = c[:words]
    binned, alone = np.bincount(bins, mass, n), np.bincount(bins, once, n)
    leaf_mass[place[words:]] = binned
    unknown[place[words:]] = (alone + 0.5) / (binned + 1)
    last_key = np.append(first_key[1:], _KEYS) - 1
    given = np.zeros(len(order), np.int64)
    given[place[words:]] = (first_key >> 12 == last_key >> 12).astype(np.int64) + (first_key >> 4 == last_key >> 4)
    anchor = np.zeros(len(order), np.int64)
    anchor[place[: min(words, ANCHORS - 1)]] = np.arange(1, min(words, ANCHORS - 1) + 1)
    leaf = np.append(place[words:][bins][key], 0)
    leaf[:words] = place[:words]
    return Tree(Index(h), np.append(c, 0), leaf, place[words:][bins].astype(np.int16), leaf_mass, unknown, given, anchor, int(total["n"]), int(total["v"]))


def train(texts: DataFrame, vocab: DataFrame) -> tuple[Model, Staged, Sent]:
    """(model, phrase counts (phrase, n), the model as it was sent to the workers) of the training rows (text, h), h being the text's hash."""
    spark, n = texts.sparkSession, fan_out(texts.sparkSession)
    tree = grow(vocab)
    sent = Sent(spark, tree)
    parts = Staged(texts.select("text").mapInArrow(_counted(sent), "k long, at binary, n binary, phrase long, times long"), "counted")
    table = np.zeros((_TOTAL // _CHUNK, _CHUNK), np.int64)
    chunks = parts.df.where("k is not null").select("k", "at", "n").repartition(n, "k").sortWithinPartitions("k")
    for r in chunks.mapInArrow(_summed, "k long, at binary, n binary").toLocalIterator():
        table[r["k"]][np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], "<i8")
    flat = table.ravel()
    model = Model(tree, flat if flat.sum() >= 1 << 31 else flat.astype(np.int32))
    phrases = Staged(parts.df.where("phrase is not null").groupBy("phrase").agg(F.sum("times").alias("n")), "phrases")
    parts.drop()
    sent.drop()
    sent = Sent(spark, model)
    for every in BLOCKS:
        block = texts.where(F.pmod(F.col("h"), F.lit(every)) == 0).select("text")
        sums = _empty_sums()
        flat_sums = [x.reshape(-1) for pair in sums for x in pair]
        edge = np.cumsum([0, *map(len, flat_sums)])
        for r in block.mapInArrow(_learnt(sent, model.weights), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            k = int(np.searchsorted(edge, r["i"], "right")) - 1
            flat_sums[k][r["i"] - edge[k]] = r["v"]
        model.weights = model.refined(sums)
    return model, phrases, sent


_ROWS = "kind byte, rid long, doc_id long, n_tokens long, n_bytes long, known long, base double, logp double, at long, tf long, share double, spelt double"


def _rows(sent: Sent, weights):
    """Of each document a row with what is known here (kind 0), its phrases (1) and its words outside the head (2)."""
    from pyspark import TaskContext

    names = [x.split()[0] for x in _ROWS.split(", ")]
    kinds = [pa.int8(), *[pa.int64()] * 5, pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def batch(n, **cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

    def run(batches):
        model = sent.get()
        model.weights = weights
        t = model.tree
        done = TaskContext.get().partitionId() << 40
        for b in batches:
            for (docs, teaches), texts in by_size(b, ["doc_id", "teaches"], most=1 << 20):
                w = Words(texts)
                m = len(texts)
                rid = done + np.arange(m)
                done += m
                learnt = np.array(teaches, bool)[w.text]
                head, leaf = t.leaves(w)
                logs = model.path(w, leaf, learnt)
                starts, phrase = t.phrases(w, leaf)
                score = np.add.reduceat(logs, starts) if len(starts) else logs
                owner = w.text[starts]
                yield batch(len(starts), kind=np.ones(len(starts), np.int8), rid=rid[owner], logp=score, at=phrase.view(np.int64), tf=learnt[starts].astype(np.int64))
                u, mass = t.unknown[leaf], t.mass[leaf]
                c = t.head_c[head].astype(np.float64)
                binned = u > 0
                within = np.zeros(len(leaf))
                seen = (head >= 0) & binned
                within[seen] = np.log((1 - u[seen]) * c[seen] / mass[seen])
                base = np.where(head >= 0, np.log10((c + 0.1) / (t.tokens + 0.1 * (t.types + 1))), 0.0)
                sums = [np.bincount(w.text, x, m) for x in ((head >= 0).astype(np.float64), base, within)]
                tail = np.flatnonzero(head < 0)
                if len(tail):
                    tail = tail[np.lexsort((w.h[tail], w.text[tail]))]
                    new = np.flatnonzero(np.append(True, (np.diff(w.h[tail]) != 0) | (np.diff(w.text[tail]) != 0)))
                    one = tail[new]
                    tf = np.diff(np.append(new, len(tail)))
                    spelt = np.zeros(len(one))
                    free = np.flatnonzero(~learnt[one])
                    if len(free):
                        spelt[free] = model.spelling(w, one[free])
                    share = (1 - u[one]) / np.maximum(mass[one], 1)
                    yield batch(len(one), kind=np.full(len(one), 2, np.int8), rid=rid[w.text[one]], at=w.h[one].view(np.int64), tf=tf, share=share, spelt=spelt + np.log(np.maximum(u[one], 1e-300)))
                size = np.fromiter((len(x.encode()) for x in texts), np.int64, m)
                yield batch(m, kind=np.zeros(m, np.int8), rid=rid, doc_id=docs, n_tokens=w.n, n_bytes=size, known=sums[0].astype(np.int64), base=sums[1], logp=sums[2])

    return run


def score(documents: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every whole text.

    Null and empty texts are the end alone.  Documents of the held-out fold teach nothing; null doc_ids are in no fold.
    Without any training document N and V are 0 and every word is spelled.  Repeated rows are scored, and learnt from, row
    by row.  Other columns, whatever their names, play no part.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("teaches", remainder("doc_id", folds) != 0)
    known = docs.where("teaches").select("text", F.xxhash64("text").alias("h"))
    vocab = Staged(vocabulary(known.select("text")), "vocabulary")
    model, phrases, sent = train(known, vocab.df)
    tokens, types = model.tree.tokens, model.tree.types
    rows = Staged(docs.mapInArrow(_rows(sent, model.weights), _ROWS), "scored")
    sent.drop()
    of = lambda kind, *cols: rows.df.where(F.col("kind") == kind).select("rid", *cols)

    met = phrases.df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("twice")).first()
    weight, all_ = (met["twice"] + 0.5) / (met["n"] + 1.0), float(max(1, met["n"]))
    copied = of(1, F.col("at").alias("phrase"), "logp", F.col("tf").alias("own")).join(phrases.df.where("n > 0"), "phrase").where("n > own")
    ratio = F.log(F.lit(weight / (1 - weight) / all_) * (F.col("n") - F.col("own"))) - F.col("logp")
    gain = F.when(ratio > 0, ratio + F.log1p(F.exp(-ratio))).otherwise(F.log1p(F.exp(ratio)))
    copied = copied.groupBy("rid").agg(F.sum(gain).alias("gain"))
    written = of(1, "logp").groupBy("rid").agg(F.sum(F.col("logp") + F.lit(float(np.log1p(-weight)))).alias("path"))

    tail = of(2, F.col("at").alias("word"), "tf", "share", "spelt").join(vocab.df.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per = F.when(F.col("c") > 0, F.log(F.col("share") * F.greatest("c", F.lit(1)))).otherwise(F.col("spelt"))
    base = F.log10((F.col("c") + 0.1) / F.lit(max(tokens + 0.1 * (types + 1), 1e-300)))
    tail = tail.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * base).alias("b"), F.sum(F.col("tf") * per).alias("p"))

    d = of(0, "doc_id", "n_tokens", "n_bytes", "known", "base", "logp").join(written, "rid").join(tail, "rid", "left").join(copied, "rid", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = (F.col("logp") + F.col("path") + some("p") + some("gain")) * F.lit(float(1 / np.log(10)))
    d = d.select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "n_tokens", "n_bytes", (F.col("known") + some("k")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + some("b")).alias("base_score"), total.alias("score"))
    return d.withColumn("bits_per_byte", -F.col("score") * F.lit(float(np.log2(10))) / F.greatest(F.col("n_bytes"), F.lit(1)))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls, empties, ties and repeated rows as in score(), an empty table gives no rows."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_bytes")
