"""Token ids in a binary format: blocks of separately compressed documents over one shared zstandard dictionary.

A block is ``magic | version | id width | dictionary hash | documents | frame offsets | doc ids | token counts | frames``
(little-endian).  Each document is a zstandard frame of its own, so that a short document is read by one seek through the
offset index and one small decompression; the shared dictionary makes up for the short frames.  Blocks are rows of a
Parquet table in ascending doc_id order, written by Spark, so any store that Spark can write works and a lost executor's
blocks are written again.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Staged, fan_out, hashed_spans

MAGIC = b"PSTOKENS"
VERSION = 1
#: Uncompressed bytes of ids after which a block is closed.
BLOCK_BYTES = 4 << 20
#: The dictionary is trained on so many documents at most, each at most this long; it changes sizes, never contents.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 20_000, 64 << 10

_HEAD = struct.Struct("<8sHH8sI")
#: White space other than the space and the line feed.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words that a worker remembers at most; fewer cost time only.
_MEMORY = 1 << 20
_MIX = np.random.default_rng(1).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_loaded: dict = {}
#: Signs that are neither letters, digits, white space nor the pattern's apostrophe, and ASCII letters.
_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Memory:
    """Words and their ids: hashes in an open-addressed table, ids in one long array.

    A word is known by 64 bits of hash and another 56 of its length and three of its bytes, so that no two are ever taken
    for each other in practice.  When full, words that were not met again go.
    """

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self._fill(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))

    def _fill(self, h, check, at, size, ids, room: int = 0) -> None:
        room = 1 << (max(room, _MEMORY) - 1).bit_length()
        self.n, self.used = len(h), len(ids)
        self.h, self.check, self.at, self.size = (np.zeros(room, x.dtype) for x in (h, check, at, size))
        for own, x in ((self.h, h), (self.check, check), (self.at, at), (self.size, size)):
            own[: len(x)] = x
        self.again = np.zeros(room, bool)
        self.ids = np.concatenate([ids, np.zeros(room, self.kind)])
        self.slots = np.full(4 * room, -1, np.int32)
        self._place(np.arange(self.n))

    def _home(self, h):
        return (h * _MIX[0] >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _place(self, todo) -> None:
        mask, at = len(self.slots) - 1, self._home(self.h[todo])
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], at[left] + 1 & mask

    def find(self, h, check) -> np.ndarray:
        """Number of each word, or -1."""
        mask, at = len(self.slots) - 1, self._home(h)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & ((self.h[out] != h) | (self.check[out] != check)))
        at = at[open_]
        while len(open_):
            at = at + 1 & mask
            got = self.slots[at]
            out[open_] = got
            more = (got >= 0) & ((self.h[got] != h[open_]) | (self.check[got] != check[open_]))
            open_, at = open_[more], at[more]
        return out

    def room(self, n: int) -> None:
        """Make place for n words more."""
        if self.n + n > len(self.h):
            keep = np.flatnonzero(self.again[: self.n])
            if len(keep) > _MEMORY // 2:
                keep = keep[:0]
            size = self.size[keep]
            src = np.arange(size.sum()) + np.repeat(self.at[keep] - (np.cumsum(size) - size), size)
            self._fill(self.h[keep], self.check[keep], np.cumsum(size) - size, size, self.ids[src], max(_MEMORY, 2 * (len(keep) + n)))

    def add(self, h, check, ids: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(ids), self.kind)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), self.kind)])
        new = slice(self.n, self.n + len(ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.h[new], self.check[new], self.size[new] = h, check, size
        self.at[new] = self.used + np.cumsum(size) - size
        self.used, self.n = self.used + len(flat), self.n + len(ids)
        self._place(np.arange(new.start, new.stop))


class Encoder:
    """Whole-text encoding with a tokenizer file of the tokenizers library, remembering the ids of words.

    Single spaces and line feeds between other characters always start a new pre-token of the byte-level pattern: a space
    goes with the word after it, a line feed is one of its own.  So a text is encoded word by word there; texts with other
    white space, runs or ends of it, or special-token strings are encoded whole.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # a word comes here once, so the library need not remember it as well
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for p, i in vocabulary.items() if p[0] == "\u0120"]] = True  # how byte-level vocabularies write a space
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.memory = Memory(self.kind)

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat, size, at, out = np.array(list(chain.from_iterable(ids)), self.kind).tobytes(), self.kind.itemsize, 0, []
        for x in ids:
            to = at + size * len(x)
            out.append(flat[at:to])
            at = to
        return out

    def _encode_words(self, words: list[str], spaced: bool) -> list[bytes]:
        """Ids of each word with a space before it, or without.  Many words are encoded as one text: their first ids, or line feeds, divide it."""
        out, size = [], self.kind.itemsize
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            text = " " + " ".join(part) if spaced else "\n".join(["", *part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            starts = np.flatnonzero(self.spaced[ids] if spaced else ids == self.feed)
            if len(starts) != len(part):
                out += self._encode([" " + w for w in part] if spaced else part)
                continue
            raw, edge = ids.tobytes(), [*(starts * size).tolist(), len(ids) * size]
            skip = 0 if spaced else size
            out += [raw[a + skip : b] for a, b in zip(edge, edge[1:])]
        return out

    def _regular(self, t: str) -> bool:
        return bool(t) and not (t[0].isspace() or t[-1].isspace() or "  " in t or " \n" in t or "\n " in t or "\n\n" in t or "<|" in t or _RARE.search(t))

    def batch(self, texts: list[str], end: bytes) -> list[bytes]:
        """The ids of each text, followed by ``end``, as bytes."""
        regular = [self.feed is not None and self._regular(t) for t in texts]
        whole = iter(self._encode([t for t, ok in zip(texts, regular) if not ok]))
        known = iter(self._by_words([t for t, ok in zip(texts, regular) if ok], end))
        return [next(known) if ok else next(whole) + end for ok in regular]

    def _by_words(self, texts: list[str], end: bytes) -> list[bytes]:
        if not texts:
            return []
        raw = [t.encode() for t in texts]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        x = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        gap = (x == 32) | (x == 10)
        stop = np.flatnonzero(gap)
        start = np.append(0, stop[:-1] + 1)
        spaced = np.append(False, x[stop[:-1]] == 32)
        last = np.zeros(len(stop), bool)
        last[np.searchsorted(stop, np.cumsum(lengths + 1) - 1)] = True
        feed = ~spaced & np.append(False, ~last[:-1])  # a line feed within a text
        # a sign after a letter is a pre-token of its own, and the word alone is met more often
        before = x[np.maximum(stop - 2, 0)]
        accent = (x[np.maximum(stop - 3, 0)] == 0xC3) & (before >= 128) & (before != 0x97) & (before != 0xB7) & (stop - start > 2)
        sign = _SIGN[x[stop - 1]] & (_LETTER[before] & (stop - start > 1) | accent)
        of = np.repeat(np.arange(len(stop)), 1 + sign)
        second = np.append(False, of[1:] == of[:-1])
        start, stop = np.where(second, stop[of] - 1, start[of]), stop[of] - (sign[of] & ~second)
        spaced, feed, last = spaced[of] & ~second, feed[of] & ~second, last[of] & (second | ~sign[of])
        h = hashed_spans(x, start, stop) * np.where(spaced, _MIX[1], _MIX[2])
        h ^= h >> np.uint64(32)
        byte = lambda i: x[i].astype(np.int64)
        check = (stop - start) << 24 | byte(start) << 16 | byte(start + stop >> 1) << 8 | byte(stop - 1)
        m = self.memory
        at = m.find(h, check)
        m.again[at[at >= 0]] = True
        view = None
        while len(new := np.flatnonzero(at < 0)):  # again if the memory has let some go to make room
            _, one = np.unique(h[new], return_index=True)
            one = new[one]
            m.room(len(one))
            view = view or x.tobytes()
            for flag in (True, False):
                part = one[spaced[one] == flag]
                if len(part):
                    found = [view[a:b].decode() for a, b in zip(start[part].tolist(), stop[part].tolist())]
                    m.add(h[part], check[part], self._encode_words(found, flag))
            at = m.find(h, check)
        size = m.size[at]
        total = size + feed + last
        to = np.cumsum(total)
        begin = to - total + feed
        out = np.empty(to[-1], self.kind)
        out[begin[feed] - 1] = self.feed
        out[to[last] - 1] = np.frombuffer(end, self.kind)[0]
        step = np.arange(size.sum())
        shift = np.cumsum(size) - size
        out[step + np.repeat(begin - shift, size)] = m.ids[step + np.repeat(m.at[at] - shift, size)]
        flat, width = out.tobytes(), self.kind.itemsize
        edge = [0, *(to[last] * width).tolist()]
        return [flat[a:b] for a, b in zip(edge, edge[1:])]


def _encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _loaded:
        _loaded[path, width] = Encoder(path, width)
    return _loaded[path, width]


def id_width(path: str) -> int:
    """2 bytes an id where the vocabulary allows it, else 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def train_dictionary(documents: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """Shared dictionary from the serialized ids of a bounded sample: the SAMPLE_DOCS texts of up to SAMPLE_CHARS characters with the smallest hashes.

    Where samples are too few or too alike to train on, they are the dictionary as they are; without any it is end ids alone.
    """
    end = end_id.to_bytes(width, "little")
    # the hashes first: of each task only so many longs reach the driver, and then the texts of the chosen alone
    short = documents.select(F.xxhash64("doc_id").alias("h"), "text").where(f"length(text) between 1 and {SAMPLE_CHARS}")
    least = short.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if least is None:
        return end * 16
    texts = [r["text"] for r in short.where(F.col("h") <= least).orderBy("h", "text").limit(SAMPLE_DOCS).collect()]
    samples = _encoder(path, width).batch(texts, end)
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return (end * 16 + b"".join(samples))[-DICTIONARY_BYTES:]


def write_block(docs: list[tuple[int | None, bytes]], width: int, dictionary: bytes, level: int = 3) -> bytes:
    """One block of (doc_id, id bytes); a null doc_id is stored as the smallest long."""
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    frames = [c.compress(ids) for _, ids in docs]
    at = np.cumsum([0, *map(len, frames)], dtype="<u8")
    ids = np.array([-(1 << 63) if d is None else d for d, _ in docs], "<i8")
    counts = np.array([len(x) // width for _, x in docs], "<u8")
    return _HEAD.pack(MAGIC, VERSION, width, hashlib.sha256(dictionary).digest()[:8], len(docs)) + at.tobytes() + ids.tobytes() + counts.tobytes() + b"".join(frames)


class Block:
    """A block that has been read; documents are decompressed one at a time."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, version, self.width, digest, n = _HEAD.unpack_from(blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block")
        if digest != hashlib.sha256(dictionary).digest()[:8]:
            raise ValueError("the block was written with another dictionary")
        at = _HEAD.size
        self.at = np.frombuffer(blob, "<u8", n + 1, at)
        self.doc_ids = np.frombuffer(blob, "<i8", n, at := at + 8 * (n + 1))
        self.counts = np.frombuffer(blob, "<u8", n, at := at + 8 * n)
        self.frames = memoryview(blob)[at + 8 * n :]
        self.d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self):
        return len(self.counts)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        raw = self.d.decompress(self.frames[int(self.at[k]) : int(self.at[k + 1])])
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4")


_BLOCKS = "shard int, block int, first_doc long, last_doc long, n_docs long, n_ids long, ids_before long, blob binary"


def _write(path: str, end_id: int, width: int, dictionary: bytes):
    from pyspark import TaskContext

    def run(batches):
        enc, end = _encoder(path, width), end_id.to_bytes(width, "little")
        shard, block, before, docs, held = TaskContext.get().partitionId(), 0, 0, [], 0

        def close():
            n = sum(len(x) for _, x in docs) // width
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (docs[0][0], pa.int64()), (docs[-1][0], pa.int64()), (len(docs), pa.int64()), (n, pa.int64()), (before, pa.int64()), (write_block(docs, width, dictionary), pa.binary()))],
                ["shard", "block", "first_doc", "last_doc", "n_docs", "n_ids", "ids_before", "blob"],
            ), n

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (size == 0 or size + len(texts[to]) < 1 << 20):
                    size, to = size + len(texts[to]) + 1, to + 1
                for d, x in zip(ids[at:to], enc.batch(texts[at:to], end)):
                    docs.append((d, x))
                    held += len(x)
                    if held >= BLOCK_BYTES:
                        row, n = close()
                        yield row
                        block, before, docs, held = block + 1, before + n, [], 0
                at = to
        if docs:
            yield close()[0]

    return run


def write_tokens(documents: DataFrame, path: str, end_id: int) -> tuple[Staged, bytes]:
    """Encode every whole text (null: empty), append ``end_id``, and write blocks in ascending doc_id order (null ids first).

    Rows are range-partitioned by doc_id and, so that rows of one id (or none) can be many, by a hash of the text; that is
    their order too, so reruns agree.  Other columns play no part; an empty table has no blocks.  Returns the table of
    blocks and the dictionary, which is needed to read them.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = id_width(path)
    dictionary = train_dictionary(docs, path, end_id, width)
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit(""))).asc()]
    dealt = docs.repartitionByRange(fan_out(spark), *order).sortWithinPartitions(*order)
    blocks = Staged(dealt.mapInArrow(_write(path, end_id, width, dictionary), _BLOCKS), "tokens", "uncompressed")
    return blocks, dictionary


_READ = "shard int, doc_id long, offset long, n_tokens long, ids binary"


def _read(dictionary: bytes, digest_only: bool):
    def run(batches):
        for b in batches:
            for shard, before, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "ids_before", "blob"))):
                block = Block(blob, dictionary)
                offset = before + np.concatenate([[0], np.cumsum(block.counts, dtype=np.int64)[:-1]])
                raw = []
                for k in range(len(block)):
                    x = block.ids(k).astype("<u4").tobytes()
                    raw.append(zlib.crc32(x) if digest_only else x)
                n = len(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([None if x == -(1 << 63) else int(x) for x in block.doc_ids], pa.int64()), pa.array(offset, pa.int64()), pa.array(block.counts.astype(np.int64)), pa.array(raw, pa.int64() if digest_only else pa.binary())],
                    ["shard", "doc_id", "offset", "n_tokens", "ids_crc32" if digest_only else "ids"],
                )

    return run


def read_tokens(blocks: DataFrame, dictionary: bytes, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of a table of blocks.

    ``start`` is the number of ids of all documents before it; shards follow each other in doc_id order, so a sum over one
    row a shard is all that is needed beyond the blocks' own index.  ``digest_only`` gives the crc32 of the ids as
    little-endian unsigned 32-bit integers instead of the ids.
    """
    from pyspark.sql import Window

    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    last = "ids_crc32" if digest_only else "ids"
    rows = blocks.select("shard", "ids_before", "blob").mapInArrow(_read(dictionary, digest_only), _READ.replace("ids binary", "ids_crc32 long") if digest_only else _READ)
    return rows.join(shards, "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", last)


def read_document(blocks: DataFrame, dictionary: bytes, doc_id: int) -> list[int] | None:
    """Ids of one document, or None: the scan is cut to blocks whose range holds it, and one frame is decompressed.

    Of several documents with the id it is the first in the table's order.
    """
    for r in blocks.where((F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)) & (F.col("last_doc") >= doc_id)).orderBy("shard", "block").select("blob").toLocalIterator():
        block = Block(bytes(r["blob"]), dictionary)
        for k in np.flatnonzero(block.doc_ids == doc_id):
            return block.ids(int(k)).tolist()
    return None


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents as read back from their blocks; nulls, ties and repeated rows as in write_tokens()."""
    import public_tokenizers

    blocks, dictionary = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_tokens(blocks.df, dictionary, digest_only=True)
