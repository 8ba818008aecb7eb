"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled into one that reads characters and writes piece ids: the normaliser (one state: a space and the
escape sign are read as the escape sign, any other character as itself, after a dummy prefix), the pieces (one arc a piece,
which weighs its negative score in a unigram model), and the byte fallback (one arc a character that no piece holds, which
writes its bytes' pieces and weighs more than any piece).  The composition with a text is a lattice whose states are the
places in it; encoding is its shortest path in the tropical semiring, where weights of alternatives are compared and those
along a path added up.  For a BPE model the machine is composed with an acceptor of pairs of arcs as well: a sequence of
pieces is what the merges give exactly if each two neighbours are what the merges give for those two alone, so a pair weighs
0 then and infinity otherwise, and one path of finite weight is left.  The acceptor's transitions and the fallback's arcs
are as many as there are pairs and characters, so they are expanded when first met.
"""

from __future__ import annotations

import re
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import cut

SPACE = "▁"
_MEMORY = 600_000
_loaded: dict = {}


def _fields(b: bytes):
    """(number, value) of each field of a serialized protocol-buffer message."""

    def varint(i):
        x = s = 0
        while True:
            x |= (b[i] & 127) << s
            i, s = i + 1, s + 7
            if b[i - 1] < 128:
                return x, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            v, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            v, i = struct.unpack("<d" if n == 8 else "<f", b[i : i + n])[0], i + n
        yield key >> 3, v


class Transducer:
    """A SentencePiece model file compiled for encoding and decoding.

    Models whose normaliser rewrites characters by a compiled map, or treat white space as a suffix, raise ValueError.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(kv for k, v in top if k == 2 for kv in _fields(v))
        norm = dict(kv for k, v in top if k == 3 for kv in _fields(v))
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24):
            raise ValueError("only normalisers without a character map that keep and escape white space")
        self.prefix = bool(norm.get(3, 1))
        self.bpe = trainer.get(3, 1) == 2
        if not self.bpe and trainer.get(3, 1) != 1:
            raise ValueError("only unigram and BPE models")
        self.writes: dict[str, bytes] = {}  # arcs by what they read: the ids they write
        self.score: dict[str, float] = {}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        self.unk, fallback = 0, False
        for n, msg in enumerate(v for k, v in top if k == 1):
            p = dict(_fields(msg))
            piece, kind = p[1].decode(), p.get(3, 1)
            self.surface.append(b"" if kind == 3 else piece.replace(SPACE, " ").encode())
            if kind == 2:
                self.unk, self.surface[-1] = n, " ⁇ ".encode()
            elif kind == 6:
                self.bytes[int(piece[3:5], 16)], fallback = n, True
                self.surface[-1] = bytes([int(piece[3:5], 16)])
            elif kind in (1, 4):
                reads = piece.replace(SPACE, " ")  # composed with the normaliser
                self.writes[reads] = np.int32(n).tobytes()
                self.score[reads] = p.get(2, 0.0)
        self.fallback = fallback
        self.is_byte = np.zeros(len(self.surface), bool)
        if fallback:
            self.is_byte[self.bytes] = True
        self.longest = max(map(len, self.score), default=1)
        self.penalty = 10.0 - min(self.score.values(), default=0.0)
        chars = set("".join(self.score))
        #: Where no piece reaches across, a text is cut: before white space, and around line ends if no piece holds them.
        inner = any(" " in p.lstrip(" ") for p in self.score)
        cut = "" if "\n" in chars else "\n"
        self.chunks = None if inner else re.compile(f"{cut or '(?!)'}| *[^ {cut}]+| +")
        if self.bpe:
            self.automaton = ahocorasick.Automaton()
            for p in self.score:
                self.automaton.add_word(p, p)
            self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    def _merged(self, s: str) -> list[str]:
        """What the merges give for a short string: best score first, then leftmost."""
        x, score = list(s), self.score
        while True:
            best = max(((score[x[i] + x[i + 1]], -i) for i in range(len(x) - 1) if x[i] + x[i + 1] in score), default=None)
            if best is None:
                return x
            i = -best[1]
            x[i : i + 2] = [x[i] + x[i + 1]]

    def _accepts(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > _MEMORY:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._merged(a + b) == [a, b]
        return ok

    def path(self, s: str) -> list[str]:
        """What the arcs of the shortest path through the lattice of a text read: pieces, or single characters for the fallback."""
        n = len(s)
        last = [""] * (n + 1)
        if self.bpe:  # one path reaches each position: arcs come longest first for each end, and one of them is accepted
            pairs, chars = self.pairs, s
            for end, p in self.automaton.iter(s):
                if last[end + 1]:
                    continue
                j = end + 1 - len(p)
                if j:
                    a = last[j] = last[j] or chars[j - 1]
                    ok = pairs.get((a, p))
                    if ok is None:
                        ok = self._accepts(a, p)
                else:
                    ok = self._reached(p)
                if ok:
                    last[end + 1] = p
        else:
            score, cost = self.score, [0.0] + [float("inf")] * n
            for i in range(1, n + 1):
                for j in range(max(0, i - self.longest), i):
                    p = s[j:i]
                    if (p in score or i - j == 1) and (c := cost[j] + (-score[p] if p in score else self.penalty)) < cost[i]:
                        cost[i], last[i] = c, p
        out = []
        while n:
            p = last[n] or s[n - 1]
            out.append(p)
            n -= len(p)
        return out[::-1]

    def _reached(self, p: str) -> bool:
        """Whether the merges reach a piece from its characters at all."""
        ok = self.pairs.get((p, ""))
        if ok is None:
            ok = self.pairs[p, ""] = self._merged(p) == [p]
        return ok

    def _written(self, path: list[str]) -> bytes:
        """The ids that the arcs of a path write."""
        writes, out, unknown = self.writes, [], False
        for p in path:
            ids = writes.get(p)
            if ids is None:
                if self.fallback:  # an arc of the byte fallback is made
                    ids = writes[p] = np.array([self.bytes[c] for c in p.encode()], np.int32).tobytes()
                elif unknown:  # neighbouring unknown characters are one unknown piece
                    continue
                else:
                    out.append(np.int32(self.unk).tobytes())
                    unknown = True
                    continue
            unknown = False
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null and empty texts have none."""
        if not text:
            return np.zeros(0, np.int32)
        s = (" " if self.prefix else "") + text.replace(SPACE, " ")
        if self.chunks is None:
            return np.frombuffer(self._written(self.path(s)), np.int32)
        known, out = self.known, []
        for c in self.chunks.findall(s):
            x = known.get(c)
            if x is None:
                x = self._written(self.path(c))
                if len(known) >= _MEMORY:
                    known.clear()
                if len(c) < 64:
                    known[c] = x
            out.append(x)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        """The text that ids stand for: the transducer read backwards."""
        surface = self.surface
        s = b"".join([surface[i] for i in ids])
        return (s[1:] if self.prefix and s[:1] == b" " else s).decode("utf-8", "replace")


def transducer(path: str) -> Transducer:
    """The compiled model, once a worker process."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def _encoded(path: str):
    def run(batches):
        t = transducer(path)
        for b in cut(batches):
            rows = [t.encode(x) for x in b.column("text").to_pylist()]
            offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the piece ids of each whole text; null and empty texts give an empty array, repeated rows stay."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches):
        t = transducer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, text string")


_TRIP = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, text_crc32 long, decoded_crc32 long, ids array<int>"


def _trip(path: str, keep: bool):
    kinds = [pa.int64()] * 5

    def run(batches):
        t = transducer(path)
        for b in cut(batches):
            out, rows = [], []
            for x in b.column("text").to_pylist():
                ids = t.encode(x)
                rows.append(ids if keep else ids[:0])
                out.append((len(ids), int(t.is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32((x or "").encode()), zlib.crc32(t.decode(ids.tolist()).encode())))
            cols = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)]
            if keep:
                offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "text_crc32", "decoded_crc32", *["ids"] * keep])

    return run


def round_trip(documents: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again, and give digests of both (and the ids, if wanted).

    ``decoded_crc32`` equals ``text_crc32`` for every text without the escape character itself, which decodes to a space.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_trip(path, keep_ids), _TRIP if keep_ids else _TRIP.removesuffix(", ids array<int>"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of the texts they decode to; nulls, empties and repeated rows as in round_trip()."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
