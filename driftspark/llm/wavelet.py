"""Token ids in wavelet matrices: one compressed, searchable file a shard."""

from __future__ import annotations

import base64
import json
import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import col

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public byte-level BPE word pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "shard string, n_docs long, n_tokens long, doc_ids array<long>, offsets array<long>, data binary"

#: Bits of one compressed block; a multiple of 64.
BLOCK = 1 << 18
_MAGIC = b"WVM1"
_tokenizers: dict = {}


def tokenizer(path: str, pattern: str):
    """The tokenizer of a public rank file, once a process."""
    if path not in _tokenizers:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _tokenizers[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _tokenizers[path]


def encode(ids: np.ndarray) -> bytes:
    """The wavelet matrix of non-negative ids.

    From the highest bit down, each plane holds one bit of every id, the ids being
    stably split by it (zeros first) before the next plane. A header lists the
    number of zeros of each plane, and each block's place and ones before it.
    """
    ids = np.ascontiguousarray(ids)
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    ids = ids.astype(np.uint16 if levels <= 16 else np.uint32 if levels <= 32 else np.uint64)
    press, body, planes, at = zstandard.ZstdCompressor(level=3), [], [], 0
    for level in reversed(range(levels)):
        bit = (ids >> ids.dtype.type(level)) & ids.dtype.type(1)
        one = bit.astype(bool)
        packed = np.packbits(one, bitorder="little")
        blocks, before = [], 0
        for lo in range(0, len(packed), BLOCK // 8):
            part = packed[lo : lo + BLOCK // 8]
            data = press.compress(part.tobytes())
            blocks.append([at, len(data), before])
            body.append(data)
            at += len(data)
            before += int(np.bitwise_count(part).sum())
        planes.append({"zeros": len(ids) - before, "blocks": blocks})
        ids = np.concatenate([ids[~one], ids[one]])
    head = press.compress(json.dumps({"n": len(ids), "planes": planes}, separators=(",", ":")).encode())
    return _MAGIC + struct.pack("<I", len(head)) + head + b"".join(body)


class WaveletMatrix:
    """Reads a file of encode(): access, rank, count and occurrences; blocks are unpacked when needed."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != _MAGIC:
            raise ValueError("no wavelet matrix file")
        size = struct.unpack("<I", data[4:8])[0]
        self._unpress = zstandard.ZstdDecompressor()
        head = json.loads(self._unpress.decompress(data[8 : 8 + size]))
        self.n, self.planes, self._data, self._base, self._cache = head["n"], head["planes"], data, 8 + size, {}

    def __len__(self) -> int:
        return self.n

    def _block(self, level: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bits in 64-bit words, and the plane's ones before each word."""
        if (level, b) not in self._cache:
            at, size, before = self.planes[level]["blocks"][b]
            raw = self._unpress.decompress(self._data[self._base + at : self._base + at + size])
            words = np.frombuffer(raw + b"\0" * (-len(raw) % 8), np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]) + before
            self._cache[level, b] = words, ones
        return self._cache[level, b]

    def _bits(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at some places and the ones before them; a place may be n."""
        bit, ones = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        end = at >= self.n
        ones[end] = self.n - self.planes[level]["zeros"]
        block = at // BLOCK
        for b in np.unique(block[~end]):
            here = (block == b) & ~end
            words, before = self._block(level, int(b))
            w, k = np.divmod(at[here] - b * BLOCK, 64)
            word = words[w]
            k = k.astype(np.uint64)
            bit[here] = (word >> k) & np.uint64(1)
            ones[here] = before[w] + np.bitwise_count(word & ((np.uint64(1) << k) - np.uint64(1)))
        return bit, ones

    def access(self, at) -> np.ndarray:
        """The ids at some places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("outside the shard")
        out = np.zeros(len(at), np.int64)
        for level, plane in enumerate(self.planes):
            bit, ones = self._bits(level, at)
            out = out * 2 + bit
            at = np.where(bit, plane["zeros"] + ones, at - ones)
        return out

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Where the token's occurrences among the first upto ids are after the last plane."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        lo, hi = 0, upto
        for level, plane in enumerate(self.planes):
            ones = self._bits(level, np.array([lo, hi]))[1]
            if token >> (len(self.planes) - 1 - level) & 1:
                lo, hi = plane["zeros"] + int(ones[0]), plane["zeros"] + int(ones[1])
            else:
                lo, hi = lo - int(ones[0]), hi - int(ones[1])
        return lo, hi

    def rank(self, token: int, upto: int) -> int:
        """How often the token occurs among the first upto ids."""
        lo, hi = self._range(token, upto)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros of a plane."""
        blocks = self.planes[level]["blocks"]
        starts = np.arange(len(blocks)) * BLOCK
        before = np.array([b[2] for b in blocks], np.int64)
        before = before if one else starts - before
        block = np.searchsorted(before, k, "right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(block):
            here = block == b
            words, ones = self._block(level, int(b))
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")[: min(BLOCK, self.n - int(b) * BLOCK)]
            out[here] = b * BLOCK + np.flatnonzero(bits == one)[k[here] - before[b]]
        return out

    def occurrences(self, token: int) -> np.ndarray:
        """All places of the token, ascending."""
        lo, hi = self._range(token, self.n)
        at = np.arange(lo, hi, dtype=np.int64)
        for level in reversed(range(len(self.planes))):
            one = bool(token >> (len(self.planes) - 1 - level) & 1)
            at = self._select(level, one, at - self.planes[level]["zeros"] if one else at) if len(at) else at
        return at

    def decode(self) -> np.ndarray:
        """All ids, plane by plane."""
        order, out = np.arange(self.n), np.zeros(self.n, np.int64)
        for level in range(len(self.planes)):
            parts = [np.unpackbits(self._block(level, b)[0].view(np.uint8), bitorder="little")[: min(BLOCK, self.n - b * BLOCK)] for b in range(len(self.planes[level]["blocks"]))]
            bit = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
            out[order] = out[order] * 2 + bit
            order = np.concatenate([order[~bit], order[bit]])
        return out


def builder(path: str, pattern: str, shard_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        ends = [0]

        def shard() -> pa.RecordBatch:
            data = encode(np.concatenate([np.zeros(0, np.uint32), *ids]))
            row = [f"{part:06d}-{made:05d}"], [len(docs)], [ends[-1]], [list(docs)], [list(ends)], [data]
            types = pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        enc = tokenizer(path, pattern)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.array(enc.encode_ordinary(text.as_py() or ""), np.uint32)
                ids.append(new)
                docs.append(doc)
                ends.append(ends[-1] + len(new))
                if ends[-1] >= shard_tokens:
                    yield shard()
                    made, ids, docs, ends = made + 1, [], [], [0]
        if docs:
            yield shard()

    return run


def token_shards(docs: DataFrame, shard_tokens: int = 1 << 21, path: str = VOCABULARY, pattern: str = PATTERN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a shard: its document ids, where each document's tokens start and end, and its file.

    Each scan partition is tokenized by a public byte-level BPE and cut into shards
    of shard_tokens tokens or a little more (documents stay whole), without any
    shuffle; data is one compressed file of encode(). Document i has the tokens
    offsets[i] to offsets[i+1].

    Null and empty texts have no tokens; their ids are listed. Rows with the same
    or no id are listed as often as they come. Extra columns are not read. An
    empty table has no shard.
    """
    return docs.select(col(doc_id).cast("long"), col(text)).mapInArrow(builder(path, pattern, shard_tokens), SCHEMA)


def write_files(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each shard's file to a folder that all executors share; returns their paths and sizes.

    A file is put in place by one rename, so a task that is lost and run again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, sizes = [], []
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                paths.append(os.path.join(folder, f"{shard}.wvm"))
                sizes.append(len(data.as_buffer()))
                part = f"{paths[-1]}.{TaskContext.get().taskAttemptId()}"
                with open(part, "wb") as f:
                    f.write(data.as_buffer())
                os.replace(part, paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return shards.select("shard", "data").mapInArrow(run, "path string, bytes long")
