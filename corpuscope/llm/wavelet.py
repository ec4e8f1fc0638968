"""Token-ID output: one wavelet matrix per shard of documents.

A shard's file holds, for each bit of an id from the highest down, a plane with that bit of every token, the tokens
stably sorted by the bits above; planes are compressed. Rank over the planes gives any token, counts of an id in a
range, and the places where it occurs, without decoding the shard.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import fresh_path, small_batches, table

MAGIC = b"WVM1"


class WaveletMatrix:
    """A sequence of ids below 2**levels. ``dump`` and ``load`` are the file format: magic, length, levels, the number
    of zeros of each plane, the planes' compressed sizes, the planes."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self._ones = planes, zeros, n, None

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        now, planes, zeros = ids.astype(np.uint16 if levels <= 16 else np.uint32), [], []
        for bit in range(levels - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            low = np.compress(~ones, now)
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(ones, now)])
        return cls(planes, zeros, len(ids))

    def dump(self) -> bytes:
        packed = [zstandard.ZstdCompressor(level=1).compress(p.tobytes()) for p in self.planes]
        k = len(packed)
        return MAGIC + struct.pack(f"<QI{k}Q{k}Q", self.n, k, *self.zeros, *map(len, packed)) + b"".join(packed)

    @classmethod
    def load(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, k = struct.unpack_from("<QI", data, 4)
        numbers = struct.unpack_from(f"<{2 * k}Q", data, 16)
        at, planes = 16 + 16 * k, []
        for size in numbers[k:]:
            planes.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=(n + 7) // 8 or 1), np.uint8))
            at += size
        return cls(planes, list(numbers[:k]), n)

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the sorts from the lowest plane up."""
        levels = len(self.planes)
        kind = np.uint16 if levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for bit, plane, zeros in zip(range(levels), reversed(self.planes), reversed(self.zeros), strict=True):
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~ones)] = now[:zeros]  # faster than by a mask
            before[np.flatnonzero(ones)] = now[zeros:] | kind(1 << bit)
            now = before
        return now

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane: a directory entry each 512 bits, then at most 64 bytes."""
        if self._ones is None:
            self._ones = []
            for plane in self.planes:
                padded = np.zeros(-(-len(plane) // 64) * 64, np.uint8)
                padded[: len(plane)] = plane
                self._ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, 64).sum(axis=1, dtype=np.int64))]))
        block, plane = i >> 9, self.planes[level]
        count = int(self._ones[level][block]) + int(np.bitwise_count(plane[block << 6 : i >> 3]).sum(dtype=np.int64))
        return count + (int(plane[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else count

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank(level, low), self._rank(level, high)
            low, high = (zeros + a, zeros + b) if token >> (len(self.zeros) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id in [low, high)."""
        if not 0 <= token < 1 << len(self.planes):
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the id's occurrence number ``k`` (from 0): from the sorted place back up through the planes."""
        first, end = self._range(token, 0, self.n) if 0 <= token < 1 << len(self.planes) else (0, 0)
        if not 0 <= k < end - first:
            raise IndexError(k)
        i = first + k
        for level in range(len(self.planes) - 1, -1, -1):
            zeros = self.zeros[level]
            bit = token >> (len(self.planes) - 1 - level) & 1
            want, low, high = (i - zeros if bit else i) + 1, 0, self.n
            while low < high:  # the smallest prefix with so many bits of this kind
                mid = (low + high) // 2
                ones = self._rank(level, mid + 1)
                low, high = (low, mid) if (ones if bit else mid + 1 - ones) >= want else (mid + 1, high)
            i = low
        return i

    def locate(self, token: int) -> list[int]:
        """All places of an id."""
        return [self.select(token, k) for k in range(self.count(token))]


#: Where cutting a text leaves the ids as they are. Byte-level BPE never merges across the pieces of its pattern; a
#: piece starts wherever white space follows anything else, and where a full stop or comma follows a letter. Other
#: white space than the six ASCII kinds is rare: such texts are encoded whole.
_CHUNK = re.compile("[\t-\r ]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,\t-\r ]|$)|[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: Chunks that are one piece whatever stands around them: the model takes them without the pipeline around it.
_PIECE = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


class Encoder:
    """Ids of whole texts by the tokenizers library. Chunks that were seen stay in a cache of at most ``most`` entries,
    so the library encodes each frequent word once per process."""

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.levels = max(1, (max(self.tokenizer.get_vocab(True).values())).bit_length())
        pieces, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        self.by_model = self.tokenizer.normalizer is None and type(pieces).__name__ == "ByteLevel" and not pieces.add_prefix_space and not any(_PIECE.fullmatch(t.content) for t in added)
        # byte-level vocabularies write a byte as a character: visible ones of Latin-1 as they are, the rest from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen]
        self.written = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_model:
            return self._encoded(texts)
        tokenize, written = self.tokenizer.model.tokenize, self.written
        single = [bool(_PIECE.fullmatch(t)) for t in texts]
        others = iter(self._encoded([t for t, s in zip(texts, single, strict=True) if not s]))
        space, out = written[32], []
        for t, s in zip(texts, single, strict=True):
            if s:  # ASCII letters are written as they are
                ids = [k.id for k in tokenize(t.replace(" ", space) if t.isascii() else t.encode().decode("latin-1").translate(written))]
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(next(others))
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit integers."""
        chunks = [[t] if _ODD_SPACE.search(t) else _CHUNK.findall(t) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = list({c for x in chunks for c in x}.difference(self.known))
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            self.known.update(zip(part, self._ids(part), strict=True))
        return [b"".join(map(self.known.__getitem__, x)) for x in chunks]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


SHARD_SCHEMA = "part int, seq int, before long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, shard_tokens: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """Encodes ``docs`` (``doc_id``, ``text``) in ascending ``doc_id`` order and writes a table of shard files.

    A row is one file, ``payload``, with its documents' ids and token counts. Documents are dealt by ranges of
    ``doc_id``; within a range files close once they hold ``shard_tokens`` tokens, so a very long text gives one long
    file and no task holds more than a file and a batch of texts. ``part`` and ``seq`` order the files; ``before``
    counts the tokens of the part's earlier files. A null text is empty and has just the end id; a null id sorts
    first; rows with equal ids are in order of text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    partitions = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        seq, before, ids, held, size = 0, 0, [], [], 0

        def closed():
            tokens = np.frombuffer(b"".join(held), dtype="<u4")
            row = [part, seq, before, len(tokens), ids, [len(x) // 4 for x in held], WaveletMatrix.build(tokens, enc.levels).dump()]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, kinds, strict=True)], names=names)

        names = ["part", "seq", "before", "n_tokens", "doc_ids", "lengths", "payload"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc, got in zip(piece.column(0).to_pylist(), enc.encode([t or "" for t in piece.column(1).to_pylist()]), strict=True):
                    ids.append(doc)
                    held.append(got + end)
                    size += len(got) // 4 + 1
                    if size >= shard_tokens:
                        yield closed()
                        seq, before, ids, held, size = seq + 1, before + size, [], [], 0
        if held:
            yield closed()

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens`` and
    ``ids_crc32`` of its ids as little-endian unsigned 32-bit integers."""
    # one number for each of write_shards' partitions
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = dict(zip([r.part for r in sums], np.concatenate([[0], np.cumsum([r.n for r in sums])])[:-1].tolist(), strict=True))

    def run(batches):
        for batch in batches:
            for part, before, ids, lengths, payload in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                tokens = WaveletMatrix.load(payload).tokens().astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins + (starts[part] + before)), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "before", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the byte-level vocabulary of 50,257 entries, into files and back."""
    import public_tokenizers

    shards = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "wavelet"))
    return read_shards(shards)
