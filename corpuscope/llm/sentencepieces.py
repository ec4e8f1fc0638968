"""SentencePiece encoding and decoding by a merge-type prefix table.

Byte-pair merging has a property that allows encoding from left to right: a sequence of pieces is what merging makes of
their text exactly if each piece is and each two neighbours are. So every prefix of a text has one possible last piece,
the only piece that ends there and suits the last piece of the prefix before it. An automaton over all pieces finds
those that end at each character; a table keeps each prefix's last piece; the ids are read from the table backwards.
"""

from __future__ import annotations

import re
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import HELD, small_batches, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
FOREVER = float("inf")


class Pieces:
    """A SentencePiece model of type BPE with byte fallback, identity normalisation and a leading space symbol.

    Chunks already encoded stay in a cache of at most ``most`` entries, of some 200 bytes each.
    """

    def __init__(self, path: str, most: int = 250_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a leading space are known here")
        if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not known here")
        self.text = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        order = sorted(self.id.values(), key=lambda i: -model.pieces[i].score)
        # when a piece can come to be: characters at once, others in order of score, equal scores at the same time
        self.time: dict[int, int] = {}
        at, last = -1, None
        for i in order:
            if model.pieces[i].score != last:
                at, last = at + 1, model.pieces[i].score
            self.time[i] = at if len(self.text[i]) > 1 else -1
        self.unknown = model.trainer_spec.unk_id
        self.plain = {i: p.replace(SPACE, " ") for i, p in enumerate(self.text) if self.kind[i] == NORMAL}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        inner = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        stops = "".join(c for c in ".,;:!?\n\t" if not any(x[1] == c and x[0] != SPACE and (x[0].isalpha() or c in "\n\t") for x in inner))
        if any(x[1] == SPACE and x[0] != SPACE for x in inner):
            raise ValueError("pieces that go on after a space are not known here")
        # A text may be cut between two characters that follow each other in no piece: before a space that follows
        # something else, and before the marks in ``stops`` that follow a letter.
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        follow = f"[{SPACE}{re.escape(stops)}]"
        self.chunk = re.compile(f"{SPACE}*[{letters}]+(?={follow}|$)|{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.strange = re.compile("[^" + re.escape("".join(c for c in self.id if len(c) == 1)) + "]")
        self.most, self.cache, self.suits, self.spines = most, {}, {}, {}
        self.decimal = list(map(str, range(len(self.text))))

    def _merged(self, text: str):
        """How merging builds a piece's text: (piece, left, right) with parts alike, a character having no parts; None
        if merging makes something else of it."""
        parts = [(self.id[c], None, None) for c in text]
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                i = self.id.get(self.text[parts[k][0]] + self.text[parts[k + 1][0]])
                if i is not None and (best is None or self.time[i] < best[0]):
                    best = (self.time[i], k, i)
            if best is None:
                return None
            _, k, i = best
            parts[k : k + 2] = [(i, parts[k], parts[k + 1])]
        return parts[0]

    def spine(self, piece: int):
        """The pieces that stand at the left edge of a piece while it is built, and those at the right edge, each as
        (text, from when, until when it stands there); None if merging never makes the piece."""
        if piece not in self.spines:
            tree = self._merged(self.text[piece])
            if tree is None or tree[0] != piece:
                self.spines[piece] = None
            else:
                edges = []
                for side in (1, 2):
                    edge, node, until = [], tree, FOREVER
                    while node is not None:
                        begin = max(self.time[node[0]], *(self.time[x[0]] for x in node[1:] if x), -1) if node[1] else -1
                        edge.append((self.text[node[0]], begin, until))
                        until, node = begin, node[side]
                    edges.append(edge)
                self.spines[piece] = tuple(edges)
        return self.spines[piece]

    def suit(self, a: int, b: int) -> bool:
        """Whether the pieces can be neighbours: at no time do the piece at a's right edge and the one at b's left edge
        merge. At the same time the merge further left comes first: one inside a before one over the border before one
        inside b."""
        right, left = self.spine(a)[1], self.spine(b)[0]
        for x, x_from, x_until in right:
            for y, y_from, y_until in left:
                i = self.id.get(x + y)
                if i is not None:
                    when = max(self.time[i], x_from, y_from)
                    if when < x_until and when <= y_until:
                        return False
        return True

    def _run(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n, suits = len(text), self.suits
        last = [-1] * (n + 1)
        for end, (size, piece) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = end - size
            if before:
                key = last[before] << 24 | piece
                fits = suits.get(key)
                if fits is None:
                    fits = suits[key] = self.spine(piece) is not None and self.suit(last[before], piece)
            else:
                fits = self.spine(piece) is not None
            if fits:
                last[end] = piece
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= len(self.text[last[at]])
        return ids[::-1]

    def _chunk_ids(self, chunk: str) -> list[int]:
        if not self.strange.search(chunk):
            return self._run(chunk)
        ids, at = [], 0
        for m in self.strange.finditer(chunk):
            if m.start() > at:
                ids += self._run(chunk[at : m.start()])
            ids += [self.byte[b] for b in m[0].encode()]
            at = m.end()
        return ids + (self._run(chunk[at:]) if at < len(chunk) else [])

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Of each chunk its ids as 32-bit integers, from the cache where it is there."""
        cache, out = self.cache, []
        for chunk in chunks:
            got = cache.get(chunk)
            if got is None:
                if len(cache) >= self.most:
                    cache.clear()
                if len(self.suits) >= 2 * self.most:
                    self.suits.clear()
                got = cache[chunk] = np.array(self._chunk_ids(chunk), "<i4").tobytes()
            out.append(got)
        return out

    def _chunks(self, text: str) -> list[str]:
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self._chunks(text) for i in self._chunk_ids(c)]

    def decode_part(self, ids: list[int]) -> str:
        """Pieces joined, space symbols as spaces; runs of bytes as UTF-8, each byte of no character as U+FFFD."""
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kind[i] == BYTE:
                held.append(int(self.text[i][1:-1], 16))
                continue
            while held:
                try:
                    out.append(held.decode())
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[: e.start].decode() + "�")
                    del held[: e.start + 1]
            if i is None or self.kind[i] == CONTROL:
                continue
            out.append(" ⁇ " if self.kind[i] == UNKNOWN else self.text[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library does: the first piece loses the space symbol it starts with."""
        try:
            out = "".join(map(self.plain.__getitem__, ids))  # without bytes, unknown or control pieces
            return out[1:] if out.startswith(" ") else out
        except KeyError:
            pass
        out = self.decode_part(ids)
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        return out[1:] if first is not None and self.kind[first] == NORMAL and self.text[first].startswith(SPACE) else out

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self._known(self._chunks(text))), "<i4")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of what the ids decode to."""
        ids = self.ids(text).tolist()
        return len(ids), sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest(), sha256(self.decode(ids).encode()).hexdigest()

    def packed_ids(self, text: str) -> tuple[bytes, str]:
        """The ids as 32-bit integers, and SHA-256 of what they decode to."""
        ids = self.ids(text)
        return ids.tobytes(), sha256(self.decode(ids.tolist()).encode()).hexdigest()


def pieces(path: str) -> Pieces:
    """One per Python worker, kept from task to task of this operator."""
    if path not in HELD:
        HELD[path] = Pieces(path)
    return HELD[path]


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    No rows move; memory is a batch of texts and the cache. A null text is an empty one and has no ids. Repeated rows
    each give a row; other columns are ignored.
    """

    def run(batches):
        use = pieces(model)
        for batch in batches:
            got = [use.digest(t or "") for t in batch.column(1).to_pylist()]
            n, ids, text = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids`` (array of int) and ``decoded_sha256``. Rules as above."""

    def run(batches):
        use = pieces(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                ids, decoded = zip(*[use.packed_ids(t or "") for t in piece.column(1).to_pylist()], strict=True)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the vocabulary of 32,000 pieces."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
