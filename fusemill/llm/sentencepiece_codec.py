"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

A text is normalised as the model file says and cut between two characters that
stand next to each other in no piece: no piece can span such a place, so the
parts are encoded by themselves. In a part the automaton reports, for each position, the pieces
that end there, following output links, and one pass relaxes the best way to
reach the position:

* unigram models: the best sum of piece scores (Viterbi); a character without a
  piece of its own costs ten less than the lowest score;
* BPE models: their scores are merge ranks, whose sum does not lead to the
  merges' result, so a piece is relaxed only onto a path whose last piece it can
  follow, that is, if merging the two pieces' characters gives just these two.
  One path is left at each position, and it is the merges' result. Runs of marks
  whose pieces tie in rank are merged directly.

Pieces that are not in the vocabulary fall back to bytes, or to the unknown
piece if the model has none. Parts are remembered up to a bound.

Defined results: a null or empty text has no ids and decodes to the empty text;
repeated rows each give a row; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from fusemill.llm.common import ship, table, texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
NO = float("-inf")
#: Parts, and pairs of pieces, that a worker remembers.
PARTS = PAIRS = 200_000


def model_kind(proto: bytes) -> int:
    """trainer_spec.model_type of a serialised model: 1 unigram (also where it is unset), 2 BPE, 3 word, 4 char."""

    def fields(data: bytes) -> Iterator[tuple[int, object]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = data[at]
                at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
                if b < 128:
                    return value

        while at < len(data):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            elif tag & 7 == 2:
                size = number()
                yield tag >> 3, data[at : at + size]
                at += size
            else:
                size = 8 if tag & 7 == 1 else 4
                yield tag >> 3, data[at : at + size]
                at += size

    trainer = dict(fields(next((v for k, v in fields(proto) if k == 2), b"")))
    return trainer.get(3, 1)


class Codec:
    def __init__(self, proto: bytes, kind: int | None = None):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bpe = (kind or model_kind(proto)) == 2
        self.auto, self.ids, self.scores = ahocorasick.Automaton(), {}, {}
        self.bytes, self.out, self.unk = {}, [], sp.unk_id()
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.out.append(b"")
            elif sp.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                self.out.append(piece.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                    self.auto.add_word(piece, (i, len(piece), sp.get_score(i)))
        self.auto.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        self.unk_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        # class 0: characters of no longer piece; inner[a, b]: some piece has a character of class a before one of class b
        longer = [p for p in self.ids if len(p) > 1]
        inner_chars = sorted(set("".join(longer)))
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in inner_chars]] = np.arange(1, len(inner_chars) + 1)
        self.inner = np.zeros((len(inner_chars) + 1, len(inner_chars) + 1), bool)
        for p in longer:
            at = self.classes[[ord(c) for c in p]]
            self.inner[at[:-1], at[1:]] = True
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours are joined, the leftmost first, until none can be."""
        parts = list(text)
        while True:
            best = max(((self.scores[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def split(self, s: str) -> list[str]:
        """The pieces of a chunk, by one pass over the automaton's reports."""
        n, bpe = len(s), self.bpe
        head = n - len(s.lstrip(MARK))
        if bpe and head > 1:
            return self.marks(s, head)
        best, back = [NO] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at = -1

        def lone(upto: int) -> None:
            nonlocal at
            while at < upto:
                at += 1
                if s[at] not in self.single and best[at] + self.unk_score > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + self.unk_score, at

        for end, (_, size, score) in self.auto.iter(s):
            if at < end:
                lone(end)
            start, stop = end + 1 - size, end + 1
            if bpe:
                if best[stop] == NO and best[start] != NO and (not start or self.follows(s[back[start] : start], s[start:stop])):
                    best[stop], back[stop] = 0.0, start
            elif best[start] + score > best[stop]:
                best[stop], back[stop] = best[start] + score, start
        lone(n - 1)
        parts, stop = [], n
        while stop:
            parts.append(s[back[stop] : stop])
            stop = back[stop]
        return parts[::-1]

    def marks(self, s: str, head: int) -> list[str]:
        """A chunk that begins with several marks: ties in rank make the order of merges matter, so they are carried out, in linear space."""
        import heapq

        sym, left, right = list(s), list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (joined := sym[a] + sym[b]) in self.scores:
                heapq.heappush(heap, (-self.scores[joined], a, b, joined))

        for k in range(len(s) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if sym[a] and sym[b] and right[a] == b and sym[a] + sym[b] == joined:
                sym[a], sym[b], right[a] = joined, "", right[b]
                if right[b] >= 0:
                    left[right[b]] = a
                offer(left[a], a)
                offer(a, right[a])
        return [x for x in sym if x]

    def chunk_ids(self, s: str) -> bytes:
        got = self.chunks.get(s)
        if got is None:
            ids: list[int] = []
            for piece in self.split(s):
                if piece in self.ids:
                    ids.append(self.ids[piece])
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in piece.encode())
                else:
                    ids.append(self.unk)
            got = np.array(ids, np.int32).tobytes()
            if len(self.chunks) >= PARTS:
                self.chunks.clear()
            if len(s) < 64:
                self.chunks[s] = got
        return got

    def parts(self, text: str) -> list[str]:
        at = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = [0, *(np.flatnonzero(~self.inner[at[:-1], at[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> np.ndarray:
        parts = self.parts(self.sp.normalize(text)) if text else []
        known = self.chunks
        return np.frombuffer(b"".join([known.get(c) or self.chunk_ids(c) for c in parts]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        data = b"".join([out[i] for i in ids.tolist()])
        return (data[1:] if data.startswith(b" ") else data).decode("utf-8", "replace")


_OPEN: dict[tuple[bytes, int | None], Codec] = {}


def codec(proto: bytes, kind: int | None = None) -> Codec:
    """A worker's own codec, kept between tasks."""
    if (proto, kind) not in _OPEN:
        _OPEN.clear()
        _OPEN[proto, kind] = Codec(proto, kind)
    return _OPEN[proto, kind]


def encode(df: DataFrame, text: str = "text", model: str = MODEL, kind: int | None = None, batch: int = 2000) -> DataFrame:
    """df with ids (array of int) and n_tokens (long)."""
    ship(df.sparkSession)
    with open(model, "rb") as f:
        proto = f.read()
    out = df.drop("ids", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(proto, kind)
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                ids = [own.encode(t) for t in texts_of(part[text])]
                sizes = np.array([len(x) for x in ids])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(sizes, pa.int64())], [*part.schema.names, "ids", "n_tokens"])

    return out.mapInArrow(run, schema(out, "ids array<int>, n_tokens long"))


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL, kind: int | None = None, batch: int = 2000) -> DataFrame:
    """df with decoded (string), from ids."""
    ship(df.sparkSession)
    with open(model, "rb") as f:
        proto = f.read()
    out = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(proto, kind)
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                column = part[ids]
                flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                texts = [own.decode(flat[a:b]) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return out.mapInArrow(run, schema(out, "decoded string"))


def schema(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def tokens(docs: DataFrame, text: str = "text", model: str = MODEL, batch: int = 2000) -> DataFrame:
    """docs with ids, n_tokens, the decoded text's sha256 and whether it is the text again, in one pass."""
    ship(docs.sparkSession)
    with open(model, "rb") as f:
        proto = f.read()
    out = docs.drop("ids", "n_tokens", "decoded_sha256", "round_trip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(proto, None)
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                texts = texts_of(part[text])
                ids = [own.encode(t) for t in texts]
                back = [own.decode(x) for x in ids]
                sizes = np.array([len(x) for x in ids])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in back]
                more = {
                    "ids": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "decoded_sha256": pa.array(sha, pa.string()),
                    "round_trip": pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays([*part.columns, *more.values()], [*part.schema.names, *more])

    return out.mapInArrow(run, schema(out, "ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
