"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton holds all ordinary pieces.  One pass over a run of characters
follows the output links at each position and relaxes the best way to reach
it from the ways to reach the start of each piece that ends there:

* Unigram models: a way is as good as the sum of its scores (Viterbi).
* BPE models: a way is admissible if no merge can cross the border between its
  last two pieces, that is, if the two pieces side by side encode to
  themselves.  One way at most is admissible at each position, and it ends in
  the pieces that merging by score would give.  A sum of scores would not give
  a BPE model's ids.

Characters without a piece become byte pieces, or the unknown piece.  As no
piece has a space mark behind another character, runs are cut before space
marks, and a run met before is taken from a bounded cache.

Edge cases: null and empty texts give no ids.  A literal U+2581 decodes to a
blank, as in the library; ``round_trip`` is then false.  Repeated rows are
encoded alike; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import blocks

MARK = "▁"
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
_CACHED_RUNS, _CACHED_LENGTH = 1_000_000, 64
_CACHED_PAIRS = 1_000_000


class Pieces:
    """The model file's pieces and the automaton over them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece.Type
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normalizer, a dummy prefix and all white space are supported")
        self.bpe = model.trainer_spec.model_type == 2
        self.texts = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.plain = [p.type == kinds.NORMAL for p in model.pieces]
        self.ids = {t: i for i, (t, plain) in enumerate(zip(self.texts, self.plain, strict=True)) if plain}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.bytes = [of_byte[b] for b in range(256)] if len(of_byte) == 256 else None
        self.decoded = [t.replace(MARK, " ").encode() if plain else b"" for t, plain in zip(self.texts, self.plain, strict=True)]
        for b, i in of_byte.items():
            self.decoded[i] = bytes([b])
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece has a space mark behind another character")
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[int]:
        """Merge by score, the leftmost first: the meaning of a BPE model.  A heap holds the merges that neighbours allow."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if after[k] < len(parts):
                both = parts[k] + parts[after[k]]
                i = self.ids.get(both)
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], k, both))

        for k in range(len(parts)):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            if parts[k] is None or after[k] >= len(parts) or parts[k] + parts[after[k]] != both:
                continue  # one of the two has been merged since
            gone = after[k]
            parts[k], parts[gone], after[k] = both, None, after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return [self.ids[p] for p in parts if p is not None]

    def stable(self, a: int, b: int) -> bool:
        """Do pieces a and b side by side encode to themselves?  a may be -1, for none."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= _CACHED_PAIRS:
                self.pairs.clear()
            left = [] if a < 0 else [a]
            found = self.pairs[a, b] = self.merged("".join(self.texts[i] for i in [*left, b])) == [*left, b]
        return found

    def best_path(self, text: str) -> list[int]:
        """Ids of a run whose characters all have pieces."""
        size = len(text)
        last: list[int | None] = [None] * (size + 1)
        last[0] = -1
        if self.bpe:
            for end, (length, i) in self.automaton.iter(text):
                before = last[end + 1 - length]
                if last[end + 1] is None and before is not None and self.stable(before, i):
                    last[end + 1] = i
        else:
            best = [0.0] + [-np.inf] * size
            for end, (length, i) in self.automaton.iter(text):
                score = best[end + 1 - length] + self.scores[i]
                if score > best[end + 1]:
                    best[end + 1], last[end + 1] = score, i
        out, at = [], size
        while at:
            i = last[at]
            if i is None:  # no admissible way: merges are not what the pairs say
                return self.merged(text)
            out.append(i)
            at -= len(self.texts[i])
        return out[::-1]

    def encode_run(self, text: str) -> list[int]:
        out: list[int] = []
        known = ""
        for c in text:
            if c in self.ids:
                known += c
                continue
            if known:
                out += self.best_path(known)
                known = ""
            out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
        return out + self.best_path(known) if known else out


class _Runs(dict):
    """Packed ids by run; ``mark`` goes before each run."""

    def __init__(self, pieces: Pieces, mark: str):
        super().__init__()
        self.pieces, self.mark = pieces, mark

    def __missing__(self, run: str) -> bytes:
        ids = np.array(self.pieces.encode_run(self.mark + run), "<u4").tobytes()
        if len(run) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_RUNS:
                self.clear()
            self[run] = ids
        return ids


class Codec:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.plain, self.marked = _Runs(self.pieces, ""), _Runs(self.pieces, MARK)
        self.newline = None if "\n" in self.pieces.ids else np.array(self.pieces.encode_run("\n"), "<u4").tobytes()
        self.table = self.pieces.decoded

    def _line(self, line: str, first: bool) -> bytes:
        if "  " in line or MARK in line or first and line.startswith(" "):
            text = (MARK if first else "") + line.replace(" ", MARK)
            return b"".join(map(self.plain.__getitem__, _RUN.findall(text)))
        runs = line.split(" ")
        head = self.marked[runs[0]] if first else self.plain[runs[0]] if runs[0] else b""
        return head + b"".join(map(self.marked.__getitem__, runs[1:]))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.newline is None:
            return self._line(text, True)
        lines = text.split("\n")
        head = self._line(lines[0], True) if lines[0] else self.marked[""]
        return self.newline.join([head, *[self._line(x, False) if x else b"" for x in lines[1:]]])

    def decode(self, data: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.table.__getitem__, np.frombuffer(data, "<u4").tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ")


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker process, kept between tasks."""
    return Codec(path)


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip [, ids] for each row; ids are little-endian unsigned 32-bit."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in blocks(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [c.encode(t) for t in texts]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array([c.decode(x) == t for x, t in zip(ids, texts, strict=True)])]
            names = ["doc_id", "n_ids", "ids_crc32", "round_trip"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text; null ids give null."""
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
