"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbols that join to a piece go to an agenda ordered by the piece's
score, leftmost first on ties; the best is merged until none is left. Symbols
outside the vocabulary become byte pieces.

No merge spans two neighbouring characters that stand next to each other in no
piece, so a text is cut there into segments that are encoded once and
remembered. Each new segment of an Arrow batch is also encoded by the
sentencepiece library, and a difference stops the job.

Supported models: type BPE, identity normalization, white space kept and marked
by a prefix; no user-defined or unused pieces. Others are refused.

Defined cases: a NULL text is empty; an empty text has no ids and decodes to an
empty text; repeated rows give repeated results; an empty table gives an empty
result; other columns do not matter. Ids of bytes that are no valid UTF-8
decode to a replacement character for each byte.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from tidemark.llm.text_map import map_texts

MARK = "▁"
#: Segments whose ids a task remembers; the older half goes when it is full.
REMEMBERED = 250_000
#: Symbols up to which a list serves as agenda, faster than a heap.
SHORT = 32


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class PieceCodec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = proto.SentencePiece
        if (trainer.model_type != trainer.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix or not trainer.byte_fallback
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)):
            raise ValueError("only BPE models with byte pieces, identity normalization and plain pieces")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.library = SentencePieceProcessor(model_proto=model)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.priority = {p.piece: -p.score for p in proto.pieces if p.type == kinds.NORMAL and len(p.piece) > 1}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.surfaces = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
                         else b" \xe2\x81\x87 " if p.type == kinds.UNKNOWN
                         else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.segments = self._segment_pattern()
        codecs.register_error("replace-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _segment_pattern(self) -> re.Pattern:
        """Cuts before a run of a character that in pieces only follows itself, and
        around characters that stand beside no other in any piece."""
        before: dict[str, set[str]] = {}
        inner = set()
        for piece in self.priority:
            inner.update(piece)
            for a, b in zip(piece, piece[1:]):
                before.setdefault(b, set()).add(a)
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inner)
        starts = [c for c in inner if before.get(c, set()) <= {c}]
        starts = "".join(re.escape(c) for c in starts if not c.isalnum())
        runs = "|".join(f"{c}+" for c in re.findall(r"\\?.", starts, re.S)) or "(?!)"
        return re.compile(f"(?:{runs})[^{starts}{alone}]*+|[^{starts}{alone}]++|[{alone}]", re.S)

    def agenda(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment (or of any marked text)."""
        symbols = list(segment)
        merged = self._merged_in_list(symbols) if len(symbols) <= SHORT else self._merged_in_heap(symbols)
        ids = []
        for symbol in merged:
            found = self.ids.get(symbol)
            if found is not None:
                ids.append(found)
            else:
                ids.extend(self.byte_ids[b] for b in symbol.encode())
        return tuple(ids)

    def _merged_in_list(self, symbols: list[str]) -> list[str]:
        """The agenda as a list with a place for each pair: its first least entry is the next merge."""
        priority, never = self.priority.get, math.inf
        agenda = [priority(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            joined = symbols[i] + symbols[i + 1]
            symbols[i:i + 2] = [joined]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = priority(joined + symbols[i + 1], never)
            if i:
                agenda[i - 1] = priority(symbols[i - 1] + joined, never)
        return symbols

    def _merged_in_heap(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap, for long segments. Entries of merged symbols are passed over."""
        priority, n = self.priority, len(symbols)
        heap = []
        for i in range(n - 1):
            found = priority.get(symbols[i] + symbols[i + 1])
            if found is not None:
                heap.append((found, i, i + 1, 2))
        heapify(heap)
        after, back = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, j, size = heappop(heap)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue
            symbols[i], symbols[j] = joined, _ = left + right, ""
            following = after[i] = after[j]
            if following < n:
                back[following] = i
                found = priority.get(joined + symbols[following])
                if found is not None:
                    heappush(heap, (found, i, following, size + len(symbols[following])))
            previous = back[i]
            if previous >= 0:
                found = priority.get(symbols[previous] + joined)
                if found is not None:
                    heappush(heap, (found, previous, i, len(symbols[previous]) + size))
        return [symbol for symbol in symbols if symbol]

    def cut(self, text: str) -> list[str]:
        """Segments of a text, marked."""
        return self.segments.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def _check(self, segments: list[str]) -> None:
        """Hold new segments against the library.

        The library puts its own mark before a text, so a segment that begins with one is
        given without it, and another one behind a line feed, which merges with nothing.
        """
        lead = len(self.library.encode("\n"))
        whole = [bool(self.prefix) and s[0] == MARK and len(s) > 1 for s in segments]
        texts = [s[1:] if w else "\n" + s for s, w in zip(segments, whole)]
        for segment, w, ids in zip(segments, whole, self.library.encode(texts, num_threads=1)):
            if list(self.recent[segment]) != (ids if w else ids[lead:]):
                raise RuntimeError(f"the library encodes {segment!r} as {ids}, the agenda as {self.recent[segment]}")

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cuts = [self.cut(text or "") for text in texts]
        new = []
        for segments in cuts:
            for segment in segments:
                if segment not in self.recent:
                    known = self.older.get(segment)
                    if known is None:
                        known = self.agenda(segment)
                        new.append(segment)
                    self.recent[segment] = known
        self._check(new)
        recent = self.recent
        encoded = [[i for segment in segments for i in recent[segment]] for segments in cuts]
        if len(recent) > REMEMBERED:
            self.older, self.recent = recent, {}
        return encoded

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.surfaces[i] for i in ids])
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", errors="replace-each-byte")


def piece_ids(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id` and the ids of every whole text."""
    def start():
        codec = PieceCodec(model)
        return lambda texts: {"ids": codec.encode_batch(texts)}

    return map_texts(docs, id_col, text, start, "ids array<int>")


def piece_texts(encoded: DataFrame, model: bytes, id_col: str = "id", ids: str = "ids") -> DataFrame:
    """`id` and the text that the ids decode to."""
    def start():
        codec = PieceCodec(model)
        return lambda rows: {"text": [codec.decode(r or []) for r in rows]}

    return map_texts(encoded, id_col, ids, start, "text string", kind="array<int>")


def piece_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, n_tokens, and SHA-256 of the ids and of the text decoded from them, in one pass."""
    def start():
        codec = PieceCodec(model)
        names = list(map(str, range(len(codec.surfaces))))

        def digests(texts):
            encoded = codec.encode_batch(texts)
            sha = lambda value: hashlib.sha256(value.encode("utf-8")).hexdigest()
            return {"n_tokens": list(map(len, encoded)),
                    "ids_sha256": [sha(",".join([names[i] for i in ids])) for ids in encoded],
                    "decoded_sha256": [sha(codec.decode(ids)) for ids in encoded]}

        return digests

    return map_texts(docs, id_col, text, start, "n_tokens long, ids_sha256 string, decoded_sha256 string")
