"""SentencePiece encoding and decoding of whole texts by a streaming Viterbi decoder.

The given vocabulary is of the merging (BPE) kind, whose ids a search for the best sum of scores would not give. The
decoder's transition score is therefore 0 for two neighbouring pieces that the merges leave as they are when they
stand alone together, and minus infinity for any other two. Under it exactly one path reaches each position, and the
path to the end is the library's own encoding; tests compare the two. Only a window of backpointers is held, and ids
are committed whenever all paths of the window have gone through one boundary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Per generation; two generations of each are kept, and what is used moves to the younger.
CACHED_WORDS, CACHED_PAIRS = 600_000, 500_000
#: A word up to this long is remembered by workers.
LONG_WORD = 64

_loaded: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder over one model file; the file gives pieces and scores only."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.octet = {i: b for b, i in self.bytes.items()}
        self.marked = ["\0" if i in self.octet else p for i, p in enumerate(self.pieces)]
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        #: pieces that the merges ever end with
        self.stable = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        #: the longest of them by their last two characters
        self.reach: dict[str, int] = {}
        for p in self.stable:
            if len(p) > 1:
                self.reach[p[-2:]] = max(self.reach.get(p[-2:], 1), len(p))
        #: neighbouring characters within pieces: no piece, and so no path, crosses a boundary between any other two
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.old_pairs: dict[tuple[str, str], bool] = {}
        self.old_words: dict[str, bytes] = {}
        # where no piece has a space mark behind another character, words can be encoded on their own
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.split = re.compile(r"(?s).+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short string: the best-scored neighbours first, the leftmost of equal ones."""
        get, none = self.scores.get, -np.inf
        parts = list(text)
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (top := max(scores)) > none:
            i = scores.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def may_meet(self, pair: tuple[str, str]) -> bool:
        """Whether the merges leave two pieces apart; called for pairs that are not in self.pairs."""
        if (found := self.old_pairs.get(pair)) is None:
            found = self.merged(pair[0] + pair[1]) == list(pair)
        if len(self.pairs) >= CACHED_PAIRS:
            self.old_pairs, self.pairs = self.pairs, {}
        self.pairs[pair] = found
        return found

    def segments(self, text: str, window: int | None = None) -> Iterator[str]:
        """Pieces of the text, in order, each yielded as soon as every surviving path has it."""
        window = max(window or 4 * self.longest, 2 * self.longest)
        back: list[str] = [""]  # back[j]: the piece that ends at start + j on the only path there
        start = 0
        stable, reach = self.stable, self.reach
        for end in range(1, len(text) + 1):
            j = end - start
            waiting = None  # one path reaches each position, so the last candidate need not be tried
            for at in range(max(0, j - reach.get(text[max(end - 2, 0) : end], 1)), j):
                before = back[at]
                if before is None:
                    continue
                piece = text[start + at : end]
                if piece in stable or at == j - 1:
                    if waiting is not None:
                        ok = not waiting[0] or (self.pairs[waiting] if waiting in self.pairs else self.may_meet(waiting))
                        if ok:
                            break
                    waiting = (before, piece)
            back.append(waiting and waiting[1])
            if j >= window:
                at = {k for k in range(j - self.longest + 1, j + 1) if back[k] is not None}
                while len(at) > 1:
                    k = max(at)
                    at.remove(k)
                    at.add(k - len(back[k]))
                if (common := at.pop()) > 0:
                    yield from self._path(back, common)
                    back = [back[common], *back[common + 1 :]]
                    start += common
        yield from self._path(back, len(text) - start)

    @staticmethod
    def _path(back: list[str], end: int) -> list[str]:
        path = []
        while end > 0:
            path.append(back[end])
            end -= len(back[end])
        return path[::-1]

    def _ids(self, pieces: Iterator[str]) -> Iterator[int]:
        for p in pieces:
            if p in self.ids:
                yield self.ids[p]
            elif self.bytes:
                yield from (self.bytes[b] for b in p.encode())
            else:
                yield self.unknown

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not in self.words, as little-endian unsigned 32-bit numbers; remembered if it is short."""
        if len(word) > LONG_WORD:
            return np.fromiter(self._ids(self.segments(word)), "<u4").tobytes()
        if (found := self.old_words.get(word)) is None:
            inside = self.inside
            cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
            if cuts:
                parts = (word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True))
                found = b"".join(self.words[x] if x in self.words else self._word(x) for x in parts)
            else:
                found = b"".join(i.to_bytes(4, "little") for i in self._ids(self.segments(word)))
        if len(self.words) >= CACHED_WORDS:
            self.old_words, self.words = self.words, {}
        self.words[word] = found
        return found

    def encode_bytes(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        parts, get = [], self.words.get
        for word in self.split(SPACE + text.replace(" ", SPACE)):
            if (found := get(word)) is None:
                found = self._word(word)
                get = self.words.get
            parts.append(found)
        return b"".join(parts)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = "".join(map(self.marked.__getitem__, ids))
        if "\0" in text:  # a byte piece: neighbouring ones are decoded together
            out, raw = [], bytearray()
            for i in ids:
                if i in self.octet:
                    raw.append(self.octet[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.pieces[i])
            text = "".join(out) + raw.decode("utf-8", "replace")
        return text.replace(SPACE, " ").removeprefix(" ")


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _path(model: str | None) -> str:
    return model or public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): one row per input row; null and empty texts have no ids. Other columns are ignored."""
    path = _path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 500):
                ids = [np.frombuffer(codec(path).encode_bytes(t), "<i4") for t in texts[i : i + 500]]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i : i + 500], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). A space mark in the original comes back as a space; null ids are an empty text."""
    path = _path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [codec(path).decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), restored.

    restored: decoding the ids gives the text again (a null text: the empty one). Repeated rows and null ids are kept,
    other columns are ignored, and an empty table gives no rows.
    """
    path = _path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                raw = codec(path).encode_bytes(text)
                back = codec(path).decode(np.frombuffer(raw, "<u4").tolist())
                rows.append((len(raw) // 4, zlib.crc32(raw), back == (text or "").replace(SPACE, " ")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.bool_())))], names=["doc_id", "n_ids", "ids_crc32", "restored"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, restored boolean")
