"""SentencePiece (BPE model) encoding and decoding with a prefix table.

A merge-type (BPE) encoding is right exactly when each pair of neighbouring tokens is what BPE makes of the two together. So every
prefix of a text has one last token: the piece that ends there, follows the last token of the prefix before it, and is compatible with
it. An Aho-Corasick automaton lists the pieces that end at each place, compatibility is looked up (or found once by merging the pair),
and the ids are recovered from the end of the text backwards. The cost is linear in the text, whatever its words look like.

No piece spans certain pairs of characters (a character before a word mark; a line break and anything), so a text is cut there and the
parts, which repeat, are looked up in a bounded table per task. Decoding reads each document's own list of ids: the bytes of every id are
gathered from one table, so it knows nothing of the text that was encoded, and `decode_documents` takes ids from anywhere.
Null is an empty text: begin and end ids only. Rows are independent: repeated rows, empty tables and other columns need no care.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.frames import per_batch, picked

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
# Parts of texts whose ids a task remembers at most (two generations of them), characters of the longest that it does, and pairs.
REMEMBERED = 250_000
REMEMBERED_CHARS = 64
REMEMBERED_PAIRS = 2_000_000
DECODED_IDS = 1 << 20

# The library writes one U+FFFD for each byte that is not UTF-8.
codecs.register_error("veilspark-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PieceModel:
    """Pieces, scores and kinds of a BPE model file with the identity normaliser and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("not a BPE model with the identity normaliser")
        if not model.trainer_spec.byte_fallback or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("byte fallback and no denormaliser are expected")
        kinds = [p.type for p in model.pieces]
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.text = {i: p.piece for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.unknown_text = model.trainer_spec.unk_surface
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        # Place of each piece in the order of merges; a single character is there before any.
        order = sorted(self.text, key=lambda i: self.rank[self.text[i]])
        self.turn = {i: k + 1 if len(self.text[i]) > 1 else 0 for k, i in enumerate(order)}
        self.single = {p for p in self.rank if len(p) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = len(kinds)
        self.cut = self._cuts()
        self._decoding()

    def _cuts(self) -> re.Pattern:
        """Parts between which no piece can stand: none holds a mark after another character, none holds a line break with others."""
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece holds a word mark after another character")
        alone = "".join(c for c in "\n\t" if not any(c in p and len(p) > 1 for p in self.rank))
        return re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")

    def merged(self, text: str, until: int = 1) -> list[str]:
        """BPE by its definition, down to `until` parts: merge the neighbours whose piece has the best score, leftmost first."""
        parts = list(text)
        while len(parts) > until:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        return parts

    def halves_of(self, token: int) -> tuple[int, int]:
        """The two pieces whose merge makes the piece; (-1, -1) for one character, or if BPE does not make it."""
        found = self.halves.get(token)
        if found is None:
            parts = self.merged(self.text[token], 2)
            made = len(parts) == 2
            found = self.halves[token] = (self.rank[parts[0]][1], self.rank[parts[1]][1]) if made else (-1, -1)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the two pieces side by side as they are. left < 0: nothing, or no piece, stands before."""
        key = (left << 32) + right
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) >= REMEMBERED_PAIRS:
                self.fits.clear()
            fit = self.fits[key] = self._stands(right) if left < 0 else self._stands(left) and self._stands(right) and self._apart(left, right)
        return fit

    def _stands(self, token: int) -> bool:
        return len(self.text[token]) == 1 or self.halves_of(token)[0] >= 0

    def _apart(self, left: int, right: int) -> bool:
        """Undo the merges of both pieces, latest first: at no stage may the two parts at the border have been merged before."""
        text, turn = self.text, self.turn
        if text[left][-1] == MARK and text[right][-1] == MARK:
            # Runs of marks share one score, so their order of merging is not that of pieces.
            return self.merged(text[left] + text[right]) == [text[left], text[right]]
        # Merges up to this turn have been made when the parts at the border stand as they are.
        done = len(turn) + 1
        while True:
            joint = self.rank.get(text[left] + text[right])
            if joint is not None and turn[joint[1]] <= done:
                return False
            if not turn[left] and not turn[right]:
                return True
            # Of equal merges the left one comes first: before one inside `left`, after one inside `right`.
            if turn[left] > turn[right]:
                done, left = turn[left] - 1, self.halves_of(left)[1]
            else:
                done, right = turn[right], self.halves_of(right)[0]

    def ids(self, part: str) -> list[int]:
        """Ids of a part with its marks. last[k]: token that ends before k; -1 at the start and after a character without a piece, -3 none."""
        last, width = [-3] * (len(part) + 1), [1] * (len(part) + 1)
        last[0] = -1
        if not self.single.issuperset(part):
            for k, c in enumerate(part):
                if c not in self.single:
                    last[k + 1] = -1
        known = self.fits.get
        for at, (size, token) in self.automaton.iter(part):
            at += 1
            if last[at] == -3 and (before := last[at - size]) != -3:
                fit = known((before << 32) + token)
                if fit or fit is None and self.compatible(before, token):
                    last[at], width[at] = token, size
        out, at = [], len(part)
        while at:
            if last[at] == -1:
                out += [self.byte_id[b] for b in reversed(part[at - 1].encode())]
            else:
                out.append(last[at])
            at -= width[at]
        out.reverse()
        return out

    def _decoding(self) -> None:
        """Bytes of every id, one after another, and where each begins. The word mark is a space; control ids have none."""
        parts = []
        for i in range(self.size):
            text = self.text.get(i)
            parts.append(bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent else (self.unknown_text if text is None else text.replace(MARK, " ")).encode())
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.length = np.array([len(x) for x in parts])
        self.start = np.cumsum(self.length) - self.length
        kind = lambda some: np.isin(np.arange(self.size), list(some))
        self.is_byte, self.is_silent = kind(self.byte_of), kind(self.silent)
        self.is_marked = kind(i for i, t in self.text.items() if self.prefix and t.startswith(self.prefix))

    def decoded(self, ids: np.ndarray) -> bytes:
        """Text of ids, in UTF-8. Runs of byte ids are UTF-8, each byte of them that is not becomes U+FFFD. The mark that encoding puts
        first is left out. Long lists are decoded in parts, cut where no run of byte ids is."""
        ids = np.asarray(ids, np.int64)
        first = np.flatnonzero(~self.is_silent[ids[:64]])
        if not len(first):
            first = np.flatnonzero(~self.is_silent[ids])
        marked = len(first) and self.is_marked[ids[first[0]]]
        out, at = [], 0
        while at < len(ids):
            end = min(at + DECODED_IDS, len(ids))
            while end < len(ids) and self.is_byte[ids[end - 1]]:
                end += 1
            out.append(self._joined(ids[at:end]))
            at = end
        text = b"".join(out)
        return text[1:] if marked else text

    def _joined(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        raw = self.blob[np.repeat(self.start[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()
        if not self.is_byte[ids].any():
            return raw
        # A control id ends a run too, though it leaves nothing in the text.
        kind = self.is_byte[ids].astype(np.int8) - self.is_silent[ids]
        try:
            if not (kind[1:-1] < 0).any():
                # What stands between runs is whole characters: all is UTF-8 exactly if each run is.
                raw.decode()
                return raw
        except UnicodeDecodeError:
            pass
        cuts = [0, *ends[np.flatnonzero(np.diff(kind))].tolist(), len(raw)]
        return b"".join(raw[a:b].decode("utf-8", "veilspark-each-byte").encode() for a, b in zip(cuts[:-1], cuts[1:]))

    def part(self, part: str) -> bytes:
        """Ids of a part as little-endian 32-bit numbers; remembered if short."""
        held = self.new.get(part)
        if held is None:
            held = self.old.get(part)
            if held is None:
                held = np.array(self.ids(part), "<u4").tobytes()
            if len(part) <= REMEMBERED_CHARS:
                if len(self.new) >= REMEMBERED:
                    self.new, self.old = {}, self.new
                self.new[part] = held
        return held

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, packed."""
        ends = np.array([self.begin, self.end], "<u4").tobytes()
        if not text:
            return ends
        return b"".join([ends[:4], *map(self.part, self.cut.findall((self.prefix + text).replace(" ", MARK))), ends[4:]])

    def both(self, text: str) -> tuple[bytes, bytes]:
        """Packed ids of a text, and the text of these ids."""
        ids = self.encode(text)
        return ids, self.decoded(np.frombuffer(ids, "<u4"))


@lru_cache(maxsize=2)
def loaded(path: str) -> PieceModel:
    return PieceModel(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ids (array), and the decoded text."""
    return _run(docs, path, id_col, text_col, "ids array<int>, decoded string", _whole)


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, SHA-256 of the ids as little-endian 32-bit numbers, SHA-256 of the decoded text."""
    return _run(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _run(docs: DataFrame, path: str | None, id_col: str, text_col: str, columns: str, shape) -> DataFrame:
    frame = picked(docs, doc_id=id_col, text=text_col)
    file = path or model_path()

    def make(batch: pa.RecordBatch) -> dict:
        model = loaded(file)
        texts: Iterator[str] = (x.as_py() or "" for x in batch.column("text"))
        return {"doc_id": batch.column("doc_id")} | shape(map(model.both, texts))

    return per_batch(frame, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, {columns}", make)


def _whole(found: Iterator[tuple[bytes, bytes]]) -> dict:
    ids, decoded = zip(*found) if (found := list(found)) else ((), ())
    values = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
    return {"ids": pa.array(values, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.binary()).cast(pa.string())}


def _digests(found: Iterator[tuple[bytes, bytes]]) -> dict:
    rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) for ids, text in found]
    n, a, b = zip(*rows) if rows else ((), (), ())
    return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}


def decode_documents(frame: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the text of a list of ids, from wherever it comes. A null list is an empty one; an id that the model lacks is an error."""
    rows = picked(frame, doc_id=id_col, ids=ids_col)
    file = path or model_path()

    def make(batch: pa.RecordBatch) -> dict:
        model = loaded(file)
        texts = [model.decoded(np.array(x.as_py() or [], np.int64)) for x in batch.column("ids")]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.binary()).cast(pa.string())}

    return per_batch(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string", make)
