"""Operator 2, SentencePiece encoding and decoding with a given model file.

The model at hand is a byte-pair one, whose segmentation is the one that merging pairs by rank gives, not the one of the greatest score sum. Every prefix
of a word has one such segmentation, and its last piece decides it: the last piece t of prefix p is the one whose pair with the last piece of p without t
is stable, that is, no merge across the two would have come before the merges that made them. So the forward pass keeps, instead of a score, the last
piece of each prefix, and a Viterbi recursion over the prefixes gives exactly the library's pieces. The pieces that end a prefix are found by walking a
trie of all pieces' characters from the last to the first, which stops where no piece goes on.

Shared prefixes: the distinct marked words (the mark that stands for a space, and what follows up to the next one) of a batch are sorted, which makes them
the depth-first order of their trie; a word keeps the forward states of the prefix that it shares with the word before and goes on from there. Tables of
words and of stable pairs are kept in each process, bounded in size.

Decoding joins the pieces and bytes back. Texts are normalised as the model says: this module takes models that only escape spaces and add one in
front (checked when loaded).

Defined results: a null or empty text has no pieces; a null doc_id stays null; repeated rows are encoded once each; an empty table gives no rows; other
columns are ignored. A very long text is held whole, with its words and ids, by one task; a very long word costs a step for each of its characters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltgrain.llm.word_tokens import in_slices

MARK = "▁"
SCHEMA = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean"
_LOADED: dict[str, Codec] = {}


class Piece:
    """A piece, or a lone character, as the last one of a prefix: its length, its ids, and the last pieces of the prefix before with which it is stable or not."""

    __slots__ = ("ids", "left", "size", "text")

    def __init__(self, text: str, ids: tuple[int, ...]):
        self.text, self.size, self.ids = text, len(text), ids
        self.left: dict[str, bool] = {}


class Codec:
    """encode() and decode() of a byte-pair model with byte fallback. most: words in each of two tables, one for those lately used; no result depends on it."""

    def __init__(self, path: str, most: int = 100_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback:
            raise ValueError("a byte-pair model with byte fallback is needed")
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("a model that only escapes spaces and adds one in front is needed")
        self.most, self.raw, score = most, [], {}
        id_of: dict[str, int] = {}
        self.byte = [0] * 256
        for i, p in enumerate(spec.pieces):
            self.raw.append(p.piece.encode())
            if p.type == pb.ModelProto.SentencePiece.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                self.raw[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == pb.ModelProto.SentencePiece.NORMAL:
                id_of[p.piece], score[p.piece] = i, p.score
            elif p.type not in (pb.ModelProto.SentencePiece.UNKNOWN, pb.ModelProto.SentencePiece.CONTROL):
                raise ValueError("user-defined and unused pieces aren't provided for")
        if any(MARK in p.lstrip(MARK) for p in id_of):
            raise ValueError("words can't be encoded apart: a piece has a mark inside")
        # A piece of several characters is made by a merge, the sooner the better its score.
        order = {x: n for n, x in enumerate(sorted({score[p] for p in id_of if len(p) > 1}, reverse=True))}
        self.rank = {p: order[score[p]] for p in id_of if len(p) > 1}
        self.parts: dict[str, tuple[str, str] | None] = {}
        #: Pieces by their characters from the last to the first; the piece itself under "".
        self.ends: dict = {}
        for p, i in id_of.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = Piece(p, (i,))
        self.alone: dict[str, Piece] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """Pieces by merging the neighbours whose joint piece scores best, the leftmost of equals, until none is left. Unknown characters stay alone."""
        parts = list(text)
        while True:
            best, at = len(self.rank), -1
            for i, (a, b) in enumerate(pairwise(parts)):
                n = self.rank.get(a + b, best)
                if n < best:
                    best, at = n, i
            if at < 0:
                return parts
            self.last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge joins when merging a piece's characters gives that piece; None if it does not."""
        if piece not in self.parts:
            whole = self.merged(piece)
            self.parts[piece] = self.last if len(whole) == 1 else None
        return self.parts[piece]

    def _stable(self, left: str, right: str) -> bool:
        """Whether the neighbours left and right, each a piece that merging gives, stay apart: undoes their merges, the later one first, and sees whether what
        then faced each other would have merged before. Of merges of one rank the leftmost comes first."""
        sooner = len(self.rank)
        while True:
            if self.rank.get(left + right, sooner) < sooner:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a > b:
                sooner, left = a, self._parts(left)[1]
            elif b >= 0:
                sooner, right = b + 1, self._parts(right)[0]
            else:
                return True

    def _ends(self, word: str, end: int, last: list[Piece]) -> Piece:
        """The last piece of the first ``end`` characters of word; last: those of the shorter prefixes."""
        node, start = self.ends, end
        while start:
            start -= 1
            node = node.get(word[start])
            if node is None:
                break
            piece = node.get("")
            if piece is None:
                continue
            left = last[start].text
            fits = piece.left.get(left)
            if fits is None:
                if piece.size > 1 and self._parts(piece.text) is None:
                    del node[""]
                    continue
                fits = piece.left[left] = not left or self._stable(left, piece.text)
                self.n_pairs += 1
            if fits:
                return piece
        character = word[end - 1]
        if character in self.ends and "" in self.ends[character]:
            raise ValueError("a prefix has no segmentation")
        piece = self.alone.get(character)  # no piece ends with it, so it is bytes
        if piece is None:
            piece = self.alone[character] = Piece(character, tuple(self.byte[b] for b in character.encode()))
        return piece

    def _forget_pairs(self) -> None:
        nodes, self.n_pairs, self.alone = [self.ends], 0, {}
        while nodes:
            for key, node in nodes.pop().items():
                if key:
                    nodes.append(node)
                else:
                    node.left = {}

    def _learn(self, words: list[str]) -> None:
        """Encodes words in sorted order. last[i]: the last piece of the prefix of i characters of the word at hand."""
        before, last, known, ends = "", [Piece("", ())], self.words, self._ends
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                last.append(ends(word, end, last))
            end, ids = len(word), ()
            while end:
                ids = last[end].ids + ids
                end -= last[end].size
            known[word], before = ids, word

    def cut(self, text: str) -> list[str]:
        """The marked words of a text: each a run of marks and what follows up to the next mark."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return _WORD.findall(marked)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.words) > self.most:
            self.words, self.older = {}, self.words
        if self.n_pairs > 5 * self.most:
            self._forget_pairs()
        known, out = self.words, list(map(self.cut, texts))
        fresh = {w for words in out for w in words if w not in known}
        again = [w for w in fresh if w in self.older]
        for w in again:
            known[w] = self.older[w]
        self._learn(list(fresh.difference(again)))
        for i, words in enumerate(out):
            out[i] = list(chain.from_iterable(map(known.__getitem__, words)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _pattern():
    import re

    return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


_WORD = _pattern()


def worker_codec(path: str) -> Codec:
    """The codec of this process, loaded once and kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip: whether decoding
    gives back the text; with_ids: also ids, an array."""
    names = ["doc_id", "n_pieces", "ids_crc32", "round_trip", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for doc_ids, raw in in_slices(batches):
            texts = [t.decode("utf-8", "replace") for t in raw]
            found = codec.encode(texts)
            columns = [
                doc_ids.cast(pa.int64()),
                pa.array(list(map(len, found)), pa.int64()),
                pa.array([zlib.crc32(np.array(x, "<u4").tobytes()) for x in found], pa.int64()),
                pa.array([codec.decode(x) == t for x, t in zip(found, texts, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found, pa.list_(pa.int32()))] * with_ids, names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows doc_id, ids; a null ids gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
