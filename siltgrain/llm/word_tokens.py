"""Token ids of whole texts by a ``tokenizers`` file, with each distinct word encoded once.

Valid for tokenizers whose pre-tokens never span white space (checked when the file is loaded): a text's ids are then those of its words, one after
the other. Words are kept per worker process in a table of bounded size; the letter-only pieces of new words are merged by ``tiktoken`` over the file's
own vocabulary, which takes a tenth of the time that the file's whole chain takes, and everything else goes through the chain.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, compress, count, pairwise

import numpy as np
import pyarrow as pa

from siltgrain.llm.common import ragged, slices, text_bytes

LETTERS = "a-zß-öø-ÿā-ıĳ-ňŊ-ž"
#: Words of these characters are cut and lowered here as the file's own rules do; all other words go through the file's whole chain.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įıĲ-ňŊ-ž]+")
PLAIN_LINES = re.compile(r"[!-~À-ÖØ-öø-įıĲ-ňŊ-ž\n]*")
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|\n|[^{LETTERS}0-9\n]+")
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOADED: dict[tuple[str, int], WordTokenizer] = {}
#: The last byte of a piece carries the end-of-word mark: an ASCII letter as its capital, which lowered text lacks, a later byte of a character as a control.
_MARKED = np.arange(256, dtype=np.uint8)
_MARKED[97:123] -= 32
_MARKED[128:192] -= 128
_APART = 0xFF


class _Lists:
    """Lists of ids, one after the other."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def ids(self, number: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[number], self.lengths[number])]

    def with_more(self, more: _Lists) -> _Lists:
        return _Lists(np.concatenate([self.flat, more.flat]), np.concatenate([self.lengths, more.lengths]))


def _mixed(first: list[list[int]], is_first: np.ndarray, second: list[list[int]]) -> _Lists:
    """The lists of first, where is_first holds, among those of second."""
    lengths = np.empty(len(is_first), np.int64)
    lengths[is_first], lengths[~is_first] = list(map(len, first)), list(map(len, second))
    of_first = np.repeat(is_first, lengths)
    flat = np.empty(len(of_first), np.uint32)
    flat[of_first], flat[~of_first] = list(chain.from_iterable(first)), list(chain.from_iterable(second))
    return _Lists(flat, lengths)


def _bytes_of_marks() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 characters stand for themselves, the other bytes for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _letter_encoder(spec: dict):
    """What merges the bytes of a lowered letter-only piece whose last byte is marked. Ids are in the order of merges, so they serve as ranks."""
    import tiktoken

    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
    if any(x >= y for x, y in pairwise(made)) or made and made[0] < 512 or spec["model"].get("ignore_merges"):
        raise ValueError("the ids of merged tokens are not in the order of merges")
    byte, ranks = _bytes_of_marks(), {}
    letter = {*range(97, 123), 0xC3, 0xC4, 0xC5, *range(128, 192)}
    for token, i in vocab.items():
        plain = token.removesuffix("</w>")
        if not all(c in byte and byte[c] in letter for c in plain):
            continue
        raw = bytearray(byte[c] for c in plain)
        if plain != token:
            if raw[-1] >= 192:
                continue  # no character ends so
            raw[-1] = _MARKED[raw[-1]]
        ranks[bytes(raw)] = i
    return tiktoken.Encoding("letters", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordTokenizer:
    """encode() of many texts at once. most: about the number of distinct words kept; beyond it the rarer half goes, which changes no result. A table of
    100,000 words takes some 20 MB."""

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        rules = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if SPLIT_RULE not in rules or spec["model"].get("end_of_word_suffix") != "</w>" or not all(x["content"].startswith("<|") for x in spec["added_tokens"]):
            raise ValueError(f"{path}: its words can't be encoded apart")
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = _letter_encoder(spec)
        self.number: dict[bytes, int] = {}
        self.lists, self.uses = _Lists(np.zeros(0, np.uint32), np.zeros(0, np.int64)), np.zeros(0, np.int64)

    def _chain(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)] if pieces else []

    def _of_pieces(self, pieces: list[str]) -> _Lists:
        """The ids of each piece: letter-only ones by merging, others by the file's chain. A line feed has no ids."""
        is_word = np.array(list(map(str.isalpha, pieces)), bool)
        raw = np.frombuffer(" ".join([*compress(pieces, is_word.tolist()), ""]).encode(), np.uint8).copy()
        apart = np.flatnonzero(raw == 32)
        raw[apart - 1] = _MARKED[raw[apart - 1]]
        raw[apart] = _APART
        found = list(map(self.letters, raw.tobytes().split(bytes([_APART]))[:-1]))
        return _mixed(found, is_word, self._chain(["" if p == "\n" else p for p in compress(pieces, (~is_word).tolist())]))

    def _of_words(self, fresh: list[bytes]) -> _Lists:
        text = b"\n".join(fresh).decode("utf-8", "replace")
        words = text.split("\n")
        plain = np.ones(len(words), bool)
        if "<|" in text or not PLAIN_LINES.fullmatch(text):
            plain = np.array([PLAIN.fullmatch(w) is not None and "<|" not in w for w in words], bool)
            text = "\n".join(compress(words, plain.tolist()))
        cut = PIECES.findall(text.lower() + "\n")
        pieces = dict(zip(dict.fromkeys(cut), count()))
        at = np.fromiter(map(pieces.__getitem__, cut), np.int64, len(cut))
        lists = self._of_pieces(list(pieces))
        others = self._chain(list(compress(words, (~plain).tolist())))
        closes = np.flatnonzero(at == pieces["\n"]) + 1 if plain.any() else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(lists.lengths[at])])
        lengths = np.empty(len(words), np.int64)
        lengths[plain], lengths[~plain] = np.diff(total[closes], prepend=0), list(map(len, others))
        of_plain = np.repeat(plain, lengths)
        flat = np.empty(len(of_plain), np.uint32)
        flat[of_plain], flat[~of_plain] = lists.ids(at), list(chain.from_iterable(others))
        return _Lists(flat, lengths)

    def _thin(self) -> None:
        """Keeps the words in use above the median, and at most half, with their uses halved."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.number) // 2])
        keep = keep[self.uses[keep] > 1]
        words = list(self.number)
        self.number = dict(zip(map(words.__getitem__, keep.tolist()), count()))
        self.lists, self.uses = _Lists(self.lists.ids(keep), self.lists.lengths[keep]), self.uses[keep] // 2

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): those of text i are ids[offsets[i]:offsets[i + 1]], with ``end`` after each text if it is given."""
        if len(self.number) > self.most:
            self._thin()
        words, counts = [], []
        for text in texts:
            # Of bytes: at ASCII white space only, which every pre-token respects. Lower case for ASCII letters only, which the tokenizer would
            # give them anyway, but not where it could make up the name of a special token.
            own = (text if b"<|" in text else text.lower()).split()
            words += own
            counts.append(len(own))
        fresh = list(set(words).difference(self.number))
        if fresh:
            self.number.update(zip(fresh, count(len(self.number))))
            self.lists = self.lists.with_more(self._of_words(fresh))
        code = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        del words
        uses = np.bincount(code, minlength=len(self.number))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        ids = self.lists.ids(code)
        of_text = np.concatenate([[0], np.cumsum(self.lists.lengths[code])])[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])]
        if end is None:
            return ids, of_text
        out, n = np.empty(len(ids) + len(texts), np.uint32), np.arange(len(texts) + 1)
        closes = of_text[1:] + n[:-1]
        keep = np.ones(len(out), bool)
        keep[closes] = False
        out[keep], out[closes] = ids, end
        return out, of_text + n


def worker_tokenizer(path: str, most: int = 100_000) -> WordTokenizer:
    """The tokenizer of this process, loaded once and kept between tasks."""
    if (path, most) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _LOADED[path, most] = WordTokenizer(path, most)
    return _LOADED[path, most]


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; a null as an empty one."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_slices(batches, most: int = 1 << 20):
    """(doc_id column, texts) of a stream of batches of doc_id and text, some ``most`` bytes of text at a time."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets, most):
            yield batch.column(0).slice(a, b - a), texts_of(batch.column(1).slice(a, b - a))
