"""Token ids of a public tokenizer inside Python workers, a block of texts at a time.

For a tokenizer that lower-cases and parts texts at white space, a block's bytes are cut into words and what follows them, equal
pieces are found by Arrow, only pieces not seen before are encoded, and the ids are laid out by numpy: Python's work is per distinct
piece. Other tokenizers encode whole texts.
"""

from __future__ import annotations

import array
import itertools
import json
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkContext

from fleetcast.llm.common import text_bytes

#: Pieces and bytes of pieces that fill a worker's memory; only speed depends on them. Bytes of text that are cut up, and words
#: encoded, at once.
PIECES, HELD, SLICE, JOINED = 300_000, 16 << 20, 5 << 19, 500

# The normalizer and pre-tokenizer of definitions whose ids are those of the pieces between spaces, one after another.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_LETTER, _MARK, _OTHER = 1, 2, 3
_CLASSES = bytes(
    0 if c in b" \n" else _LETTER if chr(c) in string.ascii_letters else _MARK if 0x20 < c < 0x7F else _OTHER for c in range(256)
)
_LOWER = bytes(range(256)).lower()


def parts_at_spaces(definition: str) -> bool:
    known = json.loads(definition)
    return known.get("normalizer") == _NORMALIZER and known.get("pre_tokenizer") == _PRE_TOKENIZER


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with ASCII and Latin letters in lower case, and the class of each byte: 0 space or line feed, letter, ASCII
    that is no letter, other."""
    raw = bytearray(data)
    out, kind = (np.frombuffer(raw.translate(table), np.uint8) for table in (_LOWER, _CLASSES))
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
    out[lead[letter & (second <= 0x9E)] + 1] += 0x20
    return out, kind


def cut(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of some bytes, and where each begins.

    Between spaces, letters followed by ASCII that is none are a word, in lower case, and its tail; anything else is one piece, as it is.
    """
    text, kind = _lowered(data)
    solid = kind > 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return pa.array([], pa.binary()), first
    mark, letter = kind == _MARK, kind == _LETTER
    odd = kind == _OTHER
    odd[1:] |= letter[1:] & mark[:-1]
    begins[1:] |= mark[1:] & letter[:-1]  # from letters to a tail
    whole = np.zeros(len(first), bool)  # chunks that stay as they are
    whole[np.searchsorted(first, np.flatnonzero(odd), side="right") - 1] = True
    if whole.any():
        sides = np.zeros(len(data) + 1, np.int8)
        sides[first[whole]] = 1
        sides[np.append(first[1:], len(data))[whole]] -= 1
        inside = np.cumsum(sides[:-1], dtype=np.int8).view(bool)
        np.copyto(text, data, where=inside)
        begins[inside] = False
        begins[first[whole]] = True
    at = np.flatnonzero(begins)
    place = np.cumsum(solid, dtype=np.int32)
    offsets = np.append(place[at] - 1, place[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(text[solid])]), at


class Tokens:
    """Ids of whole texts, without special tokens, and a memory of the pieces already encoded: when it is full, the half that fewer
    slices of text had is forgotten."""

    def __init__(self, definition: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.in_pieces = parts_at_spaces(definition)
        #: The pieces, each with its place in sizes and uses; their ids one after another; how many bytes the pieces have.
        self.known: dict[bytes, int] = {}
        self.flat, self.sizes, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.held = 0
        if self.in_pieces:
            suffix = json.loads(definition)["model"]["end_of_word_suffix"]
            vocabulary = tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array.array("I", e.ids), np.uint32) for e in self.encode(texts, add_special_tokens=False)]

    def _encoded_words(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and the number of each word's, JOINED words at a time: a run of letters is one word, whose last token says so."""
        blocks = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        found = []
        for ids, own in zip(self._encoded([" ".join(b) for b in blocks]), blocks, strict=True):
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):
                found.append((ids, np.diff(ends, prepend=0)))
            else:
                found += [(part, np.array([len(part)])) for part in self._encoded(own)]
        return found

    def _remember(self, pieces: list[bytes]) -> None:
        texts = b"\n".join(pieces).decode().split("\n")
        is_word = list(map(str.isalpha, texts))
        no_word = [not w for w in is_word]
        found = self._encoded_words(list(itertools.compress(texts, is_word)))
        found += [(part, np.array([len(part)])) for part in self._encoded(list(itertools.compress(texts, no_word)))]
        for kind in (is_word, no_word):
            self.known.update(zip(itertools.compress(pieces, kind), itertools.count(len(self.known))))
        self.flat = np.concatenate([self.flat, *(ids for ids, _ in found)])
        self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in found)])
        self.uses = np.append(self.uses, np.zeros(len(pieces), np.int32))
        self.held += sum(map(len, pieces))

    def _forget(self) -> None:
        keep = self.uses > np.median(self.uses)
        self.flat = self.flat[np.repeat(keep, self.sizes)]
        self.sizes, self.uses = self.sizes[keep], self.uses[keep] // 2
        # the pieces are in the order of their places
        self.known = dict(zip(itertools.compress(self.known, keep.tolist()), itertools.count()))
        self.held = sum(map(len, self.known))

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where the memory has these distinct pieces."""
        if len(self.known) > PIECES or self.held > HELD:
            self._forget()
        places = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            unseen = [pieces[k] for k in missing.tolist()]
            self._remember(unseen)
            places[missing] = np.fromiter(map(self.known.__getitem__, unseen), np.int64, len(unseen))
        self.uses[places] += 1
        return places

    def _slice(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some bytes, and how many belong to each of the texts that begin at `bounds`."""
        pieces, at = cut(data)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        distinct = pieces.dictionary_encode()
        # no piece has a line feed
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct.dictionary)], distinct.dictionary), b"\n")
        places = self._places(joined[0].as_py().split(b"\n"))
        size, start = self.sizes[places], (np.cumsum(self.sizes) - self.sizes)[places]
        own = distinct.indices.to_numpy()
        lengths = size[own]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(start[own] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        upto = np.concatenate([[0], ends])[np.searchsorted(at, np.append(bounds, len(data)))]
        return ids, np.diff(upto)

    def ids(self, text: str) -> bytes:
        """The ids of one text, 32-bit."""
        return self.of_texts(pa.array([text.encode()], pa.binary()))[0].astype(np.uint32).tobytes()

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of each; nulls have none."""
        if not self.in_pieces:
            found = self._encoded(["" if t is None else t.decode() for t in texts.to_pylist()])
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))
        data, offsets = text_bytes(texts)
        # a space after each text
        data = np.insert(data, offsets[1:], 0x20) if len(data) else np.full(len(texts), 0x20, np.uint8)
        bounds = (offsets + np.arange(len(offsets)))[:-1]
        found, lengths, low = [], np.zeros(len(texts), np.int64), 0
        while low < len(data):
            high = min(low + SLICE, len(data))
            if high < len(data):  # up to the end of a piece
                rest = data[high:]
                high += int(np.argmax((rest == 0x20) | (rest == 0x0A)))
            first, last = np.searchsorted(bounds, [low, high], side="right")
            own = np.maximum(bounds[first - 1 : last] - low, 0)
            ids, counts = self._slice(data[low:high], own)
            found.append(ids)
            lengths[first - 1 : last] += counts
            low = high
        return np.concatenate(found) if found else np.zeros(0, np.uint32), lengths


def shared(sc: SparkContext, path: str) -> Broadcast:
    """The definition of the tokenizer of the file at `path`, which only the driver opens; its size is that of the file."""
    with open(path, encoding="utf-8") as f:
        return sc.broadcast({"definition": f.read()})


def of_worker(sent: Broadcast) -> Tokens:
    """The tokens of this worker: made once, then kept beside the definition for its later tasks."""
    held = sent.value
    if "tokens" not in held:
        held["tokens"] = Tokens(held["definition"])
    return held["tokens"]
