"""Token ids of whole texts with a byte-level BPE file of the tokenizers library, fast enough for a corpus.

The pre-tokenizer of such a file always cuts between a character that isn't white space and a following space,
so a text is split there and each distinct piece is encoded once per worker (see Memo). Ids are those of
Tokenizer.encode(text, add_special_tokens=False); files of another make are encoded without the split. Of many texts
together, pieces are told apart by 64-bit hash, so that each different one is looked up once.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from .memo import Memo
from .words import piece_hashes

#: After letters, a run of these is one pre-token up to white space.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^`{|}~'
#: Ids of pieces that a worker keeps, about.
MOST_IDS = 5_000_000
_CUT = re.compile(r"(?<=\S) (?! )")


def _byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: printable Latin-1 as it is, others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in kept else next(rest)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBPE:
    """Encoder for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        added = [x for x in spec.get("added_tokens", []) if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"])]
        self.by_piece = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not added and spec.get("normalizer") is None and spec.get("post_processor") is None and spec["model"]["type"] == "BPE"
        self.table = str.maketrans({chr(i): c for i, c in enumerate(_byte_letters())})
        self.model = self.tokenizer.model
        self.pieces = Memo(self._piece, 8 << 20)
        self.runs = Memo(self._word)
        # Pieces seen, by sorted hash: where their ids begin in the arena, and how many there are.
        self.keys, self.spans, self.arena, self.used = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64), np.zeros(0, "<u4"), 0

    def _ids(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """Of a pre-token, which holds no special token."""
        written = word if word[0] == "\u0120" else word.encode().decode("latin-1").translate(self.table)
        return _packed([x.id for x in self.model.tokenize(written)])

    def _piece(self, piece: str) -> bytes:
        """Of a piece that follows a space in the text."""
        if piece.isalpha():
            return self._word("\u0120" + piece) if piece.isascii() else self._word(" " + piece)
        stem = piece.rstrip(_MARKS)
        if stem.isalpha():
            return self.pieces[stem] + self.runs[piece[len(stem) :]]
        return self._ids(" " + piece)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece:
            return self._ids(text)
        pieces = text.split(" ") if "  " not in text else _CUT.split(text)
        return self._ids(pieces[0]) + b"".join(map(self.pieces.__getitem__, pieces[1:])) if pieces[1:] else self._ids(pieces[0])


    def _looked_up(self, hashes: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, count) in the arena of the ids of each piece; hashes are sorted. Pieces not seen yet are encoded; beyond MOST_IDS ids the arena starts anew."""
        if self.used > MOST_IDS:
            self.keys, self.spans, self.used = self.keys[:0], self.spans[:, :0], 0
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(new):
            found = [self._known(data[s:e].decode()) for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            ids = np.frombuffer(b"".join(found), "<u4")
            counts = np.array([len(x) >> 2 for x in found], np.int64)
            self._behind(ids)
            spans = np.stack([np.cumsum(counts) - counts + self.used, counts])
            self.used += len(ids)
            into = np.searchsorted(self.keys, hashes[new])
            self.keys, self.spans = np.insert(self.keys, into, hashes[new]), np.insert(self.spans, into, spans, axis=1)
            at = np.searchsorted(self.keys, hashes)
        return self.spans[0, at], self.spans[1, at]

    def _behind(self, ids: np.ndarray) -> None:
        """Write ids behind those that the arena keeps."""
        if self.used + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena[: self.used], np.empty(len(ids) + len(self.arena) // 2 + 1024, "<u4")])
        self.arena[self.used : self.used + len(ids)] = ids

    def _known(self, piece: str) -> bytes:
        """Of a piece that follows a space: a word and the marks after it are looked up apart, so that the memo holds words."""
        stem = piece.rstrip(_MARKS)
        return self.pieces[stem] + self.runs[piece[len(stem) :]] if stem != piece and stem.isalpha() else self.pieces[piece]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """encode of each text in UTF-8."""
        plain = [self.by_piece and b"  " not in x for x in texts]
        whole = [x for x, p in zip(texts, plain) if p]
        if not whole:
            return [self.encode(x.decode()) for x in texts]
        data = b" ".join(whole)
        space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts, ends = np.concatenate([[0], space + 1]), np.append(space, len(data))
        sizes = np.array([x.count(b" ") + 1 for x in whole], np.int64)
        first = np.cumsum(sizes) - sizes
        hashes = piece_hashes(data, starts, ends)
        # The piece that opens a text follows no space: it stands for itself, by a number that no other hash may have.
        hashes = np.maximum(hashes, np.uint64(len(first)))
        hashes[first] = np.arange(len(first), dtype=np.uint64)
        by = np.argsort(hashes)
        new = np.ones(len(by), bool)
        new[1:] = hashes[by[1:]] != hashes[by[:-1]]
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        heads = by[new]
        heads = heads[hashes[heads] >= len(first)]
        offset, counts = self._looked_up(hashes[heads], data, starts[heads], ends[heads])
        opening = [self._ids(data[s:e].decode()) for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        # The opening pieces' ids stand behind the kept ones until the next call, so that the arena isn't copied.
        self._behind(np.frombuffer(b"".join(opening), "<u4"))
        own = np.array([len(x) >> 2 for x in opening], np.int64)
        offset, counts = np.concatenate([np.cumsum(own) - own + self.used, offset]), np.concatenate([own, counts])
        many = counts[which]
        stops = np.cumsum(many)
        ids = self.arena[np.arange(stops[-1]) + np.repeat(offset[which] - stops + many, many)]
        last = stops[np.append(first[1:], len(which)) - 1]
        encoded = iter([ids[a:b].tobytes() for a, b in zip(np.concatenate([[0], last[:-1]]).tolist(), last.tolist())])
        return [next(encoded) if p else self.encode(x.decode()) for x, p in zip(texts, plain)]


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The encoder of a file, made once per worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]
