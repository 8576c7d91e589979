"""SentencePiece BPE encoding by a table over prefixes, and decoding.

In a BPE vocabulary whose merges have distinct ranks, every prefix of a word has an encoding of its own and that
encoding's last token is unique: it is the one token that ends the prefix, and that may follow the last token of
what is left. So one pass stores each prefix's last token, taking the tokens that end there from an Aho-Corasick
automaton over the vocabulary and testing each with the pair-compatibility of two tokens (they stay as they are
when their concatenation is encoded); the ids are then read backwards from the end.

Characters outside the vocabulary never merge; they cut the word and become byte tokens. Runs of several spaces
may hold pieces of equal rank, for which the table's uniqueness does not hold: these words are merged directly.
Null and empty texts have no ids. Words are encoded once per worker as long as a bounded memo holds them.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable

from .memo import Memo

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict]:
    """Pieces (text, score, kind) of a SentencePiece model file, and the settings that matter for encoding."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n, t = model.normalizer_spec, model.trainer_spec
    return [(p.piece, p.score, p.type) for p in model.pieces], {
        "bpe": t.model_type == 2, "byte_fallback": t.byte_fallback, "suffix": t.treat_whitespace_as_suffix, "plain": not n.precompiled_charsmap and not n.remove_extra_whitespaces and n.escape_whitespaces, "dummy": n.add_dummy_prefix,
    }


class PieceBPE:
    """Encoder and decoder for one model file: BPE with byte fallback, no normalisation beyond the space mark."""

    def __init__(self, path: str):
        import ahocorasick

        self.pieces, self.settings = read_model(path)
        s = self.settings
        if not (s["bpe"] and s["byte_fallback"] and s["plain"] and not s["suffix"]) or any(k in (_USER, _UNUSED) for _, _, k in self.pieces):
            raise ValueError("this encoder takes BPE models with byte fallback, without normalisation and without user-defined pieces")
        self.rank = {p: -x for p, x, k in self.pieces if k == _NORMAL}
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == _NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark after other characters; words can't be encoded one by one")
        seen: dict[float, int] = {}
        for x in self.rank.values():
            seen[x] = seen.get(x, 0) + 1
        if any(seen[x] > 1 and p.strip(SPACE) and len(p) > 1 for p, x in self.rank.items()):
            raise ValueError("pieces other than runs of spaces share a rank")
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == _BYTE}
        #: A piece that its own encoding cuts apart is never emitted; the automaton leaves it out.
        self.own = {p: i for p, i in self.ids.items() if len(p) == 1 or len(self._merged(p)) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.own.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.text = [p for p, _, _ in self.pieces]
        #: Neighbours that occur in some piece; characters outside the vocabulary are in none.
        self.inside = {p[i : i + 2] for p in self.own for i in range(len(p) - 1)}
        self.pairs = Memo(self._fits, 64 << 20)
        self.parts = Memo(self._part, 24 << 20)
        self.words = Memo(self._word, 64 << 20)
        self.out = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else b" \xe2\x81\x87 " if k == _UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in self.pieces]
        self.control = {i for i, (_, _, k) in enumerate(self.pieces) if k == _CONTROL}

    def _merged(self, word: str) -> list[str]:
        """Merge the best-ranked neighbours, leftmost first among equals, until none can be merged."""
        part, after, before = list(word), [*range(1, len(word)), -1], list(range(-1, len(word) - 1))
        heap = [(self.rank[x], i, x) for i in range(len(part) - 1) if (x := part[i] + part[i + 1]) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, x = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j < 0 or part[i] + part[j] != x:
                continue
            part[i], part[j], after[i] = x, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (y := part[a] + part[b]) in self.rank:
                    heapq.heappush(heap, (self.rank[y], a, y))
        return [x for x in part if x]

    def _fits(self, pair: int) -> bool:
        """Whether the second token may follow the first."""
        a, b = self.text[pair >> 32], self.text[pair & 0xFFFFFFFF]
        return self._merged(a + b) == [a, b]

    def _run(self, word: str) -> list[int]:
        """Ids of characters that are all in the vocabulary: last token of each prefix, then backwards."""
        lengths, tokens, pairs, done = [0] * len(word), [0] * len(word), self.pairs, -1
        for end, (n, token) in self.automaton.iter(word):  # at each end the longest comes first
            if end != done and (n > end or pairs[tokens[end - n] << 32 | token]):
                lengths[end], tokens[end], done = n, token, end
        out, i = [], len(word) - 1
        while i >= 0:
            out.append(tokens[i])
            i -= lengths[i]
        return out[::-1]

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of a part of a word across whose ends nothing can merge."""
        if part in self.ids or len(part) > 1:
            return tuple([self.ids[x] for x in self._merged(part)] if SPACE * 2 in part else self._run(part))
        return tuple(self.bytes[b] for b in part.encode())

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word with its space marks in front, cut where two neighbours occur in no piece."""
        inside = self.inside
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
        if not cuts:
            return self._part(word)
        parts = self.parts
        return tuple(x for a, b in zip([0, *cuts], [*cuts, len(word)]) for x in parts[word[a:b]])

    def encode(self, text: str) -> list[int]:
        """The ids that the sentencepiece library gives, without begin and end ids."""
        if not text:
            return []
        if self.settings["dummy"]:
            text = SPACE + text.replace(" ", SPACE)
        else:
            text = text.replace(" ", SPACE)
        parts = text.split(SPACE)
        words = self.words
        out: list[int] = []
        if parts[0]:
            out += words[parts[0]]
        marks = SPACE
        for p in parts[1:-1]:
            if p:
                out += words[marks + p]
                marks = SPACE
            else:
                marks += SPACE
        if len(parts) > 1:
            out += words[marks + parts[-1]]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, as the library's decode: the mark that encoding put in front goes, bytes that form no character become U+FFFD each."""
        ids = list(ids)
        raw = b"".join(map(self.out.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), None)
        drop = self.settings["dummy"] and first is not None and self.text[first].startswith(SPACE)
        try:
            out = raw.decode()
        except UnicodeDecodeError:
            out = ""
        if not out or not self.control.isdisjoint(ids):  # bytes on both sides of a control token form no character
            out = "".join(_repaired(b"".join(self.out[i] for i in run)) for control, run in itertools.groupby(ids, self.control.__contains__) if not control)
        return out[1:] if drop else out


def _repaired(raw: bytes) -> str:
    """Decode, with one U+FFFD for each byte that belongs to no character."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 1
        try:
            out.append(raw[i : i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


_loaded: dict[str, PieceBPE] = {}


def load(path: str) -> PieceBPE:
    """The encoder of a file, made once per worker."""
    if path not in _loaded:
        _loaded[path] = PieceBPE(path)
    return _loaded[path]
