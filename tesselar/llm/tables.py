"""Tables of distinct text chunks: each is segmented once, and a text's ids are joined from its chunks by position."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from functools import cache

#: Chunks that a worker's byte-level table holds; it is emptied when full. Longer ones than LONGEST are never held.
TABLE_SIZE = 150_000
LONGEST = 80

#: White space as Unicode's White_Space property has it, a fixed value.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No token of the byte-level pattern goes on from other signs to white space, so texts may be cut there.
_SPACED = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: The pattern of byte-level BPE vocabularies with 50,257 entries, a fixed value.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe(dict):
    """Chunk to little-endian 32-bit ids, for a byte-level BPE file of the ``tokenizers`` library.

    Ids are those of the library with ``add_special_tokens=False``: a string that is an added token of the file gets that
    token's id, wherever it stands in a text.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model.get("added_tokens", [])
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on their surroundings are not known")
        special = {x["content"]: x["id"] for x in added}
        self.added = {c: array("I", [i]).tobytes() for c, i in special.items()}
        self.cuts = re.compile("(" + "|".join(re.escape(c) for c in sorted(special, key=len, reverse=True)) + ")") if special else None
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(visible)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(map(byte.__getitem__, piece)): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        self.ranks, self.bpe = ranks, tiktoken.Encoding("vocabulary", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        raw = chunk.encode()
        if (one := self.ranks.get(raw)) is not None:
            ids = [one]
        else:
            core = chunk[1:] if chunk[0] == " " else chunk
            word = core.isalpha() and max(core) < "\u0250"  # one word of the pattern: it needn't be split
            ids = self.bpe._encode_single_piece(raw) if word else self.bpe.encode_ordinary(chunk)
        out = array("I", ids).tobytes()
        if len(chunk) <= LONGEST:
            if len(self) >= TABLE_SIZE:
                self.clear()
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if self.cuts is None or not any(c in text for c in self.added):
            return b"".join(map(self.__getitem__, _SPACED.findall(text)))
        out = []
        for part in self.cuts.split(text):
            out += [self.added[part]] if part in self.added else map(self.__getitem__, _SPACED.findall(part))
        return b"".join(out)


#: The sign that marks a space in piece vocabularies.
MARK = "\u2581"
_MARKED = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


class Pieces:
    """Tables of distinct marked words, for a sentencepiece model whose pieces don't cross marks.

    A marked word is a run of marks with what follows it up to the next mark. As no piece holds a mark after another
    sign, merges never join two marked words, and a text's pieces are those of its words in order. The constructor
    checks that of the model, and that the model marks and keeps every space.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
            raise ValueError("the model has pieces that cross white-space marks")
        probe = "  a \t b\ufb01 \xa0  "
        if sp.decode(sp.encode(probe)) != probe or sp.encode(MARK + "a") != sp.encode(" a"):
            raise ValueError("the model changes texts before it segments them")
        self.lone, self.before = sp.piece_to_id(MARK), sp.piece_to_id("a")

    def table(self, texts: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Every distinct marked word of the texts, segmented once: native 32-bit ids, and what they decode to."""
        distinct: dict[str, None] = {}
        for text in texts:
            if text:
                distinct.update(dict.fromkeys(_MARKED.findall(" " + text)))
        chunks = list(distinct)
        # Encoding puts one mark in front: a chunk's own first mark is left to that.
        ids = [x or [self.lone] for x in self.model.encode([c[1:] for c in chunks], num_threads=1)]
        decoded = self.model.decode([[self.before, *x] for x in ids], num_threads=1)
        return {c: (array("i", x).tobytes(), d[1:]) for c, x, d in zip(chunks, ids, decoded, strict=True)}


def joined(text: str, table: dict[str, tuple[bytes, str]]) -> tuple[bytes, str]:
    """All ids of a text, and what the library decodes them to, from its words' entries in order of their positions."""
    if not text:
        return b"", ""
    found = list(map(table.__getitem__, _MARKED.findall(" " + text)))
    return b"".join([x[0] for x in found]), "".join([x[1] for x in found])[1:]


@cache
def byte_bpe(path: str) -> ByteBpe:
    """The worker's table; workers are reused, so the next task finds it filled."""
    return ByteBpe(path)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)
