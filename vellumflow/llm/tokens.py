"""Token ids of whole texts with a public byte-level BPE file.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. A
text is cut where the pre-tokenizer always cuts (before white space that
follows something else, and between letters or digits and other signs), each
distinct piece is encoded once by the library, and the pieces' ids are joined.
Pieces that weren't met since the cache was last full are dropped when it is full
again, so that memory is bounded and frequent ones stay.
"""

from __future__ import annotations

import json
import re
from array import array

from vellumflow.llm.shared import kept

#: Unicode White_Space, which the pre-tokenizer's \s stands for.
WS = "\t-\r \x85\xa0  -     　"
_LATE = WS.replace(" ", "", 1)  # white space that no following word takes along
_END = "'(?:s|t|re|ve|m|ll|d)"  # the endings that the pre-tokenizer keeps together
_ALNUM = "0-9A-Za-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\u024f"  # [^\W_] of Latin script, which takes longer to match
#: Pieces of texts in Latin script; a piece begins where the pre-tokenizer always cuts.
FINE = re.compile(rf" ?[{_ALNUM}]+|[{_LATE}](?=[{_ALNUM}])|{_END}|[{WS}]*[{_LATE}]{_END}|[{WS}]*[{_ALNUM}]+|[{WS}]*(?:_|[^\w{WS}])+|[{WS}]+")
#: Pieces of any other text.
COARSE = re.compile(rf"[{WS}]*[^{WS}]+|[{WS}]+")
#: Signs beyond Latin script, about whose class two Unicode versions might differ.
OTHER = re.compile("[ɐ-ᙿᚁ-῿⁰-⿿、-\U0010ffff]")
#: One pre-token of letters only.
WORD = re.compile("( ?)([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+)")


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceCache(dict):
    """Little-endian ids of each piece, made by the tokenizers library when first met."""

    def __init__(self, path: str, most: int = 600_000):
        import sys

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.swap = sys.byteorder == "big"
        self.most, self.signs = most, byte_signs()
        self.old: dict[str, bytes] = {}  # what was met before the cache was last full
        self.model = self.tokenizer.model

    def packed(self, ids: list[int]) -> bytes:
        a = array(self.kind, ids)
        if self.swap:
            a.byteswap()
        return a.tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            if WORD.fullmatch(piece):
                if piece.isascii():  # letters stand for themselves
                    signs = self.signs[32] + piece[1:] if piece[0] == " " else piece
                else:
                    signs = piece.encode().decode("latin-1").translate(self.signs)
                out = self.packed([t.id for t in self.model.tokenize(signs)])
            else:
                out = self.packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, ``width`` bytes each, little-endian."""
        if not self.cuts or any(a in text for a in self.added):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if 2 * len(self) > self.most:
            self.old = self.copy()
            self.clear()
        pieces = (COARSE if OTHER.search(text) else FINE).findall(text)
        return b"".join(map(self.__getitem__, pieces))


def piece_cache(path: str, most: int = 600_000) -> PieceCache:
    """The worker's own cache for a tokenizer file, kept between tasks."""
    return kept(("pieces", path, most), lambda: PieceCache(path, most))


def as_text(raw: bytes | None) -> str:
    """Text of a value read as binary; null is empty, bad bytes become U+FFFD."""
    return "" if raw is None else raw.decode("utf-8", "replace")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
