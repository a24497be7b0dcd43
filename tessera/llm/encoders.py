"""Encoders of the public tokenizer files, with the bytes of every token.

``ByteBpe`` gives the ids of the tokenizers library with special strings as plain text. Where the file says that merges
are ranked by id, and a text holds only code points whose classes the two libraries agree on, tiktoken makes the same ids
several times faster; every other text goes to the library itself. ``Pieces`` wraps a SentencePiece model.

A null text is an empty one, and an empty text has no tokens.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

#: Code points up to U+024F; later ones may be newer in one library's tables than in the other's.
_AGREED = regex.compile(r"[\x00-ɏ]*")
#: The byte-level pre-tokenizer's fixed pattern, as its libraries publish it.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


class ByteBpe:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor has one core for this worker
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
        letters = byte_letters()
        plain = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added and all(c in letters for c in t)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.table: list[bytes] = [b""] * (max([*vocab.values(), *special.values()], default=-1) + 1)
        for t, i in plain.items():
            self.table[i] = t
        for t, i in special.items():
            self.table[i] = t.encode()
        self.quick = tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=plain, special_tokens={}) if self._ranked(spec, plain) else None

    @staticmethod
    def _ranked(spec: dict, plain: dict[bytes, int]) -> bool:
        """Whether the file is a plain byte-level BPE whose merges come in the order of their ids."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return False
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or sorted(plain.values()) != list(range(len(plain))):
            return False
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        return len(plain) == len(pairs) + 256 and made == sorted(made) and min(made, default=0) >= 256

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [self.quick.encode_ordinary(t) if self.quick is not None and _AGREED.fullmatch(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, e in zip(rest, self.library.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings as one token each (the library's default). The ids of one text are held at a time."""
        out = []
        for t in texts:
            parts = self.special.split(t) if self.special is not None and self.special.search(t) else [t]
            out.append(len(parts) - 1 + sum(len(ids) for p in parts for ids in self.encode([p])))
        return out


class Pieces:
    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.table.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_kept: dict[tuple[type, str], ByteBpe | Pieces] = {}


def kept(kind: type, path: str):
    """The worker's encoder of a file, kept for its life."""
    if (kind, path) not in _kept:
        _kept[kind, path] = kind(path)
    return _kept[kind, path]


def sizes(table: list[bytes]) -> np.ndarray:
    """Bytes of every token."""
    return np.array([len(t) for t in table], np.int64)
