"""The tokenizers library on pieces of texts: many short ones in one call, or any text whole."""

from __future__ import annotations

import json
import os

import numpy as np


#: Fixed value: the pattern of a splitter that keeps only matches, none of which holds a blank.
BLANKLESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def id_type(vocabulary: int) -> str:
    """The little-endian type of ids of a vocabulary."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class Library:
    """A tokenizer file. cuts: whether its ids may be found piece by piece (plain byte-level BPE).

    drops_blanks: whether words between ASCII blanks are tokenised apart from each other.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.width = np.dtype(self.dtype).itemsize
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or ()
        self.specials = tuple(t["content"] for t in added)
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else -1
        self.cuts = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and self.newline >= 0
            and not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and spec["model"].get("dropout") is None
            and not any(t.get(k) for t in added for k in ("normalized", "lstrip", "rstrip", "single_word"))
        )
        first = (pre.get("pretokenizers") or [pre])[0]
        steps = (spec.get("normalizer") or {}).get("normalizers", [spec["normalizer"]] if spec.get("normalizer") else [])
        plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and (n["pattern"], n["content"]) == ({"Regex": "\\s+"}, " ") for n in steps)
        self.drops_blanks = (
            plain and first.get("type") == "Split" and first.get("pattern") == {"Regex": BLANKLESS} and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and not any(spec.get(k) for k in ("truncation", "padding")) and spec["model"].get("dropout") is None
            and not any(t.get(k) for t in added for k in ("normalized", "lstrip", "rstrip", "single_word")) and not any(b in s for s in self.specials for b in " \t\n\r\x0b\x0c")
        )

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as bytes of dtype, added tokens' strings as the library takes them by default."""
        return [np.asarray(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        """The numbers of ids of whole texts."""
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, keys: list[str]) -> list[bytes]:
        """Ids of pieces: 'x' stands for a space and x, '\\nx' for itself; x has no blank.

        They are encoded many at a time, a newline between any two. A newline between
        non-blanks, or before one space, is a token of its own, which no piece has but as
        its first character.
        """
        out: list[bytes] = []
        w, first = self.width, np.array(self.newline, dtype=self.dtype).tobytes()
        for at in range(0, len(keys), 512):
            part = keys[at : at + 512]
            bare = [p[:1] == "\n" for p in part]
            joined = "\n".join([p[1:] if b else " " + p for p, b in zip(part, bare, strict=True)])
            ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
            starts = np.append(0, ends[:-1] + 1)
            if len(ends) != len(part):
                raise AssertionError("a piece has a newline inside")
            raw = ids.tobytes()
            out += [(first + raw[a:b]) if n else raw[a:b] for a, b, n in zip((w * starts).tolist(), (w * ends).tolist(), bare, strict=True)]
        return out
