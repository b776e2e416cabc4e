"""Byte-level BPE ids from a public vocabulary file, in Python workers.

The ids are those of ``tokenizers`` with the same JSON file and add_special_tokens=False. With ``added`` (default) a text is split at the file's added
tokens, as that call does; without it they are ordinary text (``encode_special_tokens``). Where the file's normaliser, splitting, merges and added tokens are those of a plain
byte-level BPE (:func:`is_plain`), the faster ``tiktoken`` does the merging from the ranks in that file (same ids, tested); any other file is left to ``tokenizers``, and so is a text with
``LONG_BLANKS`` blanks in a row, on which the splitting pattern of ``tiktoken`` would run out of its stack.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: The splitting pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes bytes as characters: printable Latin-1 as itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


LONG_BLANKS = 100_000
_LONG = re.compile(rf"\s{{{LONG_BLANKS}}}")


def is_plain(file: dict) -> bool:
    """Whether a vocabulary file is a byte-level BPE without normaliser, with the usual splitting, with ids in the order of its merges, and at most one added token without options."""
    model, split, tokens = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
    if file.get("normalizer") or file.get("truncation") or file.get("post_processor") or model.get("type") != "BPE":
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    if len(tokens) > 1 or any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word")):
        return False
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))


class Encoder:
    """ids(text) as uint32, and size[id]: the bytes of each id."""

    def __init__(self, path: str, added: bool = True):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        special = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
        back = byte_of_char()
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.size = np.zeros(max([*vocab.values(), *special.values()]) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]
        self.size[list(special.values())] = [len(t.encode()) for t in special]
        self._file, self._added, self._slow, self._fast = path, added, None, None
        if is_plain(file):
            import tiktoken

            self._fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})
            self._allowed = set(special) if added else set()

    def ids(self, text: str) -> np.ndarray:
        if self._fast is not None and (len(text) < LONG_BLANKS or not _LONG.search(text)):
            return self._fast.encode_to_numpy(text, allowed_special=self._allowed, disallowed_special=())
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._file)
            self._slow.encode_special_tokens = not self._added
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = True) -> Encoder:
    return Encoder(path, added)
