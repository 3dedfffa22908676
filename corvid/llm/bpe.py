"""Loading public byte-level BPE vocabularies once per Python worker. Paths are parameters."""

from __future__ import annotations

import base64
import functools
import json


@functools.lru_cache(maxsize=8)
def from_ranks(path: str, pattern: str):
    """A tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _printable_bytes() -> dict[str, int]:
    """The byte each printable stand-in character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=8)
def from_json(path: str, pattern: str):
    """The ids of a byte-level BPE ``tokenizer.json``, from its own vocabulary and added tokens.

    Ids of such a file rise with the merge order, so its vocabulary gives the ranks; the tests hold the ids against
    the ``tokenizers`` library, which this is several times faster than.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    back = _printable_bytes()
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def encode(encoding, text: str):
    """Ids as a uint32 array; strings of special tokens become those tokens where the encoding has them."""
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not text.isascii() and any("\ud800" <= c <= "\udfff" for c in text) else text
    return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
