"""Byte-level BPE by monoid tree reduction over text halves.

``encode_tree`` halves a text at any place down to short leaves, encodes them, and joins neighbours by encoding a window
around the seam anew; tokens outside the window stand. The window grows until that is certain, in one of two ways.

Inside a long run of one kind of character, which the split pattern takes as one match on either side of the seam and
across it, the window grows by tokens until its first and last token are what they were before. Byte-pair encodings are
the sequences whose neighbouring pairs are all encodings of their own bytes, so then the whole match stands.

Elsewhere it grows to the nearest ``safe_cut`` on either side: a place where a match of the pattern must end on the left
and begin on the right, whatever follows or precedes. Decoding concatenates byte strings up the same tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _kind(c: str) -> str:
    """L letter, N number, S anything the pattern may take as white space, O other."""
    if c.isspace() or c < " ":
        return "S"
    if c.isascii():
        return "L" if c.isalpha() else "N" if c.isdigit() else "O"
    import unicodedata

    return {"L": "L", "N": "N", "Z": "S"}.get(unicodedata.category(c)[0], "O")


def safe_cut(text: str, at: int) -> bool:
    """True where no match of the pattern can span ``at`` and what lies on one side cannot change the other's matches.

    That holds before white space that follows none, and between a letter or number and any other class but white
    space; an apostrophe may take letters that follow it, so nothing is claimed after other characters but before
    numbers. Characters unassigned in this Python's tables count as no class, so no cut is claimed beside them.
    """
    if at <= 0 or at >= len(text):
        return True
    left, right = _kind(text[at - 1]), _kind(text[at])
    if "O" in (left, right) and (_unassigned(text[at - 1]) or _unassigned(text[at])):
        return False
    if left == "S":
        return False
    if right == "S" and text[at] not in _SPACES:
        return left in "LN"
    return right == "S" or left in "LN" and right != left or left == "O" and right == "N"


#: Characters that are white space in every Unicode version.
_SPACES = frozenset(" \t\n\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}


def _unassigned(c: str) -> bool:
    import unicodedata

    return not c.isascii() and unicodedata.category(c) in ("Cn", "Co", "Cs")


#: The places looked for first: a white-space character after printable ASCII.
_QUICK = re.compile(r"(?<=[!-~])[ \n]")


def _left_cut(text: str, low: int, at: int, step: int = 64) -> int:
    """The nearest safe cut at or before ``at``, or ``low``; the window looked at grows."""
    begin = at
    while begin > low:
        end, begin = begin, max(low, begin - step)
        found = [m.start() for m in _QUICK.finditer(text, begin, end)]
        if found:
            return found[-1]
        for p in range(end, begin, -1):
            if safe_cut(text, p):
                return p
        step *= 2
    return low


def _right_cut(text: str, at: int, high: int, step: int = 64) -> int:
    end = at
    while end < high:
        begin, end = end, min(high, end + step)
        for p in range(begin, end):
            if p > at and safe_cut(text, p):
                return p
        step *= 2
    return high


def _one_kind(text: str, begin: int, end: int) -> str | None:
    """The kind of all characters of a range if they are of one, and certainly so: L, N, O, or S for white space."""
    part = text[begin:end]
    if part.isascii():
        if part.isalpha():
            return "L"
        if part.isdigit():
            return "N"
    kinds = set(map(_kind, part))
    if len(kinds) != 1:
        return None
    kind = kinds.pop()
    if kind == "S":
        return kind if _SPACES.issuperset(part) else None
    return kind if not any(map(_unassigned, part)) else None


#: Characters of the run that must lie outside a window of tokens: a contraction takes two letters of the run after its
#: apostrophe, and the last white space of a run may go to what follows it.
_MARGIN = 3


def encode_tree(encode, text: str, leaf: int = 256) -> list[tuple[int, int, list]]:
    """Runs (start, end, ids) in order; their ids one after the other are the ids of the text. ``encode``: str to ids, with
    ``sizes``, the bytes of each id."""

    def reduce(low: int, high: int) -> list[tuple[int, int, list]]:
        if high - low <= leaf:
            return [(low, high, encode(text[low:high]))] if high > low else []
        middle = (low + high) // 2
        return join(reduce(low, middle), reduce(middle, high), middle, low, high)

    def join(left: list, right: list, seam: int, low: int, high: int) -> list:
        if safe_cut(text, seam):
            return left + right
        window = by_tokens(left, right, seam, low, high)
        if window is None:
            begin, end = _left_cut(text, low, seam - 1), _right_cut(text, seam, high)
            window = begin, end, encode(text[begin:end])
        return before(left, window[0]) + [window] + after(right, window[1])

    def by_tokens(left: list, right: list, seam: int, low: int, high: int):
        """The window by tokens, or None where its run of one kind ends too early."""
        n, done = 8, None
        kind = _one_kind(text, max(low, seam - _MARGIN), min(high, seam + _MARGIN))
        while kind:
            begin, first = edge(left, seam, low, n, True)
            end, last = edge(right, seam, high, n, False)
            if begin - low < _MARGIN or high - end < _MARGIN or (begin, end) == done or _one_kind(text, begin - _MARGIN, end + _MARGIN) != kind:
                return None
            ids = encode(text[begin:end])
            if ids[0] == first and ids[-1] == last:
                return begin, end, ids
            n, done = 2 * n, (begin, end)
        return None

    def edge(runs: list, seam: int, stop: int, n: int, back: bool):
        """Where the ``n`` tokens nearest to the seam begin or end, or somewhat more so that no character is cut, and the
        token there."""
        size, at, token = 0, seam, None
        reached = 0  # bytes of text between the seam and at
        for _, _, ids in reversed(runs) if back else runs:
            for token in ids[::-1].tolist() if back else ids.tolist():
                size, n = size + int(encode.sizes[token]), n - 1
                while reached < size and at != stop:
                    at -= back
                    reached += len(text[at].encode("utf-8"))
                    at += not back
                if n <= 0 and reached == size:
                    return at, token
        return stop, token

    def before(runs: list, at: int) -> list:
        """Runs up to a place, which lies between two tokens."""
        k = len(runs)
        while k and runs[k - 1][0] >= at:
            k -= 1
        kept = runs[:k]
        if kept and kept[-1][1] > at:
            a, b, ids = kept.pop()
            kept.append((a, at, strip(ids, at, b, False)))
        return kept

    def after(runs: list, at: int) -> list:
        k = 0
        while k < len(runs) and runs[k][1] <= at:
            k += 1
        kept = runs[k:]
        if kept and kept[0][0] < at:
            a, b, ids = kept[0]
            kept[0] = (at, b, strip(ids, a, at, True))
        return kept

    def strip(ids, begin: int, end: int, front: bool):
        """``ids`` without the tokens of text[begin:end] at its front or back, found by their byte length."""
        size = len(text[begin:end].encode("utf-8"))
        held = encode.sizes[ids] if front else encode.sizes[ids[::-1]]
        k = int(held.cumsum().searchsorted(size)) + 1 if size else 0
        return ids[k:] if front else ids[: len(ids) - k]

    return reduce(0, len(text))


class Encoder:
    """A tiktoken encoding as the tree needs it: ids of a part, and each token's length in bytes."""

    def __init__(self, path: str, pattern: str):
        import numpy as np

        self.encoding = bpe.from_ranks(path, pattern)
        self.sizes = np.zeros(self.encoding.n_vocab, dtype=np.int64)
        for token, rank in self.encoding._mergeable_ranks.items():
            self.sizes[rank] = len(token)

    def __call__(self, part: str):
        return bpe.encode(self.encoding, part)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; counts and digests of the ids and of the decoded bytes.

    A null or empty text has no tokens and the digests of the empty string. Rows are independent: repeated rows give
    repeated results, an empty table gives none.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(ranks_path, pattern)
        words = [str(i) for i in range(encoder.encoding.n_vocab)]
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs = encode_tree(encoder, text or "", leaf)
                ids = np.concatenate([r[2] for r in runs]) if runs else np.zeros(0, np.uint32)
                said = " ".join([words[i] for i in ids.tolist()])
                decoded = hashlib.sha256()
                for _, _, part in runs:
                    decoded.update(encoder.encoding.decode_bytes(part.tolist()))
                for column, value in zip(rows, (doc, len(ids), hashlib.sha256(said.encode()).hexdigest(), decoded.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2]), pa.array(rows[3])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, CODED)
