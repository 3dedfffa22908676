"""Maximal periodic runs of words: suffix trees of a document and its reversal answer how far two places agree.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping q. Each run holds a Lyndon
word of length q, for the order of words or its opposite, that begins where the next smaller (or greater) suffix is q
words on. So the longest Lyndon words at each place are the candidates, at most two a place, and each is extended to both
sides by common extensions: to the right in the tree of the document, to the left in that of its reversal. Trees are
Ukkonen's; a common extension is the depth of the lowest common ancestor of two leaves, the least depth between them on
the Euler tour.

Words that no run can hold are taken out first, which is exact: a run of length L and period q holds each of its
sequences of L - 2q + 1 words or fewer again q words away, so a word of a run stands only in sequences that recur nearby. What
is left of a document, its stretches parted by words of their own, goes into the two trees.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_tree(s: list[int], symbols: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's tree of ``s``, whose last symbol is its only 0; symbols are below ``symbols``. Where each node's edge
    begins and ends in ``s``, and the child by parent * symbols + first symbol. Node 0 is the root."""
    n = len(s)
    start, end, link, child = [0], [0], [0], {}
    node, edge, length, due = 0, 0, 0, 0
    for i, c in enumerate(s):
        waits, due = 0, due + 1
        while due:
            if not length:
                edge = i
            key = node * symbols + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if waits:
                    link[waits] = node
                    waits = 0
            else:
                a = start[below]
                size = min(end[below], i + 1) - a
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                if s[a + length] == c:
                    if waits:
                        link[waits] = node
                    length += 1
                    break
                middle = child[key] = len(start)
                start += (a, i)
                end += (a + length, n)
                link += (0, 0)
                start[below] = a + length
                child[middle * symbols + c] = middle + 1
                child[middle * symbols + s[a + length]] = below
                if waits:
                    link[waits] = middle
                waits = middle
            due -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - due + 1
    return start, end, child


class Extensions:
    """Longest common extensions of places of ``s`` in constant time each."""

    def __init__(self, s: list[int], symbols: int):
        import numpy as np

        start, end, child = suffix_tree(s, symbols)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        to = np.fromiter(child.values(), np.int64, len(child))
        order = np.lexsort((-(keys % symbols), keys // symbols))  # the least child is taken from the stack first
        above, to = (keys // symbols)[order], to[order]
        first = np.searchsorted(above, np.arange(len(start) + 1)).tolist()
        parent = [0] * len(start)
        for p, v in zip(above.tolist(), to.tolist(), strict=True):
            parent[v] = p
        children = to.tolist()
        # The tour, kept to leaves and the least depth between one leaf and the next.
        depth, leaves, least = [0] * len(start), [], []
        stack, climbed = children[first[0] : first[1]], False
        while stack:
            v = stack.pop()
            at = depth[parent[v]]
            if climbed:
                least.append(at)
                climbed = False
            a, b = first[v], first[v + 1]
            if a == b:
                leaves.append(start[v] - at)
                climbed = True
            else:
                depth[v] = at + end[v] - start[v]
                stack += children[a:b]
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[np.array(leaves, np.int64)] = np.arange(len(leaves))
        self._levels = [np.array(least or [0], np.int32)]
        while (w := 1 << (len(self._levels) - 1)) * 2 <= len(least):
            self._levels.append(np.minimum(self._levels[-1][:-w], self._levels[-1][w:]))

    def __call__(self, i, j):
        """Common length at the places ``i`` and ``j`` (arrays, unequal pairwise)."""
        import numpy as np

        a, b = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self._levels[k][a[own]], self._levels[k][b[own] - (1 << k)])
        return out


def _next(rank: list[int], smaller: bool) -> list[int]:
    """For each place the next one of smaller (or greater) rank; the length of the list if there is none."""
    out, stack = [len(rank)] * len(rank), []
    for j, r in enumerate(rank):
        while stack and (rank[stack[-1]] > r) == smaller:
            out[stack.pop()] = j
        stack.append(j)
    return out


def repeating(words, min_length: int, min_exponent: int):
    """Begin and end of the stretches of ``words`` (an array of word numbers) that may hold runs."""
    import numpy as np

    n = len(words)
    k = min(max(min_length, min_exponent * q) - 2 * q + 1 for q in range(1, min_length + 1))
    if n < max(min_length, k + 1):
        return np.empty((0, 2), np.int64)
    h = np.zeros(n - k + 1, np.uint64)  # unequal sequences with equal sums only keep words that the trees rule out
    for t in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[t : t + len(h)].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    gap = np.where(h[order[1:]] == h[order[:-1]], order[1:] - order[:-1], n)
    near = np.full(len(h), n)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    room, before = np.full(len(h), n), -1
    while True:
        keep = near * min_exponent <= room
        kept = int(keep.sum())
        if kept == before or not kept:
            break
        before = kept
        edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2] + k - 1
        good = end - begin >= min_length
        begin, end = begin[good], end[good]
        room = np.zeros(len(h), np.int64)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            room[a : b - k + 1] = b - a
    return np.stack([begin, end], axis=1) if kept else np.empty((0, 2), np.int64)


def find_runs(words, min_length: int = 6, min_exponent: int = 4):
    """(start, length, period) of all runs of ``words`` (an array of word numbers from 0) by start, then period."""
    import numpy as np

    none = np.empty((0, 3), np.int64)
    parts = repeating(words, min_length, min_exponent)
    if not len(parts):
        return none
    symbol, place, apart = [], [], int(words.max()) + 2
    for k, (a, b) in enumerate(parts.tolist()):
        symbol += [words[a:b] + 1, [apart + k]]
        place += [np.arange(a, b), [-1]]
    symbol, place = np.concatenate(symbol[:-1]), np.concatenate(place[:-1])
    _, symbol = np.unique(symbol, return_inverse=True)
    n, symbols = len(symbol), int(symbol.max()) + 2
    right = Extensions([*(symbol + 1).tolist(), 0], symbols)
    left = Extensions([*(symbol[::-1] + 1).tolist(), 0], symbols)
    rank = right.rank[:n].tolist()
    i, j = np.tile(np.arange(n), 2), np.array(_next(rank, True) + _next(rank, False), np.int64)
    i, j = i[j < n], j[j < n]
    period = j - i
    end = j + right(i, j)
    start = i - np.where(i > 0, left(n - i, n - j), 0)
    good = end - start >= np.maximum(min_length, min_exponent * period)
    if not good.any():
        return none
    found = np.unique(np.stack([place[start[good]], (end - start)[good], period[good]], axis=1), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def detect(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: (doc_id, n_words, runs, collapsed). ``runs`` are all runs of ``min_length`` words
    and ``min_exponent`` periods or more, by start, then period; ``collapsed`` is the words outside what each run repeats
    after its first period, joined by a space.

    Null and wordless texts have no runs and an empty ``collapsed``; null and repeated ids keep their rows. No row needs
    another, so nothing is shuffled; a document's trees take some 900 bytes a word of what may hold runs, so a text of very many such
    words needs an executor that can hold them.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs have two periods and two words or more")

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                counts, found, sizes, texts = [], [], [], []
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    words = (text or b"").split()
                    number: dict[bytes, int] = {}
                    runs = find_runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64), min_length, min_exponent)
                    if len(runs):
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
                        words_kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                    else:
                        words_kept = words
                    counts.append(len(words))
                    found.append(runs)
                    sizes.append(len(runs))
                    texts.append(b" ".join(words_kept))
                flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                runs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(kind.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RUNS)


def digest(found: DataFrame) -> DataFrame:
    """The longest run (of equal ones the earliest, then that of the smallest period), and digests of all runs and of
    the collapsed text."""
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] > a["length"], r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], F.lit(None).cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
