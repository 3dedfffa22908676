"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by scaled forward recursion.

Words fall into ``classes`` by a hash. Baum-Welch rounds train start, transition and class emission probabilities over all
training documents, whole. A last count then gives each word that occurs ``frequent`` times or more emissions of its own
in each state, from how often each state is expected to emit it; the others share their class's remainder by their
training counts plus 0.5, an unknown word counting 0.5. So what is gathered grows with the vocabulary, and stays in Spark.

Documents are stored once as blocks with a vocabulary of their own. Sums over all blocks of a word's numbers are made by
dealing each block's different words into parts by a hash: a part sums its words and answers each block in turn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, hashes binary, words binary, counts binary, n_words long, trained binary"
KNOWN = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, classes binary, c binary, places binary"
ANSWER = "part int, block long, sums binary, totals array<double>"
#: (block, word) pairs that a part has on average, at most; a task holds 4 bytes a pair.
PART_PAIRS = 1 << 20
#: Tokens of the sequences that both recursions take at once, at most but for the last one; some 120 bytes each.
GROUP_TOKENS = 1 << 20
#: Tokens of whole steps whose emissions are looked up at once, so that they stay in the processor's cache.
RUN_TOKENS = 1 << 13


def held_out(doc_id) -> bool:
    """One in five documents, by the CRC-32 of the id as text; a null id is empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def blocks(docs: DataFrame, classes: int, block_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in blocks of about ``block_bytes`` of text (a longer text is a block of its own), as a written table.

    ``words`` are a block's different words with blanks between them, common ones first, as ``ids`` number them; ``hashes`` are
    their CRC-32 numbers, ``counts`` how often each stands in the block's training documents; ``trained`` has the class
    numbers of those documents, each with the end, ``classes``, after it.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        base, n_blocks = TaskContext.get().partitionId() << 32, 0
        vocabulary: dict[bytes, int] = {}
        doc_ids, held, ids, size = [], [], [], 0

        def flush():
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lengths = np.fromiter(map(len, ids), np.int32, len(ids))
            order = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable")  # common words first
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(len(order), dtype=np.int32)
            flat, words = number[flat], list(vocabulary)
            words = [words[k] for k in order.tolist()]
            hashes = np.fromiter(map(zlib.crc32, words), "<u4", len(words))
            own = np.repeat(~np.array(held, bool), lengths)
            trained = np.bincount(flat[own], minlength=len(words)).astype("<u4")
            symbols = np.insert((hashes % np.uint32(classes)).astype("<u2")[flat[own]], np.cumsum(lengths[~np.array(held, bool)]), classes)
            return pa.RecordBatch.from_arrays(
                [pa.array([base + n_blocks]), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
                 *(pa.array([x], pa.binary()) for x in (_pack(flat), hashes.tobytes(), b" ".join(words), trained.tobytes())), pa.array([len(words)], pa.int64()), pa.array([symbols.tobytes()], pa.binary())],
                names=[c.split()[0] for c in BLOCK.split(", ")],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "replace").lower()
                if doc_ids and size + len(raw) > block_bytes:
                    yield flush()
                    n_blocks += 1
                    vocabulary.clear()
                    doc_ids, held, ids, size = [], [], [], 0
                words = raw.split()
                number = vocabulary.setdefault
                ids.append(np.fromiter((number(w, len(vocabulary)) for w in words), np.int32, len(words)))
                doc_ids.append(doc)
                held.append(held_out(doc))
                size += len(raw)
        if doc_ids:
            yield flush()

    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCK), "lm-blocks")


def _parts_of(hashes, parts: int):
    """The part of each word; the hash is mixed first, as classes are its remainders."""
    import numpy as np

    return ((hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _by_part(of):
    """(part, places) of a block's words, places ascending."""
    import numpy as np

    order = np.argsort(of, kind="stable")
    found, begin = np.unique(of[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, begin[1:]), strict=True))


def _pack(ids) -> bytes:
    """Word numbers as four planes of bytes: numbers are small, as common words come first, so upper planes compress away."""
    import numpy as np

    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(packed):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _rows(batches, *names):
    """The rows of record batches; binary columns as buffers, not copied."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield [c[i].as_buffer() if str(c.type) == "binary" else c[i].as_py() for c in columns]


def count_words(stored: DataFrame, parts: int, classes: int, frequent: int) -> DataFrame:
    """ANSWER rows: for each block and part the training counts over all blocks of the block's words, in its order, and, for
    words of ``frequent`` or more, a number within the part. And a row a part without block, whose totals are, by class,
    different words and their counts, first of all trained words, then of frequent ones.

    A block has a word once, so however common it is, a part has at most a row a block of it.
    """

    def deal(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for block, hashes, words, counts in _rows(batches, "block", "hashes", "words", "counts"):
            hashes, counts = np.frombuffer(hashes, "<u4"), np.frombuffer(counts, "<u4")
            if not len(hashes):
                continue
            words = words.to_pybytes().split(b" ")
            made = [(p, b" ".join([words[k] for k in at.tolist()]), counts[at].tobytes()) for p, at in _by_part(_parts_of(hashes, parts))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.int32()), pa.array([block] * len(made), pa.int64()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.binary())],
                names=["part", "block", "words", "counts"],
            )

    def add(batches) -> Iterator:
        import numpy as np

        def answers(part, held, known, sums):
            n = sums[: len(known)]
            of, often = np.fromiter((zlib.crc32(w) % classes for w in known), np.int64, len(known)), n >= frequent
            number = np.where(often, np.cumsum(often) - 1, -1).astype("<i4")
            yield from _answers(part, ((block, n[ids].tobytes() + number[ids].tobytes()) for block, ids in held))
            totals = [np.bincount(of, x, classes) for x in (n > 0, n, often, n * often)]
            yield from _answers(part, [(None, None)], np.concatenate(totals))

        now, held, known, sums = None, [], {}, None
        for part, block, words, counts in _rows(batches, "part", "block", "words", "counts"):
            if part != now:
                if held:
                    yield from answers(now, held, known, sums)
                now, held, known, sums = part, [], {}, np.zeros(1 << 12, "<i8")
            number, words = known.setdefault, words.to_pybytes().split(b" ")
            ids = np.fromiter((number(w, len(known)) for w in words), np.int32, len(words))
            while len(known) > len(sums):
                sums = np.concatenate([sums, np.zeros_like(sums)])
            sums[ids] += np.frombuffer(counts, "<u4")
            held.append((block, ids))
        if held:
            yield from answers(now, held, known, sums)

    asked = stored.select("block", "hashes", "words", "counts").mapInArrow(deal, "part int, block long, words binary, counts binary")
    return materialize(asked.repartition("part").sortWithinPartitions("part", "block").mapInArrow(add, ANSWER), "lm-counts")


def _answers(part: int, rows, totals=None) -> Iterator:
    """Record batches of ANSWER rows (block, sums), 64 at a time."""
    import itertools

    import pyarrow as pa

    rows = iter(rows)
    while some := list(itertools.islice(rows, 64)):
        kinds = pa.array([totals] * len(some), pa.list_(pa.float64())) if totals is not None else pa.nulls(len(some), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array([b for b, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary()), kinds], names=["part", "block", "sums", "totals"])


def _totals(answers: DataFrame, size: int):
    """The sums of all parts' totals; ``size`` numbers come to the driver."""
    import numpy as np

    out = np.zeros(size)
    for r in answers.where("block is null").select(F.posexplode("totals").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def answered(blocks_: DataFrame, answers: DataFrame) -> DataFrame:
    """``blocks_`` with ``found``, the answers (part, sums) to each block; as many as there are parts. Blocks are dealt by
    number, a few to a task."""
    n = max(1, -(-blocks_.count() // 4))
    by_block = answers.where("block is not null").repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct("part", "sums")).alias("found"))
    return blocks_.repartition(n, "block").join(by_block, "block", "left")


def with_counts(stored: DataFrame, counted: DataFrame, parts: int, classes: int) -> DataFrame:
    """KNOWN rows: blocks with the class and the count ``c`` of each word, and for each frequent word its part and number."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = [c.split()[0] for c in KNOWN.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("hashes")[i].as_buffer(), "<u4")
                c, places, of = np.zeros(len(hashes), "<i8"), np.full((len(hashes), 2), -1, "<i4"), _parts_of(hashes, parts)
                sums = {r["part"]: r["sums"] for r in batch.column("found")[i].as_py() or ()}
                for part, at in _by_part(of) if sums else ():
                    c[at], places[at, 1] = np.frombuffer(sums[part], "<i8", len(at)), np.frombuffer(sums[part], "<i4", len(at), 8 * len(at))
                places[:, 0] = np.where(places[:, 1] < 0, -1, of)
                kept = [batch.column(k).slice(i, 1) for k in names[:5]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([x.tobytes()], pa.binary()) for x in ((hashes % np.uint32(classes)).astype("<u2"), c, places))], names=names)

    slim = stored.select("block", "doc_ids", "held", "lengths", "ids", "hashes")
    return materialize(answered(slim, counted).mapInArrow(run, KNOWN), "lm-known")


class Model:
    """Start, transition and emission probabilities; ``classes`` is the number of word classes, one more is the end."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, class_counts, states: int, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        share = (class_counts + 0.5) / (class_counts + 0.5).sum()
        emit = share[None, :] * rng.uniform(0.5, 1.5, (states, len(share)))
        move = np.full((states, states), 0.03 / max(1, states - 1)) + np.eye(states) * 0.97
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def estimated(cls, counts, states: int, class_share):
        """From expected counts, each emission smoothed by a tenth of a count's share of the classes."""
        import numpy as np

        start, move, emit = counts[:states] + 0.5, counts[states : states + states**2].reshape(states, states) + 0.5, counts[states + states**2 :].reshape(states, -1)
        emit = emit + 0.1 * len(class_share) * class_share[None, :]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def posteriors(model: Model, rows, relative=None):
    """For groups of whole symbol sequences: (symbols, their posteriors, a row a state, expected starts, expected transitions).

    Sequences are taken longest first and laid out by steps: those still going on at a step stand beside each other, and
    are the first ones of the step before. So both recursions run over the same rows, a product over all of them a step,
    and a group has enough tokens that a step is wide. Every 16th step is brought to a sum of 1 in the forward recursion,
    and divided by the same in the backward one, which begins with 1 / the forward sum of the last step; so the products
    of both are the posteriors as they are. ``relative``: (symbols, states) emissions.
    """
    import numpy as np

    s = len(model.start)
    relative = np.ascontiguousarray((model.emit / model.emit.mean(0)).T) if relative is None else relative
    move, back, one = np.ascontiguousarray(model.move), np.ascontiguousarray(model.move.T), np.ones(s)
    rows = sorted(rows, key=len, reverse=True)
    size = np.array([len(r) for r in rows], np.int64)
    of_group = (np.cumsum(size) - size) // GROUP_TOKENS
    for g in np.unique(of_group):
        lo, hi = np.searchsorted(of_group, [g, g + 1])
        part = size[lo:hi]
        alive = np.searchsorted(-part, -np.arange(1, part[0] + 1), side="right") if part[0] else np.zeros(0, np.int64)
        if not len(alive):
            continue
        at = np.cumsum(alive) - alive
        own = np.arange(part.sum(), dtype=np.int32) - np.repeat(at.astype(np.int32), alive)
        begun = (np.cumsum(part) - part).astype(np.int32)
        seen = np.concatenate(rows[lo:hi])[begun[own] + np.repeat(np.arange(len(alive), dtype=np.int32), alive)]
        ahead, post, moved, scales = np.empty((len(seen), s)), np.empty((s, len(seen))), np.zeros((s, s)), {}
        places = list(zip(at.tolist(), (at + alive).tolist(), strict=True))
        of_run = at // RUN_TOKENS
        runs = np.append(np.flatnonzero(np.diff(of_run, prepend=-1)), len(alive)).tolist()
        runs = list(zip(runs, runs[1:], strict=False))
        before = 0
        for first, until in runs:
            base = places[first][0]
            fits = np.take(relative, seen[base : places[until - 1][1]], axis=0)
            for t in range(first, until):
                a, b = places[t]
                now = ahead[a:b]
                if t:
                    np.dot(ahead[before : before + b - a], move, out=now)
                else:
                    now[:] = model.start
                np.multiply(now, fits[a - base : b - base], out=now)
                if t and t % 16 == 0:
                    scales[t] = (now @ one)[:, None]
                    now /= scales[t]
                before = a
        last = np.sort(at[part[: alive[0]] - 1] + np.arange(alive[0]))
        ends = (1 / (ahead[last] @ one))[:, None]
        carried = np.empty((0, s))  # the first step of the run that was done before
        for first, until in reversed(runs):
            base, stop = places[first][0], places[until - 1][1]
            fits = np.take(relative, seen[base:stop], axis=0)
            behind, after = np.empty_like(fits), np.empty_like(fits)  # after: the next step and all that follows, by its state
            x, y = np.searchsorted(last, (base, stop))
            behind[last[x:y] - base], after[last[x:y] - base] = ends[x:y], 0
            for t in range(until - 1, first - 1, -1):
                a, b = places[t][0] - base, places[t][1] - base
                n = len(carried) if t == until - 1 else places[t + 1][1] - places[t + 1][0]
                if t == until - 1:
                    after[a : a + n] = carried
                np.dot(after[a : a + n], back, out=behind[a : a + n])
                if t > first:
                    o = places[t - 1][0] - base
                    now = after[o : o + b - a]
                else:
                    now = carried = np.empty((b - a, s))
                np.multiply(behind[a:b], fits[a:b], out=now)
                if t in scales:
                    now /= scales[t]
            for i in range(s):
                np.multiply(ahead[base:stop, i], behind[:, i], out=post[i, base:stop])
            moved += ahead[base:stop].T @ after
        yield seen, post, post[:, : alive[0]].sum(1), model.move * moved


def expected_counts(model: Model, rows):
    """Baum-Welch counts (start, transitions, emissions, flat) of whole class sequences, given as integer arrays."""
    import numpy as np

    s, k = model.emit.shape
    start, moved, emit = np.zeros(s), np.zeros((s, s)), np.zeros((s, k))
    for seen, post, begun, went in posteriors(model, rows):
        start += begun
        moved += went
        for i in range(s):
            emit[i] += np.bincount(seen, post[i], k)
    return np.concatenate([start, moved.ravel(), emit.ravel()])


def forward(start, move, emit, flat, lengths):
    """log10 likelihood of each sequence of symbols, whole; ``flat`` holds them one after the other, ``emit`` is (symbols, states)."""
    import numpy as np

    lengths = np.asarray(lengths)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.concatenate([[0], np.cumsum(lengths)])[:-1])[order]
    size = lengths[order]
    total = np.zeros(len(size))
    a = None
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for t, n in enumerate(alive.tolist()):
        a = (start[None, :] if t == 0 else a[:n] @ move) * emit[flat[begin[:n] + t]]
        scale = a.sum(1)
        a /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(size))
    out[order] = total
    return out


def _sequences(lengths, ids, end: int):
    """Symbols of a block's documents, each followed by the end, and their lengths."""
    import numpy as np

    lengths = np.array(lengths, np.int64)
    return np.insert(ids, np.cumsum(lengths), end), lengths + 1


def _split(symbols, lengths, held) -> list:
    """Sequences of training documents, from symbols of them alone."""
    import numpy as np

    sizes = np.array(lengths, np.int64)[~np.array(held, bool)] + 1
    return np.split(symbols, np.cumsum(sizes)[:-1]) if len(sizes) else []


def train(stored: DataFrame, class_counts, states: int, classes: int, rounds: int) -> Model:
    """``rounds`` rounds of Baum-Welch, each over all training documents, whole.

    Each round sums the expected counts over partitions; states * (states + classes + 2) sums come to the driver, however
    many documents.
    """
    import numpy as np

    needed = stored.select("held", "lengths", "trained")
    share = (class_counts + 0.5) / (class_counts + 0.5).sum()
    model = Model.initial(class_counts, states)
    for _ in range(rounds):

        def count(batches, model=model) -> Iterator:
            import pyarrow as pa

            total = 0
            for batch in batches:  # its blocks together, so that steps of long documents are wider
                total = total + expected_counts(model, [x for held, lengths, symbols in _rows([batch], "held", "lengths", "trained") for x in _split(np.frombuffer(symbols, "<u2"), lengths, held)])
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "n"])

        counts = np.zeros(states * (1 + states + classes + 1))
        for r in needed.mapInArrow(count, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts[r["at"]] = r["n"]
        if counts.sum() > 0:
            model = Model.estimated(counts, states, share)
    return model


#: Sums of the tasks of ``word_posteriors`` are added in so many parts.
TOTAL_PARTS = 64


def word_posteriors(known: DataFrame, model: Model, states: int, classes: int) -> DataFrame:
    """ANSWER rows: for each block and part how often each state is expected to emit the block's frequent words of that part,
    over all training documents. Rows without block have the sums by state and class of all words, then of frequent ones."""

    def deal(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names, relative, totals = ["part", "block", "numbers", "values"], (model.emit / model.emit.mean(0)).T, np.zeros((2, states, classes))
        for block, held, lengths, ids, of, places in _rows(batches, "block", "held", "lengths", "ids", "classes", "places"):
            of, ids, places = np.frombuffer(of, "<u2"), _unpack(ids), np.frombuffer(places, "<i4").reshape(-1, 2)
            end, seen = len(of), np.zeros((states, len(of) + 1))
            flat, sizes = _sequences(lengths, ids, end)
            rows = [x for x, out in zip(np.split(flat, np.cumsum(sizes)[:-1]), held, strict=True) if not out]
            for symbols, post, _, _ in posteriors(model, rows, relative[np.append(of, classes)]):
                for i in range(states):
                    seen[i] += np.bincount(symbols, post[i], end + 1)
            often = np.flatnonzero(places[:, 1] >= 0)
            for i in range(states):
                totals[0, i] += np.bincount(of, seen[i, :end], classes)
                totals[1, i] += np.bincount(of[often], seen[i, often], classes)
            made = [(p, places[often[at], 1].tobytes(), np.ascontiguousarray(seen[:, often[at]].T).astype("<f4").tobytes()) for p, at in _by_part(places[often, 0])] if len(often) else []
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([block] * len(made), pa.int64()), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([-1 - TaskContext.get().partitionId() % TOTAL_PARTS], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([totals.tobytes()], pa.binary())], names=names)

    def add(batches) -> Iterator:
        import numpy as np

        def answers(part, held, sums):
            if part < 0:
                return _answers(part, [(None, None)], sums)
            return _answers(part, ((block, sums[ids].astype("<f4").tobytes()) for block, ids in held))

        now, held, sums = None, [], None
        for part, block, numbers, values in _rows(batches, "part", "block", "numbers", "values"):
            if part != now:
                if now is not None:
                    yield from answers(now, held, sums)
                now, held, sums = part, [], np.zeros(2 * states * classes) if part < 0 else np.zeros((1 << 10, states))
            if part < 0:
                sums += np.frombuffer(values)
                continue
            ids = np.frombuffer(numbers, "<i4").copy()
            while ids.max() >= len(sums):
                sums = np.concatenate([sums, np.zeros_like(sums)])
            sums[ids] += np.frombuffer(values, "<f4").reshape(-1, states)
            held.append((block, ids))
        if now is not None:
            yield from answers(now, held, sums)

    asked = known.select("block", "held", "lengths", "ids", "classes", "places").mapInArrow(deal, "part int, block long, numbers binary, values binary")
    return materialize(asked.repartition("part").sortWithinPartitions("part", "block").mapInArrow(add, ANSWER), "lm-emissions")


def word_shares(model: Model, c, of, seen, often, in_class, class_kinds, expected, frequent_share, prior: float):
    """(words + 1, states) emissions of a block's words and of the end: the class's, times the word's share of the class.

    A word's share is its count's, q = (c + 0.5) / (sum of the class + 0.5 * (kinds + 1)), the unknown word being one of the
    kinds; ``frequent_share`` are the sums of frequent words' q. A frequent word's share in a state is (expected emissions + ``prior`` * q) / (expected emissions of the class +
    ``prior``); what the class's frequent words leave is shared by the others as their q are. Shares of a class sum to 1.
    """
    import numpy as np

    classes = len(in_class)
    q = (c + 0.5) / (in_class + 0.5 * (class_kinds + 1))[of]
    whole = expected[0] + prior
    others = (1 - (expected[1] + prior * frequent_share) / whole) / (1 - frequent_share)
    share = others.T[of] * q[:, None]
    share[often] = (seen + prior * q[often, None]) / whole.T[of[often]]
    out = np.empty((len(c) + 1, model.emit.shape[0]))
    out[:-1] = model.emit.T[of] * share
    out[-1] = model.emit[:, classes]
    return out


def score(docs: DataFrame, states: int = 6, classes: int = 1024, rounds: int = 14, block_bytes: int = 8 << 20, frequent: int = 32, prior: float = 32.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Null and empty texts are the end token alone. An empty table gives an empty result; with no training document all
    words are unknown. Repeated rows are scored and, if of the training part, counted each time.
    """
    import numpy as np

    stored = blocks(docs, classes, block_bytes, id_col, text_col)
    size = stored.agg(F.sum("n_words").alias("pairs"), F.sum(F.size(F.filter("held", lambda h: ~h))).alias("trained")).first()
    parts, trained = max(1, -(-(size.pairs or 0) // PART_PAIRS)), size.trained or 0
    counted = count_words(stored, parts, classes, frequent)
    kinds, in_class, frequent_kinds, in_frequent = np.split(_totals(counted, 4 * classes), 4)
    total, vocabulary = float(in_class.sum()) + trained, float(kinds.sum()) + (1 if trained else 0)
    model = train(stored, np.append(in_class, trained), states, classes, rounds)
    known = with_counts(stored, counted, parts, classes)
    seen = word_posteriors(known, model, states, classes)
    expected = _totals(seen, 2 * states * classes).reshape(2, states, classes)
    frequent_share = (in_frequent + 0.5 * frequent_kinds) / (in_class + 0.5 * (kinds + 1))
    base_all = np.log10(total + 0.5 * (vocabulary + 1))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc_ids, held, lengths, ids, of, c, places, found in _rows([batch], "doc_ids", "held", "lengths", "ids", "classes", "c", "places", "found"):
                c, ids, of = np.frombuffer(c, "<i8"), _unpack(ids), np.frombuffer(of, "<u2")
                places = np.frombuffer(places, "<i4").reshape(-1, 2)
                often = np.flatnonzero(places[:, 1] >= 0)
                spoken, sums = np.zeros((len(often), states)), {r["part"]: r["sums"] for r in found or ()}
                for part, at in _by_part(places[often, 0]) if len(often) else ():
                    spoken[at] = np.frombuffer(sums[part], "<f4").reshape(-1, states)
                emit = word_shares(model, c, of, spoken, often, in_class, kinds, expected, frequent_share, prior)
                flat, lengths = _sequences(lengths, ids, len(c))

                def by_doc(values, n=lengths - 1, ids=ids):
                    sums = np.concatenate([[0.0], np.cumsum(values[ids])])
                    ends = np.cumsum(n)
                    return sums[ends] - sums[ends - n]

                known_words = by_doc((c > 0).astype(float)).astype(np.int64) + (1 if trained else 0)
                base = by_doc(np.log10(c + 0.5)) + np.log10(trained + 0.5) - lengths * base_all
                whole = forward(model.start, model.move, emit, flat, lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lengths.astype(np.int64)), pa.array(known_words), pa.array(np.full(len(lengths), int(total), np.int64)), pa.array(base), pa.array(whole)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return answered(known, seen).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
