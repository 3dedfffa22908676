import functools
import hashlib
import io
import base64
import itertools
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest

from corvid.llm import embed, lm, warc
from tests.llm.test_text_operators import WORD, brute_components, texts


# 4
def check_vectors(spark, rows, threshold=0.95, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vec string, rep string, pair string")
    got = {r.vec_id: r for r in embed.near_duplicates(df, threshold, **how).collect()}
    unit = {}
    for i, v, *_ in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(np.float32(v), np.float64)
            unit[i] = x / np.linalg.norm(x)
    linked = [(a, b) for a, b in itertools.combinations(sorted(unit), 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    n = Counter(x for pair in linked for x in pair)
    components = brute_components([r[0] for r in rows], linked)
    assert len(got) == len(rows)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (n[i], components[i], i == components[i])
    return len(linked)


@pytest.mark.parametrize("how", [{}, {"tile": 40, "max_pivots": 8}, {"tile": 16, "max_pivots": 1}])
def test_vectors_match_all_pairs(spark, how):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = [(int(i), (centres[i % 12] * rng.uniform(0.1, 9) + rng.normal(size=24) * rng.uniform(0, 0.5)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)]
    rows += [(300, None), (301, [0.0] * 24), (302, [float("nan")] + [1.0] * 23), (303, [float("inf")] + [1.0] * 23), (304, [None] + [1.0] * 23), (305, []), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1e-30] * 24), (309, [1e30] * 24)]
    assert check_vectors(spark, [(*r, 1, "a", "b", "c") for r in rows], **how) > 500


def test_vectors_of_the_table_and_none(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert check_vectors(spark, [(r.vec_id, r.embedding, 0, "", "", "") for r in df.collect()]) >= 0
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(0)
    unit = embed._unit(rng.normal(size=(300, 33)))
    codes, scale, error, norm = embed._quantise(unit)
    dots = (codes.astype(float) * scale[:, None]) @ (codes.astype(float) * scale[:, None]).T
    assert (np.abs(unit @ unit.T - dots) <= error[:, None] * norm[None, :] + error[None, :]).all()


# 8
def brute_scores(rows, model_of):
    tokens = [[*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)), None] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = [sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) for ws in tokens]
    return tokens, held, counts, n, base


def brute_word_emissions(m, rows, tokens, held, counts, classes, frequent, prior):
    """P(word | state) of every word of a document or None for the end, and of an unknown one."""
    of = lambda w: zlib.crc32(w.encode()) % classes
    s = len(m.start)
    gamma = {}
    for ws, h in zip(tokens, held, strict=True):
        if h:
            continue
        x = [classes if w is None else of(w) for w in ws]
        a, b = np.zeros((len(x), s)), np.ones((len(x), s))
        for t, k in enumerate(x):
            a[t] = (m.start if t == 0 else a[t - 1] @ m.move) * m.emit[:, k]
            a[t] /= a[t].sum()
        for t in range(len(x) - 2, -1, -1):
            b[t] = m.move @ (m.emit[:, x[t + 1]] * b[t + 1])
            b[t] /= b[t].sum()
        for t, w in enumerate(ws[:-1]):
            gamma[w] = gamma.get(w, 0) + a[t] * b[t] / (a[t] * b[t]).sum()
    size, kinds = np.zeros(classes), np.zeros(classes)
    for w, c in counts.items():
        size[of(w)] += c
        kinds[of(w)] += 1
    q = lambda w: (counts[w] + 0.5) / (size[of(w)] + 0.5 * (kinds[of(w)] + 1))
    all_, own, mass = np.zeros((s, classes)), np.zeros((s, classes)), np.zeros(classes)
    for w, g in gamma.items():
        all_[:, of(w)] += g
        if counts[w] >= frequent:
            own[:, of(w)] += g
            mass[of(w)] += q(w)

    def emission(w):
        if w is None:
            return m.emit[:, classes]
        k = of(w)
        if counts[w] >= frequent:
            return m.emit[:, k] * (gamma[w] + prior * q(w)) / (all_[:, k] + prior)
        return m.emit[:, k] * (all_[:, k] - own[:, k] + prior * (1 - mass[k])) / (all_[:, k] + prior) * q(w) / (1 - mass[k])

    return emission


@pytest.mark.parametrize("frequent", [3, 10**9])
def test_base_scores_and_exact_forward(spark, odd, both, monkeypatch, frequent):
    kept = {}
    real = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("model", real(*a)))
    monkeypatch.setattr(lm, "PART_PAIRS", 500)
    for df in (odd, both):
        kept.clear()
        rows = texts(df)
        got = sorted((r.asDict() for r in lm.score(df, states=3, classes=64, rounds=1, block_bytes=20000, frequent=frequent, prior=4.0).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"]))
        tokens, held, counts, n, base = brute_scores(rows, None)
        del counts[None]
        order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], len(tokens[i])))
        assert len(got) == len(rows)
        m = kept["model"]
        emission = brute_word_emissions(m, rows, tokens, held, counts, 64, frequent, 4.0)
        emission = functools.cache(emission)
        for r, i in zip(got, order, strict=True):
            assert (r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) == (rows[i][0], held[i], len(tokens[i]), n)
            assert r["n_known"] == sum(w is None or counts[w] > 0 for w in tokens[i])
            assert r["base_score"] == pytest.approx(base[i], rel=1e-9)
            if len(tokens[i]) < 400:
                a, total = m.start, 0.0
                for t, w in enumerate(tokens[i]):
                    a = (a if t == 0 else a @ m.move) * emission(w)
                    total += np.log10(a.sum())
                    a = a / a.sum()
                assert r["score"] == pytest.approx(total, rel=1e-5)


def test_emissions_of_a_state_sum_to_one(spark, both, monkeypatch):
    kept = {}
    real = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("model", real(*a)))
    rows = texts(both)
    lm.score(both, states=3, classes=8, rounds=1, block_bytes=20000, frequent=3, prior=4.0).count()
    tokens, held, counts, _, _ = brute_scores(rows, None)
    del counts[None]
    emission = brute_word_emissions(kept["model"], rows, tokens, held, counts, 8, 3, 4.0)
    unknown = {}
    for i in itertools.count():
        unknown.setdefault(zlib.crc32(f"no-{i}".encode()) % 8, f"no-{i}")
        if len(unknown) == 8:
            break
    assert sum(emission(w) for w in [*counts, *unknown.values(), None]) == pytest.approx(np.ones(3))


def test_model_beats_counts_on_held_out_documents(spark):
    """So does a model whose states emit words beat one whose states emit classes alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r, c = (lm.score(docs, frequent=n).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first() for n in (32, 10**9))
    assert r.s > c.s > c.b


def test_more_rounds_raise_the_likelihood():
    rng = np.random.default_rng(3)
    rows = [rng.choice(6, 40, p=[0.4, 0.4, 0.1, 0.1, 0, 0]) if i % 2 else rng.choice(6, 40, p=[0, 0, 0.1, 0.1, 0.4, 0.4]) for i in range(60)]
    counts = np.bincount(np.concatenate(rows), minlength=6).astype(float)
    share = (counts + 0.5) / (counts + 0.5).sum()
    model, flat, size = lm.Model.initial(counts, 2), np.concatenate(rows), [40] * 60
    seen = [lm.forward(model.start, model.move, model.emit.T, flat, size).sum()]
    for _ in range(12):
        model = lm.Model.estimated(lm.expected_counts(model, rows), 2, share)
        seen.append(lm.forward(model.start, model.move, model.emit.T, flat, size).sum())
    assert seen[-1] > seen[0] + 50


def brute_round(model, rows):
    s, k = model.emit.shape
    start, move, emit = np.zeros(s), np.zeros((s, s)), np.zeros((s, k))
    for r in rows:
        a, b, scale = np.zeros((len(r), s)), np.ones((len(r), s)), np.ones(len(r))
        for t, x in enumerate(r):
            a[t] = (model.start if t == 0 else a[t - 1] @ model.move) * model.emit[:, x]
            scale[t] = a[t].sum()
            a[t] /= scale[t]
        for t in range(len(r) - 2, -1, -1):
            b[t] = model.move @ (model.emit[:, r[t + 1]] * b[t + 1]) / scale[t + 1]
        start += a[0] * b[0]
        for t, x in enumerate(r):
            emit[:, x] += a[t] * b[t]
            if t:
                move += np.outer(a[t - 1], model.emit[:, x] * b[t] / scale[t]) * model.move
    return np.concatenate([start, move.ravel(), emit.ravel()])


def test_expected_counts_of_whole_sequences():
    rng = np.random.default_rng(8)
    rows = [rng.integers(0, 9, n) for n in (150_000, 120_000, 2000, 700, 700, 300, 129, 128, 17, 16, 1, 1)]
    model = lm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.full(9, 0.1), 3) + 1e-9)
    assert lm.expected_counts(model, rows) == pytest.approx(brute_round(model, rows), rel=1e-8, abs=1e-9)
    assert not lm.expected_counts(model, []).any()


def test_short_sequences_make_wide_steps():
    rng = np.random.default_rng(9)
    model = lm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(9), 3))
    made = list(lm.posteriors(model, [rng.integers(0, 9, 200) for _ in range(600)]))
    assert len(made) == 1  # one group, so 200 steps for all of them
    assert made[0][1].sum(0) == pytest.approx(np.ones(120_000), rel=1e-9)


@pytest.mark.parametrize(("group", "run"), [(1, 1), (50, 1), (300, 40), (1 << 20, 1), (1 << 20, 64)])
def test_counts_are_the_same_however_steps_are_cut(monkeypatch, group, run):
    monkeypatch.setattr(lm, "GROUP_TOKENS", group)
    monkeypatch.setattr(lm, "RUN_TOKENS", run)
    rng = np.random.default_rng(10)
    rows = [rng.integers(0, 9, n) for n in (90, 90, 61, 33, 32, 17, 16, 16, 2, 1, 1, 0)]
    model = lm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.full(9, 0.1), 3) + 1e-9)
    assert lm.expected_counts(model, rows) == pytest.approx(brute_round(model, [r for r in rows if len(r)]), rel=1e-8, abs=1e-9)


def test_every_round_sees_all_documents_whole(spark, monkeypatch):
    kept, real = {}, lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("model", real(*a)))
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, int(n))) or None) for i, n in enumerate(rng.integers(0, 600, 40))]
    lm.score(spark.createDataFrame(docs, "doc_id long, text string"), states=2, classes=8, block_bytes=4000).count()
    rows = [np.array([zlib.crc32(w.encode()) % 8 for w in (text or "").split()] + [8]) for i, text in docs if not lm.held_out(i)]
    counts = np.bincount(np.concatenate(rows), minlength=9).astype(float)
    share = (counts + 0.5) / (counts + 0.5).sum()
    model = lm.Model.initial(counts, 2)
    for _ in range(14):
        model = lm.Model.estimated(brute_round(model, rows), 2, share)
    for a, b in ((kept["model"].start, model.start), (kept["model"].move, model.move), (kept["model"].emit, model.emit)):
        assert a == pytest.approx(b, rel=1e-6)


def test_scores_of_nothing(empty):
    assert lm.score(empty).count() == 0


# 10
def check_pages(spark, rows, folder, **how):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest string, first string")
    got = warc.read(warc.write(df, folder, **how), folder, payloads=True).collect()
    first = {}
    for i, _, h, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault((h or "").encode(), i)
    want = Counter()
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        revisit = len(p) >= how.get("min_bytes", 0) and p in first and first[p] != i
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[p] if revisit else None, None if revisit else p] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert all(r.digest_ok for r in got)


PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b\r\nX: y", ""), (4, "u", "<p>x</p>"), (5, "u", "é" * 50000), (5, "u", "é" * 50000), (6, "", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "no id"), (None, "u", "no id"), (None, None, "<p>x</p>"), (None, None, None)]


@pytest.mark.parametrize("how", [{}, {"min_bytes": 5}, {"zip64": True, "records_per_package": 2}])
def test_pages_round_trip(spark, tmp_path, how):
    check_pages(spark, [(*r, "a", "b", "c") for r in PAGES], f"file://{tmp_path}/w", **how)


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df, folder=f"file://{tmp_path}/w").count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    out = io.BytesIO()
    z = warc.ZipWriter(out, zip64)
    z.member("a.txt", [b"one", b"two"])
    z.member("b", [])
    z.close()
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as f:
        assert f.read("a.txt") == b"onetwo" and f.read("b") == b"" and f.testzip() is None
    places = warc.directory(lambda at, n: raw[at : at + n], len(raw))
    assert raw[places["a.txt"][0] :][: places["a.txt"][1]] == b"onetwo" and places["b"][1] == 0


def test_packages_of_others_are_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        f.writestr("stored", b"abc")
        f.writestr(zipfile.ZipInfo("packed"), b"x" * 1000, zipfile.ZIP_DEFLATED)
        f.comment = b"PK\x05 not the end"
    raw = out.getvalue()
    places = warc.directory(lambda at, n: raw[at : at + n], len(raw))
    assert list(places) == ["stored"] and raw[places["stored"][0] :][:3] == b"abc"
