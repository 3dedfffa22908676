import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from corvid.llm import codec, lines, packing, quality, queries, secrets, simhash, tokens

SF = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# 1
def test_token_rollup_matches_a_recount(spark, both, tmp_path):
    rollup = tokens.TokenRollup(spark, f"file://{tmp_path}/r", {"words-1": tokens.count_words, "bpe": tokens.bpe_counter(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern())})
    docs = both.dropDuplicates(["doc_id"])
    assert rollup.apply("a", docs.selectExpr("*", "false as deleted"))
    changes = docs.where("doc_id % 3 = 0").selectExpr("doc_id", "text", "source", "lang", "true as deleted").unionByName(docs.where("doc_id % 3 = 1").selectExpr("doc_id", "concat(text, ' more words') as text", "'moved' as source", "lang", "false as deleted"))
    assert rollup.apply("b", changes)
    assert not rollup.apply("b", changes)
    now = {r.doc_id: r for r in docs.collect() if r.doc_id % 3}
    want = Counter()
    for i, r in now.items():
        text = r.text if i % 3 != 1 or r.text is None else r.text + " more words"
        key = ("moved" if i % 3 == 1 else r.source, r.lang)
        want[key, "words-1", "n"] += 1
        want[key, "words-1", "t"] += len(WORD.findall(text or ""))
    got = {(r["source"], r["lang"]): r for r in rows(rollup.totals().where("version = 'words-1'"))}
    assert {k[0] for k in want} == set(got)
    for (key, _, what), v in want.items():
        assert got[key]["n_docs" if what == "n" else "n_tokens"] == v
    assert rollup.totals().where("version = 'bpe'").count() == len(got)


def test_token_count_query_matches_a_recount(spark):
    """Without later copies and with revised texts, counted afresh by both tokenizers."""
    e, now, seen = reference_encoding(), Counter(), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assign = re.compile(secrets.ASSIGN.replace(r"\x20", " "))
    for r in docs:
        if r.text is not None and seen.setdefault(r.text, r.doc_id) != r.doc_id:
            continue
        text = assign.sub(lambda m: m[1], r.text or "")
        for version, n in (("words-1", len(WORD.findall(text))), ("byte_bpe_50k-1", len(e.encode_ordinary(text)))):
            now[r.source, r.lang, version, "docs"] += 1
            now[r.source, r.lang, version, "tokens"] += n
    got = queries.op1_token_counts(spark, SF).collect()
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in got} == {k[:3]: (n, now[*k[:3], "tokens"]) for k, n in now.items() if k[3] == "docs"}


def test_token_rollup_of_nothing_and_failed_attempts(spark, empty, odd, tmp_path):
    rollup = tokens.TokenRollup(spark, f"file://{tmp_path}/r", {"w": tokens.count_words})
    assert rollup.totals().count() == 0
    assert rollup.apply("none", empty.selectExpr("*", "false as deleted"))
    assert rollup.totals().count() == 0
    spark.range(1).write.parquet(f"file://{tmp_path}/r/totals/left-behind")
    assert not rollup._commit("none", "a-later-attempt") and len(rollup._attempts()) == 1
    assert rollup.apply("odd", odd.selectExpr("*", "false as deleted"))
    assert rollup.totals().selectExpr("sum(n_docs)").first()[0] == odd.count()
    assert rollup.apply("gone", odd.selectExpr("doc_id", "text", "source", "lang", "true as deleted"))
    assert rollup.totals().selectExpr("sum(n_docs)").first()[0] == odd.where("doc_id is null").count() > 0


# 2
def brute_lines(docs, min_words=5):
    """Dropped (doc, line) by reason, all pairs compared."""
    first, order, equal, close = {}, [], set(), set()
    for doc, text in sorted(docs, key=lambda d: d[0]):
        for i, line in enumerate(text.split("\n")):
            w = tuple(line.encode().split())
            if not w:
                continue
            if w in first:
                equal.add((doc, i))
            else:
                first[w] = (doc, i)
                order.append(w)
    by_size = defaultdict(list)
    for w in order:
        near = any(lines.within_one(list(w), list(x)) for n in (len(w) - 1, len(w), len(w) + 1) if max(n, len(w)) >= min_words for x in by_size[n])
        if near:
            close.add(first[w])
        by_size[len(w)].append(w)
    return equal, close


def test_line_dedup_matches_all_pairs(spark, both):
    docs = both.dropDuplicates(["doc_id"])
    noisy = docs.unionByName(docs.where("doc_id >= 1000 and doc_id < 1060").selectExpr("doc_id + 5000 as doc_id", r"regexp_replace(text, '(?m)^(\\S+ \\S+ )\\S+', '$1changed') as text", "lang", "source", "n_chars"))
    noisy = noisy.unionByName(docs.where("doc_id >= 1060 and doc_id < 1100").selectExpr("doc_id + 5000 as doc_id", r"regexp_replace(text, '(?m)\\S+$', '') as text", "lang", "source", "n_chars"))
    equal, close = brute_lines(texts(noisy))
    got = {r["doc_id"]: r for r in rows(lines.report(noisy))}
    assert len(close) > 50 and len(got) == noisy.count()
    assert {(d, int(x)) for d, r in got.items() for x in r["dropped"].split(",") if x} == equal | close
    assert sum(r["n_equal"] for r in got.values()) == len(equal) and sum(r["n_near"] for r in got.values()) == len(close)
    kept = {r.doc_id: r.text for r in lines.remove(noisy).collect()}
    for d, t in texts(noisy):
        want = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in equal | close)
        assert (kept[d] or "") == want


def test_line_dedup_of_odd_rows(odd, empty):
    assert lines.report(empty).count() == 0 and lines.remove(empty).count() == 0
    assert lines.report(odd).count() == odd.select("doc_id").distinct().count()
    out = lines.remove(odd)
    assert out.count() == odd.count() and out.columns == odd.columns


def test_line_dedup_of_repeated_rows_matches_all_pairs(spark, both):
    """Equal rows keep their lines; of rows with one doc_id and other texts each line is judged by its own words."""
    docs = both.where("coalesce(length(text), 0) < 20000").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(docs.where("doc_id % 5 = 0").selectExpr("doc_id", "concat('a line put before\n', text, ' x') as text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "no id at all here\nby any means"), (None, None), (7, "one two three four five\none two three four six"), (7, "one two three four seven")], "doc_id long, text string")).repartition(5)
    places = sorted({(r.doc_id, i, tuple(x.encode().split())) for r in docs.collect() if r.doc_id is not None for i, x in enumerate((r.text or "").split("\n")) if x.split()})
    no_id = {tuple(x.encode().split()) for r in docs.collect() if r.doc_id is None for x in (r.text or "").split("\n")}
    first = {}
    for d, i, w in places:
        if w not in no_id:
            first.setdefault(w, (d, i))
    gone = {(d, i, w) for d, i, w in places if first.get(w) != (d, i)}
    by_size = defaultdict(list)
    for w, place in sorted(first.items(), key=lambda x: x[1]):
        if any(first[x] < place and lines.within_one(list(w), list(x)) for n in (len(w) - 1, len(w), len(w) + 1) if max(n, len(w)) >= 5 for x in by_size[n]):
            gone.add((*place, w))
        by_size[len(w)].append(w)
    want = Counter((r.doc_id, None if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i, tuple(x.encode().split())) not in gone)) for r in docs.collect())
    got = Counter((r.doc_id, r.text) for r in lines.remove(docs).collect())
    assert got == want and len(gone) > 20
    twice = spark.createDataFrame([(5, "one line of six whole words\nsecond line")] * 2, "doc_id long, text string")
    assert [r.text for r in lines.remove(twice).collect()] == ["one line of six whole words\nsecond line"] * 2
    assert [(r.n_lines, r.n_equal, r.dropped) for r in lines.report(twice).collect()] == [(2, 0, "")]


def test_line_removal_is_linear_in_a_documents_lines(spark):
    import time

    took = []
    for n in (20_000, 20_000, 80_000):
        docs = spark.createDataFrame([(1, "the same line\n" * n + "end")], "doc_id long, text string")
        began = time.time()
        assert lines.remove(docs).first().text == "the same line\nend"
        took.append(time.time() - began)
    assert took[2] < 3 * took[1] + 5


def test_within_one():
    assert lines.within_one([], ["a"]) and lines.within_one(list("abc"), list("abd")) and lines.within_one(list("abc"), list("bc"))
    assert not lines.within_one(list("abc"), list("bca")) and not lines.within_one([], ["a", "b"]) and not lines.within_one(list("abc"), list("xbd"))


# 3
def base_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_scan_base_matches_re(spark, odd, both):
    more = spark.createDataFrame([(1, "password: token: abcdefghij é AKIA" + "A" * 12 + " token=1234567 TOKEN='abcdefgh' " + "a" * 31 + " " + "b" * 32), (2, "日本 secret = \"x.y-z_1234\"" + "0" * 40)], "doc_id long, text string")
    for df in (odd, both, more):
        got = rows(secrets.digest(secrets.scan(df)))
        want = Counter()
        for d, t in texts(df):
            spans = base_spans(t)
            said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
            want[d, *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(said.encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
        for r in got:
            assert r["n_assign"] + r["n_access"] + r["n_hex"] + r["n_markov"] == len([x for x in r["spans"].split(",") if x])


def test_markov_models_part_random_from_ordinary(spark, documents):
    import random

    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = ["".join(rng.choice(alphabet) for _ in range(32)) for _ in range(200)]
    plain = [f"{a}_{b}_{i}" for i, (a, b) in enumerate(zip(["the_anineration", "thereandthation", "ofthe_ationinger"] * 67, ["shouldbe_handled"] * 200, strict=False))]
    model = secrets.train(documents)
    df = spark.createDataFrame([(i, f"see {w} here") for i, w in enumerate(made + plain)], "doc_id long, text string")
    hit = {r.doc_id for r in df.select("doc_id", secrets.spans(df.text, model).alias("s")).where("size(s) > 0").collect()}
    assert len([i for i in hit if i < 200]) >= 190 and len([i for i in hit if i >= 200]) <= 4


def test_redaction(spark, odd, empty):
    assert secrets.redact(empty).count() == 0
    out = {r.doc_id: r.text for r in secrets.redact(odd.where("doc_id in (0, 12, 16)")).collect()}
    assert out[0] is None and out[16] == '[SECRET]" [SECRET] [SECRET]' and out[12] == dict(texts(odd))[12]


def test_secret_scan_is_native(odd):
    plan = secrets.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 5
def brute_measures(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def test_quality_measures_and_verdicts(odd, both):
    for df in (odd, both):
        want = Counter((d, *brute_measures(t)) for d, t in texts(df))
        got = rows(quality.judge(df))
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_quality_keeps_labelled_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = got.where("quality = 1").selectExpr("avg(kept::int) k").first().k
    bad = got.where("quality = 0").selectExpr("avg(kept::int) k").first().k
    assert good > 0.97 and bad < 0.5, (good, bad)


def test_quality_filter_keeps_rows_as_they_are(odd, empty):
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 2


def test_em_finds_the_better_rule():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    votes = [np.where(rng.random(20000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.8, 0.8, 0.6)]
    votes[3] = np.where(rng.random(20000) < 0.5, 0, votes[3])
    counts = Counter(zip(*[v.tolist() for v in votes], strict=True))
    post = quality.fit(sorted(counts.items()))
    assert post[1, -1, -1, 0] > 0.5 > post[-1, 1, 1, -1] - 0.45
    right = sum(c for v, c in Counter(zip(*[v.tolist() for v in votes], truth.tolist(), strict=True)).items() if (post[v[:4]] > 0.5) == v[4])
    assert right / 20000 > 0.94


# 6
def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_matches_all_pairs(both, odd):
    df = both
    prints = {d: brute_fingerprint(t) for d, t in texts(df)}
    ids = sorted(prints)
    want = brute_components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = rows(simhash.near_duplicates(df))
    assert len(got) == df.count()
    for r in got:
        assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("how", [{}, {"least_bits": 3, "part_keys": 1 << 12, "passes": 3}, {"least_bits": 12, "passes": 1}, {"least_bits": 15, "passes": 2}])
def test_simhash_links_in_dense_buckets(spark, how):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres} | {0, 1, 3, (1 << 64) - 1}
    for c in centres[:6]:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(1, 9)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    linked = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), **how).collect()
    assert brute_components(fps, linked) == brute_components(fps, [(r.src, r.dst) for r in found])


@pytest.mark.parametrize("apart", [1, 2, 3, 4])
def test_simhash_finds_every_pair_of_bits(spark, apart):
    """A pair that differs in just these bits is linked, wherever they are; pairs with one bit more are not."""
    rng = np.random.default_rng(apart)
    for extra in (0, 1) if apart == 4 else (0,):
        fps, want = [], set()
        for _ in range(300):
            x, bits = int(rng.integers(0, 2**63)), rng.permutation(64)[: apart + extra]
            y = x ^ sum(1 << int(b) for b in bits)
            x, y = (v - (1 << 64) if v >= 1 << 63 else v for v in (x, y))
            fps += [x, y]
            want.add((min(x, y), max(x, y)))
        found = {(min(r.src, r.dst), max(r.src, r.dst)) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
        assert found == (set() if extra else want)


def test_simhash_of_odd_rows(odd, empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    with_ids = odd.where("doc_id is not null")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(with_ids).collect()}
    assert groups[0] == groups[1] == groups[2] == 0 and groups[6] == 5
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.keep_one(odd).where("doc_id is null").count() == odd.where("doc_id is null").count()
    assert simhash.keep_one(with_ids).where("doc_id = 5").count() == 2


# 7
def reference_encoding():
    from corvid.llm import bpe

    return bpe.from_ranks(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern())


@pytest.mark.parametrize("leaf", [7, 64, 256, 8192])
def test_tree_encoding_matches_tiktoken(odd, both, leaf):
    encoder = codec.Encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern())
    for _, t in texts(odd) + texts(both.limit(60)):
        t = t if leaf > 64 else t[:4000]
        runs = codec.encode_tree(encoder, t, leaf)
        assert [int(i) for r in runs for i in r[2]] == encoder.encoding.encode_ordinary(t)
        assert [r[0] for r in runs[1:]] == [r[1] for r in runs[:-1]]


ALPHABETS = ["a", "ab", "etaoinshrdlu", "aé日本語ж", "0123456789", " ", " \n", "\t\n\u3000 ", "'", "'!", "!?.,'-", "'sltred", "a'", "a ", " 'lvre", "1a", "😀é", "\u0378a", "A\x1c ", "٠1²", "ﬁa日!1 '\n"]


@pytest.mark.parametrize("leaf", [4, 32, 256])
def test_tree_encoding_of_random_runs(leaf):
    """Long runs of one kind, of few kinds, and of the pattern's special cases, at every offset of the seams."""
    encoder = codec.Encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern())
    rng = random.Random(leaf)
    for alphabet in ALPHABETS:
        for n in [*range(1, 40), *(rng.randrange(40, 900) for _ in range(30))]:
            t = "".join(rng.choice(alphabet) for _ in range(n))
            if n % 3 == 0:
                t = "".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 40))) for a in rng.choices(ALPHABETS, k=n // 10 + 1))
            assert [int(i) for r in codec.encode_tree(encoder, t, leaf) for i in r[2]] == encoder.encoding.encode_ordinary(t), (alphabet, t)


@pytest.mark.parametrize("alphabet", ["etaoinshrdlu", "0123456789", "!?.,-", "日本語文字"])
def test_a_run_without_a_cut_is_encoded_about_once(alphabet):
    encoder = codec.Encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern())
    rng, seen = random.Random(3), []

    class Counting:
        sizes = encoder.sizes

        def __call__(self, part):
            seen.append(len(part))
            return encoder(part)

    t = "".join(rng.choice(alphabet) for _ in range(1 << 16))
    ids = [int(i) for r in codec.encode_tree(Counting(), t, 1024) for i in r[2]]
    assert ids == encoder.encoding.encode_ordinary(t) and len(seen) > 64 and sum(seen) < 1.5 * len(t)


def test_documents_of_the_table_join_and_match(spark):
    """All documents of the smallest table; every one of over 256 characters is halved and joined."""
    encoder = codec.Encoder(queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern())
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        runs = codec.encode_tree(encoder, r.text or "")
        assert [int(i) for x in runs for i in x[2]] == encoder.encoding.encode_ordinary(r.text or "")
        assert (len(runs) > 1) == (len(r.text or "") > 256)


def test_round_trip_digests(odd, empty):
    assert codec.round_trip(empty, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern()).count() == 0
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in codec.round_trip(odd, queries.vocabulary("byte_bpe_50k.tiktoken"), queries.split_pattern(), 256).collect())
    e = reference_encoding()
    want = Counter()
    for d, t in texts(odd):
        ids = e.encode_ordinary(t)
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want


# 9
def test_packing_against_tokenizers(odd, both, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    path, pattern = queries.vocabulary("byte_bpe_50k.json"), queries.split_pattern()
    assert packing.pack(packing.pieces(empty, path, pattern)).count() == 0
    for df in (odd, both):
        got = rows(packing.pack(packing.pieces(df, path, pattern)))
        want = Counter()
        for d, t in texts(df):
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
            n = len(ids)
            first = n if n <= 1024 else n % 1024 or 1024
            cuts = [0, *range(first, n, 1024), n]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        packed = defaultdict(list)
        for r in got:
            packed[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in packed.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        least = -(-sum(r["length"] for r in got) // 1024)
        assert len(packed) <= 1.03 * least + 2


def test_best_fit_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert p.add(7) == (0, 0) and p.add(6) == (1, 0) and p.add(4) == (1, 6)
    assert p.add(5) == (2, 0)  # open: bin 0 with 3 free, bin 2 with 5
    assert p.add(6) == (3, 0)  # bin 0, the fullest, closes
    assert p.add(3) == (3, 6) and p.add(3) == (2, 5)
    full = packing.BestFit(10, 5)
    assert full.add(10) == (0, 0) and full.count == 0 and full.add(10) == (1, 0)
