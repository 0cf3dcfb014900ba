"""The ten training-data operators and the pipeline, against brute force, round trips and edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kinforge.llm import bpe, components, html_text, packing, quality_mil, quality_rules, records, sharding, simhash, stats, substring, tokens, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = tokens.default_path()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, rank string, tie int, a string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())


def phrase(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, clashing columns."""
    long = phrase(1, 9000)
    texts = [None, "", " \n\t ", "one", long, long, "two words", phrase(2, 40), phrase(2, 40), phrase(3, 25) + " " + phrase(2, 40), "#### $$$ | | |" * 30, "x" * 5000, "<|endoftext|> ΑΣ İ é \x1c\x85 end"]
    data = [(i, t, None, "s", None, 1, "r", None, "b") for i, t in enumerate(texts)]
    data += [data[7], data[7], (7, "another text of the same id", "en", None, 3, None, None, 1, None), (None, phrase(2, 40), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# Tokens ---------------------------------------------------------------------------------------------
def test_encoders_equal_the_library(rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(PATH)
    r = random.Random(1)
    parts = ["a", "B", "'s", "'LL", " ", "\n", "\x1c", "\x85", "\xa0", "É", "é", "́", "Σ", "ΑΣ", "ß", "İ", "½", "漢", "한", "ᄒ", "ᅡ", "ᆫ", "🙂", "<|endoftext|>", "<|", "|>", "​", "\0", "12", "...", "x" * 900, "ab" * 300, "नि"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(600)] + [t for _, t in rows]
    own, lib = tokens.BatchedBpe(PATH), tokens.Encoder(PATH)
    for kind in (own, lib):
        ids, off = kind.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == tk.encode(t, add_special_tokens=False).ids, (kind, t)
    ids = tk.encode(" ".join(texts), add_special_tokens=False).ids
    assert own.decode(ids) == tk.decode(ids, skip_special_tokens=False)


def test_memory_limit_changes_nothing(rows):
    small, usual = tokens.Encoder(PATH), tokens.Encoder(PATH)
    small.memo = tokens.Memo(limit=50)
    texts = [t for _, t in rows[:60]]
    for lo in range(0, 60, 7):
        a, b = small.encode(pa.array(texts[lo : lo + 7])), usual.encode(pa.array(texts[lo : lo + 7]))
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_bpe_query(spark, documents, odd, none, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(PATH)

    def want(text):
        ids = tk.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    for df in (documents, odd, none):
        got = sorted((tuple(r) for r in bpe.digest_roundtrip(df, PATH).collect()), key=str)
        assert got == sorted(((r.doc_id, *want(r.text)) for r in df.collect()), key=str)
    ids = bpe.encode_texts(odd, PATH)
    back = {r.doc_id: r.text for r in bpe.decode_ids(ids, PATH).where("doc_id is not null and doc_id <> 7").collect()}
    assert back == {r.doc_id: tk.decode(r.ids, skip_special_tokens=False) for r in ids.where("doc_id is not null and doc_id <> 7").collect()}


# Sharding -------------------------------------------------------------------------------------------
def test_sharding(documents, odd, none):
    for df in (documents, odd):
        got = sharding.shard_documents(df, sharding.tree_of(40), sharding.tree_of(41)).collect()
        assert len(got) == df.count() and all(r.law == "key" and (r.grown_shard in (r.shard, 40)) for r in got)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))
        want = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    assert sharding.shard_documents(none, sharding.tree_of(40)).count() == 0


def test_weights_and_confined_movement(spark):
    keys = spark.range(60_000).withColumnRenamed("id", "k")
    before = sharding.Tree((((1.0, 2.0), (1.0,)), ((1.0, 0.0), (3.0, 1.0))))
    after = sharding.Tree((((1.0, 2.0), (1.0,)), ((1.0, 0.0), (3.0, 3.0))))
    rows = sharding.with_shard(sharding.with_shard(keys, "k", before, "a"), "k", after, "b").groupBy("a", "b").count().collect()
    n = collections.Counter()
    for r in rows:
        n[r.a] += r["count"]
        # Region 1 takes keys from region 0; inside it only rack 1 does, and there only the heavier shard.
        assert r.a == r.b or (r.a < 3 and r.b in (3, 5, 6)) or (r.a == 3 and r.b in (5, 6)) or (r.a, r.b) == (5, 6)
    weights = [1, 2, 1, 1, 0, 3, 1]
    for shard, w in enumerate(weights):
        assert abs(n[shard] / 60_000 - w / sum(weights)) < 0.01


# Packing --------------------------------------------------------------------------------------------
def check_packing(out, capacity):
    used = collections.defaultdict(list)
    for r in out:
        used[r.sequence_id].append((r.offset, r.length))
    for v in used.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(used)


def test_packing(documents, odd, none):
    enc = tokens.Encoder(PATH)
    for df, cap in ((documents, 4096), (odd, 4096), (odd, 64)):
        out = packing.pack_documents(df, PATH, cap).collect()
        n = check_packing(out, cap)
        assert n <= 1.03 * math.ceil(sum(r.length for r in out) / cap) + 1
        want = []
        for r in df.collect():
            ids = np.append(enc.encode(pa.array([r.text or ""]))[0], np.uint32(1)).astype("<u4")
            want += [(r.doc_id, i // cap, i, len(ids[i : i + cap]), zlib.crc32(ids[i : i + cap].tobytes())) for i in range(0, len(ids), cap)]
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)
    assert packing.pack_documents(none, PATH).count() == 0


@pytest.mark.parametrize(("n", "mu", "sigma"), [(50, 6, 1), (10_000, 6.8, 1), (100_000, 7, 0.8)])
def test_plans_are_near_the_bound(n, mu, sigma):
    lengths = np.clip(np.random.default_rng(0).lognormal(mu, sigma, n).astype(int), 1, 4096)
    histogram = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    p = packing.plan(histogram)
    assert p.sequences <= 1.01 * math.ceil(lengths.sum() / 4096) + 1
    placed = collections.Counter()
    for length, _, count, _, _ in p.steps:
        placed[length] += count
    assert placed == histogram


def test_least_squares():
    r = np.random.default_rng(2)
    a, x = r.random((6, 12)), np.maximum(r.normal(size=12), 0)
    got = packing.nnls(a, a @ x, 20_000)
    assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-3


# Vectors --------------------------------------------------------------------------------------------
def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 16))
    near = np.concatenate([base[:40] + r.normal(scale=0.08, size=(40, 16)) for _ in range(4)])
    x = np.concatenate([base, near, base[:20], 3.0 * base[20:25]]).tolist()
    short = r.normal(size=(30, 3))
    x += short.tolist() + (short + 0.01).tolist() + [[1.0], [2.0], [-1.0]]
    rest = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 2), (903, [None] + [1.0] * 15, 2), (904, [float("inf")] + [1.0] * 15, None), (905, [1.0] * 7, 1), (906, [], 0)]
    data = [(i, v, 1) for i, v in enumerate(x)] + rest
    df = spark.createDataFrame([(*d, "x", 5) for d in data], "vec_id long, embedding array<float>, label int, pivot string, n int")
    got = {g.vec_id: g for g in vectors.near_vectors(df, block=50).collect()}
    assert len(got) == len(data) and all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 907))
    wide = collections.defaultdict(list)
    for i, v in enumerate(x):
        wide[len(v)].append(i)
    for width, ids in wide.items():
        u = np.array([x[i] for i in ids], np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        close = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
        assert sum(got[i].n_links for i in ids) >= 0.9 * close.sum() > 0, width
        assert all(got[i].n_links <= c.sum() for i, c in zip(ids, close, strict=True))
    for i in range(20):
        assert got[460 + i].component_id == got[i].component_id <= i
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(empty).count() == 0
    assert [tuple(t) for t in vectors.near_vectors(df.where("vec_id = 3")).collect()] == [(3, 0, 3, True)]
    odd = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [2.0, 4.0])], "vec_id long, embedding array<double>")
    assert sorted((tuple(t) for t in vectors.near_vectors(odd).collect()), key=str) == [(4, 2, 4, True), (4, 2, 4, True), (5, 2, 4, False), (None, 0, None, True)]


def test_recall_at_registered_parameters(spark):
    """As registered, on vectors that have links just above the threshold, against all pairs."""
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = r.normal(size=(1500, 64))
    off -= (off * x[:1500]).sum(axis=1, keepdims=True) * x[:1500]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([x, 0.953 * x[:1500] + math.sqrt(1 - 0.953**2) * off]).astype(np.float32)
    got = {g.vec_id: g.n_links for g in vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), 0.95).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert links.sum() >= 3000 and all(got[i] <= n for i, n in enumerate(links.tolist()))
    assert sum(got.values()) >= 0.99 * links.sum()


def test_pivots_grow_with_the_root():
    n = [vectors.numbers_of_pivots({64: k})[64] for k in (2, 500, 10_000, 1_000_000, 10**12)]
    assert n == [2, 88, 400, 4000, vectors.MOST]
    many = vectors.numbers_of_pivots({w: 100_000 for w in range(1, 200)})
    assert sum(many.values()) <= vectors.MOST and min(many.values()) > 1


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(1, 80)] + [(5, 5)]
    up = {}

    def root(v):
        up.setdefault(v, v)
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {g.node: g.component for g in components.components(spark.createDataFrame(edges + [(None, 4)], "a long, b long")).collect()}
    assert got == {v: root(v) for a, b in edges if a != b for v in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substring dedup ------------------------------------------------------------------------------------
def brute_spans(rows):
    seen, out = {}, []
    for doc, text in rows:
        w = WORD.findall(text or "")
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                keep[i : i + 20] = [False] * 20
            else:
                seen[key] = (doc, i)
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((doc, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring(spark, documents, rows, odd, none):
    assert sorted(tuple(r) for r in substring.digests(documents).collect()) == brute_spans(rows)
    loop = "a b c " * 40
    crossing = [(1, phrase(5, 60)), (2, phrase(6, 60)), (3, phrase(5, 60) + " " + phrase(6, 60)), (4, loop), (5, loop + phrase(5, 30)), (6, phrase(5, 19)), (7, None)]
    df = spark.createDataFrame(crossing, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in substring.digests(df).collect()) == brute_spans(crossing)
    spans = {r.doc_id: r.spans for r in substring.deduplicate(df).collect()}
    assert [(s.start, s.end, s.src_doc, s.src_start) for s in spans[3]] == [(0, 60, 1, 0), (60, 120, 2, 0)]
    got = substring.digests(odd).collect()
    assert len(got) == odd.count()
    assert [r.n_removed for r in got if r.doc_id == 7 and r.n_words == 40] == [0, 0, 0]  # one document, repeated, and the first
    assert substring.digests(none).count() == 0 and substring.replace_texts(none).count() == 0
    again = substring.replace_texts(odd)
    assert again.columns == odd.columns and again.count() == odd.count()


def test_texts_wait_for_their_factors_squeezed(spark, monkeypatch):
    """Texts met their factors as they are, which took a third of the disk of this operator."""
    r = random.Random(2)
    words = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=400))) for i in range(40)] + [(40, None), (41, ""), (42, "\u00e9 \U0001f600")]
    got = substring.with_factors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(len(x.text or b"") for x in got) < 0.6 * sum(len(t or "") for _, t in rows)
    monkeypatch.setattr(substring, "SLICE_BYTES", 10_000)
    batch = pa.RecordBatch.from_pydict({"doc_id": [x.doc_id for x in got], "text": pa.array([x.text for x in got], pa.binary())})
    parts = list(substring.opened(iter([batch, batch.slice(0, 0)])))
    assert len(parts) > 5 and sorted((i, t) for p in parts for i, t in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)) == rows


def parsed_apart(texts, blocks=7):
    """Words that emit and parse cover, run here and not in Spark."""
    ids = [i for i, _ in texts]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "tie": pa.array([0] * len(ids), pa.int64()), "text": pa.array([t for _, t in texts], pa.string())})
    sent = sorted(((k, b) for part in substring.emit(iter([batch]), blocks) for k, b in zip(part.column("block").to_pylist(), part.column("blob").to_pylist(), strict=True)), key=lambda x: x[0])
    rows = pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in sent], pa.int64()), "blob": pa.array([b for _, b in sent], pa.binary())})
    found = collections.defaultdict(bytes)
    for part in substring.parse(iter([rows])):
        for i, f in zip(part.column("doc_id").to_pylist(), part.column("factors").to_pylist(), strict=True):
            found[i] += f
    return [(i, int(substring.covered(substring.Words(pa.array([t])), [found.get(i)]).sum())) for i, t in texts]


@pytest.mark.parametrize("size", [substring.SLICE_BYTES, 300])
def test_parse_of_long_and_periodic_texts(monkeypatch, size):
    """Also where texts are longer than a slice and are cut into stretches, and slices see few documents."""
    monkeypatch.setattr(substring, "SLICE_BYTES", size)
    monkeypatch.setattr(substring.slices, "__defaults__", ("text", size))
    r = random.Random(3)
    parts = [phrase(k, 45) for k in range(6)]
    texts = [(i, " ".join(r.choice(parts) if r.random() < 0.6 else phrase((i, j).__hash__(), 17) for j in range(r.randint(0, 9)))) for i in range(40)]
    texts += [(50, "a b c " * 300), (51, "x " * 500 + phrase(1, 30)), (52, "  " + "a b c " * 20 + "\n")]
    assert parsed_apart(texts) == [(i, gone) for i, _, gone, _ in brute_spans(texts)]


def test_a_worker_of_emit_stays_small():
    """On one Arrow batch of 8 MB of text; twice as much per worker took the pipeline's executors over their limit."""
    import tracemalloc

    r = random.Random(1)
    words = [f"w{i}" for i in range(50_000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([0] * 3000), pa.array(texts)], ["doc_id", "tie", "text"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in substring.emit(iter([batch]), 100)) and tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_equality_is_that_of_words(monkeypatch):
    """With one hash for all windows the words alone decide."""
    monkeypatch.setattr(substring, "grams", lambda h, sizes: [np.zeros(max(len(h) - k + 1, 0), np.uint64) for k in sizes])
    texts = [(1, phrase(1, 60)), (2, phrase(2, 30) + " " + phrase(1, 60)), (3, "a b " * 30), (4, phrase(2, 30))]
    assert parsed_apart(texts) == [(i, gone) for i, _, gone, _ in brute_spans(texts)]


def test_factors_are_greedy():
    code = np.array([*range(40), 99, *range(5, 35), *range(0, 25)])
    at, seg = np.array([*range(0, 21), *range(41, 41 + 36)]), np.repeat([0, 1], [21, 36])
    hashed = np.array([hash(tuple(code[i : i + 20])) & (2**63 - 1) for i in at], np.uint64)
    first = substring.first_places(code, at, hashed)
    w, s, n = substring.factorize(code, at, seg, first, first != np.arange(len(at)))
    assert [(int(at[a]), int(at[b]), int(c)) for a, b, c in zip(w, s, n, strict=True)] == [(41, 5, 11), (71, 0, 6)]


# SimHash --------------------------------------------------------------------------------------------
def slow_fingerprint(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(named):
    """Smallest id reachable through fingerprints at two bits or fewer."""
    up = {i: i for i, _ in named}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, (a, f) in enumerate(named):
        for b, g in named[i + 1 :]:
            if (f ^ g).bit_count() <= 2:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in named}


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 1])
def test_simhash(spark, documents, rows, crowded):
    named = [(i, slow_fingerprint(t)) for i, t in rows]
    want = groups_of(named)
    got = simhash.near_copies(documents, crowded=crowded).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in named}


def test_close_pairs(spark):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for k in (1, 2, 3):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), k)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = {frozenset((a, b)) for (a,) in signed for (b,) in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for crowded in (10_000, 1):
        df = spark.createDataFrame(signed, "fp long")
        assert {frozenset((p.a, p.b)) for p in simhash.close_pairs(df, crowded).collect()} == want


def test_simhash_edges(odd, none):
    got = simhash.near_copies(odd).collect()
    assert len(got) == odd.count()
    zero = {r.component_id for r in got if r.fingerprint == "0" * 16 and r.doc_id is not None}
    assert zero == {0}
    assert simhash.near_copies(none).count() == 0 and simhash.keep_first(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 5 not in ids and 4 in ids


def firsts_by_jaccard(texts):
    """The smallest id of each group of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8."""
    def shingles(text):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t in texts.items()}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
            lo, hi = sorted((group[a], group[b]))
            group = {i: lo if g == hi else g for i, g in group.items()}
    return sorted(i for i, g in group.items() if i == g)


def test_near_dedup_finds_every_pair_of_the_threshold(spark):
    """The stage against brute-force Jaccard of 5-word shingles; near copies are many bits apart."""
    r = random.Random(11)
    made = []
    for k in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice((6, 14, 60, 100, 150)))]
        made.append(base)
        for _ in range(k % 4):
            copy = list(base)
            for _ in range(1 + len(base) // 50):
                copy[r.choice((-1, r.randrange(len(copy))))] = f"x{r.randrange(9)}"
            made.append(copy + ["tail"] * r.randrange(2))
    made += [["one"], ["ONE"], [], []]
    texts = [(i, " ".join(w)) for i, w in enumerate(made)]
    texts += [(10_000 + x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    firsts = firsts_by_jaccard(dict(texts))
    bits = [slow_fingerprint(t) for _, t in texts[: len(made)]]
    assert sum(min((f ^ g).bit_count() for g in bits[:i] or [2**64 - 1]) > 2 for i, f in enumerate(bits) if i not in set(firsts)) > 5
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(x.doc_id for x in got) == firsts


# Records --------------------------------------------------------------------------------------------
def test_records(spark, documents, rows, odd, none, tmp_path):
    enc = tokens.Encoder(PATH)
    want, start = [], 0
    for i, t in rows:
        ids = np.append(enc.encode(pa.array([t]))[0], np.uint32(1)).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in records.tokens_roundtrip(documents, PATH).collect()) == want
    got = records.tokens_roundtrip(odd, PATH).orderBy("start").collect()
    assert len(got) == odd.count() and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    ids = [r.doc_id for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(r.doc_id for r in odd.collect() if r.doc_id is not None)
    assert records.tokens_roundtrip(none, PATH).count() == 0
    manifest = records.write_records(documents, f"file://{tmp_path}/r", PATH)
    fs, _ = records.open_store(f"file://{tmp_path}/r")
    n = len(records.read_index(fs, manifest[0]["path"]))
    order = np.random.default_rng(1).permutation(n)
    straight = list(records.iterate(f"file://{tmp_path}/r", manifest[0]["path"]))
    shuffled = list(records.iterate(f"file://{tmp_path}/r", manifest[0]["path"], order))
    assert [k for k, _ in shuffled] == [straight[i][0] for i in order]


def test_damage_is_found():
    data = records.frame(records.pack(-5, np.array([1, 2, 70_000], np.uint32)))
    assert records.unpack(records.unframe(data))[1].tolist() == [1, 2, 70_000]
    assert records.unpack(records.pack(None, np.array([3], np.uint32)))[0] is None
    for i in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    with pytest.raises(ValueError):
        records.unframe(data[:-1])


# Quality --------------------------------------------------------------------------------------------
def slow_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(hit)


def test_rules(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.learn(docs, labels)
    for df in (docs, odd):
        for r, d in zip(sorted(quality_rules.judge(df, model).collect(), key=lambda r: (str(r.doc_id), r.n_words)), sorted(df.collect(), key=lambda d: (str(d.doc_id), len(WORD.findall(d.text or "")))), strict=True):
            n = slow_counts(d.text)
            failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
            assert tuple(r)[1:6] == n and r.base_failed == failed and (not failed or not r.kept)
    assert quality_rules.judge(none, model).count() == 0 and quality_rules.filter_documents(odd, model).columns == odd.columns
    quality = {r.doc_id: r.quality for r in labels.where(stats.held_out("doc_id")).collect()}
    judged = [r for r in quality_rules.judge(docs, model).collect() if r.doc_id in quality and not r.base_failed]
    assert sum(r.kept == bool(quality[r.doc_id]) for r in judged) >= 0.97 * len(judged)


def test_trees_are_monotonic():
    r = np.random.default_rng(3)
    x = r.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * r.normal(size=2000) < 0.6).astype(float)
    t = quality_rules.fit(x, y, [-1, 0, 1])
    probe = r.random((200, 3))
    for f, sign in ((0, -1), (2, 1)):
        grid = np.repeat(probe, 30, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 30), 200)
        s = t.score(grid).reshape(200, 30)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()
    assert ((t.score(x) > 0.5) == (y > 0.5)).mean() > 0.85
    assert quality_rules.fit(np.zeros((0, 3)), np.zeros(0), [0, 0, 0]).score(x[:4]).tolist() == pytest.approx([0.999] * 4)


def test_classifier(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_mil.learn(docs, labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_mil.score_documents(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
    assert quality_mil.score_documents(odd, model).count() == odd.count() and quality_mil.score_documents(none, model).count() == 0
    blank = quality_mil.learn(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in quality_mil.score_documents(odd, blank).collect()} == {1}


def test_scores_equal_a_plain_forward_pass(spark, documents, odd):
    """Every text's score against loops over its words and passages."""
    model = quality_mil.learn(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))
    p = {k: v.tolist() for k, v in model.p.items()}

    def score(text):
        w = WORD.findall(text or "")
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        bags = [range(i, min(i + 48, len(w))) for i in range(0, max(len(w), 1), 48)]
        hs, gates = [], []
        for bag in bags:
            own = [w[j] for j in bag]
            data = "".join(own).encode()
            size, chars = max(len(own), 1), max(len("".join(own)), 1)
            of = {k: sum(int(table[b]) for b in data) for k, table in stats.CLASSES.items()}
            x = [of[k] / (chars if k in ("symbols", "digits", "capitals", "others") else size) for k in stats.CLASSES]
            x += [chars / size, sum(j in again for j in bag) / size, sum(j > 0 and w[j] == w[j - 1] for j in bag) / size, len(set(own)) / size, len(own) / 48, len(bags) == 1, not own]
            hashed = [0.0] * quality_mil.BUCKETS
            for word in own:
                h = xxhash.xxh64_intdigest(word)
                hashed[(h >> 20) % quality_mil.BUCKETS] += 1 if h & 1 else -1
            x = [min(max((float(v) - m) / d, -8), 8) for v, m, d in zip([*x, *[v / size for v in hashed]], model.mean, model.spread, strict=True)]
            h = [math.tanh(sum(a * b for a, b in zip(x, col, strict=True)) + e) for col, e in zip(zip(*p["E"], strict=True), p["e"], strict=True)]
            dot = lambda m: [sum(a * b for a, b in zip(h, col, strict=True)) for col in zip(*m, strict=True)]
            hs.append(h)
            gates.append(sum(c * math.tanh(t) / (1 + math.exp(-u)) for c, t, u in zip(p["w"], dot(p["V"]), dot(p["U"]), strict=True)))
        a = [math.exp(g - max(gates)) for g in gates]
        z = [sum(k * h[i] for k, h in zip(a, hs, strict=True)) / sum(a) for i in range(quality_mil.HIDDEN)]
        return 1 / (1 + math.exp(-sum(u * v for u, v in zip(z, p["c"], strict=True)) - p["b"][0]))

    for df in (documents, odd):
        got = sorted((str(r.doc_id), r.score) for r in quality_mil.score_documents(df, model).collect())
        want = sorted((str(r.doc_id), score(r.text)) for r in df.collect())
        assert [g[0] for g in got] == [v[0] for v in want] and np.allclose([g[1] for g in got], [v[1] for v in want], atol=1e-9)


def test_gradients():
    r = np.random.default_rng(1)
    m = quality_mil.Model(5)
    x, off, y = r.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-np.mean(y * np.log(m.score(x, off)) + (1 - y) * np.log(1 - m.score(x, off))))
    g = m.gradients(m.forward(x, off), off, y)
    for k, p in m.p.items():
        i = tuple(int(r.integers(n)) for n in p.shape)
        old = p[i]
        p[i] = old + 1e-6
        up = loss()
        p[i] = old - 1e-6
        down = loss()
        p[i] = old
        assert (up - down) / 2e-6 == pytest.approx(g[k][i], abs=1e-6)


# Pages ----------------------------------------------------------------------------------------------
def test_messages_equal_enumeration():
    r = np.random.default_rng(2)
    dom = html_text.parsed("<div><p>a</p><ul><li>b<li>c</ul></div><footer>d</footer>")
    f = html_text.Forest([dom])
    n = len(f.x)
    unary, pair = r.normal(size=(n, 2)), r.normal(size=(len(html_text.KINDS), 2, 2))
    node, _, z = html_text.sum_product(f, unary, pair)
    weight = np.zeros((n, 2))
    total = 0.0
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        w = math.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pair[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total += w
        for i in range(n):
            weight[i, y[i]] += w
    assert np.allclose(node, weight / total) and z[0] == pytest.approx(math.log(total))


@pytest.fixture(scope="module")
def page_model():
    return html_text.learn()


def test_pages(spark, page_model):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for p, r in zip(pages.orderBy("page_id").collect(), html_text.extract(pages, page_model).orderBy("page_id").collect(), strict=True):
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:h1|p)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == p.url


#: Pages and their main text, written by hand and not by the generator.
PAGES = [
    ('<body><article><h1>Head</h1><svg><title/>icon<style/>x</svg><p>Some words of the story here.</p></article></body>', 'Head\nSome words of the story here.'),
    ('<body><header><a href=/>Site</a></header><article><header><h1>The headline</h1></header><p>First paragraph of the story, with words.</p><p>Second paragraph goes on.</p></article><footer>c 2020</footer></body>', 'The headline\nFirst paragraph of the story, with words.\nSecond paragraph goes on.'),
    ('<body><nav><a href=/>Home</a> <a href=/x>News</a></nav><article><h1>Title of it</h1><p>Para one is here and long enough to read.</p><aside>Related stuff to see</aside><p>Para two is here as well.</p><form><input name=q>Sign up</form></article><footer>f</footer>', 'Title of it\nPara one is here and long enough to read.\nPara two is here as well.'),
    ('<html><body><div><div><a href=/>Home</a> | <a href=/b>Blog</a></div><div><h1>Plain page</h1><p>All of this is in divs without any class at all, as old pages have it.</p><p>More of it follows here in a second paragraph.</p></div><div><a href=/1>Imprint</a> <a href=/2>Privacy</a></div></div></body>', 'Plain page\nAll of this is in divs without any class at all, as old pages have it.\nMore of it follows here in a second paragraph.'),
    ('<body><main><h1>Shown</h1><p>Visible text of the page, a sentence.</p><p hidden>Not to be seen by anyone reading.</p><p>Also visible text.</p></main>', 'Shown\nVisible text of the page, a sentence.\nAlso visible text.'),
    ('<body><article><h1>T here</h1><p>One paragraph of text. <noscript>Fallback words</noscript></p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given.</p></article>', 'T here\nOne paragraph of text. Fallback words\nLet x=1 be given.'),
    ('<html><head><title>t</title><p>Text of the page right away, no body tag at all.<p>And a second paragraph.', 'Text of the page right away, no body tag at all.\nAnd a second paragraph.'),
    ("<!doctype html><html><head><title>x</title><script>var a='<p>no</p>';</script></head><body class=home><div id=wrapper><div id=masthead><h1><a href=/>My Blog</a></h1><p>just another blog</p></div><ul id=menu><li><a href=/>Home</a><li><a href=/about>About</a></ul><div id=content><div class=post><h2>A day out</h2><p>We went to the sea &amp; came back late.</p><ul><li>sand</li><li>water</li></ul><blockquote>It was fine.</blockquote></div></div><div id=sidebar><h3>Archive</h3><ul><li><a href=/1>May</a><li><a href=/2>June</a></ul></div><div id=comments><h3>2 comments</h3><div class=comment><p>Nice trip, thanks for telling.</p></div></div><div id=footer>&copy; me</div></div></body></html>", 'A day out\nWe went to the sea & came back late.\nsand\nwater\nIt was fine.'),
    ("<html><body><div class='cookie-banner'>We use cookies. <button>Accept</button></div><header class=site><nav><a href=#>World</a><a href=#>Sport</a></nav></header><main><section class='article-body'><h1>Mayor opens bridge</h1><p>The mayor opened the bridge on Monday.</p><div class=advert><p>Buy shoes now, half price!</p></div><p>It had been closed since March.</p><table><tr><td>Length</td><td>40 m</td></tr></table></section><section class=related-stories><h2>More stories</h2><a href=/>One</a></section></main><div class=newsletter-signup><p>Get our newsletter</p><form><input><button>Go</button></form></div></body></html>", 'Mayor opens bridge\nThe mayor opened the bridge on Monday.\nIt had been closed since March.\nLength\n40 m'),
    (None, ""), ("", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages_written_apart(page_model, page, text):
    assert html_text.main_texts([page], page_model) == [text]


def test_page_parsing_is_linear(page_model):
    """Unmatched end tags and paragraphs in deep nests don't search the stack again and again."""
    import time

    def took(n):
        began = time.perf_counter()
        html_text.parsed("<div>" * n + "</foo>" * n + "<x>" * n + "<p>a" * n)
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 25 * max(took(2_000), 0.02)


def test_generated_pages_of_another_seed(page_model):
    held = html_text.labelled_pages(200, seed=77)
    texts = html_text.main_texts([h for h, _ in held], page_model)
    assert sum(t == "\n".join(b) for t, (_, b) in zip(texts, held, strict=True)) >= 0.85 * len(held)


def test_page_edges(spark, page_model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<html><head><title>t</title></head><body></body></html>"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "<script>if (a<b) x('</p>')</script>"), (6, "u", "<!-- only"), (7, "u", "<" * 500)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), page_model).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got}[1] == "" and {r.page_id: r.text for r in got}[3] == ""
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), page_model).count() == 0
    text = html_text.main_texts(["<body><nav><ul><li><a href=/>menu</a></ul></nav><article><h1>T &amp; t</h1><p>a  b\n<b>c</b>&nbsp;d<p>e</article><section class='comments'><p>me too</p></section><footer>f</footer>"], page_model)
    assert text == ["T & t\na b c d\ne"]


# Pipeline -------------------------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf).cache()
        got = out.collect()
        if k < 4:
            assert out.columns == columns
        if k < 2:
            assert all(before[r.doc_id].text == r.text for r in got)
            clean = [i for i in before if labels.get(i) == 1 and len(before[i].text.split()) >= 20]
            ids = {r.doc_id for r in got}
            assert sum(i in ids for i in clean) >= 0.99 * len(clean)
        elif k == 2:
            assert sorted(r.doc_id for r in got) == firsts_by_jaccard({i: r.text for i, r in before.items()})
        elif k == 3:
            want = {i: x for i, *x in brute_spans([(i, before[i].text) for i in sorted(before)])}
            for r in got:
                n, gone, digest = want[r.doc_id]
                assert hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() == digest and r.n_chars == len(r.text)
                assert gone or r.text == before[r.doc_id].text
        else:
            check_packing(got, 4096)
            assert {r.doc_id for r in got} == set(before)
        docs = out


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_edges(spark, odd, none):
    """Every stage: nulls, empty and long texts, repeated rows, columns that clash with inner names, no rows."""
    sf = "/root/testdata/sf0.01"
    clash = {c: F.lit("x") for c in ("row", "id", "nth", "_first", "_nth", "name", "fp", "group", "key", "factors", "carried", "_doc", "_tie", "score", "kept")}
    for df in (odd.withColumns(clash), none.withColumns(clash)):
        n = df.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            got = out.collect()
            if name != "best_fit_packing":
                assert out.columns == df.columns and len(got) <= n and all(r["carried"] == "x" for r in got)
            if name == "simhash_near_dedup" and n:
                ids = [r.doc_id for r in got if r.doc_id is not None]
                assert len(ids) == len(set(ids)) and 4 in ids and 5 not in ids and sum(r.doc_id is None for r in got) == 2
            if name == "substring_dedup":
                assert len(got) == n and all((r.text is None) == (r.n_chars is None) for r in got if r.doc_id is None)


def test_twins_in_sql(spark):
    import duckdb

    from kinforge.llm import queries

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        got = c.execute(sql)
        columns = [d[0] for d in got.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted((tuple(r) for r in got.fetchall()), key=str) == sorted((tuple(r) for r in df.select(*columns).collect()), key=str), name


def test_long_texts_take_bounded_memory():
    """The statistics of a text of some 20 MB: well below what a worker of an executor has."""
    import resource
    import subprocess
    import sys

    code = "import numpy as np, pyarrow as pa, resource; from kinforge.llm import stats; r = np.random.default_rng(0); t = ' '.join(map(str, r.integers(0, 5000, 4_000_000))); b = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; s = stats.TextStats(pa.array([t])); print(len(t), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - b) // 1024)"
    size, mb = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=__file__.rsplit("/tests", 1)[0]).stdout.split())
    assert size > 18_000_000 and mb < 600


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_nothing_else_imports_the_subpackage():
    import pathlib

    top = pathlib.Path(__file__).parents[2] / "kinforge"
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p


def test_hot_groups_stay_split(spark):
    """A third of all rows in one group: no part of a numbered group holds more than a few of them."""
    from kinforge.llm.common import gapless

    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("g"))
    got = gapless(df, ["g"], ["doc_id"], 16, "nth").where("g = 1").select("nth").collect()
    assert sorted(r.nth for r in got) == list(range(len(got))) and len(got) > 2900
