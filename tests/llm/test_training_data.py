"""Training-data operators against brute force, exact round trips and SQL on small inputs."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cityjobs.llm import dom, exact_dedup, id_coder, id_files, jaccard, lattice, mixing, packing, quality, queries, sharding, style_tree, tokens, warc
from cityjobs.llm.common import ROW, with_rows
from cityjobs.llm.dom import TEXT_LEVEL, blocks

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept string, id string, h string"
LONG = "Wörter und words. " * 4000
TEXTS = [None, "", " \n\t", "a", "a", "a b c d e", "A B C D E", LONG, LONG + "x", "x\x0by z  w", "<|endoftext|> it's 1,234.50!\n\n\nNew line", "日本語の文章です。" * 300]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i}", None, "s", "k", "i", "h") for i, t in enumerate(TEXTS)]
    rows += [(3, "a", "en", "src3", 1, None, None, None, None), (None, "a b c d e", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_exact_dedup(docs, none):
    groups = {}
    for i, t in pairs(docs):
        groups.setdefault(t, []).append(i)
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest()] += 1
    for ident in (F.xxhash64, lambda c: F.pmod(F.length(c), F.lit(2)).cast("long")):
        got = exact_dedup.exact_dedup(docs.filter("doc_id IS NOT NULL OR text IS NULL").dropDuplicates(["doc_id"]) if ident is not F.xxhash64 else docs, identifier=ident).collect()
        if ident is F.xxhash64:
            assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
            one = exact_dedup.exact_dedup(docs.withColumn("at", F.monotonically_increasing_id()), row_col="at").filter("kept").collect()
            assert Counter(r.text_sha256 for r in one) == Counter({hashlib.sha256(t.encode()).hexdigest() for t in groups}) and all(r.doc_id == r.keep_id for r in one)
        else:
            by = {r.doc_id: r for r in got}
            assert by[7].keep_id == 7 and by[8].keep_id == 8 and by[3].keep_id == by[4].keep_id == 4
    assert exact_dedup.exact_dedup(none).count() == 0


def test_external_shuffle_query(spark):
    """All that the query returns of each document, and its law."""
    out = queries.op3_external_shuffle(spark, SF).collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in out} == want and len(out) == len(want)
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    slots = {k: sorted(r.slot for r in out if r.shard == k) for k in range(16)}
    assert all(s == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))] != sorted(want)


def test_external_shuffle_splits_hot_keys(spark):
    rows = [(None, "same text " * 9, {"a": 1, "b": i % 2}) for i in range(300)] + [(5, f"t{i} " * 9, None) for i in range(300)] + [(i, "x", {}) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>").repartition(3)
    placed = sharding.external_shuffle(frame, n_shards=4, bucket_bytes=4096)
    out = placed.collect()
    show = lambda r: (r.doc_id, r.text, sorted((r.tags or {}).items()), r.tags is None)
    assert sorted(map(str, map(show, out))) == sorted(map(str, map(show, frame.collect())))
    hot = sorted(r.shard for r in out if r.doc_id is None)
    assert {k: hot.count(k) > 30 for k in range(4)} == dict.fromkeys(range(4), True)  # dealt over all of the order


@pytest.mark.parametrize("bucket", [200, 1 << 20])
def test_external_shuffle(docs, none, bucket):
    wide = docs.drop("shard") if bucket > 200 else docs.drop("shard").filter("length(text) > 1000 OR doc_id < 3")  # without hot keys at that size
    out = sharding.write_shards(wide, n_shards=4, bucket_bytes=bucket).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in wide.collect())
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.external_shuffle(wide.repartition(3), n_shards=4, bucket_bytes=bucket).collect()
    at = lambda rows: sorted((r.shard, r.slot, str(r.doc_id), r.text or "") for r in rows)
    assert at(again) == at(out)
    assert sharding.external_shuffle(none.drop("shard")).count() == 0


def test_lattice_forward_equals_all_segmentations():
    pieces = [bytes([x]) for x in lattice.BYTES] + [b" a", b"ab", b"abc", b"bc", b" ab"]
    probs = lattice.smoothed(np.arange(1, len(pieces) + 1, dtype=float))
    score = dict(zip(pieces, probs, strict=True))

    def total(w):
        return 1.0 if not w else sum(score[w[:k]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in score)

    words = [b"abc", b"aabcab", b"x", b"abcabc", b"bcbc"]
    got = lattice.Lattice(pieces, probs).scores(words)
    assert np.allclose(got, [math.log(total(b" " + w)) for w in words])
    one = lattice.Lattice(pieces, probs).expect([b"abc"], np.array([2.0]))
    lengths = np.array([len(p) for p in pieces])
    assert math.isclose((one * lengths).sum(), 2.0 * 4)


def test_long_words_equal_short_ones(monkeypatch):
    """Forward and expected numbers of a word taken window by window, and a megabyte without a space."""
    rng = random.Random(3)
    pieces = [bytes([x]) for x in lattice.BYTES] + [b" a", b"ab", b"abc", b"bc", b" ab", b"a" * 16]
    probs = lattice.smoothed(np.arange(1, len(pieces) + 1, dtype=float))
    words = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1, 15, 16, 17, 100, 250)] + [b"a" * 200]
    lat = lattice.Lattice(pieces, probs)
    weights = np.arange(1.0, len(words) + 1)
    want, many = lat.scores(words), lat.expect(words, weights)
    monkeypatch.setattr(lattice, "LONG", 0)
    for window in (7, 16, 64, 1 << 14):
        monkeypatch.setattr(lattice, "WINDOW", window)
        assert np.allclose(lat.scores(words), want) and np.allclose(lat.expect(words, weights), many)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(1 << 20))
    total = np.zeros(lat.n + 1)
    lat.long_expect(text, 1.0, total)
    assert math.isclose((total[:-1] * np.array([len(p) for p in pieces])).sum(), len(text) + 1, rel_tol=1e-3)


def test_lattice_scores(docs, none, monkeypatch):
    """Counts, base and score of every document against a plain model that goes through all segmentations."""
    path = queries.public_file("piece_bpe_32k.model")
    monkeypatch.setattr(lattice, "MAX_HELD_WORDS", 4)  # the others are joined
    rows = pairs(docs)
    out = lattice.lattice_scores(docs, path).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: t.encode().lower().split()
    pieces, own = lattice.public_pieces(path)

    def model(train):
        counts = Counter(w for _, t in train for w in words(t))
        probs, drawn = own, 0.0
        p_end = (len(train) + 1) / (lattice.PRIOR + len(train) + 1)

        def alphas(w, score, back=False):
            a = [1.0]
            for e in range(1, len(w) + 1):
                a.append(sum(a[e - k] * score.get(w[-e : len(w) - e + k] if back else w[e - k : e], 0.0) for k in range(1, min(e, 16) + 1)))
            return a

        for _ in range(lattice.EM_ROUNDS):
            score = dict(zip(pieces, (1 - p_end) * probs, strict=True))
            total = Counter()
            for w, c in counts.items():
                w = b" " + w
                f, g = alphas(w, score), alphas(w, score, True)
                for e in range(1, len(w) + 1):
                    for k in range(1, min(e, 16) + 1):
                        if (piece := w[e - k : e]) in score:
                            total[piece] += c * f[e - k] * score[piece] * g[len(w) - e] / f[-1]
            weights = lattice.PRIOR * own + np.array([total[p] for p in pieces])
            drawn = sum(total.values())
            probs = lattice.smoothed(weights)
            p_end = (len(train) + 1) / (drawn + lattice.PRIOR + len(train) + 1)
        score = dict(zip(pieces, (1 - p_end) * probs, strict=True))
        assert math.isclose(sum(score.values()) + p_end, 1.0)
        return lambda t: math.log10(p_end) + sum(math.log10(alphas(b" " + w, score)[-1]) for w in words(t))

    train = [(i, t) for i, t in rows if not held(i)]
    counts, ends = Counter(w for _, t in train for w in words(t)), len(train)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    counts[None] = ends
    short = [(i, t) for i, t in rows if len(t) < 1000]
    want, scores = Counter(), {}
    for i, t in rows:
        w = words(t) + [None]
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    few = docs.filter("text IS NULL OR length(text) < 1000")
    got = Counter((r.doc_id, round(r.score, 6)) for r in lattice.lattice_scores(few, path).collect())
    plain = model([(i, t) for i, t in short if not held(i)])
    assert got == Counter((i, round(plain(t), 6)) for i, t in short)
    one = lattice.lattice_scores(docs.filter("doc_id IS NULL"), path).collect()  # none to train on
    assert all(r.train_tokens == 0 == r.base_score and r.n_known == 0 for r in one)
    assert lattice.lattice_scores(none, path).count() == 0


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(3)
    for _ in range(50):
        lengths = np.array([rng.randrange(1, 65) for _ in range(rng.randrange(1, 120))])
        where, offset = packing.best_fit_decreasing(lengths, 64)
        room, w2 = [], np.zeros(len(lengths), int)
        for i in np.argsort(-lengths, kind="stable"):
            fits = [(c, -k) for k, c in enumerate(room) if c >= lengths[i]]
            if not fits:
                room.append(64)
                fits = [(64, -(len(room) - 1))]
            c = min(fits)[0]
            k = next(k for k, x in enumerate(room) if x == c) if c != 64 else len(room) - 1
            w2[i] = k
            room[k] -= lengths[i]
        assert where.max() + 1 == len(room)
        used = Counter()
        for w, o, n in sorted(zip(where.tolist(), offset.tolist(), lengths.tolist(), strict=True)):
            assert o == used[w]
            used[w] += n
        assert max(used.values()) <= 64


@pytest.mark.parametrize("name,style,end", [("byte_bpe_50k.json", "bytes", 1), ("word_bpe_49k.json", "words", 2)])
def test_unit_memory_equals_the_tokenizer(name, style, end):
    enc = tokens.UnitEncoder(queries.public_file(name), style)
    rng = random.Random(9)
    alphabet = ["a", "b", "é", "Σ", "'s", "'", " ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", ",", ".", "!", "1", "²", "日", "́", "_", "<|endoftext|>", "don't", "ﬁ", "\x85", "\r\n", "\x01", "　", "😀", "à", "Ġ"]
    texts = [t or "" for t in TEXTS] + ["x" * 100 + " " + "y" * 70 + "é " + "z" * 5000, "漢" * 500] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [ids[a:b].tolist() for _, _, ids, at in enc.encode(pa.array(texts), 7) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [x + [7] for x in want]


def test_held_units_stay_within_their_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_HELD", 1 << 20)
    monkeypatch.setattr(tokens, "RUN", 1 << 14)
    enc = tokens.UnitEncoder(queries.public_file("byte_bpe_50k.json"), "bytes")
    rng = random.Random(1)
    texts = [" ".join(f"{rng.randrange(10**12):x}" for _ in range(2000)) + " " + "y" * 3000 for _ in range(20)]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for k, t in enumerate(texts):
        ((_, _, ids, _),) = enc.encode(pa.array([t]), 7)
        assert ids.tolist() == want[k] + [7]
        assert enc.table.nbytes() < 3 << 20


def test_packing(docs, none):
    path = queries.public_file("byte_bpe_50k.json")
    out = packing.pack_documents(docs, path, keep_ids=True).collect()
    enc = tokens.UnitEncoder(path, "bytes").tokenizer
    want = Counter((i, tuple(enc.encode(t, add_special_tokens=False).ids + [1])) for i, t in pairs(docs))
    assert sum(len(r.ids) for r in out) == sum(len(k[1]) * n for k, n in want.items())
    for i in {k[0] for k in want} - {None, 3}:
        mine = sorted((r.start, r.ids) for r in out if r.doc_id == i)
        assert [x for _, ids in mine for x in ids] == list(next(k[1] for k in want if k[0] == i))
    by = {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(none, path).count() == 0


def components(rows):
    sets = {i: set() if not (w := t.encode().lower().split()) else {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("most", [0, 64])
def test_jaccard_join(spark, docs, none, most, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", most)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**9)}" for _ in range(50)] for _ in range(2)]
    rows = []
    for k in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(50)] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    common = [f"c{i}" for i in range(14)]
    rows += [(k, " ".join(common + [f"y{rng.randrange(30)}" for _ in range(rng.randrange(0, 6))])) for k in range(120, 200)]
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, " ")]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = components([(i, t or "") for i, t in rows])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    # rows by number, whatever ids they have
    numbered = docs.withColumn("at", F.monotonically_increasing_id()).collect()
    by_row = components([(r["at"], r.text or "") for r in numbered])
    ids = {r["at"]: r.doc_id for r in numbered}
    least = {}
    for at, (_, root) in by_row.items():
        least[root] = min((i for i in (least.get(root), ids[at]) if i is not None), default=None)
    out = jaccard.jaccard_components(spark.createDataFrame(numbered, docs.withColumn("at", F.lit(0).cast("long")).schema), keep=("at",)).collect()
    assert {r["at"]: (r.doc_id, r.n_shingles, r.component_id) for r in out} == {at: (ids[at], n, least[root] if n else ids[at]) for at, (n, root) in by_row.items()}
    assert all((r.component is None) == (r.n_shingles == 0) for r in out)
    assert jaccard.jaccard_components(none).count() == 0


def near_copies(n, seed):
    """Copies of a text with none to twelve words changed, every fifth cut short: about half lie beyond the threshold of all others."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**9)}" for _ in range(120)]
    rows = []
    for k in range(n):
        words = base[: rng.randrange(85, 121)] if k % 5 == 0 else list(base)
        for _ in range(rng.randrange(0, 13)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    return rows


def test_jaccard_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    """The pairs looked at grow with the group, not with its square, and no link is lost, also where sets differ in size."""
    looked = []
    near = jaccard._near

    def counted(pairs, light, percent):
        looked[-1] += pairs.count()
        return near(pairs, light, percent)

    monkeypatch.setattr(jaccard, "_near", counted)
    monkeypatch.setattr(jaccard, "PAIRS_PER_POSTING", 8)
    for n in (200, 800):
        rows = near_copies(n, n)
        looked.append(0)
        out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components(rows)
    assert looked[1] < 8 * looked[0]  # 4 times the rows: 303 and 1,222 pairs


def test_id_coder_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 255, 256, 2049, 9000, 70_001):
        for ids in (rng.integers(0, 49408, n), rng.integers(0, 3, n), np.zeros(n, int), rng.integers(0, 65536, n), (rng.zipf(1.3, n) % 60000)):
            assert (id_coder.decode(id_coder.encode(ids, 30_000)) == ids).all()
    ids = rng.integers(0, 100, 5000)
    data = bytearray(id_coder.encode(ids, 2000))
    first, second, third = (id_coder.block_of(data, k) for k in range(3))
    assert (id_coder.decode_block(bytes(second)) == ids[5000 // 3 : 2 * 5000 // 3]).all()  # a block needs no other
    for at in (-40, -len(third) + 20):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            id_coder.decode(bytes(broken))
        assert (id_coder.decode_block(id_coder.block_of(bytes(broken), 0)) == ids[: 5000 // 3]).all()


def test_coded_ids_are_smaller_than_order_0_entropy(spark):
    """By 4 % at least on the documents; adaptive frequencies cost 15 % at most where ids are independent."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    enc = tokens.encoder(queries.public_file("word_bpe_49k.json"), "words")
    entropy = lambda ids: sum(-c * math.log2(c / len(ids)) for c in Counter(ids.tolist()).values()) / 8
    ids = np.concatenate([ids for _, _, ids, _ in enc.encode(pa.array(texts), 2)])
    assert len(id_coder.encode(ids)) < 0.96 * entropy(ids)
    ids = np.random.default_rng(1).zipf(1.3, 400_000) % 49_000
    assert len(id_coder.encode(ids)) < 1.15 * entropy(ids)


def test_id_files(spark, docs, none):
    path = queries.public_file("word_bpe_49k.json")
    enc = tokens.UnitEncoder(path, "words").tokenizer
    want = Counter()
    for i, t in pairs(docs):
        ids = np.array(enc.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    for size in (3000, 1 << 20):
        out = sorted(id_files.read_ids(spark, id_files.write_ids(docs, path, file_ids=size)).collect(), key=lambda r: r.start)
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
        at = 0
        for a, b in zip(out, out[1:] + [None], strict=True):
            assert a.start == at
            at += a.n_tokens
            assert b is None or (a.doc_id is None) or (b.doc_id is not None and a.doc_id <= b.doc_id)
    assert id_files.read_ids(spark, id_files.write_ids(none, path)).count() == 0


@pytest.mark.parametrize("bounds", [0, 1 << 20])
def test_warc(spark, bounds, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BOUNDS", bounds)
    rows = [(1, "http://a/x", "<p>a"), (2, None, "<p>a"), (3, "http://b/", None), (4, "http://c/", ""), (5, "u", "é" * 5000), (5, "u", "é" * 5000), (None, "n", "<p>a"), (7, "u v\nw", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(1) for k in ("hash", "copy", "member", "winner", "size")})
    for roll in (300, 1 << 20):
        out = warc.read_warc(spark, warc.write_warc(pages, roll_bytes=roll)).collect()
        best = {}
        for p, _, h in rows:
            best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
        want = Counter((p, len((h or "").encode()), warc.sha1_base32((h or "").encode()), "response" if best[h or ""] == p else "revisit", None if best[h or ""] == p else best[h or ""]) for p, _, h in rows)
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
        assert len({r.record_id for r in out}) == len(rows)
    a, b = (sorted((r.file, r.record_id) for r in warc.read_warc(spark, warc.write_warc(p, roll_bytes=300)).collect()) for p in (pages, pages.repartition(5)))
    assert a == b
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0


def test_warc_files_of_large_ids_beside_a_null(spark):
    """Ids over 2**53 beside a null one, which no float may touch: the files roll, and the order within them is that of the ids."""
    rng = random.Random(3)
    ids = [(1 << 53) + k for k in range(60)]
    rows = [(i, None, f"<p>{rng.random()}") for i in ids]
    files = {}
    for name, extra in (("without", []), ("with", [(None, None, "<p>x")])):
        frame = spark.createDataFrame(rows + extra, "page_id long, url string, html string").repartition(3)
        path = warc.write_warc(frame, roll_bytes=400)
        out = warc.read_warc(spark, path).collect()
        assert Counter(r.page_id for r in out) == Counter(i for i, _, _ in rows + extra)
        files[name] = {r.page_id: r.file for r in out}
        for f in set(files[name].values()):
            data = warc.read_file(path, f)
            held = [h.get("x-page-id") for h, _ in warc.parse_records(data)]
            assert held == sorted(held, key=lambda x: (x is not None, int(x or 0)))
    assert len(set(files["without"].values())) > 30 and len(set(files["with"].values())) > 30
    assert max(Counter(files["with"].values()).values()) <= 3
    order = sorted(files["with"], key=lambda i: (i is not None, i or 0))
    assert [files["with"][i] for i in order] == sorted(files["with"].values())


def test_warc_numbers_repeats_in_ranges(spark):
    rows = [(5, f"u{i % 3}", "<p>same") for i in range(120)] + [(None, None, "<p>none")] * 30 + [(7, "v", "<p>once"), (5, "u", "<p>other")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    light = with_rows(frame).select("page_id", F.col("html").alias("hash"), "url", ROW)
    for n in (9, 1000):
        out = warc._numbered(light, range_rows=n)
        got = light.join(out, ROW).collect()
        by = {}
        for r in got:
            by.setdefault((r.page_id, r["hash"]), []).append((r.copy, r.url or ""))
        assert len(got) == len(rows) and all([c for c, _ in sorted(v)] == list(range(len(v))) and [u for _, u in sorted(v)] == sorted(u for _, u in v) for v in by.values())
    ids = [r.record_id for r in warc.read_warc(spark, warc.write_warc(frame)).collect()]
    assert len(set(ids)) == len(rows)


def test_main_text(spark):
    page = '<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One<br><p>two  &nbsp;three<script>x</script><form>f</form></article><div id="comments">no</div><footer>F'
    assert [b.text for b in blocks(page)[0] if b.in_body and not b.furniture] == ["A & B", "One", "two three"]
    tpl = "<body><div><p>Same words on every page</p></div><div><p>Own words {}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", tpl.format(i)) for i in range(12)] + [(20, None, None), (21, "http://other.example/", tpl.format(21)), (22, "u", page)]
    out = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[20] == "" and out[22] == "A & B\nOne\ntwo three"
    assert out[21] == "Same words on every page\nOwn words 21"
    side = "<body><section class='x'><p>Same words on every page</p></section><div><p>Own words {}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", side.format(i)) for i in range(12)]
    assert {r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {f"Own words {i}" for i in range(12)}
    assert style_tree.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_beside_articles_in_furniture(spark):
    page = "<body><div><h1>Head</h1><p>Whole text</p></div>{}</body>"
    others = [
        "<section id=comments><article><p>first!</p></article></section>",
        "<aside><article><p>Other story</p></article></aside>",
        "<div class=related><article><header>x</header><p>Card</p></article></div>",
        "<div class=sidebar><div itemprop=articleBody>y</div></div>",
        "<div class=nav role=main>z</div>",
    ]
    ids = "<body><article><header><h1 id=header>Head</h1></header><p id=search>One</p><h2 id='related-work'>Related work</h2><p>Two</p><div id=comments><p>no</p></div><p class=share>no</p></article></body>"
    hidden = "<body><article hidden><p>old</p></article><div><p>Whole text</p></div></body>"
    rows = [(i, f"http://h{i}.example/", page.format(x)) for i, x in enumerate(others)] + [(10, "http://i.example/", ids), (11, "http://j.example/", hidden)]
    out = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: "Head\nWhole text" for i in range(len(others))} | {10: "Head\nOne\nRelated work\nTwo", 11: "Whole text"}


def test_tree_judges_articles_and_counts_copies_once(spark):
    schema = "page_id long, url string, html string"
    texts = lambda rows: {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, schema)).collect()}
    page = "<body><article><h1>Head {0}</h1><div><p>Read our letter</p></div><p>Own words {0}</p><p>Tell your friends</p></article></body>"
    assert texts([(i, f"http://h.example/{i}", page.format(i)) for i in range(12)]) == {i: f"Head {i}\nOwn words {i}" for i in range(12)}
    few = texts([(i, f"http://h.example/{i}", page.format(i)) for i in range(7)])
    assert few[3] == "Head 3\nRead our letter\nOwn words 3\nTell your friends"
    plain = "<body><div><p>Own words {}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", plain.format(min(i, 3))) for i in range(60)]
    assert texts(rows) == {i: f"Own words {min(i, 3)}" for i in range(60)}
    rows = [(i, f"http://h.example/{i}", page.format(min(i, 11))) for i in range(60)]
    assert texts(rows) == {i: f"Head {min(i, 11)}\nOwn words {min(i, 11)}" for i in range(60)}


def test_names_say_furniture_only_where_they_say_nothing_else(spark):
    page = (
        "<body><article><p title='the hidden truth'>one</p><section data-id='ad'><p>two</p></section><div class='share-price'>three</div><div class='related work'>four</div>"
        "<div class='ad-hoc'>five</div><div id='comment-on-kant'>six</div><p class=keep>seven</p><div class='share-buttons'>no</div><div class='col-4 sidebar'>no</div><div id=comments>no</div></article></body>"
    )
    teasers = "<body><main><p>Teaser {0}</p></main><div><p>" + "A story {0} in an unmarked element. " * 9 + "</p></div></body>"
    rows = [(1, "http://a.example/", page)] + [(2 + i, "http://b.example/", teasers.format(i)) for i in range(9)] + [(20, "http://c.example/", teasers.format(1))]
    out = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == "one\ntwo\nthree\nfour\nfive\nsix\nseven"
    assert "A story" in out[2]  # the tree knows that the host's main branch is not the marked one
    assert out[20] == "Teaser 1"  # without a tree the page's mark counts, however short what it marks is


def test_tree_cuts_what_differs_on_every_page_without_names(spark):
    """Adverts and footers with other words on each page, in elements without a telling name."""
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for i in range(20):
        body = [say(30) for _ in range(rng.randrange(2, 6))]
        head = say(6)
        rows.append((i, f"http://h.example/{i}", f"<body><div class=q>{say(4)}</div><div class=z><h1>{head}</h1>" + "".join(f"<p>{t}</p>" for t in body) + f"<div class=lead>{say(3)}</div></div><div class=y>{say(5)}</div></body>"))
        want[i] = [head, *body]
    out = {r.page_id: r.text.split("\n") for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: t[:-1] for i, t in out.items()} == want  # what stands within the main branch stays, however short


def brute_tree(rows):
    """Of (host, html): texts, child sequences and pages of every node, and what the texts of every branch carry, and their words."""
    texts, shapes, having = {}, {}, {}
    for host, page in rows:
        found, styles = blocks(page or "")
        own = {(b.path, b.text) for b in found}
        for path, text in own:
            c = texts.setdefault((host, path), Counter())
            c[text] += 1
        above = {"/".join(p.split("/")[:k]) for p, _ in own for k in range(2, p.count("/") + 2)}
        for p in above:
            having[host, p] = having.get((host, p), 0) + 1
        for p, s in {x for x in styles if x[0] in above}:
            shapes.setdefault((host, p), Counter())[s] += 1
    carried, words = Counter(), Counter()
    for (host, path), c in texts.items():
        m = having[host, path]
        for text, k in c.items():
            n = len(text.split(" ")) * k
            kept = n * (1 - min(1, math.log(k) / math.log(m))) if m >= style_tree.MIN_PAGES else n
            for j in range(1, path.count("/") + 2):
                branch = "/".join(path.split("/")[:j])
                carried[host, branch] += kept
                words[host, branch] += n
    return texts, shapes, having, carried, words


def test_importance_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(150)
    rows = style_tree.with_host(pages.withColumn("url", F.concat(F.lit("http://h"), F.col("page_id") % 3, F.lit(".example/")))).select("__host", "html", F.lit(1).cast("long").alias("copies"))
    counted = rows.mapInArrow(style_tree._features, "host string, path string, kind int, feature long, words long, pages double")
    features = counted.groupBy("host", "path", "kind", "feature", "words").agg(F.round(F.sum("pages")).cast("long").alias("k"))
    got = {(r.host, r.branch): r for r in style_tree.importance(features).collect()}
    texts, shapes, having, carried, words = brute_tree([(r["__host"], r.html) for r in rows.collect()])
    assert set(got) == {x for x in words if x[1]} and len(got) > 10
    for (host, branch), r in got.items():
        m = having[host, branch]
        style = sum(-min(1, c / m) * math.log(min(1, c / m)) / math.log(m) for c in shapes.get((host, branch), {}).values()) if m > 1 else 0
        assert r.pages == m and math.isclose(r.style, style, abs_tol=1e-9)
        assert math.isclose(r.content, carried[host, branch] / words[host, branch], abs_tol=1e-9)
        assert math.isclose(r.share, carried[host, branch] / carried[host, ""], abs_tol=1e-9)


def brute_cuts(rows):
    """Host -> branches to cut, single texts to cut (path, text), and the main branch; from distinct pages."""
    rows = list(dict.fromkeys(rows))
    texts, shapes, having, carried, words = brute_tree(rows)
    pages = Counter(h for h, _ in rows)
    out = {h: (set(), set(), None) for h in pages}
    for h in pages:
        if pages[h] < style_tree.MIN_PAGES:
            continue
        nodes = {p: m for (host, p), m in having.items() if host == h}
        container = lambda p: p.rpartition("/")[2].partition(".")[0] not in TEXT_LEVEL
        share = {p: carried[h, p] / max(carried[h, ""], 1e-9) for p in nodes}
        way = [p for p in nodes if container(p) and share[p] > 0.5]
        main = max(way, key=len, default=None)
        low, single = set(), set()
        for p, m in nodes.items():
            if m < style_tree.MIN_PAGES:
                continue
            style = 0.1 * sum(-min(1, c / m) * math.log(min(1, c / m)) / math.log(m) for c in shapes.get((h, p), {}).values())
            up = p.rpartition("/")[0]
            if style + 0.9 * carried[h, p] / words[h, p] < style_tree.THRESHOLD or (container(p) and style + 0.9 * share[p] < style_tree.BESIDE and up in way and up != main):
                low.add(p)
            single |= {(p, t) for t, k in texts.get((h, p), {}).items() if 2 * k > max(m, style_tree.MIN_PAGES) and 0.9 * (1 - min(1, math.log(k) / math.log(m))) < style_tree.THRESHOLD}
        out[h] = (low, single, main)
    return out


def test_texts_of_the_query_equal_brute_force(spark):
    """Whole texts of all pages of two scales: trees and cuts worked out in plain Python."""
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
        host = lambda u: (urlsplit(u or "").hostname or "").lower()
        cuts = brute_cuts([(host(r.url), r.html or "") for r in rows if host(r.url)])
        want = {}
        for r in rows:
            low, single, main = cuts.get(host(r.url), (set(), set(), None))
            inside = lambda b, p: (b.path + "/").startswith(p + "/")
            left = [b for b in blocks(r.html or "")[0] if not b.furniture and not any(inside(b, p) for p in low) and (b.path, b.text) not in single]
            marked, of_main = [b for b in left if b.in_body], [b for b in left if main and inside(b, main)]
            chosen = left if not marked or (of_main and not set(of_main) & set(marked)) else marked
            want[r.page_id] = (r.url, "\n".join(b.text for b in chosen), sum(len(b.text) + 1 for b in chosen[:-1]) + len(chosen[-1].text) if chosen else 0)
        got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op9_style_tree(spark, sf).collect()}
        assert got == want


class _Plain(HTMLParser):
    """Texts outside of elements without text, cut at every tag that is not inline."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out, self.now = 0, [], []

    def cut(self):
        self.out.append(" ".join("".join(self.now).split()))
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        elif tag not in dom.INLINE:
            self.cut()
        self.skip += tag in SKIPPED

    def handle_endtag(self, tag):
        if tag not in dom.INLINE:
            self.cut()
        self.skip -= tag in SKIPPED

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


SKIPPED = {"script", "style", "noscript", "template", "textarea", "title", "iframe"}


def test_blocks_equal_another_parser(spark):
    n = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = _Plain()
        plain.feed(r.html or "")
        plain.close()
        plain.cut()
        assert [b.text for b in blocks(r.html or "")[0]] == [t for t in plain.out if t]
        n += 1
    assert n > 200


def test_tags_that_are_broken_or_cross(spark):
    texts = lambda page: [b.text for b in blocks(page)[0]]
    assert texts('<p class=x">first<p>second') == ["first", "second"]
    assert texts("<p title='it's'>one</p><p a = \"x>y\" b=c>two</p>") == ["one", "two"]
    assert texts('<p a="open>three<p>four') == ["three", "four"]
    assert texts("a < b <3 <p/>five</p ><!-- <p>no --><br/>six") == ["a < b <3", "five", "six"]
    assert texts("<script>if (a</b) '</p>'</script>x<style>y") == ["x"]
    for page in ('<p ' * 300_000, "<div>" * 100_000 + "</p>" * 100_000, '<p a="x>' * 120_000, "<" * 10**6, "<!--" * 250_000, "<div class=abcdefgh>x" * 50_000, "<a " + " / " * 300_000):
        began = time.process_time()
        blocks(page)
        assert time.process_time() - began < 20  # a megabyte; the time is linear


def test_headlines_and_texts_that_names_do_not_hide(spark):
    page = "<body><div class=header>no</div><article><div class='header'><h1>Head</h1></div><p>One</p><section id='comments-policy'><p>Two</p></section><div class='cookie-policy'>no</div><div class='share-on'>no</div><div class='related-articles'>no</div></article></body>"
    short = "<body><article><h1>Head</h1><p>Short</p></article><div><p>" + "A longer teaser of another story. " * 30 + "</p></div></body>"
    rows = [(1, "http://a.example/", page), (2, "http://b.example/", short)]
    out = {r.page_id: r.text for r in style_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {1: "Head\nOne\nTwo", 2: "Head\nShort"}


def test_main_text_of_odd_rows(spark):
    """Long html, repeated rows, ties, null ids and urls, and columns of clashing names."""
    long = "<body><article>" + "<p>word word</p>" * 40_000 + "</article>" + "<div>" * 3000 + "x"
    rows = [(1, None, "<p>a", "h"), (1, None, "<p>a", "h"), (None, "http://x.example/", "<p>b", "h"), (3, "http://x.example/", long, "h"), (4, "nonsense", "<article>", "h"), (5, "http://x.example/", None, "h")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumns({k: F.lit(1) for k in ("text", "paths", "path", "k")})
    out = style_tree.main_texts(frame).collect()
    assert Counter((r.page_id, r.text[:9], r.n_chars) for r in out) == Counter([(1, "a", 1), (1, "a", 1), (None, "b", 1), (3, "word word", 40_000 * 10 - 1), (4, "", 0), (5, "", 0)])


def test_quality_counts(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.judge(docs, labels).collect()
    want = Counter()
    for i, t in pairs(docs):
        w = [x.decode() for x in t.encode().split()]
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {p for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep), failed, not failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out) == want
    assert quality.judge(none, labels).count() == 0


def test_quality_rules_are_certified_and_junk_goes(spark):
    rng = random.Random(6)
    text = lambda end: " ".join(f"w{rng.randrange(10**6)}{end if k % 2 else ''}" for k in range(60))
    langs = ["en"] * 1000 + ["de"] * 600 + ["xx"] * 50
    rows = [(i, text(""), lang, 1) for i, lang in enumerate(langs)]
    rows += [(10_000 + i, text("#"), lang, 0 if i % 2 else None) for i, lang in enumerate(["en", "de", "xx", "yy", None] * 20)]
    frame = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.judge(frame, labels).collect()}
    assert all("symbol_rate" in out[i].failed_rules and not out[i].kept for i in out if i >= 10_000)
    good = [out[i].kept for i in range(len(langs))]
    assert sum(good) == len(langs)
    few = quality.judge(frame, labels.filter("doc_id < 200 OR doc_id >= 10000")).collect()
    assert all(r.kept for r in few)


def test_quality_steps_equal_brute_force(spark):
    rng = random.Random(8)
    rows, values = [], {}
    for i in range(4000):
        stratum = "a" if i % 3 else "b" if i % 2 else f"s{i % 7}"
        n = 100
        rows.append((i, stratum, n, 400 + (500 if rng.random() < 0.003 else 0), 60 if i % 40 == 0 else rng.choice([0, 0, 0, 1]), 10, 4 if rng.random() < 0.004 else 0, 0, 0))
        values[i] = rows[-1]
    cols = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long"
    labels = spark.createDataFrame([(i, 0 if i % 40 == 0 else 1) for i in range(4000)], "doc_id long, quality int")
    got = {r.stratum: r for r in quality.certified_cutoffs(spark.createDataFrame(rows, cols), labels).collect()}
    grid = quality.GRID
    value = lambda r: {"symbol_rate": r[4] / 100, "dup_line_rate": r[6] / 10, "repeat_word_rate": 0.0, "upper_rate": 0.0, "word_length": r[3] / 100}
    level = lambda r: tuple(sum(v > c for c in grid[k]) for k, v in value(r).items())
    ladder = quality.ladder_of([(level(r), 1) for r in rows if r[0] % 40 == 0])
    assert sorted(ladder) == sorted((r, float(c)) for r, cs in grid.items() for c in cs)
    good = [r for r in rows if r[0] % 40]
    sizes = Counter(r[1] for r in good)
    need = lambda m: next(n for n in range(10**4) if 0.99**n <= 0.05 / m)
    m = sum(n >= need(2) for n in sizes.values()) + 1
    assert set(got) == {s for s, n in sizes.items() if n >= need(m)} | {None} and len(got) == 3
    for s, row in got.items():
        mine = [value(r) for r in good if s in (None, r[1])]
        want, now = {}, {}
        for rule, cut in ladder:
            now[rule] = cut
            k, n = sum(any(v[r] > c for r, c in now.items()) for v in mine), len(mine)
            if k >= n * 0.01 or sum(math.comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1)) > 0.05 / m:
                break
            want = dict(now)
        assert {r: row[f"cut_{r}"] for r in grid} == {r: want.get(r) for r in grid}


def test_binomial_bound(spark):
    p = 0.03
    cases = [(k, n) for n in (1, 10, 400, 3000) for k in range(0, min(n, 60), 7)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), p).alias("c")).collect()
    for r in got:
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(p) + (r.n - j) * math.log1p(-p)) for j in range(r.k + 1))
        assert math.isclose(r.c, want, rel_tol=1e-8)


def test_mixing_budgets(spark, docs, none):
    rows = [(d, "en", f"src{s}", " ".join(["w"] * n)) for d, (s, n) in enumerate([(0, 10), (0, 30), (1, 5), (5, 40), (5, 40), (11, 7)])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"), budget=1.0, max_epochs=1).collect()
    assert sum(r.take_tokens for r in out) == 132
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"), budget=0.5, max_epochs=2).collect()
    assert sum(r.take_tokens for r in out) == 66
    assert mixing.mix(docs).count() > 0 and mixing.mix(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == sorted(str([dict(zip(rel.columns, r, strict=True))[c] for c in cols]) for r in rel.fetchall())


def test_names_of_sets_that_clash(spark, monkeypatch):
    """With a first half of few values, sets are told apart by the second."""
    whole = jaccard._digest
    monkeypatch.setattr(jaccard, "_digest", lambda s: (whole(s)[0] % 3, whole(s)[1]))
    words = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join(words[: 20 + k % 5] + [f"u{k // 5}"] * 8)) for k in range(15)] + [(20, "x y")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root for i, (_, root) in components(rows).items()}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= kept.count()
        kept = spark.createDataFrame(out.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts))


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """With null, repeated and clashing ids, whole rows that repeat, and columns of clashing names."""
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**8)}" for _ in range(n))
    base = [fresh(60) for _ in range(12)]
    near = [" ".join(t.split()[:-2] + ["end", str(k)]) for k, t in enumerate(base[:4])]
    junk = "again and again " * 40
    rows = [(i, t) for i, t in enumerate(base)] + [(7, junk), (7, near[0]), (None, base[1]), (None, near[1]), (None, None), (None, ""), (3, base[3]), (3, base[3]), (30, base[3]), (40, near[2]), (40, near[2]), (None, fresh(55)), (5, "short")]
    schema = "doc_id long, text string, lang string, source string, n_words long, kept string, component string"
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    wide = [(i, t, "en" if k % 2 else None, f"src{k % 7}", k, "k", None) for k, (i, t) in enumerate(rows)]

    def stage(k, given):
        given.write.parquet(at := f"{folder}/{len(list(tmp_path.iterdir()))}")
        out = corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(at), folder)
        assert k == 4 or out.columns == given.columns
        return out, [tuple(r) for r in given.collect()]

    lots = lambda rows: Counter((r[0], r[1]) for r in rows)
    out, given = stage(0, spark.createDataFrame(wide, schema))
    kept = out.collect()
    assert lots(kept) == lots(r for r in given if r[1] and len(r[1].split()) >= 50 and r[1] != junk)
    out, given = stage(1, spark.createDataFrame(wide, schema))
    top = {}
    for i, t in ((r[0], r[1] or "") for r in given):
        top[t] = max(top.get(t, -1), -1 if i is None else i)
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect()) == Counter((i, t) for t, i in top.items())
    out, given = stage(2, spark.createDataFrame(wide, schema))
    comp = components([(k, r[1] or "") for k, r in enumerate(given)])
    best = {}
    for k, (n, root) in comp.items():
        i = given[k][0]
        root = root if n else ("none", k)
        best[root] = min(best.get(root, (2, 0)), (i is None, i or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == Counter(best.values())
    out, given = stage(3, out)
    chosen, total = out.collect(), sum(len((r[1] or "").split()) for r in given)
    assert not lots(chosen) - lots(given)
    assert 0.9 * total - 1 <= sum(len((r.text or "").split()) for r in chosen) <= total
    out, given = stage(4, spark.createDataFrame(wide, schema))
    enc = tokens.UnitEncoder(queries.public_file("byte_bpe_50k.json"), "bytes").tokenizer
    assert sum(r.length for r in out.collect()) == sum(len(enc.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in given)
    none = spark.createDataFrame([], schema)
    assert [stage(k, none)[0].count() for k in range(5)] == [0] * 5
