"""Filter audit, benchmark passages and vector codes against brute force on small inputs."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from cityjobs.llm import decontaminate as dc
from cityjobs.llm import filter_audit, vector_codes

DOCS = "doc_id long, text string, source string, good long, n long, runs string, code string, error string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "Wörter und mehr words. " * 30000


def doc_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "r", "c", "e") for r in rows], DOCS)


# ---- filter audit


def brute_audit(docs, labels):
    ids = {}
    for i, t, _ in docs:
        ids.setdefault(t or "", []).append(i)
    flagged = []
    for i, t, part in docs:
        t = t or ""
        w = SPLIT.findall(t)
        least = min((x for x in ids[t] if x is not None), default=None)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least is not None and i > least,
        }
        marks = [x for x in labels if x[0] == i and i is not None]
        flagged.append((part or "", fails, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out = {}
    for part in {f[0] for f in flagged}:
        rows = [f for f in flagged if f[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                failing = [r for r in rows if r[1][f]]
                only = sum(sum(r[1].values()) == 1 for r in failing)
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [f, len(left), len(gone), len(failing) - len(gone), only, sum(r[2] for r in gone), sum(r[3] for r in gone), len(failing)]
        for k in [k for k in out if k[0] == part]:
            out[k].append(removed_by[out[k][0]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    names = ["filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "failing", "shapley"]
    rows = df.collect()
    out = {(r["part"], r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def test_filter_audit(spark):
    rng = random.Random(3)
    texts = [None, "", "  \n", "a b c", "a " * 60, "A B" * 40, LONG, LONG, "x$ " + " ".join(map(str, range(70))), "x$ " + " ".join(map(str, range(70))), " ".join(f"W{i}" for i in range(60)), "née " * 49, " ".join(f"é{i}" for i in range(50))]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "s1", "hot", "hot", "hot"])) for i in range(150)]
    docs += [(7, texts[8], "s1"), (7, texts[8], "s1"), (None, texts[8], "s1"), (None, None, None), (None, "only once", "alone")]
    labels = [(rng.choice([None, *range(160)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(120)]
    frame = spark.createDataFrame([(*x, "A") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert audited(filter_audit.audit(doc_frame(spark, docs), frame)) == brute_audit(docs, labels)


def test_filter_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(doc_frame(spark, []), labels).count() == 0
    docs = [(1, "a", "s"), (2, "a", "s")]
    assert audited(filter_audit.audit(doc_frame(spark, docs), labels)) == brute_audit(docs, [])


# ---- benchmark passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_passages(docs, items, size=10):
    """(id, words, hit words, names) of each document, in order."""
    of = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for name, t in items:
        w = of(t)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    out = []
    for i, t, *_ in docs:
        w, hit, names = of(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                got = windows.get(tuple(w[a : a + n]))
                if got:
                    hit |= set(range(a, a + n))
                    names |= got
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def passages(spark, size=10):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "γάμμα", "d4", "ÉE", "x", "yy", "日本", "q"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "-", "_", ". ", "…", "\x7f", " "]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(30)] + [(3, text(20)), (None, text(12)), (None, text(15)), (77, None), (78, ""), (-5, "- _ ."), (79, text(60))]
    items = [(i, "zq " + t if t and len(WORD.findall(t)) < 4 else t) for i, t in items]
    docs = [(i, text(rng.choice([0, 2, 9, 30, 80]))) for i in range(60)]
    for i in range(60, 160):
        t = rng.choice(items)[1] or ""
        docs.append((i, text(rng.choice([0, 1, 20])) + rng.choice([t, t.upper(), t.lower(), t.replace(" ", ", ")]) + " " + text(rng.choice([0, 5]))))
    docs += [(3, items[5][1]), (3, items[5][1]), (None, items[4][1]), (None, None), (200, None), (201, ""), (202, LONG + " " + items[-1][1] + " " + LONG)]
    return docs, items


def passage_frames(spark):
    docs, items = passages(spark)
    return docs, items, doc_frame(spark, [(i, t, "s") for i, t in docs]).repartition(3), spark.createDataFrame([(*x, "w") for x in items], "item_id long, text string, n_words string")


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 400])
def test_benchmark_passages(spark, block):
    docs, items, frame, bench = passage_frames(spark)
    got = dc.report(dc.find_passages(frame, bench, block_bytes=block)).collect()
    assert Counter(map(tuple, got)) == brute_passages(docs, items)
    assert any(r.n_items > 1 for r in got)


def test_benchmark_passages_of_empty_tables(spark):
    docs, _, frame, bench = passage_frames(spark)
    assert {(r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in dc.report(dc.find_passages(frame, bench.limit(0))).collect()} == {(0, 0, False, hashlib.sha256(b"").hexdigest())}
    assert dc.find_passages(frame.limit(0), bench).count() == 0


def test_long_items_are_cut_with_overlap(monkeypatch, spark):
    monkeypatch.setattr(dc, "PIECE_WORDS", 7)
    docs, items, frame, bench = passage_frames(spark)
    assert Counter(map(tuple, dc.report(dc.find_passages(frame, bench)).collect())) == brute_passages(docs, items)
    assert all(len(p) <= 400 or len(ps) == 1 for ps, _, _ in dc.item_blocks(bench, block_bytes=400) for p in ps)


def test_hits_are_verified_where_hashes_clash(monkeypatch):
    monkeypatch.setattr(dc, "mix64", lambda h: h % dc.U(3) << dc.U(40))
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    pieces = [text(rng.choice([2, 3, 4, 8])).encode() + b" " for _ in range(40)]
    found = dc.WindowSet(pieces, np.arange(40), size=3)
    docs = [text(60) for _ in range(10)]
    data = "".join(docs).encode()
    words = dc.Words(np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in docs]))))
    begin, _, doc, item = found.find(words)
    want = set()
    for k, p in enumerate(pieces):
        w = p.decode().split()
        n = min(3, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for j, d in enumerate(docs):
            v = d.split()
            want |= {(j, k) for i in range(len(v) - n + 1) if tuple(v[i : i + n]) in grams}
    assert set(zip(doc.tolist(), item.tolist(), strict=True)) == want and len(begin) > 100


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 300])
def test_decontaminate(spark, block):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "short Item"), (3, "été à la plage avec les amis de mon frère aujourd'hui")], "item_id long, text string")
    docs = doc_frame(spark, [(1, "Before ONE, two three four five six seven eight nine ten! After short-item.", "s"), (2, "clean", "s"), (3, None, None), (4, "x été à la plage avec les amis de mon frère y", "s"), (5, "", "s"), (1, "clean as well", "s")])
    spans = dc.decontaminate(docs, bench, "spans", block_bytes=block)
    assert spans.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in spans.collect()) == Counter([(1, "Before ! After ."), (2, "clean"), (3, None), (4, "x  y"), (5, ""), (1, "clean as well")])
    left = dc.decontaminate(docs, bench, "documents", block_bytes=block)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(2, "clean"), (3, None), (5, ""), (1, "clean as well")])
    assert dc.decontaminate(docs, bench, max_share=0.84, block_bytes=block).count() == 5
    with pytest.raises(ValueError):
        dc.decontaminate(docs, bench, "words")


# ---- vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not ok:
        return Counter()
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    d = len(ok[0][1]) // parts
    cut = lambda v, p: v[p * d : p * d + d]
    books = [[cut(v, p) for _, v, _ in ok[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((far(cut(v, p), c), k) for k, c in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        of = [assign(v) for _, v, _ in ok]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(ok, of, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = [assign(v) for _, v, _ in ok]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(x for x, _ in a) for a in of]
    by = Counter()
    for (_, _, lab), e in zip(ok, errors, strict=True):
        by[lab] += e
    return Counter((i, "".join(f"{k:02x}" for _, k in a), e, by[lab], digest) for (i, _, lab), a, e in zip(ok, of, errors, strict=True))


def vector_rows(n, dim, seed):
    rng = random.Random(seed)
    value = lambda: float(np.float32(rng.choice([rng.uniform(-1, 1), rng.choice([0.0, -0.00390625, 0.5])])))
    rows = [(i * 3 % n, [value() for _ in range(dim)], rng.choice([None, 0, 1, 1, 1])) for i in range(n)]
    rows += [rows[5], rows[5], (2, rows[9][1], 4), (None, rows[1][1], 1), (None, None, 1), (n + 1, None, None), (-4, [0.0] * (dim - 1) + [None], 0), (-3, [math.nan] * dim, 0), (-2, [math.inf] + [0.0] * (dim - 1), 0), (n + 2, [], 0), (n + 3, [0.5] * (dim + 16), 0), (-9, [0.5] * 7, 1)]
    return rows


@pytest.mark.parametrize(("n", "dim"), [(300, 32), (20, 16), (1, 48)])
def test_vector_codes(spark, n, dim):
    rows = vector_rows(max(n, 10), dim, n) if n > 1 else [(4, [0.25] * dim, None)]
    frame = spark.createDataFrame([(*r, "c", "e") for r in rows], "vec_id long, embedding array<float>, label int, code string, error string").repartition(4)
    got = vector_codes.compress(frame).collect()
    assert Counter(map(tuple, got)) == brute_codes(rows)


def test_vector_codes_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(none).count() == 0
    bad = spark.createDataFrame([(1, None, 1), (2, [1.0] * 5, 2)], "vec_id long, embedding array<float>, label int")
    out = vector_codes.compress(bad)
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_nearest_takes_the_first_of_equal_entries():
    books = np.array([[[1], [-1], [1]], [[5], [5], [4]]])
    code, best = vector_codes.nearest(np.array([[0, 9], [-3, 4]]), books)
    assert code.tolist() == [[0, 0], [1, 2]] and best.tolist() == [[1, 16], [4, 0]]


def test_too_large_components_raise():
    with pytest.raises(OverflowError):
        vector_codes.scaled_vectors(pa.array([[0.0, 1e30]]))
