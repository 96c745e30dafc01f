"""Similarity join of documents by the Jaccard index of their word shingles.

Rare-first prefix filtering: when the shingles of every document are put in one global
order, rare ones first, two documents over the threshold share a shingle among the first
``n - ceil(t * n) + 1`` of each (their prefixes). Only prefixes are matched. Pairs that
match pass a length filter, a positional filter (what can still be shared after the
place of the match) and a suffix filter (an upper bound of the overlap from counts over a
partition of the hash space), and are then verified once on the whole sets.

Equal sets are one class, known by a hash of its shingles, and are joined as one. Matching
proceeds in rounds that keep groups of copies linear: the class that holds a shingle at the
least place, one in the middle of its group, is paired with all others that hold it, pairs
found join components, and pairs within a component need no further look; postings too late
for every partner go. Later rounds take 64 times the leaders each, and once few pairs are
left these are paired in full, so no link is lost.

The rounds run twice. First every pair that passes the filters counts as a link: this
gives candidate components, and no class outside one has any link. Only for the classes in
these are whole sets fetched, in one pass over the texts; then the filtered pairs are
verified, and rounds within each candidate component settle what is still open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS_PER_TASK, materialize, ship
from .components import connected_components
from .shingles import U, mix64, shingle_sets

#: Bound of the broadcast list of frequent shingles (12 bytes each).
MAX_FREQUENT = 1 << 18
#: Prefix shingles that a task of the pruning step holds, about 20 bytes each.
BUCKET_ENTRIES = 1 << 20
#: Parts of the hash space that the suffix filter counts over.
PARTS = 32
#: Rounds of star matching go on while more than this many pairs remain for each posting.
PAIRS_PER_POSTING = 64
#: The first round has one leader for a shingle, each later one so many times more.
LEADERS = 64
#: Sets whose 64-bit names clash; more than these fail the job (ten are expected among 2 * 10**10 different sets).
MAX_CLASHES = 100_000


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - -(-n * percent // 100) + 1


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of a hash of a set."""
    k = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(k[:8], "little", signed=True), int.from_bytes(k[8:], "little", signed=True)


_FOUND = [("n", T.LongType()), ("id", T.LongType()), ("other", T.LongType()), ("parts", T.ArrayType(T.IntegerType())), ("gram", T.LongType()), ("times", T.LongType())]


def _profiles(size: int):
    """Per document, beside its own columns: n, the halves of its set's hash, and, where the task meets the set first,
    its counts over parts of the hash space. Then the shingles that two sets or more of the task hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        waiting = 0
        counts = (np.zeros(0, U), np.zeros(0, np.int64))
        schema = None

        def settle():
            nonlocal held, waiting, counts
            if held:
                g, c = np.unique(np.concatenate(held), return_counts=True)
                more = c > 1
                g, c = np.concatenate((counts[0], g[more])), np.concatenate((counts[1], c[more]))
                u, inv = np.unique(g, return_inverse=True)
                counts = (u, np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64))
            held, waiting = [], 0

        names = [k for k, _ in _FOUND]
        for batch in batches:
            schema = [(f.name, f.type) for f in batch.schema if f.name != "__text"]
            n, first, other, parts = [], [], [], []
            for s in shingle_sets(batch.column("__text"), size):
                k = _digest(s) if len(s) else (None, None)
                n.append(len(s))
                first.append(k[0])
                other.append(k[1])
                if len(s) and k not in seen:
                    seen.add(k)
                    held.append(s)
                    waiting += len(s)
                    parts.append(np.bincount((s >> U(59)).astype(np.int64), minlength=PARTS).astype(np.int32))
                else:
                    parts.append(None)
            none = pa.nulls(len(n), pa.int64())
            found = [pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(other, pa.int64()), pa.array(parts, pa.list_(pa.int32())), none, none]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k, _ in schema] + found, names=[k for k, _ in schema] + names)
            if waiting > 4_000_000:
                settle()
        settle()
        m = len(counts[0])
        if m:
            none = pa.nulls(m, pa.int64())
            found = [none, none, none, pa.nulls(m, pa.list_(pa.int32())), pa.array(counts[0].view(np.int64)), pa.array(counts[1])]
            yield pa.RecordBatch.from_arrays([pa.nulls(m, t) for _, t in schema] + found, names=[k for k, _ in schema] + names)

    return run


def _order(s: np.ndarray, grams: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in the global order (not frequent first, then by rank, ties by hash) and which are frequent."""
    at = np.searchsorted(grams, s)
    at[at == len(grams)] = 0
    common = grams[at] == s if len(grams) else np.zeros(len(s), bool)
    if not common.any():
        return s, common
    r = np.where(common, rank[at], 0) if len(grams) else np.zeros(len(s), np.int32)
    o = np.lexsort((s, r))
    return s[o], common[o]


_HEAD = np.dtype([("id", "<i8"), ("n", "<u4")])
_POSTING = np.dtype([("gram", "<u8"), ("doc", "<u4"), ("pos", "<u2")])


def _named(k: tuple[int, int], clashing: frozenset[int]) -> int:
    return k[1] if k[0] in clashing else k[0]


def _prefixes(frequent, clashing: frozenset[int], percent: int, size: int, n_buckets: int):
    """Prefix postings as packed blobs: (bucket, kind, head, postings).

    Kind 0 may hold shingles that occur nowhere else; kind 1 are frequent ones, dealt out evenly.
    A place beyond 65,535 counts as that, which lets more pairs pass the positional filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rank = frequent.value
        seen: set[int] = set()
        for batch in batches:
            head, parts, flags, docs, places = [], [], [], [], []
            for s in shingle_sets(batch.column(0), size):
                if not len(s):
                    continue
                k = _named(_digest(s), clashing)
                if k in seen:
                    continue
                seen.add(k)
                o, common = _order(s, grams, rank)
                p = prefix_length(len(s), percent)
                docs.append(np.full(p, len(head), np.uint32))
                head.append((k, len(s)))
                parts.append(o[:p])
                flags.append(common[:p])
                places.append(np.minimum(np.arange(p), 65535).astype(np.uint16))
            if not head:
                continue
            heads = np.array(head, _HEAD)
            g, c, d, p = np.concatenate(parts), np.concatenate(flags), np.concatenate(docs), np.concatenate(places)
            b = (mix64(np.where(c, g + heads["id"].view(U)[d], g)) % U(n_buckets)).astype(np.int64) * 2 + c
            o = np.argsort(b, kind="stable")
            b = b[o]
            rows = np.zeros(len(o), _POSTING)
            rows["gram"], rows["doc"], rows["pos"] = g[o], d[o], p[o]
            cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))).tolist() + [len(b)]
            out = {"bucket": [], "kind": [], "head": [], "postings": []}
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                u, inv = np.unique(rows["doc"][x:y], return_inverse=True)
                rows["doc"][x:y] = inv
                out["bucket"].append(int(b[x]) // 2)
                out["kind"].append(int(b[x]) % 2)
                out["head"].append(heads[u].tobytes())
                out["postings"].append(b"".join(rows[k][x:y].tobytes() for k in ("gram", "doc", "pos")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["bucket"], pa.int32()), pa.array(out["kind"], pa.int32()), pa.array(out["head"], pa.binary()), pa.array(out["postings"], pa.binary())], names=list(out)
            )

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Postings of a bucket whose shingle two different sets or more hold; all of frequent shingles."""
    heads, grams, docs, places, sizes, at = [], [], [], [], [], 0
    for h, x in zip(pdf["head"], pdf["postings"], strict=True):
        m = len(x) // _POSTING.itemsize
        heads.append(np.frombuffer(h, _HEAD))
        grams.append(np.frombuffer(x, "<u8", m))
        docs.append(np.frombuffer(x, "<u4", m, 8 * m).astype(np.int64) + at)
        places.append(np.frombuffer(x, "<u2", m, 12 * m))
        sizes.append(m)
        at += len(heads[-1])
    head, gram, doc, pos = np.concatenate(heads), np.concatenate(grams), np.concatenate(docs), np.concatenate(places)
    known = np.repeat(pdf["kind"].to_numpy() == 1, sizes)
    key = head["id"][doc]
    o = np.lexsort((key, gram))
    gram, key, doc, pos, known = gram[o], key[o], doc[o], pos[o], known[o]
    new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])))  # one posting for each set
    gram, key, doc, pos, known = gram[new], key[new], doc[new], pos[new], known[new]
    same = gram[1:] == gram[:-1]
    keep = known.copy()
    keep[1:] |= same
    keep[:-1] |= same
    return pd.DataFrame({"gram": gram[keep].view(np.int64), "id": key[keep], "n": head["n"][doc[keep]].astype(np.int64), "pos": pos[keep].astype(np.int64)})


def _sets(clashing: frozenset[int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [s for s in shingle_sets(batch.column(0).slice(at, 256), size) if len(s)]
                ids = [_named(_digest(s), clashing) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "grams"])

    return run


def needed(na: Column, nb: Column, percent: int) -> Column:
    """Least overlap with 100 * overlap >= percent * (na + nb - overlap)."""
    return F.ceil((na + nb) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _near(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that pass the suffix filter: the overlap is at most the sum over parts of the lesser count.

    Both sides grow with the data, so these are sort-merge joins at any size.
    """
    a, b = light.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa")), light.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))
    bound = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    return materialize(both.filter(bound >= needed(F.col("na"), F.col("nb"), percent)).select("a", "b"), "near")


def _verified(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among distinct pairs (a written table), by their whole sets."""
    both = near.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")).hint("merge"), "b")
    both = both.select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("m"))
    links = both.filter(F.col("m") * 100 >= (F.col("na") + F.col("nb") - F.col("m")) * percent).select("a", "b")
    return materialize(links.repartition(max(1, -(-near.count() // ROWS_PER_TASK))), "links")


def _passes(percent: int) -> Column:
    """Length and positional filters on (na, pa) and (nb, pb)."""
    long = (F.least("na", "nb") * 100) >= F.greatest("na", "nb") * percent
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # the match and what follows it
    return long & (left >= needed(F.col("na"), F.col("nb"), percent))


def _may_pass(percent: int) -> Column:
    """Whether a posting (n, pos) may pass these filters with any set of ``least_n`` shingles or more."""
    return F.col("n") - F.col("pos") >= needed(F.col("n"), F.greatest("least_n", F.ceil(F.col("n") * percent / 100 - F.lit(1e-9))), percent)


def _pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of different components that share a shingle and pass the filters on it."""
    a = left.select("gram", F.col("id").alias("x"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    b = right.select("gram", F.col("id").alias("y"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"))
    both = a.join(b.hint("merge"), "gram").filter(F.col("ca") != F.col("cb")).filter(_passes(percent))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _settle(postings: DataFrame, labels: DataFrame | None, percent: int, link, step: int = 0) -> DataFrame:
    """Components (node, comp), so that no two classes that share a shingle and that ``link`` would link are in different ones.

    Leaders of a round are, in each of LEADERS**round slots of a shingle's classes, those that
    hold it at the least place. Such a set has the fewest shingles of its own before those that
    its group shares, so it lies in the middle of the group: it links with members that do not
    link with each other, and the positional filter passes its pairs before all others. The
    leaders come from an aggregation that is combined in the tasks.

    Postings whose place is too late for the smallest set that holds the shingle pass the
    positional filter with no other and go before the pairing.
    """
    central = F.shiftleft("pos", 47).bitwiseOR(F.col("id").bitwiseAND(F.lit((1 << 47) - 1)))  # place, then name; classes that agree in both lead together
    while True:
        if labels is None:
            current = postings.withColumn("comp", F.col("id"))
        else:
            known = labels.select(F.col("node").alias("id"), "comp")
            current = postings.join(known.hint("merge"), "id", "left").select("gram", "id", "n", "pos", F.coalesce("comp", "id").alias("comp"))
            current = materialize(current, "current")
            by = current.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least_n"))
            by = by.groupBy("gram").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"), F.min("least_n").alias("least_n"))
            by = materialize(by.withColumn("pairs", (F.col("m") * F.col("m") - F.col("same")) / 2).filter("pairs > 0"), "open")
            sums = by.agg(F.sum("pairs").alias("p"), F.sum("m").alias("m")).first()
            if not sums["m"]:
                return labels
            opened = current.join(by.select("gram", "least_n").hint("merge"), "gram").filter(_may_pass(percent))
            if sums["p"] <= PAIRS_PER_POSTING * sums["m"]:
                return connected_components(link(_pairs(opened, opened, percent)), labels)
        slot = F.pmod(F.xxhash64("id"), F.lit(LEADERS**step)).alias("slot")
        # in the first round, where a shingle has one slot, its least set is that of the slot
        of_open, least_n = (current.groupBy("gram", slot), F.min("n")) if labels is None else (opened.groupBy("gram", slot), F.min("least_n"))
        # written, so that the join below, which keeps open shingles only, is one whose skewed keys AQE can split
        least = materialize(of_open.agg(F.min(central).alias("least"), least_n.alias("least_n")), "least")
        current = current.select("*", slot)
        marked = current.join(least.hint("merge"), ["gram", "slot"]).filter(_may_pass(percent))
        marked = materialize(marked.select("gram", "id", "n", "pos", "comp", (central == F.col("least")).alias("first")), "marked")
        labels = connected_components(link(_pairs(marked.filter("first"), marked, percent)), labels)
        postings = marked.filter("NOT first").select("gram", "id", "n", "pos")
        step += 1


def _frequent(times: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, counted over all documents, with their counts; the list is cut to its bound at a power of two."""
    histogram = times.groupBy(F.floor(F.log2("times")).cast("int").alias("e")).count().collect()  # 64 rows at most
    least, listed = 64, 0
    for e, n in sorted(((r["e"], r["count"]) for r in histogram), reverse=True):
        if listed + n > MAX_FREQUENT:
            break
        least, listed = e, listed + n
    rows = times.filter(F.col("times") >= F.lit(float(2**least))).toArrow() if listed else pa.table({"gram": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    grams, counts = rows["gram"].to_numpy().view(U), rows["times"].to_numpy()
    o = np.argsort(grams)
    return grams[o], counts[o]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, n_shingles, class_id, component_id, component[, keep...]) for every document.

    class_id is the least id with the same shingle set, component_id the least id reachable
    by links of at least ``percent`` / 100, component a name that the rows of a component
    share. ``keep`` are columns that are handed through.

    * Null and empty texts have no shingles and are linked with nothing; their component is null.
    * Rows that repeat an id are joined as the documents they are.
    * Rows without an id are linked like others; class_id and component_id are null where no
      row of the class or component has an id.
    * An empty table gives an empty result; other columns are ignored.
    * Ids are integers. A set, a shingle or a group of copies may belong to any share of the
      rows: equal sets are merged before they are matched, frequent shingles are dealt out
      evenly, and the joins on them are plain ones that AQE splits.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    # what fetches a document again: its id or, without one, a hash of its text
    ref = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("__ref")
    own = docs.select(F.col(id_col).cast("long").alias("__id"), ref, *keep, text.alias("__text"))
    fields = [f for f in own.schema.fields if f.name != "__text"] + [T.StructField(k, t) for k, t in _FOUND]
    profile = materialize(own.mapInArrow(_profiles(size), T.StructType([T.StructField(f.name, f.dataType) for f in fields])), "profiles")
    frequent = spark.sparkContext.broadcast(_frequent(materialize(profile.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("times").alias("times")), "times")))
    own = profile.filter("gram IS NULL").drop("gram", "times")

    # sets are known by the first half of their hash; where that is not unique, by the second
    halves = own.filter("parts IS NOT NULL").groupBy("id").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("lo <> hi")
    clashing = frozenset(r["id"] for r in halves.select("id").limit(MAX_CLASHES).collect())
    if len(clashing) == MAX_CLASHES:
        raise ValueError("too many sets share the first half of their hash")
    if clashing:
        own = own.withColumn("id", F.when(F.col("id").isin(*clashing), F.col("other")).otherwise(F.col("id")))

    total = own.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(16, -(-total * (100 - percent) // 100 // BUCKET_ENTRIES))
    texts = docs.select(text.alias("__text"))
    blobs = texts.mapInArrow(_prefixes(frequent, clashing, percent, size, n_buckets), "bucket int, kind int, head binary, postings binary")
    shared = materialize(blobs.groupBy("bucket").applyInPandas(_shared, "gram long, id long, n long, pos long"), "shared")
    frequent.unpersist()
    light = materialize(own.filter("parts IS NOT NULL").select("id", "n", "parts").dropDuplicates(["id"]), "light")

    nears: list[DataFrame] = []

    def as_links(pairs: DataFrame) -> DataFrame:
        nears.append(_near(pairs, light, percent))
        return nears[-1]

    candidates = _settle(shared, None, percent, as_links)  # (node, comp) of classes that may have links
    n_near = sum(x.count() for x in nears)
    near = materialize(reduce(DataFrame.unionByName, nears).distinct(), "candidates", n_near)

    # the sets of these, in one pass over the texts
    nodes = candidates.select(F.col("node").alias("id"))
    refs = materialize(own.filter("parts IS NOT NULL").join(nodes.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("__ref").alias("__ref")), "refs", 2 * n_near)
    fetched = docs.select(ref, text.alias("__text")).join(refs.select("__ref").distinct().hint("merge"), "__ref", "left_semi").select("__text")
    sets = materialize(fetched.mapInArrow(_sets(clashing, size), "id long, grams array<bigint>"), "sets")
    n_rows, n_refs = (x.count() for x in (sets, refs))
    if n_rows != n_refs:  # an id, or a text without one, that several rows have
        sets = materialize(sets.dropDuplicates(["id"]).join(nodes.hint("merge"), "id", "left_semi"), "sets")

    links = _verified(near, sets, percent)
    labels = connected_components(links)
    failed = materialize(near.join(links.hint("merge"), ["a", "b"], "left_anti"), "failed", n_near)
    # a link lies within a candidate component
    part = candidates.select(F.col("node").alias("id"), F.col("comp").alias("part"))
    inner = shared.join(part.hint("merge"), "id").select(F.xxhash64("gram", "part").alias("gram"), "id", "n", "pos")
    labels = _settle(inner, labels, percent, lambda pairs: _verified(_near(pairs.join(failed.hint("merge"), ["a", "b"], "left_anti"), light, percent), sets, percent), step=1)

    classes = own.filter("n > 0").groupBy("id").agg(F.min("__id").alias("class_id"), F.count(F.lit(1)).alias("c"))
    groups = classes.join(labels.select(F.col("node").alias("id"), "comp").hint("merge"), "id", "left").filter("c > 1 OR comp IS NOT NULL")
    groups = materialize(groups.select("id", "class_id", F.coalesce("comp", "id").alias("comp")), "groups")
    least = groups.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    found = groups.join(least, "comp").withColumnRenamed("id", "__found")
    out = own.join(found.hint("merge"), F.col("id") == F.col("__found"), "left")
    of = lambda c: F.when(F.col("__found").isNotNull(), F.col(c)).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), of("class_id").alias("class_id"), of("component_id").alias("component_id"), F.coalesce("comp", "id").alias("component"), *keep)
