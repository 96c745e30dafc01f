"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of element paths; pages of equal payload count
as one. The importance of a branch joins its presentation (entropy of the child sequences
that pages give it) and its content:

* how evenly each text in it is spread over the pages: a text on all pages carries nothing,
  a text on one page carries all. A branch, or a single text of a node, whose texts repeat is
  cut wherever it stands, within a marked article as well.
* its share of all that the host's texts carry. From the root down, containers that hold
  more than half of it lead to the host's main branch; a container beside that way which holds
  little, and which looks the same on every page, is cut: an advert or a footer with other words
  on each page.

Element semantics, and names that say nothing but page furniture, remove what the tree
leaves, and all on hosts with too few pages for a tree. What remains, within the article
if the page marks one, is the main text; unless the tree knows the host's main branch, and
what the page marks lies beside it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship
from .dom import TEXT_LEVEL, Block, blocks

#: Distinct pages that a node needs before it can be judged.
MIN_PAGES = 8
#: A branch of texts of lower importance is cut.
THRESHOLD = 0.2
#: A container beside the way to the main branch of lower importance is cut.
BESIDE = 0.12
#: Weight of content against presentation.
GAMMA = 0.9


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, kind, feature, words, pages): texts (kind 0), child sequences (1), branches (2) and the pages themselves (3).

    A page of which the host has n copies counts as 1/n.
    """
    counts: defaultdict = defaultdict(float)

    def out():
        rows = list(zip(*counts, strict=True))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(r, k) for r, k in zip(rows, kinds, strict=True)), pa.array(counts.values(), pa.float64())], names=["host", "path", "kind", "feature", "words", "pages"])

    for batch in batches:
        for host, page, copies in zip(*batch.columns, strict=True):
            host = host.as_py()
            found, styles = blocks(page.as_py() or "")
            seen = {(host, b.path, 0, _digest(b.text), b.text.count(" ") + 1) for b in found}
            above = {p[:i] for p in {x[1] for x in seen} for i in range(1, len(p) + 1) if i == len(p) or p[i] == "/"}
            seen |= {(host, p, 2, 0, 0) for p in above}
            seen |= {(host, p, 1, _digest(s), 0) for p, s in styles if p in above}
            seen.add((host, "", 3, 0, 0))
            share = 1 / copies.as_py()
            for x in seen:
                counts[x] += share
        if len(counts) > 200_000:
            yield out()
            counts.clear()
    if counts:
        yield out()


def _prefixes(path: Column) -> Column:
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def importance(features: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows (host, branch, pages, style, content, share): what the tree of a host with ``min_pages`` pages knows of a branch.

    ``features`` are sums (host, path, kind, feature, words, k) with k the number of distinct
    pages. pages is the number that have the branch; style the entropy of its child sequences,
    to the base of that number; content what its texts carry of what their words would carry if
    no text repeated on the pages of its node; share what they carry of all that the host's
    texts carry. Texts of nodes on fewer than ``min_pages`` pages carry all.
    """
    hosts = features.filter("kind = 3").filter(F.col("k") >= min_pages).select("host")
    nodes = features.filter("kind = 2").select("host", "path", F.col("k").alias("m"))
    # a node may hold most texts of a host: its features are summed by their number of pages before the join
    sums = features.filter("kind < 2").groupBy("host", "path", "kind", "k").agg(F.count(F.lit(1)).alias("c"), F.sum("words").alias("words"))
    sums = sums.join(hosts, "host", "left_semi").join(nodes, ["host", "path"])
    part = F.least(F.lit(1.0), F.col("k") / F.col("m"))
    judged, text = F.col("m") >= min_pages, F.col("kind") == 0
    carried = F.when(judged, 1 - F.least(F.lit(1.0), F.log("k") / F.log("m"))).otherwise(1.0)  # of a text on k of m pages
    per_node = sums.groupBy("host", "path").agg(
        F.first("m").alias("m"),
        F.coalesce(F.sum(F.when(text, F.col("words") * F.col("k") * carried)), F.lit(0.0)).alias("carried"),
        F.coalesce(F.sum(F.when(text, F.col("words") * F.col("k"))), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.when(~text & (F.col("m") > 1), -F.col("c") * part * F.log(part) / F.log("m"))), F.lit(0.0)).alias("style"),
    )
    # a branch joins all nodes below it
    own = F.col("path") == F.col("branch")
    tree = per_node.withColumn("branch", F.explode(_prefixes(F.col("path")))).groupBy("host", "branch")
    tree = tree.agg(F.max(F.when(own, F.col("m"))).alias("pages"), F.sum("carried").alias("carried"), F.sum("words").alias("words"), F.max(F.when(own, F.col("style"))).alias("style"))
    whole = per_node.groupBy("host").agg(F.sum("carried").alias("all"))
    tree = tree.filter("words > 0").join(whole, "host")
    return tree.select("host", "branch", "pages", "style", (F.col("carried") / F.col("words")).alias("content"), (F.col("carried") / F.greatest("all", F.lit(1e-9))).alias("share"))


def unimportant(pages: DataFrame, html_col: str = "html", min_pages: int = MIN_PAGES, threshold: float = THRESHOLD, beside: float = BESIDE) -> DataFrame:
    """Rows (host, paths, texts, main): the branches to cut on the pages of a host, the single texts as 'digest path', and the main branch.

    ``pages`` has the host in ``__host``. Only copies of a page are joined by payload, so pages
    are shuffled only where the table of payloads that repeat is too large to be broadcast.
    """
    ship(pages.sparkSession)
    rows = pages.filter("__host <> ''").select("__host", F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("__payload", F.unhex(F.md5(F.coalesce("html", F.lit("")).cast("binary"))))
    copies = materialize(rows.groupBy("__host", "__payload").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "page-copies")
    rows = rows.withColumn("copies", F.lit(1).cast("long")) if copies.isEmpty() else rows.join(copies, ["__host", "__payload"], "left")
    rows = rows.select("__host", "html", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    counted = rows.mapInArrow(_features, "host string, path string, kind int, feature long, words long, pages double")
    sums = counted.groupBy("host", "path", "kind", "feature", "words").agg(F.round(F.sum("pages")).cast("long").alias("k"))
    features = materialize(sums.filter("k > 0"), "style-features")
    tree = materialize(importance(features, min_pages), "style-tree")
    judged = tree.filter(F.col("pages") >= min_pages)
    low = judged.filter((1 - GAMMA) * F.col("style") + GAMMA * F.col("content") < threshold).select("host", "branch")
    # the way to the main branch: containers with more than half of what the host's texts carry, each in the one before
    tag = F.regexp_extract("branch", r"/([^/.]*)[^/]*$", 1)
    container = ~tag.isin(*sorted(TEXT_LEVEL))
    way = tree.filter(container & (F.col("share") > 0.5)).select("host", F.col("branch").alias("up"))
    inmost = way.groupBy("host").agg(F.max_by("up", F.length("up")).alias("main"))
    parent = F.regexp_replace("branch", r"/[^/]*$", "")
    side = judged.filter(container & ((1 - GAMMA) * F.col("style") + GAMMA * F.col("share") < beside)).withColumn("up", parent)
    side = side.join(way, ["host", "up"], "left_semi").join(inmost, "host").filter("up <> main").select("host", "branch")
    # a text on most pages of its node is a leaf without presentation; a page of usual length has few such
    carried = 1 - F.least(F.lit(1.0), F.log("k") / F.log("m"))
    nodes = judged.select("host", F.col("branch").alias("path"), F.col("pages").alias("m"))
    most = features.filter((F.col("kind") == 0) & (2 * F.col("k") > min_pages)).join(nodes, ["host", "path"])
    most = most.filter((2 * F.col("k") > F.col("m")) & (GAMMA * carried < threshold))
    leaves = most.select("host", F.lit(None).cast("string").alias("branch"), F.concat_ws(" ", "feature", "path").alias("leaf"))
    cut = low.unionByName(side).withColumn("leaf", F.lit(None).cast("string")).unionByName(leaves)
    cut = cut.groupBy("host").agg(F.array_sort(F.collect_set("branch")).alias("paths"), F.array_sort(F.collect_set("leaf")).alias("texts"))
    return materialize(cut.join(inmost, "host", "full"), "unimportant")


def left_by_tree(found: list[Block], cut: tuple[str, ...], single: frozenset[str]) -> list[Block]:
    return [b for b in found if not any(within(b.path, p) for p in cut) and not (single and f"{_digest(b.text)} {b.path}" in single)]


def within(path: str, branch: str) -> bool:
    return path == branch or path.startswith(branch + "/")


def main_blocks(found: list[Block], cut: tuple[str, ...], single: frozenset[str], main: str | None = None) -> list[Block]:
    """The blocks of a page that neither the tree nor names remove, within its article if it marks one.

    The mark does not count where the host's main branch holds blocks of the page but none that is marked.
    """
    left = [b for b in left_by_tree(found, cut, single) if not b.furniture]
    inside = [b for b in left if b.in_body]
    in_main = [b for b in left if main and within(b.path, main)]
    return left if not inside or (in_main and not any(b.in_body for b in in_main)) else inside


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = []
            for page, low, leaves, main in zip(part.column("html"), part.column("paths"), part.column("texts"), part.column("main"), strict=True):
                cut, single = tuple(low.as_py() or ()), frozenset(leaves.as_py() or ())
                found, _ = blocks(page.as_py() or "")
                texts.append("\n".join(b.text for b in main_blocks(found, cut, single, main.as_py())))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    host = F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.withColumn("__host", F.lower(F.coalesce(host, F.lit(""))))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Rows (id, url, text, n_chars) for every page.

    * Null html has an empty text. Pages without a host, or of hosts with fewer than
      ``MIN_PAGES`` distinct pages, are judged by semantics and names alone.
    * Repeated rows and rows without an id are extracted each; an empty table gives an empty
      result; other columns are ignored, whatever their names.
    * A page of any length is parsed in one pass, in time and memory linear in its length.
    * Branches of equal importance are judged alike, so ties need no order.
    * A host may hold any share of the pages: its tree is summed in the tasks before the
      shuffle, and pages join it by a plain join that is broadcast only while small.
    """
    spark: SparkSession = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = with_host(rows)
    low = unimportant(rows, **options)
    kind = rows.schema["page_id"].dataType.simpleString()
    if low.isEmpty():
        rows = rows.withColumns({c: F.lit(None).cast("array<string>") for c in ("paths", "texts")} | {"main": F.lit(None).cast("string")})
    else:
        rows = rows.join(low.withColumnRenamed("host", "__low"), F.col("__host") == F.col("__low"), "left").select("page_id", "url", "html", "paths", "texts", "main")
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long").withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
