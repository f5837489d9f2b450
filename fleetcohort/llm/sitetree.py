"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is an element path with its classes, and
the tree counts on how many pages a node stands, in which presentation styles (the inline
elements of its blocks) and with which contents. A node's importance is

    (1 - g^l) * presentation + g^l * content,   g = 0.9, l = number of its styles,

where presentation is the entropy of its styles and content is one minus the mean entropy of
its texts over the pages, both to the base of the number of pages. A text that stands on every
page has entropy one, a node that only holds such texts importance zero. Branches below
``LEAST`` are removed from each page.

A host with few pages tells little, so nodes on fewer than ``PAGES`` pages stay. Elements that
HTML marks as menus, headers, footers or sidebars, or that are hidden, have no importance on any
host; nor have forms and elements whose whole class or id names such a part, a notice, an advert
or comments, unless the branch holds an article, a main part or most of the page's text, or the
page has no text besides; a branch of reader comments goes however much it holds, also articles
of its own. The plain paragraphs, headings, lists and tables of an
article are never removed, however often a text is copied over the pages of a host; a page
whose text would vanish keeps it.

Pages are counted per (host, node, text) before anything meets, so a host with very many pages
is never in one task. Null and empty pages give an empty text. A null url counts as a host of
its own name "". Null keys and repeated rows stay, one row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcohort.llm.common import pieces, small_batches, stage
from fleetcohort.llm.html_blocks import blocks, is_plain_article

LEAST, PAGES, DAMPING = 0.2, 8, 0.9

#: Low nodes up to which they are broadcast (host and path of each), beyond that joined by host.
BROADCAST_NODES = 20_000

_BLOCK = pa.struct(
    [("path", pa.string()), ("style", pa.string()), ("text", pa.int64())]
)
_BLOCK_DDL = "array<struct<path:string,style:string,text:bigint>>"


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://([^/:?#]*)", 1))


def merged(pages: DataFrame, url: str, html: str) -> DataFrame:
    """row, host and blocks of each page, texts as hashes: what the trees are made of. A
    written table, much smaller than the pages."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        _host(F.col(f"`{url}`")).alias("host"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = [
                [{"path": p, "style": s, "text": _hash(t)} for p, s, _, t in blocks(page)]
                for page in batch.column("html").to_pylist()
            ]
            kept = batch.select(["row", "host"])
            yield kept.append_column("blocks", pa.array(found, type=pa.list_(_BLOCK)))

    return stage(rows.mapInArrow(run, f"row long, host string, blocks {_BLOCK_DDL}"), "pages-merged")


def _hash(text: str) -> int:
    digest = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _entropy_share(n: Column, pages: Column) -> Column:
    """Entropy of something that stands once on each of ``n`` of ``pages``, base ``pages``."""
    return F.when(pages > 1, F.log(n.cast("double")) / F.log(pages.cast("double"))).otherwise(0.0)


def site_tree(read: DataFrame) -> DataFrame:
    """host, path, pages, styles, presentation, content, importance of each node."""
    each = read.select("row", "host", F.explode("blocks").alias("b"))
    nodes = each.select("row", "host", "b.path").distinct()
    pages = nodes.groupBy("host", "path").agg(F.count("row").alias("pages"))

    contents = each.select("row", "host", "b.path", "b.text").distinct()
    counts = contents.groupBy("host", "path", "text").agg(F.count("row").alias("n"))
    content = (
        counts.join(pages, ["host", "path"])
        .groupBy("host", "path", "pages")
        .agg((1 - F.avg(_entropy_share(F.col("n"), F.col("pages")))).alias("content"))
    )
    styles = each.select("row", "host", "b.path", "b.style").distinct()
    weights = styles.groupBy("host", "path", "style").agg(F.count("row").alias("n"))
    p = F.col("n") / F.col("total")
    totals = weights.groupBy("host", "path").agg(F.sum("n").alias("total"))
    shown = (
        weights.join(totals, ["host", "path"])
        .groupBy("host", "path")
        .agg(F.count("n").alias("styles"), (-F.sum(p * F.log(p))).alias("entropy"))
    )
    base = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    damp = F.pow(F.lit(DAMPING), F.col("styles"))
    single = F.col("pages") == 1
    return (
        content.join(shown, ["host", "path"])
        .withColumn("presentation", F.when(single, 1.0).otherwise(F.col("entropy") / base))
        .withColumn("importance", (1 - damp) * F.col("presentation") + damp * F.col("content"))
        .drop("entropy")
    )


def main_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Per row: key, url, ``text``: the blocks of the main text joined by line feeds.

    Pages are read twice, for the trees and for the texts, so that no text is moved or kept.
    """
    small_batches(pages.sparkSession)
    tree = site_tree(merged(pages, url, html))
    low = tree.where((F.col("importance") < LEAST) & (F.col("pages") >= PAGES))
    low = stage(low.select("host", "path"), "pages-low")
    by_host = low.groupBy("host").agg(F.collect_set("path").alias("cut"))
    if low.count() <= BROADCAST_NODES:
        by_host = F.broadcast(by_host)
    rows = pages.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{url}`").alias("url"),
        _host(F.col(f"`{url}`")).alias("host"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"),
    ).join(by_host, "host", "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = []
            cuts = batch.column("cut").to_pylist()
            for page, cut in zip(batch.column("html").to_pylist(), cuts, strict=True):
                whole = [(p, t) for p, _, noise, t in blocks(page) if not noise]
                gone = set(cut or ())
                left = [t for p, t in whole if p not in gone or is_plain_article(p)]
                texts.append("\n".join(left or [t for _, t in whole]))
            kept = batch.select(["key", "url"])
            yield kept.append_column("text", pa.array(texts, type=pa.string()))

    out = rows.mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text")
