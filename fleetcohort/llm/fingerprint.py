"""Document fingerprints: bottom-k sketches of word-shingle hashes, built-in functions only.

A sketch is the sorted array of the k least distinct 64-bit hashes of a text's shingles. The
sketch of a union is the bottom k of the sketches' union, so parts of a document, or of a
group of documents, merge. Sketches estimate resemblance, containment and the number of
distinct shingles, and are exact where a text has fewer than k of them.

Words are what ASCII white space separates, A-Z in lower case. A text with fewer words than a
shingle gives one shingle of all its words; null, empty and blank texts give an empty sketch,
whose fingerprint is the empty string. Two empty sketches resemble each other fully, an empty
and another one not at all. Repeated rows stay, one row each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcohort.llm.common import keyed_text

SIZE, WORDS = 256, 5
#: Documents of one bucket of the key order, and buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 512, 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = float(1 << 64)


def _hashes(words: Column, width: int) -> Column:
    """Hash of each run of ``width`` words; of all words where there are fewer."""
    n = F.size(words)
    runs = F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(width))),
    )
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    none = F.array().cast("array<bigint>")
    return F.when(n >= width, runs).when(n > 0, whole).otherwise(none)


def with_sketch(
    df: DataFrame, text: str, name: str, size: int = SIZE, width: int = WORDS
) -> DataFrame:
    """Adds the sketch of the text column; ``name`` and two derived names must be free.

    Long texts first drop the hashes that cannot be among the least, by a cut about three
    times as high as needed; where that leaves too few, all hashes are sorted.
    """
    words, hashes = f"{name}_words", f"{name}_hashes"
    split = F.split(F.translate(F.col(text), _UPPER, _LOWER), "[ \t-\r]+")
    df = df.withColumn(words, F.filter(split, lambda w: w != ""))
    df = df.withColumn(hashes, _hashes(F.col(words), width)).drop(words)
    n = F.size(hashes)
    cut = (F.lit(-_SPAN / 2) + F.lit(_SPAN * 3 * size) / n).cast("bigint")
    low = F.array_distinct(F.filter(F.col(hashes), lambda h: h <= cut))
    df = df.withColumn(
        name, F.when(n > 4 * size, low).otherwise(F.array_distinct(F.col(hashes)))
    )
    least = F.when(
        (n > 4 * size) & (F.size(name) < size), F.array_distinct(F.col(hashes))
    ).otherwise(F.col(name))
    return df.withColumn(name, F.slice(F.sort_array(least), 1, size)).drop(hashes)


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    union = merged(a, b, size)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) > 0, both / F.size(union)).otherwise(1.0)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the first one's shingles that the second one has, 0 to 1."""
    union = merged(a, b, size)
    own = F.array_intersect(union, a)
    both = F.size(F.array_intersect(own, b))
    return F.when(F.size(own) > 0, both / F.size(own)).otherwise(1.0)


def distinct_shingles(sketch: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``size``."""
    reach = (F.element_at(sketch, -1).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise(
        (size - 1) / reach
    )


def merge_groups(
    parts: DataFrame, group: list[str], sketch: str = "sketch", size: int = SIZE
) -> DataFrame:
    """One sketch per group of parts: ``group`` and ``sketch``.

    Hashes are made distinct and cut to the least ``size`` on each side of the shuffle, so a
    group of any number of parts sends no more than that from a task.
    """
    hashes = parts.select(*group, F.explode(sketch).alias("_hash")).distinct()
    order = Window.partitionBy(*group).orderBy("_hash")
    least = hashes.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= size)
    return least.groupBy(*group).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def in_key_order(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``bucket``, and per bucket ``follower``: the text after its last row.

    ``rows`` has ``key`` and ``text``. The keys' order is cut at approximate quantiles, so no
    task holds the whole order; the text after a bucket's end comes from one row per bucket.
    Rows with null keys stand in a bucket range of their own and follow nothing.
    """
    keys = rows.where(F.col("key").isNotNull())
    count = keys.count()
    parts = max(1, min(MAX_BUCKETS, -(-count // BUCKET_ROWS)))
    steps = [i / parts for i in range(1, parts)]
    cuts: list[int] = []
    if steps:
        found = keys.select(F.percentile_approx("key", steps, 20 * parts).alias("cuts"))
        cuts = sorted(set(found.first()["cuts"]))
    bucketed = rows.withColumn("bucket", _bucket(F.col("key"), cuts))
    firsts = (
        bucketed.where(F.col("key").isNotNull())
        .groupBy("bucket").agg(F.min("key").alias("key"))
    )
    texts = (
        bucketed.join(F.broadcast(firsts), ["bucket", "key"])  # MAX_BUCKETS rows at most
        .groupBy("bucket").agg(F.min("text").alias("first_text"))
    )
    order = Window.orderBy("bucket")
    lead = F.lead("first_text").over(order)
    around = F.first("first_text").over(order.rowsBetween(Window.unboundedPreceding, 0))
    seams = texts.select("bucket", F.coalesce(lead, around).alias("follower"))
    return bucketed, seams


def _bucket(key: Column, cuts: list[int], step: int = 64) -> Column:
    """Number of cuts at or below the key; null keys spread over negative buckets by row."""
    if not cuts:
        found = F.lit(0)
    else:
        def constant(numbers: list[int]) -> Column:
            return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")

        coarse = F.size(F.filter(constant(cuts[step - 1 :: step] or [1 << 62]), lambda c: c <= key))
        fine = F.slice(constant(cuts), coarse * step + 1, step)
        found = coarse * step + F.size(F.filter(fine, lambda c: c <= key))
    nulls = -1 - F.pmod(F.xxhash64("text"), F.lit(MAX_BUCKETS)).cast("int")
    return F.when(key.isNull(), nulls).otherwise(found)


def half_edited(text: Column, other: Column) -> Column:
    """The text with its last half (rounded down, in code points) replaced by the first as
    many code points of the other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def compare_with_next(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, width: int = WORDS
) -> DataFrame:
    """Per row: key, n_chars, edited_text, sketch, edited_sketch, near_edited, near_next.

    Each text is compared with its half-edited version and with the next document in
    ascending key order (after the last: the first; equal keys: by text). A row with a null
    key has the empty text as its next one.
    """
    rows, seams = in_key_order(keyed_text(docs, key, text))
    # Texts move before sketches are made: a sketch may be as large as its text.
    sketched = with_sketch(rows.repartition("bucket"), "text", "sketch", size, width)
    seams = with_sketch(seams, "follower", "follower_sketch", size, width)
    order = Window.partitionBy("bucket").orderBy("key", "text")
    inside = F.lead(F.struct("text", "sketch")).over(order)
    ahead = sketched.withColumn("ahead", inside).join(seams, "bucket", "left")
    real = F.col("key").isNotNull()
    none = F.array().cast("array<bigint>")
    nearby = ahead.select(
        "key",
        "text",
        "sketch",
        F.when(~real, F.lit(""))
        .otherwise(F.coalesce(F.col("ahead.text"), F.col("follower"), F.lit("")))
        .alias("next_text"),
        F.when(~real, none)
        .otherwise(F.coalesce(F.col("ahead.sketch"), F.col("follower_sketch"), none))
        .alias("next_sketch"),
    )
    edited = nearby.withColumn("edited_text", half_edited(F.col("text"), F.col("next_text")))
    edited = with_sketch(edited.drop("next_text"), "edited_text", "edited_sketch", size, width)
    return edited.select(
        F.col("key").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        "edited_text",
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), size).alias("near_next"),
    )
