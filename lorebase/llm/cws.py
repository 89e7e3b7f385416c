"""Document fingerprints by consistent weighted sampling.

A text is a bag of words, each weighted by how often it occurs. For every word and every sample number the hash of both
gives two gamma variables r, c and a uniform one b, the same in every text. With t = floor(ln(weight) / r + b) the sample
is the pair (word, t) for which ln(c) - r * (t - b + 1) is least, and two texts have equal samples with a chance equal to
their generalised Jaccard similarity, sum of least over sum of greatest weights. A gamma variable is minus the logarithm of the
product of two uniform ones, of 32 bits each for c and 22 for r: the tails that decide a minimum over many words are whole.
A fingerprint is the list of hashed samples.

All on Spark's functions: words are counted and minima taken by hash aggregates over rows that already lie together by
document, so no word is shuffled.

Defined results: a null or empty text is one empty word; equal texts have equal fingerprints; an empty table gives no
rows. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.session import persist_table

SAMPLES = 64
_LOW = (1 << 24) - 1


def _uniform(h: Column, at: int, bits: int) -> Column:
    """The middle of one of 2**bits equal shares of (0, 1), by the bits of ``h`` from ``at`` on."""
    return (F.shiftrightunsigned(h, at).bitwiseAND((1 << bits) - 1).cast("double") + 0.5) * F.lit(2.0 ** -bits)


def _sample(word: Column, log_weight: Column, number: int) -> Column:
    """What is least for the sampled word: the sampling value above, 24 bits of (word, t) below."""
    h, g = F.xxhash64(word, F.lit(number)), F.xxhash64(word, F.lit(~number))
    log_c = F.log(-F.log(_uniform(h, 0, 32) * _uniform(h, 32, 32)))
    r = -F.log(_uniform(g, 0, 22) * _uniform(g, 22, 22))
    b = _uniform(g, 44, 20)
    t = F.when(log_weight > 0, F.floor(log_weight / r + b)).otherwise(F.lit(0).cast("long"))  # 0 for the many words that occur once
    value = ((log_c - r * (t - b + 1) + 96) * F.lit(2.0 ** 31)).cast("long")
    return F.shiftleft(value, 24).bitwiseOR(word.bitwiseXOR(t * 7919).bitwiseAND(_LOW))  # no bits that the value depends on


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``keys, samples``: an array of 24-bit integers per key; a key is one text.

    If ``rows`` lie together by one of the keys, nothing is shuffled.
    """
    words = rows.select(*keys, F.explode(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\n\r\t", "   "), " ")).alias("_word"))
    weights = words.select(*keys, F.xxhash64("_word").alias("_w")).groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_n"))
    weights = weights.select(*keys, "_w", F.log(F.col("_n").cast("double")).alias("_ln"))
    least = weights.groupBy(*keys).agg(*[F.min(_sample(F.col("_w"), F.col("_ln"), i)).alias(f"_s{i}") for i in range(samples)])
    return least.select(*keys, F.array(*[F.col(f"_s{i}").bitwiseAND(_LOW).cast("int") for i in range(samples)]).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_text(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """``k, doc_id, r, n, copies, last_k, last_r, last_half``: each document's place r in ascending id, and of the one before
    (before the first: the last) its key, place and half its length. Equal rows (id and text) are one document.
    """
    narrow = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.char_length("text").cast("long").alias("n"))
    narrow = narrow.groupBy("doc_id", "k", "n").agg(F.count(F.lit(1)).alias("copies"))
    at = F.monotonically_increasing_id()  # part << 33 | row in part; written before it is used
    placed = persist_table(narrow.repartitionByRange("doc_id", "k", "n").sortWithinPartitions("doc_id", "k", "n").withColumn("at", at), "order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))  # a row per task
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = persist_table(placed.join(parts, "part").select("doc_id", "k", "n", "copies", (F.col("_before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("r")), "ranks")
    total = max(1, ranked.count())
    last = ranked.select(F.col("k").alias("last_k"), F.col("r").alias("last_r"), F.floor(F.col("n") / 2).alias("last_half"), ((F.col("r") + 1) % total).alias("r"))
    return ranked.join(last, "r").select("k", "doc_id", "r", "n", "copies", "last_k", "last_r", "last_half")


def same(a: str, b: str) -> Column:
    """Equality that is no join key: rows stay dealt by ``k`` alone, and it tells apart what would share a hash."""
    return (F.col(a) <= F.col(b)) & (F.col(a) >= F.col(b))


def with_edited(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``k, r, text, edited``: the last half of the code points replaced by as many from the start of the next document."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k"))
    if places.where("copies > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "k"])
    rows = rows.withColumn("_n", F.char_length("text")).join(places.drop("doc_id"), "k").where(same("n", "_n")).select("k", "r", "text", "n", "last_k", "last_r", "last_half")
    heads = rows.select(F.col("last_k").alias("k"), F.col("last_r").alias("_r"), F.expr("substring(text, 1, cast(last_half as int))").alias("head"))
    both = rows.join(heads, "k").where(same("r", "_r"))
    edited = F.concat(F.expr("substring(text, 1, cast(n - floor(n / 2) as int))"), "head")
    return both.select("k", "r", "text", edited.alias("edited"))
