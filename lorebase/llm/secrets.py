"""Secret scans with corpus-wide ownership frequency.

Texts are scanned by patterns for assigned secrets, access keys and hexadecimal keys, and for tokens that mix letters and
digits. The hash of every candidate value is counted over the whole corpus by distinct repositories and owners: what many
owners have is an example that was copied around, what one owner has looks live. A token without a telling pattern counts
as a secret only if it is live: it repeats a value that a pattern found, or looks random, and no more than ``live_owners``
have it. All on Spark's functions; only rows with a candidate, and of these only values and places, are shuffled.

Places are code points, ends exclusive. Candidates of one kind don't overlap and are found from the left.

Defined results: a null or empty text has no spans; a null owner or repository counts as one of its own; repeated rows get
equal spans; an empty table gives no rows. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.session import persist_table

# The base patterns, and the least length of what counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: a token: a run of these that is long enough and has a letter and a digit
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
KINDS = ("assign", "access", "hex", "token")
LIVE_OWNERS, EXAMPLE_OWNERS = 1, 3
#: a token of at least this length with lower case, upper case and digits looks random
RANDOM_LENGTH = 20
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
_RUN = 256


def _before(sizes: Column) -> Column:
    """For each of the sizes the sum of those before it; folds run over blocks, so that many sizes stay cheap."""
    def running(values, start):
        first = F.struct(F.array().cast("array<bigint>").alias("a"), start.alias("t"))
        return F.aggregate(values, first, lambda s, x: F.struct(F.concat(s["a"], F.array(s["t"])).alias("a"), (s["t"] + x).alias("t")))["a"]

    zero = F.lit(0).cast("bigint")
    blocks = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.greatest(F.size(sizes), F.lit(1)) - 1) / _RUN)),
                         lambda b: F.slice(sizes, (b * _RUN + 1).cast("int"), F.lit(_RUN)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, running(sums, zero), running))


def _spans(df: DataFrame, kind: str, pattern: str, clue: Column, group: int = 0) -> DataFrame:
    """Adds the matches of ``pattern`` as column ``kind``; where ``clue`` is false the pattern isn't tried."""
    none = F.array().cast("array<string>")
    df = df.withColumn("_hit", F.when(clue, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(none))
    df = df.withColumn("_gap", F.when(F.size("_hit") > 0, F.transform(F.split("text", pattern, -1), lambda x: F.char_length(x).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_own", F.when(F.size("_hit") > 0, F.regexp_extract_all("text", F.lit(pattern), group)).otherwise(none)) if group else df.withColumn("_own", F.col("_hit"))
    df = df.withColumn("_start", F.when(F.size("_hit") > 0, _before(F.zip_with("_gap", "_hit", lambda g, h: g + F.coalesce(F.char_length(h), F.lit(0))))))
    found = F.transform(F.arrays_zip("_hit", "_own", F.expr("slice(_gap, 1, size(_hit))").alias("_gap"), F.expr("slice(_start, 1, size(_hit))").alias("_start")), lambda x: F.struct(
        F.lit(kind).alias("kind"), (x["_start"] + x["_gap"]).alias("start"), (x["_start"] + x["_gap"] + F.char_length(x["_hit"])).alias("end"), x["_own"].alias("value")))
    return df.withColumn(kind, F.when(F.size("_hit") > 0, found).otherwise(F.array().cast(SPAN))).drop("_hit", "_gap", "_own", "_start")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source") -> DataFrame:
    """``doc_id, digest, repository, owner, base, tokens``: what the patterns find in each row, ``digest`` of its text."""
    df = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                     F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    df = _spans(df, "assign", ASSIGN, F.col("text").rlike(r"(?i:passw|secret|token|api_?key)"), 2)
    df = _spans(df, "access", ACCESS, F.contains("text", F.lit("AKIA")))
    df = _spans(df, "hex", r"[0-9a-f]{24,}", F.col("text").rlike(r"[0-9a-f]{24}"))  # runs shorter than 24 fail anyway
    df = _spans(df, "token", TOKEN, F.col("text").rlike(r"[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]"))
    base = F.concat(*[_at_least(k, n) for k, n in {"assign": 6, "access": 20, "hex": 24}.items()])
    df = df.withColumn("base", F.when(F.size("assign") + F.size("access") + F.size("hex") > 0, base).otherwise(F.array().cast(SPAN)))
    tokens = F.filter("token", lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    df = df.withColumn("tokens", F.when(F.size("token") > 0, tokens).otherwise(F.array().cast(SPAN)))
    return df.select("doc_id", F.xxhash64("text").alias("digest"), "repository", "owner", "base", "tokens")


def _at_least(kind: str, length: int) -> Column:
    return F.filter(kind, lambda x: F.char_length(x["value"]) >= length)


def ownership(found: DataFrame) -> DataFrame:
    """``secret, repositories, owners, telling``: for each value's hash how many have it and whether a pattern found it."""
    spans = found.select("repository", "owner", F.explode(F.concat("base", "tokens")).alias("x"))
    each = spans.groupBy(F.sha2("x.value", 256).alias("secret"), "repository", "owner").agg(F.max(F.col("x.kind") != "token").alias("telling"))
    return each.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("telling").alias("telling")).groupBy("secret").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"), F.max("telling").alias("telling"))


def _looks_random(value: Column) -> Column:
    return (F.char_length(value) >= RANDOM_LENGTH) & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "source", owner: str = "source",
         live_owners: int = LIVE_OWNERS, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``doc_id, digest, spans`` of every row: spans ``kind, start, end, value, owners, repositories, verdict`` in order.

    ``verdict`` is live, shared or example. Base spans always stay; tokens are there only if they are live secrets.
    """
    found = persist_table(candidates(docs, key, text, repository, owner), "secrets")
    with_any = found.where("size(base) + size(tokens) > 0").select("doc_id", "digest", "base", "tokens").dropDuplicates(["doc_id", "digest"])
    spans = with_any.select("doc_id", "digest", F.explode(F.concat("base", "tokens")).alias("x")).select("doc_id", "digest", "x.*", F.sha2("x.value", 256).alias("secret"))
    verdict = F.when(F.col("owners") <= live_owners, "live").when(F.col("owners") >= example_owners, "example").otherwise("shared")
    judged = spans.join(ownership(found), "secret").withColumn("verdict", verdict)
    judged = judged.where((F.col("kind") != "token") | (F.col("verdict") == "live") & (F.col("telling") | _looks_random(F.col("value"))))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    whole = F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "value", "owners", "repositories", "verdict")))
    by_row = judged.groupBy(F.col("doc_id").alias("_d"), F.col("digest").alias("_g")).agg(whole.alias("_s"))
    rows = found.select("doc_id", "digest")
    joined = rows.join(by_row, rows["doc_id"].eqNullSafe(by_row["_d"]) & (rows["digest"] == by_row["_g"]), "left")
    kept = F.transform("_s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"),
                                                x["owners"].alias("owners"), x["repositories"].alias("repositories"), x["verdict"].alias("verdict")))
    return joined.select("doc_id", "digest", F.coalesce(kept, F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,owners:bigint,repositories:bigint,verdict:string>>")).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with the spans (in order; they may overlap) replaced."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    done = F.aggregate(spans, first, lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(
        F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(text.substr((s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask))).otherwise(F.lit(""))).alias("out"),
        x["end"].alias("at"))))
    return F.concat(done["out"], text.substr((done["at"] + 1).cast("int"), F.char_length(text)))
