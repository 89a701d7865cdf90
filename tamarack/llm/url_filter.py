"""Operator 8: URL filter with a blocked Bloom filter before an exact join, in DataFrame operations only.

A rule is (action, host, path): it fits its host and all subdomains where the URL's path starts with
the rule's; the longest rule wins (of equal lengths the longer host, then block).  A URL's candidate
keys are its host's endings with as many labels as rules have, times its path's beginnings with the
lengths that rules' paths have.  The keys of all rules sit in a Bloom filter whose blocks are four
longs, one bit set in each; a candidate reads the one block that its hash names.  What passes joins
the rules on host and path, which takes away the false positives.  A rule that fits is fully given
by the two lengths, so the best one comes out of a maximum over longs, by page: that is the only shuffle, of
each page's host and path once.

Cases: a null URL, or one without "://", has an empty host and path and fits no rule; without a rule
the method's verdict is allow, as the URL isn't listed; repeated rules count once; repeated pages are
judged each; very long URLs only cost their length (candidates are as many as rules' labels and lengths);
other columns are never read, whatever their names; both tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import store

#: The rules of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
WORDS, RULES_A_BLOCK = 4, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    quoted = [", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) for r in rules]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({q})" for q in quoted) + " AS t(action, host, path)")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    after = F.regexp_extract(rest, r"^[^/?#]*((?s:.*))$", 1)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^([^?#]*)", 1)).otherwise("")


def _bit(hash_: Column, word: int) -> Column:
    """The bit of a block's word that a key sets: six bits of its second hash, as a mask."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hash_, 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def _block(hash_: Column, blocks: int) -> Column:
    return F.pmod(hash_, F.lit(blocks))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    own = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path").alias("path"), F.col("action")).filter("host is not null and path is not null and action is not null")
    own = own.groupBy("host", "path").agg(F.max((F.col("action") == "block").cast("int")).alias("blocks"))
    shape = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths"), F.max(F.length("host") + F.length("path")).alias("longest")).first()
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).na.fill("", ["host", "path"])
    if not shape["n"]:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    blocks = -(-shape["n"] // RULES_A_BLOCK)
    row = shape["longest"] * 2 + 64
    h1 = lambda h, p: F.xxhash64(h, p)
    h2 = lambda h, p: F.xxhash64(p, h, F.lit(1))
    keyed = own.select(_block(h1(F.col("host"), F.col("path")), blocks).alias("block"), *[_bit(h2(F.col("host"), F.col("path")), k).alias(f"w{k}") for k in range(WORDS)])
    bloom = store.broadcast_if_small(keyed.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]), blocks, 8 * (WORDS + 1))

    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in shape["lengths"]]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(endings, lambda h: F.transform(starts, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    numbered = split.withColumn("_rid", F.monotonically_increasing_id())
    asked = numbered.select("_rid", "page_id", "host", "path", F.posexplode_outer(keys).alias("pos", "key")).select("*", F.col("key.h").alias("h"), F.col("key.p").alias("p")).drop("key")
    asked = asked.withColumn("block", _block(h1(F.col("h"), F.col("p")), blocks)).withColumn("bits", h2(F.col("h"), F.col("p")))
    passes = F.col("h").isNotNull()
    for k in range(WORDS):
        passes = passes & (F.coalesce(F.col(f"w{k}"), F.lit(0).cast("long")).bitwiseAND(_bit(F.col("bits"), k)) != 0)
    hits = asked.join(bloom, "block", "left").withColumn("hit", passes).filter(F.col("hit") | F.coalesce(F.col("pos") == 0, F.lit(True)))
    hits = hits.select("_rid", "page_id", "host", "path", F.when(F.col("hit"), F.col("h")).alias("h"), F.when(F.col("hit"), F.col("p")).alias("p"))
    listed = store.broadcast_if_small(own.select(F.col("host").alias("h"), F.col("path").alias("p"), "blocks"), shape["n"], row)
    code = (((F.length("h") + F.length("p")).cast("long") * (1 << 24) + F.length("h")) * 2) + F.col("blocks")
    best = hits.join(listed, ["h", "p"], "left").groupBy("_rid", "page_id", "host", "path").agg(F.max(F.when(F.col("blocks").isNotNull(), code)).alias("code"))
    in_host = F.floor(F.col("code") / 2).cast("long") % (1 << 24)
    in_path = F.floor(F.col("code") / (1 << 25)).cast("long") - in_host
    rule = F.concat(F.substring(F.col("host"), (F.length("host") - in_host + 1).cast("int"), in_host.cast("int")), F.substring(F.col("path"), F.lit(1), in_path.cast("int")))
    return best.select("page_id", "host", "path", F.when(F.col("code").isNotNull(), rule).alias("rule"), F.when(F.col("code") % 2 == 1, "block").otherwise("allow").alias("verdict"))


def rules_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for ``judge`` over the table pages."""
    quoted = [", ".join("'" + x.replace("'", "''") + "'" for x in r) for r in rules]
    return f"""
        WITH r(action, rhost, rpath) AS (VALUES {", ".join(f"({q})" for q in quoted)}),
        u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM u),
        best AS (SELECT p.*, action, rhost || rpath AS rule, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC, action DESC) AS k
                 FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM best WHERE k = 1"""
