"""URL filtering: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Rules and listed URLs are entries: a host (with all its subdomains) and the beginning of a path. A page's URL can only
fit an entry that is one of its host's suffixes followed by one of its path's beginnings, of a length that some entry
has. These keys are looked up in the filter, 64-bit blocks with four bits a key, whose size is fixed; only keys that
it passes are joined with the entries, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = [
    # host, path, verdict
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
LISTED = ["http://spam-farm.example.org/", "http://cheap-pills.example.com/"]
FILTER_WORDS = 1 << 14
BITS_PER_KEY = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(rest, UPPER, LOWER), path


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS)).cast("int")


def _bits(key: Column) -> Column:
    """The key's bits within its block, from a second hash."""
    second = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftright(second, 6 * k).bitwiseAND(63)).cast("int")) for k in range(BITS_PER_KEY)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def rule_entries(rules: DataFrame) -> DataFrame:
    """Entries of a rule table (host, path, verdict); of equal rules with different verdicts, block counts."""
    host, path = F.translate("host", UPPER, LOWER), F.col("path")
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(host.alias("e_host"), path.alias("e_path"))
        .agg(F.max("verdict").alias("verdict"))
        .select("e_host", "e_path", F.concat("e_host", "e_path").alias("rule"), "verdict", F.lit(1).alias("rank"))
    )


def listed_entries(listed: DataFrame) -> DataFrame:
    """Entries of a table of listed URLs (url): canonical host and path, blocked unless a rule fits the page."""
    host, path = host_and_path(F.col("url"))
    return (
        listed.select(host.alias("e_host"), path.alias("e_path"))
        .where("e_host <> ''")
        .distinct()
        .select("e_host", "e_path", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("rank"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url; other columns are ignored).

    A rule fits its host and all subdomains if the path begins with the rule's; the longest wins, then the one with
    the longer host. Without a rule, a page is blocked if a listed URL fits in the same way, else allowed. A null
    url, or one without ``://``, has an empty host and path, no rule, and is allowed. Equal rows are judged once and
    all returned; a null page_id stays null.
    """
    key = F.concat_ws("\n", "e_host", "e_path")
    entries = rule_entries(rules).unionByName(listed_entries(listed)).withColumn("key", key)
    words = (
        entries.groupBy(_block(F.col("key")).alias("at"))
        .agg(F.bit_or(_bits(F.col("key"))).alias("word"))
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))
        .select(F.transform(F.sequence(F.lit(0), F.lit(FILTER_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))
    )
    lengths = entries.agg(F.sort_array(F.collect_set(F.length("e_path"))).alias("lengths"))
    host, path = host_and_path(F.col("url"))
    # Equal rows are counted first: hot URLs shrink before they are shuffled, and each is judged once.
    urls = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .groupBy("page_id", "host", "path")
        .agg(F.count("*").alias("copies"))
        .withColumns({"words": words.scalar(), "lengths": lengths.scalar()})
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    starts = F.transform(
        F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n)
    )
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat_ws("\n", h, p))))
    passed = F.filter(keys, lambda k: F.get("words", _block(k)).bitwiseAND(_bits(k)) == _bits(k))
    probed = urls.select("page_id", "host", "path", "copies", passed.alias("keys"))
    hits = probed.select("page_id", "host", "path", "copies", F.explode_outer("keys").alias("key"))
    order = F.struct("rank", F.length("rule").alias("size"), F.length("e_host").alias("host_size"), "rule", "verdict")
    judged = (
        hits.join(entries, "key", "left")
        .groupBy("page_id", "host", "path")
        .agg(F.max("copies").alias("copies"), F.max(F.when(F.col("verdict").isNotNull(), order)).alias("best"))
    )
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")


OP2_SQL = r"""
WITH rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), listed(h, p) AS (
  VALUES ('spam-farm.example.org', '/'), ('cheap-pills.example.com', '/')
), u AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), best AS (
  SELECT n, arg_max(struct_pack(r := h || p, v := v), len(h || p) * 1000 + len(h)) AS b FROM u JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
), bad AS (
  SELECT DISTINCT n FROM u JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, b.r AS rule,
  coalesce(b.v, CASE WHEN bad.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (n) LEFT JOIN bad USING (n)
"""
