"""URL filter: prefix rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join.

The filter is a table of blocks of 512 bits in eight words; a URL's hash names its block, and eight further hashes one bit
in each word. URLs that pass it are joined by value with the list, which removes false positives.

Defined results: a null URL, or one without ``://``, has empty host, path and canonical form, fits no rule and is
never listed; an empty list allows everything; URLs of any length are read whole; repeated rows each get their verdict; an empty table gives an empty result; further columns stay, but a result replaces a column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm._columns import guarded
from riskweave.session import stage

#: Blocks up to which the filter (80 bytes a block) is broadcast; beyond, it is joined by block. Listed URLs, and bytes of them, up to which the list is too; beyond, it is
#: joined by shuffling, and only what the filter lets pass is shuffled.
BROADCAST_BLOCKS = 1_000_000
BROADCAST_URLS = 200_000
BROADCAST_BYTES = 32 << 20
BITS_PER_URL = 16
#: Query parameters that name no page.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without last slashes, other than tracking parameters in order; no scheme, no fragment."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.substring_index(x, "=", 1).isin(TRACKING)))
    base = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def longest_rule(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest (verdict, host, path) rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bit(url: Column, word: int) -> Column:
    return F.xxhash64(url, F.lit(word)).bitwiseAND(F.lit(63)).cast("int")


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def bloom(listed: DataFrame, n_blocks: int, url: str = "canonical") -> DataFrame:
    """The filter's blocks that have bits: _block and the words _w0 to _w7."""
    words = [_one(_bit(F.col(url), i)).alias(f"_w{i}") for i in range(8)]
    bits = listed.select(_block(F.col(url), n_blocks).alias("_block"), *words)
    return bits.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(8)])


def flag_listed(df: DataFrame, listed: DataFrame, key: str = "canonical") -> DataFrame:
    """df with ``maybe`` (the filter lets the key pass) and ``listed`` (the key is in the list, exactly)."""
    urls = stage(listed.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct(), "url-list")
    n_urls, n_bytes = urls.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(key)), F.lit(0))).first()
    n_blocks = max(1, -(-n_urls * BITS_PER_URL // 512))
    blocks = bloom(urls, n_blocks, key)
    probed = df.withColumn("_block", _block(F.col(key), n_blocks)).join(F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks, "_block", "left")
    hit = F.lit(True)
    for i in range(8):
        hit &= F.call_function("shiftrightunsigned", F.col(f"_w{i}"), _bit(F.col(key), i)).bitwiseAND(F.lit(1)) == 1
    probed = probed.withColumn("maybe", F.coalesce(hit, F.lit(False))).select(*df.columns, "maybe")
    if n_urls <= BROADCAST_URLS and n_bytes <= BROADCAST_BYTES:  # one pass: the key that meets the list is null where the filter says no
        known = F.broadcast(urls.select(F.col(key).alias("_key")))
        met = probed.join(known, F.when(F.col("maybe"), F.col(key)) == F.col("_key"), "left")
        return met.withColumn("listed", F.col("_key").isNotNull()).drop("_key")
    passed = probed.where("maybe").join(urls.withColumn("listed", F.lit(True)), key, "left").select(*df.columns, "maybe", F.coalesce("listed", F.lit(False)).alias("listed"))
    return probed.where("NOT maybe").withColumn("listed", F.lit(False)).unionByName(passed)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, canonical, rule, maybe, listed and verdict: the longest rule's, else block if listed."""
    work, restore = guarded(pages, {"_url": url})
    parts = work.withColumn("host", host(F.col("_url"))).withColumn("path", path(F.col("_url"))).withColumn("canonical", canonical(F.col("_url")))
    flagged = flag_listed(parts, listed)
    found = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    judged = flagged.withColumn("_found", found).withColumn("rule", F.col("_found.rule")).withColumn("verdict", F.coalesce(F.col("_found.verdict"), method))
    return restore(judged, ["host", "path", "canonical", "rule", "maybe", "listed", "verdict"])


def canonical_on_hosts(pages: DataFrame, labels: list[str], url: str = "url") -> DataFrame:
    """A URL list: canonical forms of the pages on hosts with one of the labels."""
    hosts = F.split(host(F.col(url)), r"\.")
    return pages.where(F.arrays_overlap(hosts, F.array(*map(F.lit, labels)))).select(canonical(F.col(url)).alias("canonical"))


# fixed values of the registered query
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','ref','fbclid','gclid'], split_part(x, '=', 1)))) AS kept FROM a),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM b),
l AS (SELECT DISTINCT canonical AS listed FROM c WHERE canonical <> '' AND
  list_has_any(string_split(host, '.'), ['adult-x','ads-track','casino-win','cheap-pills','free-bets','spam-farm'])),
f AS (SELECT c.*, l.listed IS NOT NULL AS listed, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM c LEFT JOIN l ON c.canonical = l.listed)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM f
"""
