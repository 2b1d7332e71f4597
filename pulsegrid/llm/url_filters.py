"""URL rules, and a list of URLs looked up through a blocked Bloom filter.

Everything is built-in column functions. The filter is a table of blocks: a listed URL's hash names one block of 64
bits and sets `probes` bits in it. A page looks at its one block; only possible hits go on to the exact join with the
list, which removes the false positives.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower, table
from pulsegrid.sources.stage import materialise


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

TRACKING = r"(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    """Between the first "://" and the next "/", "?", "#" or the end, A-Z lower-cased. Empty for null or without "://"."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to "?", "#" or the end. Empty for null or without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without "www.", path without its last "/" and ".html", sorted query without tracking keys. No scheme, no fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.array_sort(F.filter(F.split(F.regexp_replace(query, TRACKING, ""), "&"), lambda x: x != ""))
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"(?:/|\.html)$", ""),
                    F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.concat_ws("&", keys))).otherwise(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """Name or verdict of the longest rule that fits; ties go to the rule named first. Null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r.name))
    picks = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, what))) for r in ordered]
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


BLOCKS_TO_SEND = 1 << 21
"""Blocks of a filter that is broadcast: at most 32 MB of longs."""


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, probes: int) -> Column:
    """The bits of a key: slices of six bits of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return reduce(Column.bitwiseOR, [F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(probes)])


def bloom_blocks(listed: DataFrame, key: str, blocks: int, probes: int) -> DataFrame:
    """(block, bits): one row for each block that some key falls into."""
    k = F.col(key)
    return listed.groupBy(_block(k, blocks).alias("block")).agg(F.bit_or(_mask(k, probes)).alias("bits"))


def url_filter(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, *, page_id: str = "page_id", url: str = "url",
               listed_url: str = "url", keys_per_block: int = 4, probes: int = 4, blocks_to_send: int = BLOCKS_TO_SEND) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of `pages`.

    The longest rule that fits gives the verdict; else a page whose canonical URL is in `listed` is blocked, the others
    are allowed. Null or odd URLs have an empty host and path, fit no rule, and are never listed. Repeated rows are
    judged each. Other columns are not read. An empty list lists nothing.

    The list and the filter are written before they are joined, so Spark knows their sizes. A filter of up to `blocks_to_send`
    blocks (16 bytes each) is broadcast, a larger one is shuffled. Only pages that the filter lets through meet the list; the
    others, nearly all, are never shuffled for it. The number of blocks follows from the list's length.
    """
    keys = listed.select(canonical(F.col(listed_url)).alias("key"), host_of(F.col(listed_url)).alias("h")).where("h <> ''").select("key").distinct()
    keys = materialise(keys, "listed-urls")
    blocks = max(1, keys.count() // keys_per_block)
    bloom = materialise(bloom_blocks(keys, "key", blocks, probes), "url-bloom")
    if blocks <= blocks_to_send:
        bloom = F.broadcast(bloom)
    u = F.col("_u")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_u")).select(
        "page_id", host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("_key"))
    rows = rows.withColumn("_block", _block(F.col("_key"), blocks)).join(bloom.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")), "_block", "left")
    mask = _mask(F.col("_key"), probes)
    maybe = F.coalesce((F.col("_bits").bitwiseAND(mask) == mask) & (F.col("host") != ""), F.lit(False))
    rows = rows.select("page_id", "host", "path", "_key", maybe.alias("_maybe"))
    met = rows.where("_maybe").join(keys.select(F.col("key").alias("_key"), F.lit(True).alias("_hit")), "_key", "left")
    hits = met.select("page_id", "host", "path", "_hit").unionByName(
        rows.where("not _maybe").select("page_id", "host", "path", F.lit(None).cast("boolean").alias("_hit")))
    host, path, hit = F.col("host"), F.col("path"), F.coalesce(F.col("_hit"), F.lit(False))
    return hits.select("page_id", "host", "path", rule_of(host, path, rules, "name").alias("rule"),
                       F.coalesce(rule_of(host, path, rules, "verdict"), F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("listed"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every page against the rules and a list: the URLs of the pages whose id is a multiple of 100."""
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages, pages.where(F.col("page_id") % 100 == 0))


SQL = r"""
with urls as (
  select page_id, url,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path,
         list_sort(list_filter(string_split(regexp_replace(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), ''),
           '(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '&'), lambda x: x <> '')) as kv
  from pages),
keyed as (
  select page_id, host, path,
         regexp_replace(host, '^www\.', '') || regexp_replace(path, '(?:/|\.html)$', '')
           || case when len(kv) > 0 then '?' || array_to_string(kv, '&') else '' end as key
  from urls),
listed as (select distinct key from keyed where page_id % 100 = 0 and host <> ''),
fits as (
  select k.*, l.key is not null as listed,
         (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') as net,
         (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') as net_en,
         (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') as com_de,
         (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') as org_fr
  from keyed k left join listed l on k.key = l.key and k.host <> '')
select page_id, host, path,
       case when net_en then 'example.net/en/' when com_de then 'example.com/de/' when org_fr then 'org/fr/' when net then 'net/' end as rule,
       case when net_en then 'allow' when com_de then 'block' when org_fr then 'allow' when net then 'block'
            when listed then 'block' else 'allow' end as verdict,
       listed
from fits
"""
