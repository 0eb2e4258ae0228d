"""URL filters: rules by host and path first, then a list of URLs by a blocked Bloom filter and an exact join.

The list is kept as canonical URLs. A blocked Bloom filter of them (blocks of eight 64-bit words, one bit of each
word for a URL) is a table with one row a block; a page meets its one block in a broadcast join, and only pages that
find all eight bits set go to the exact join on the canonical URL, which removes false positives. All of it is built-in
functions and joins.

Odd cases: a null URL, or one without ``://``, has an empty host and path, meets no rule, is on no list and is allowed.
Empty and very long URLs are ordinary text. Pages may repeat; every row is judged by itself. Rules that tie (the same
host and path twice) block. Null or host-less URLs of the list are left out, repeated ones count once, and an empty
list blocks nothing. Columns of the pages that are named like an output column (``host``, ``path``, ``rule``,
``verdict``) give way to it.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landstrata.llm.common import written

WORDS = 8
#: URLs that share a block of 512 bits: about 6 of 10,000 URLs that are not listed pass.
URLS_PER_BLOCK = 32
#: The filter has at most so many blocks (about 100 bytes each where it is broadcast); longer lists let more pages pass to the exact join.
MOST_BLOCKS = 1 << 18
MOST_RULES = 10_000
OUT = ("host", "path", "rule", "verdict")
# Parameters that name a campaign, not a page.
TRACKING = "^(utm_[^=]*|gclid|fbclid|ref)(=|$)"


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lower(c: Column) -> Column:
    """A to Z in lower case, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column | str) -> Column:
    """What follows the first ``://``; empty without one."""
    url = _text(url)
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column | str) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case."""
    return _lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column | str) -> Column:
    """One form for the URLs of a page: no scheme, ``www.``, default port, trailing slash, fragment or tracking parameter; the other parameters sorted. Null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)\z", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    joined = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, F.regexp_replace(path_of(url), r"/+\z", ""), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    return F.when(host != "", whole)


# -- rules ---------------------------------------------------------------------------------------------------------
def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` as a table."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def with_rules(pages: DataFrame, rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """Add ``rule`` and ``__ruled`` (its verdict) of the longest rule that fits ``host`` and ``path``; null where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Rules are a policy of ``most`` rows at
    most, which is checked before they are broadcast: one row a host, met by the host's last k labels for each number of
    labels k that the rules have.
    """
    found = rules.agg(F.count(F.lit(1)), F.collect_set(F.size(F.split("host", r"\.")))).first()
    if found[0] > most:
        raise ValueError(f"{found[0]} rules, at most {most}; put single URLs into the list")
    whole = F.concat("host", "path")
    one = F.struct(F.length(whole).alias("n"), "verdict", whole.alias("rule"), F.col("path").alias("start"))
    by_host = rules.groupBy(F.col("host").alias("__rule_host")).agg(F.collect_set(one).alias("__rules"))
    fits = []
    for k in sorted(found[1]):
        own = by_host.where(F.size(F.split("__rule_host", r"\.")) == k).withColumnsRenamed({"__rule_host": f"__host{k}", "__rules": f"__rules{k}"})
        pages = pages.join(F.broadcast(own), F.substring_index("host", ".", -k) == F.col(f"__host{k}"), "left")
        fits.append(F.filter(f"__rules{k}", lambda r: F.startswith(F.col("path"), r["start"])))
    # A host of fewer than k labels is met at every k from its own number on: the same rules, so the longest is the same.
    best = F.greatest(*[F.array_max(f) for f in fits], F.lit(None).cast("struct<n:int,verdict:string,rule:string,start:string>")) if fits else None
    if best is None:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "__ruled": F.lit(None).cast("string")})
    return pages.withColumn("__best", best).withColumns({"rule": F.col("__best.rule"), "__ruled": F.col("__best.verdict")}).drop(
        "__best", *[f"__{name}{k}" for k in found[1] for name in ("host", "rules")]
    )


# -- blocked Bloom filter ------------------------------------------------------------------------------------------
def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), url), F.lit(blocks)).cast("int")


def _bits(url: Column) -> list[Column]:
    """One bit of each word of the block: six bits of a second hash each."""
    h = F.xxhash64(F.lit(2), url)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def filter_blocks(urls: DataFrame, url: str, blocks: int) -> DataFrame:
    """``(block, w0 … w7)``, one row for each block that has a URL; each task unites its own rows first."""
    c = F.col(url)
    bits = urls.select(_block(c, blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(c))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def blocks_for(urls: int, most: int = MOST_BLOCKS) -> int:
    """A power of two: about ``URLS_PER_BLOCK`` URLs a block, never more than ``most`` blocks."""
    return min(most, 1 << max(0, ceil(log2(max(1, urls) / URLS_PER_BLOCK))))


def possible(pages: DataFrame, url: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Add ``__possible``: all bits of the URL are set in its block. The blocks, of bounded number, are broadcast."""
    named = blocks.withColumnsRenamed({"block": "__block", **{f"w{i}": f"__w{i}" for i in range(WORDS)}})
    met = pages.join(F.broadcast(named), _block(F.col(url), n_blocks) == F.col("__block"), "left")
    every = F.lit(True)
    for i, bit in enumerate(_bits(F.col(url))):
        every = every & (F.col(f"__w{i}").bitwiseAND(bit) != 0)
    flag = F.col(url).isNotNull() & F.coalesce(every, F.lit(False))
    return met.withColumn("__possible", flag).drop("__block", *[f"__w{i}" for i in range(WORDS)])


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", keep: list[str] | None = None, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Pages with ``host``, ``path``, ``rule`` and ``verdict``: the longest rule's, else ``block`` for a listed URL and ``allow`` for others.

    ``listed`` has its URLs in its first column. ``keep`` names the columns of ``pages`` that come out (all). Pages that
    the filter does not pass are never shuffled.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in OUT]
    wanted = listed.select(canonical(F.col(f"`{listed.columns[0]}`")).alias("__listed")).dropna().distinct()
    wanted = written(wanted, "listed-urls")
    n_blocks = blocks_for(wanted.count(), most_blocks)
    parsed = pages.select(
        *[F.col(f"`{c}`") for c in keep], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), canonical(F.col(f"`{url}`")).alias("__url")
    )
    ruled = with_rules(parsed, rules)
    # A page with a rule needs no list.
    open_url = ruled.withColumn("__url", F.when(F.col("__ruled").isNull(), F.col("__url")))
    flagged = possible(open_url, "__url", filter_blocks(wanted, "__listed", n_blocks), n_blocks)
    out = [*[f"`{c}`" for c in keep], "host", "path", "rule"]
    passed = flagged.where("__possible").join(wanted, F.col("__url") == F.col("__listed"), "left")
    exact = passed.select(*out, F.when(F.col("__listed").isNotNull(), "block").otherwise("allow").alias("verdict"))
    rest = flagged.where("not __possible").select(*out, F.coalesce("__ruled", F.lit("allow")).alias("verdict"))
    return rest.union(exact)
