"""URL filters: rules by host and path, then a list behind a blocked Bloom filter.

The canonical form of a URL, and of an entry of the list, is its host without port and
leading "www.", A-Z lower-cased, and its path without slashes at its ends, query and fragment; scheme is
dropped, and an entry needs none. A URL is listed when one of its expressions is: its host or a
domain above it, with its whole path or a leading part of it. Of these, those are made
that have as many labels and folders as some entry of the list; no other can be listed. The expressions are
tested against a blocked Bloom filter, each in one block of eight words. Only
possible hits go to an exact join with the list, which removes false positives.
The filter grows with the list up to MOST blocks; beyond, it passes more, never fewer.

Defined results: null and no "://" give an empty host and path, which no rule and
no list matches, so they are allowed; repeated rows are judged alike; ties between
rules can't arise, as rules that fit one URL differ in length; null entries and such without
a host list nothing; other columns are ignored; an empty table or list gives an empty
result or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import settle

#: verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Entries for each block of eight 32-bit words; and how many blocks there are at least, and at most (32 MB).
PER_BLOCK = 8
FEWEST, MOST = 1 << 10, 1 << 20
LANES = 8
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


def host_of(url: str = "url") -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(F.col(url), F.locate("://", F.col(url)) + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str = "url") -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(F.col(url), F.locate("://", F.col(url)) + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict), or null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        under = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits = F.when(under & F.startswith(F.col("path"), F.lit(path)), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _clean_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), r"^www\.", "")


def _folders(path: Column) -> Column:
    """The parts of a path; none for a path of slashes."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "/+$", ""), "^/+", ""), "/")
    return F.when(parts[0] == "", F.array().cast("array<string>")).when(F.size(parts) > 0, parts)


def _joined(labels: Column, folders: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), F.array_join(F.concat(folders, F.array(F.lit(""))), "/"))


def entries(listed: DataFrame) -> DataFrame:
    """entry: the canonical forms of listed (column entry), each once."""
    whole = listed.select(F.when(F.contains("entry", F.lit("://")), F.col("entry")).otherwise(F.concat(F.lit("://"), F.col("entry"))).alias("u"))
    parts = whole.select(host_of("u").alias("host"), path_of("u").alias("path")).select(_clean_host(F.col("host")).alias("host"), _folders(F.col("path")).alias("folders"))
    # a host alone has no folders, and its path is empty
    return parts.where("host != ''").select(_joined(F.split("host", r"\."), F.col("folders")).alias("entry")).distinct()


def depths(listed: DataFrame) -> list[tuple[int, int]]:
    """The numbers of host labels and of folders that canonical entries have."""
    host = F.substring_index("entry", "/", 1)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x)))
    pairs = listed.select((count(host, ".") + 1).alias("labels"), (count(F.col("entry"), "/") - 1).alias("folders"))
    return sorted((r["labels"], r["folders"]) for r in pairs.distinct().toLocalIterator())


def expressions(of: list[tuple[int, int]], host: str = "host", path: str = "path") -> Column:
    """What of a URL may be listed, with as many labels and folders as in `of`: host or a domain above it, with the path or a leading part of it."""
    none = F.array().cast("array<string>")
    if not of:
        return none
    labels, folders = F.split(_clean_host(F.col(host)), r"\."), _folders(F.col(path))
    n = F.size(labels)
    held = F.array(*(F.struct(F.lit(a).alias("labels"), F.lit(b).alias("folders")) for a, b in of))
    each = F.transform(
        F.filter(held, lambda d: (d["labels"] <= n) & (d["folders"] <= F.size(folders))),
        lambda d: _joined(F.slice(labels, n - d["labels"] + 1, d["labels"]), F.slice(folders, 1, d["folders"])),
    )
    return F.when(F.col(host) != "", each).otherwise(none)


class BlockedBloom:
    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of_size(cls, blocks: int) -> BlockedBloom:
        return cls(np.zeros((blocks, LANES), np.uint32))

    def _masks(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block, and a bit for each of its words."""
        block = ((h >> np.uint64(32)) % np.uint64(len(self.words))).astype(np.int64)
        low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bits = (low[:, None] * _SALTS[None, :]) >> np.uint32(27)
        return block, np.uint32(1) << bits

    def add(self, h: np.ndarray) -> None:
        block, mask = self._masks(h)
        np.bitwise_or.at(self.words, block, mask)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        block, mask = self._masks(h)
        return ((self.words[block] & mask) == mask).all(axis=1)


def build(listed: DataFrame) -> BlockedBloom:
    """The filter of canonical entries; each task sends at most one row for each block."""
    blocks = min(max(FEWEST, 1 << (listed.count() // PER_BLOCK).bit_length()), MOST)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = BlockedBloom.of_size(blocks)
        for batch in batches:
            own.add(batch["h"].to_numpy(np.int64).view(np.uint64))
        used = np.flatnonzero(own.words.any(axis=1))
        lanes = own.words[used].astype(np.int64)
        yield pd.DataFrame({"block": used, **{f"w{i}": lanes[:, i] for i in range(LANES)}})

    parts = listed.select(F.xxhash64("entry").alias("h")).mapInPandas(run, "block long, " + ", ".join(f"w{i} long" for i in range(LANES)))
    rows = parts.groupBy("block").agg(*(F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(LANES)))
    out = BlockedBloom.of_size(blocks)
    for row in rows.toLocalIterator():
        out.words[row["block"]] = [row[f"w{i}"] for i in range(LANES)]
    return out


def listed_hits(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """url of pages of which an expression is listed; pages has url, host, path."""
    held = settle(entries(listed), "listed")
    words = pages.sparkSession.sparkContext.broadcast(build(held).words)

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(words.value).may_hold(h.to_numpy(np.int64).view(np.uint64)))

    each = pages.select("url", F.explode(expressions(depths(held))).alias("entry"))
    maybe = each.where(possible(F.xxhash64("entry"))).distinct()
    return maybe.join(held, "entry", "left_semi").select("url").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url)."""
    seen = pages.select("page_id", "url").withColumn("host", host_of()).withColumn("path", path_of()).withColumn("r", rule_of(rules))
    open_ = seen.where("r is null and host != ''")
    hits = listed_hits(open_, listed).select(F.col("url").alias("_hit"))
    both = seen.join(hits, F.col("url") == F.col("_hit"), "left")
    method = F.when(F.col("_hit").isNotNull(), "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"))
