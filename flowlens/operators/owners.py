"""Owners of addresses by network, and registrable domains by public suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import net

#: An IPv4 address with decimal parts of up to three digits.
_PARTS = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def address_number(address: Column) -> Column:
    """An IPv4 address as a number; null for all that is none, parts over 255 included."""
    parts = [F.regexp_extract(address, _PARTS, i).try_cast("long") for i in (1, 2, 3, 4)]
    number = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    return F.when(F.greatest(*parts) <= 255, number)


def networks(blocks: DataFrame, cidr: str) -> DataFrame:
    """``blocks`` with _length and _prefix of their networks; rows that are no IPv4 network in CIDR form go. A bare address is its own network."""
    length = F.when(F.col(cidr).contains("/"), F.split_part(F.col(cidr), F.lit("/"), F.lit(2)).try_cast("int")).otherwise(32)
    number = address_number(F.split_part(F.col(cidr), F.lit("/"), F.lit(1)))
    rows = blocks.withColumns({"_length": length, "_number": number}).where(F.col("_length").between(0, 32) & F.col("_number").isNotNull())
    return rows.withColumn("_prefix", F.expr("shiftright(_number, 32 - _length)")).drop("_number")


def owned_addresses(rows: DataFrame, blocks: DataFrame, address: str, cidr: str = "cidr", owner: str = "owner") -> DataFrame:
    """Adds owner and network: those of the longest block that holds a row's address, null where none does.

    Each distinct address lists its prefixes of the lengths that occur among the
    blocks, at most 33, so the search is one equality join and not a comparison
    of addresses with blocks. Of equal blocks the smallest owner counts. Other
    texts than IPv4 addresses, and null, have no owner.
    """
    held = networks(blocks, cidr).groupBy("_length", "_prefix").agg(F.min(F.struct(F.col(owner).alias("owner"), F.col(cidr).alias("network"))).alias("_block"))
    lengths = sorted(r[0] for r in held.select("_length").distinct().collect())  # at most 33
    seen = rows.select(F.col(address).alias("_address")).distinct().withColumn("_number", address_number(F.col("_address"))).where("_number is not null")
    listed = seen.withColumn("_length", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).withColumn("_prefix", F.expr("shiftright(_number, 32 - _length)"))
    found = listed.join(held, ["_length", "_prefix"]).groupBy("_address").agg(F.max_by("_block", "_length").alias("_block"))
    out = rows.join(found, F.col(address) == F.col("_address"), "left")
    return out.select(*rows.columns, F.col("_block.owner").alias("owner"), F.col("_block.network").alias("network"))


def registrable_domains(rows: DataFrame, suffixes: DataFrame, host: str, rule: str = "rule") -> DataFrame:
    """Adds domain: the public suffix of a row's host and one label more; null where nothing is left before the suffix.

    ``suffixes`` are rules of a public suffix list: ``co.uk``; ``*.ck``, any
    label before ck; ``!www.ck``, an exception, whose suffix is what follows its
    first label. An exception wins, then the rule of most labels, then the last
    label alone. An IPv4 address is its own domain. Case and a closing dot don't
    matter. Each distinct host lists its own endings, so rules are met by one
    equality join.
    """
    text = F.lower(F.trim(F.col(rule)))
    bare = F.regexp_replace(text, r"^(!|\*\.)", "")
    labels = F.size(F.split(bare, r"\."))
    kinds = suffixes.where(text != "").select(bare.alias("_ending"), F.when(text.startswith("!"), F.struct(F.lit(1).alias("first"), (labels - 1).alias("n"))).otherwise(F.struct(F.lit(0).alias("first"), F.when(text.startswith("*."), labels + 1).otherwise(labels).alias("n"))).alias("_rule"))
    name = F.regexp_replace(F.lower(F.col(host)), r"\.$", "")
    seen = rows.select(F.col(host).alias("_host")).distinct().withColumn("_labels", F.split(F.regexp_replace(F.lower("_host"), r"\.$", ""), r"\."))
    n = F.size("_labels")
    endings = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice("_labels", n - k + 1, k), "."))
    met = seen.where("_host is not null").withColumn("_ending", F.explode(endings)).join(kinds, "_ending")
    best = met.where(F.col("_rule.n") <= n).groupBy("_host").agg(F.max("_rule").alias("_best"))
    out = rows.join(best, F.col(host) == F.col("_host"), "left")
    parts, more = F.split(name, r"\."), F.coalesce(F.col("_best.n"), F.lit(1)) + 1
    domain = F.when(net.is_ipv4(F.col(host)), F.col(host)).when((F.size(parts) >= more) & ~F.array_contains(parts, ""), F.array_join(F.slice(parts, F.greatest(F.size(parts) - more + 1, F.lit(1)), more), "."))
    return out.select(*rows.columns, domain.alias("domain"))
