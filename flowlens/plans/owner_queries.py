"""Owners of addresses and domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import owners

from .inputs import read
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: Blocks of the suppliers, of lengths from 8 to 30, which nest; and addresses of the customers.
_BLOCK = "concat(cast(10 + s_nationkey % 5 as varchar(9)), '.', cast(case when s_suppkey % 3 = 0 then 0 else s_suppkey % 16 * 16 end as varchar(9)), '.', cast(case when s_suppkey % 3 < 2 then 0 else s_suppkey % 4 * 64 end as varchar(9)), '.0/', cast(case s_suppkey % 3 when 0 then 8 when 1 then 12 + s_suppkey % 9 else 18 + s_suppkey % 13 end as varchar(9)))"
_ADDRESS = "concat(cast(9 + c_nationkey % 7 as varchar(9)), '.', cast(c_custkey % 256 as varchar(9)), '.', cast(c_custkey % 7 * 42 as varchar(9)), '.', cast(case when c_custkey % 50 = 0 then 300 else c_custkey % 90 end as varchar(9)))"
_NUMBER = "(string_split({0}, '.')[1]::bigint * 16777216 + string_split({0}, '.')[2]::bigint * 65536 + string_split({0}, '.')[3]::bigint * 256 + string_split({0}, '.')[4]::bigint)"


@query(f"""with b as (select cidr, owner, string_split(cidr, '/')[2]::int as n, {_NUMBER.format("string_split(cidr, '/')[1]")} as base from (select {_BLOCK} as cidr, s_name as owner from supplier)),
g as (select n, base >> (32 - n) as prefix, min(struct_pack(o := owner, c := cidr)) as blk from b group by all),
a as (select c_custkey, address, case when c_custkey % 50 <> 0 then {_NUMBER.format('address')} end as num from (select c_custkey, {_ADDRESS} as address from customer)),
l as (select c_custkey, max_by(blk, n) as blk from a join g on num >> (32 - n) = prefix group by c_custkey)
select a.c_custkey, address, blk.o as owner, blk.c as network from a left join l on l.c_custkey = a.c_custkey""")
def owned_addresses(spark, sf_dir):
    """The supplier whose smallest block holds each customer's address."""
    blocks = read(spark, sf_dir, "supplier").selectExpr(f"{_BLOCK} as cidr", "s_name as owner")
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ADDRESS} as address")
    return owners.owned_addresses(rows, blocks, "address")


#: Rules like those of a public suffix list.
_RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "s3.amazonaws.com", "org"]
_TAILS = ["example.com", "example.co.uk", "uk", "a.b.ck", "www.ck", "x.city.kawasaki.jp", "y.z.kawasaki.jp", "bucket.s3.amazonaws.com", "device.local", "Example.ORG."]
_HOST = "concat(case c_custkey % 3 when 0 then '' when 1 then 'api.' else concat('n', cast(c_nationkey as varchar(9)), '.x.') end, {0})"


@query(f"""with h as (select c_custkey, {_HOST.format(f"(['" + "', '".join(_TAILS) + "'])[1 + c_custkey % 10]")} as host from customer),
r(rule) as (values {', '.join(f"('{r}')" for r in _RULES)}),
k as (select regexp_replace(rule, '^(!|[*][.])', '') as base, rule[1] = '!' as ex, len(string_split(rule, '.')) - (rule[1] = '!')::int as n, starts_with(rule, '*.') as wild from r),
m as (select c_custkey, host, rtrim(lower(host), '.') as name, len(string_split(rtrim(lower(host), '.'), '.')) as labels from h),
f as (select c_custkey, max(struct_pack(ex := ex, n := n)) as best from m join k on ('.' || name = '.' || base or ends_with(name, '.' || base)) and labels >= n group by c_custkey)
select m.c_custkey, host, case when labels > coalesce(best.n, 1) then array_to_string(string_split(name, '.')[labels - coalesce(best.n, 1) : labels], '.') end as domain from m left join f on f.c_custkey = m.c_custkey""")
def registrable_domains(spark, sf_dir):
    tails = "array(" + ", ".join(f"'{t}'" for t in _TAILS) + ")[int(c_custkey % 10)]"
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_HOST.format(tails)} as host")
    return owners.registrable_domains(rows, spark.createDataFrame([(r,) for r in _RULES], "rule string"), "host")
