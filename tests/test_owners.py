from __future__ import annotations

import ipaddress
import random

from flowlens.operators import owners


def test_longest_block_by_brute_force(spark):
    rng = random.Random(1)
    blocks = [(str(ipaddress.ip_network((rng.choice([0x0A000000, 0x0A010000, 0xC0A80000]) + rng.randrange(1 << 16), n), strict=False)), f"o{i}") for i in range(60) for n in [rng.choice([0, 8, 12, 16, 17, 20, 23, 24, 28, 31, 32])] if n or i < 5]
    blocks += [(blocks[0][0], "a first"), ("10.0.0.1", "bare"), ("nonsense", "x"), ("10.0.0.0/99", "y"), ("fe80::/10", "z"), (None, "n")]
    valid = [(ipaddress.ip_network(c), o) for c, o in blocks if c and "." in c and not c.endswith("/99")]
    addresses = [str(ipaddress.ip_address(rng.choice([0x0A000000, 0x0A010000, 0xC0A80000, 0x08080808]) + rng.randrange(1 << 16))) for _ in range(400)] + ["10.0.0.1"]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate([*addresses, None, "", "host.example", "10.0.0.256", "fe80::1", "1.2.3"])], "id long, ip string")
    got = {r["id"]: (r["owner"], r["network"]) for r in owners.owned_addresses(rows, spark.createDataFrame(blocks, "cidr string, owner string"), "ip").collect()}
    for i, a in enumerate(addresses):
        held = [(n.prefixlen, o) for n, o in valid if ipaddress.ip_address(a) in n]
        want = min((o for p, o in held if p == max(held)[0]), default=None) if held else None
        assert got[i][0] == want, a
    assert all(got[i] == (None, None) for i in range(len(addresses), len(addresses) + 6))
    none = owners.owned_addresses(rows, spark.createDataFrame([], "cidr string, owner string"), "ip")
    assert none.where("owner is not null").count() == 0 and none.count() == rows.count()


def test_domains_by_rules_and_exceptions(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "uk", "co.uk", "*.ck", "!www.ck", " *.kawasaki.jp", "!city.kawasaki.jp", "jp", "")], "rule string")
    want = {
        "a.b.example.com": "example.com", "example.com": "example.com", "com": None, "a.example.co.uk": "example.co.uk", "co.uk": None, "bbc.uk": "bbc.uk",
        "a.b.c.ck": "b.c.ck", "c.ck": None, "ck": None, "www.ck": "www.ck", "x.www.ck": "www.ck", "a.city.kawasaki.jp": "city.kawasaki.jp", "b.c.kawasaki.jp": "b.c.kawasaki.jp", "c.kawasaki.jp": None,
        "plug.local": "plug.local", "local": None, "Api.Example.COM.": "example.com", "8.8.8.8": "8.8.8.8", "": None, "a..com": None, None: None,
    }
    rows = spark.createDataFrame([(h,) for h in want] + [("example.com",)], "host string")
    got = owners.registrable_domains(rows, rules, "host")
    assert got.count() == len(want) + 1 and {r["host"]: r["domain"] for r in got.collect()} == want


def test_destinations_by_public_suffix(spark):
    from flowlens.operators import naming

    rows = spark.createDataFrame([(i, "plug", d) for i, d in enumerate(["a.example.co.uk", "b.other.co.uk", "co.uk", "x.example.com", None, "1.2.3.4"])], "id int, device string, domain string")
    known = spark.createDataFrame([("example.co.uk", "Example"), ("example.com", "Example"), ("co.uk", "Nominet")], "name string, org string")
    first = spark.createDataFrame([("plug", ["example"])], "device string, orgs array<string>")
    rules = spark.createDataFrame([("co.uk",), ("com",)], "rule string")
    got = {r["id"]: r["org"] for r in naming.destinations(rows, known, first, [], rules).collect()}
    assert got == {0: "Example", 1: "other.co.uk", 2: "Nominet", 3: "Example", 4: None, 5: "1.2.3.4"}
    plain = {r["id"]: r["org"] for r in naming.destinations(rows, known, first, []).collect()}
    assert plain[0] == plain[1] == "Nominet"
