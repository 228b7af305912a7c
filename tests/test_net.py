from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from flowlens.functions import net


def test_addresses_by_the_standard_library(spark):
    rng = random.Random(1)
    ips = [".".join(map(str, (rng.choice([10, 11, 127, 169, 172, 192, 223, 224, 239, 240]), rng.choice([0, 15, 16, 31, 32, 168, 254]), rng.randrange(256), rng.randrange(256)))) for _ in range(400)]
    rows = spark.createDataFrame([(i,) for i in [*ips, None, "", "10.x", "1.2.3", "300.1.1.1"]], "ip string").select("ip", net.is_ipv4(F.col("ip")).alias("v"), net.is_private(F.col("ip")).alias("p"), net.is_multicast(F.col("ip")).alias("m")).collect()
    networks = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")]
    for r in rows:
        if r["ip"] in ips:
            a = ipaddress.ip_address(r["ip"])
            assert (r["v"], r["p"], r["m"]) == (True, any(a in n for n in networks), a.is_multicast)
        else:
            assert (r["v"], r["p"], r["m"]) == (False, False, False)
