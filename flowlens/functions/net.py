"""Column functions over addresses, hosts, protocols and activity labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
PRIVATE = r"^(10|127|192\.168|169\.254|172\.(1[6-9]|2\d|3[01]))\."
MULTICAST = r"^(22[4-9]|23\d)\."
#: Protocols that keep a network running rather than serve an activity.
INFRASTRUCTURE = ("DNS", "MDNS", "NTP", "SSDP", "DHCP")
CLOUD = "*.compute.amazonaws.com"


def is_ipv4(ip: Column) -> Column:
    """Whether a string is a dotted IPv4 address; null: false."""
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def octet(ip: Column, i: int) -> Column:
    return F.get(F.split(ip, r"\."), i).try_cast("int")


def ip_number(ip: Column) -> Column:
    """An address as a number, for ordering two ends of a flow; null for others."""
    n = sum((octet(ip, i).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return F.when(is_ipv4(ip), n)


def is_private(ip: Column) -> Column:
    """Addresses of private, loopback and link-local networks, by one pattern instead of numbers of octets."""
    return is_ipv4(ip) & F.coalesce(ip.rlike(PRIVATE), F.lit(False))


def is_multicast(ip: Column) -> Column:
    return is_ipv4(ip) & F.coalesce(ip.rlike(MULTICAST), F.lit(False))


def is_local_traffic(a: Column, b: Column, routers: list[str]) -> Column:
    """Both ends private, or one private and the other a router; ends that aren't addresses count as local."""
    known = is_ipv4(a) & is_ipv4(b)
    return ~known | (is_private(a) & is_private(b)) | (is_private(a) & b.isin(routers)) | (is_private(b) & a.isin(routers))


def transport(protocol: Column) -> Column:
    """TCP for what runs over it, UDP likewise; other names with ``;`` as `` & ``."""
    p = protocol
    return F.when(p.contains("TCP") | p.contains("MQTT") | p.contains("TLS"), "TCP").when(p.contains("UDP"), "UDP").otherwise(F.replace(p, F.lit(";"), F.lit(" & ")))


def main_host(hosts: Column) -> Column:
    """First of a ``;`` list in small letters; null: empty."""
    return F.lower(F.coalesce(F.get(F.split(hosts, ";"), 0), F.lit("")))


def collapse_cloud(host: Column) -> Column:
    """Names of rented hosts as one wildcard."""
    return F.when(host.rlike(r"^ec.*\.compute(-1)?\.amazonaws\.com$"), CLOUD).otherwise(host)


#: Fixed values: (beginning of the device's name, host, the name that its fingerprints have).
HOST_ALIASES = [
    ("tplink", "n-devs.tplinkcloud.com", "devs.tplinkcloud.com"),
    ("wink-hub2", "3.90.178.36", "*.compute-1.amazonaws.com"),
    ("wyze-cam", "45.56.113.17", "*.ip.linodeusercontent.com"),
]


def aliased_host(host: Column, device: Column) -> Column:
    """The name that a device's fingerprints have for a host; other hosts, and null, as they are."""
    named = host
    for prefix, seen, name in HOST_ALIASES:
        named = F.when(F.startswith(device, F.lit(prefix)) & (host == seen), F.lit(name)).otherwise(named)
    return named


#: Hosts that stand for a link and not for a destination.
LINK_HOSTS = ("00:0c:43:26:60:00", "22:ef:03:1a:97:b9", "ff:ff:ff:ff:ff:ff", "multicast")


def is_link_host(host: Column) -> Column:
    """Names of hardware, multicast, and whatever has a colon, as hardware and IPv6 addresses do; null: false."""
    return F.coalesce(host.isin(*LINK_HOSTS) | host.contains(":"), F.lit(False))


def is_of_pattern(host: Column, pattern: Column) -> Column:
    """Whether a host is the pattern, or ends with what follows the pattern's leading ``*.``; null: null."""
    return (host == pattern) | (F.startswith(pattern, F.lit("*")) & F.endswith(host, F.substr(pattern, F.lit(3))))


def suffix(host: Column, labels: int = 3) -> Column:
    return F.substring_index(host, ".", -labels)


def labels_of(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


#: Prefixes of activity labels that tell who caused it, not what it was.
ACTORS = r"^(alexa|google|android_lan|android_wan|android|app|local|voice)_"


def activity(label: Column) -> Column:
    """An activity without its actor, on and off as one."""
    bare = F.regexp_replace(label, ACTORS, "")
    return F.when(bare.rlike(r"(^|_)(on|off)$"), F.regexp_replace(bare, r"(on|off)$", "on_off")).otherwise(bare)
