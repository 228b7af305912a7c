"""Names of activities, hosts and organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import net

from . import lookups

# Devices whose labels can't be told apart, by what is merged for them.
ON_OFF = "echoplus echospot echodot3c echodot4a insteon-hub lightify-hub nest-tstat magichome-strip philips-bulb smartthings-hub xiaomi-hub xiaomi-strip govee-led1 switchbot-hub gosund-bulb1 bulb1 smartlife-bulb ikea-hub t-wemo-plug tplink-bulb".split()
SPEAKERS = ["echospot"]
CAMERAS = "microseven-camera icsee-doorbell tuya-camera yi-camera lefun-cam-wired wyze-cam luohe-spycam amcrest-cam-wired wansview-cam-wired dlink-camera ubell-doorbell".split()
RINGS = ["ring-camera", "ring-doorbell"]
STRIPS = ["magichome-strip"]
THERMOSTATS = ["nest-tstat"]
# Merges in their order: devices, labels, the merged label, and how many labels the device must exceed.
MERGES = [
    (ON_OFF, ["on", "off"], "on_off", 0),
    (ON_OFF, ["color", "dim"], "color_dim", 2),
    (ON_OFF, ["lock", "unlock"], "lock_unlock", 2),
    (CAMERAS, ["audio", "photo", "recording", "watch"], "audio_photo_recording_watch", 0),
    (RINGS, ["audio", "stop", "watch"], "audio_stop_watch_motion", 0),
    (STRIPS, ["color_dim", "on_off", "scene"], "toggle", 0),
    (THERMOSTATS, ["set", "temp"], "set", 0),
]
# Who caused an activity, as prefixes of labels.
CAUSES = r"^(alexa|android_lan|android_wan|local)_"


def merged_labels(rows: DataFrame, training: DataFrame, device: str, label: str) -> DataFrame:
    """Adds activity, the label that a device's indistinguishable labels share.

    Some merges need more than so many labels in ``training``. The rules run
    once over the distinct (device, label) pairs, and rows then look theirs up.
    A null device or label has a null activity.
    """
    raw, dev = F.col("_raw"), F.col("_device")
    strip = F.when(raw.rlike(CAUSES), F.element_at(F.split(raw, "_"), -1)).otherwise(raw)
    first = F.when(dev.isin(SPEAKERS) & raw.isin("android_wan_volume", "android_lan_volume"), "on_off").when(dev.isin(SPEAKERS) & raw.isin("local_voice", "local_volume"), "voice").otherwise(strip)
    pair = lambda df, known: df.select(F.col(device).alias("_device"), F.col(label).alias("_raw"), F.lit(known).alias("_known")).distinct()
    pairs = pair(rows, False).unionByName(pair(training, True)).withColumn("activity", first)
    for devices, labels, merged, above in MERGES:
        on = dev.isin(devices) & F.col("activity").isin(labels)
        if above:
            seen = pairs.where("_known").groupBy("_device").agg(F.count_distinct("activity").alias("_n"))
            pairs = pairs.join(seen, "_device", "left")
            on = on & (F.coalesce("_n", F.lit(0)) > above)
        pairs = pairs.withColumn("activity", F.when(on, merged).otherwise(F.col("activity"))).drop("_n")
    names = pairs.where("not _known").drop("_known")
    return rows.join(names, (F.col(device) == F.col("_device")) & (F.col(label) == F.col("_raw")), "left").drop("_device", "_raw")


def resolve_hosts(packets: DataFrame, history: DataFrame, reverse: DataFrame, routers: list[str]) -> DataFrame:
    """Adds host and outcome of each packet's far end.

    Multicast ends, local traffic and private ends have fixed names; other ends
    take the history's last name before the packet, else its first, else the
    name in ``reverse`` (ip, name), a table of reverse lookups, else none. Needs
    device, ip_src, ip_dst and ts; history has device, ip, ts and name.
    """
    dst = F.col("ip_dst")
    fixed = F.when(net.is_multicast(dst), "multicast").when(net.is_local_traffic(F.col("ip_src"), dst, routers), "local").when(net.is_private(dst), "private")
    rows = packets.withColumn("_fixed", fixed).withColumn("ip", F.when(fixed.isNull(), dst))
    named = lookups.as_of(rows.where("_fixed is null"), history, ["device", "ip"], "ts", "name")
    named = named.join(reverse.select("ip", F.lower("name").alias("_whois")), "ip", "left")
    host = F.coalesce("name", "_whois", F.lit(""))
    outcome = F.when(F.col("outcome") != "blank", F.col("outcome")).when(F.coalesce("_whois", F.lit("")) != "", "whois").otherwise("blank")
    done = named.select(*packets.columns, host.alias("host"), outcome.alias("outcome"))
    name = F.when(F.col("_fixed") == "multicast", "Multicast").when(F.col("_fixed") == "local", "local").otherwise("")
    return done.unionByName(rows.where("_fixed is not null").select(*packets.columns, name.alias("host"), F.col("_fixed").alias("outcome")))


def registered_name(domain: Column) -> Column:
    """What an organisation is looked up by: an address itself, else the last two labels."""
    return F.when(net.is_ipv4(domain), domain).otherwise(F.substring_index(domain, ".", -2))


def destinations(rows: DataFrame, owners: DataFrame, first_parties: DataFrame, support: list[str], suffixes: DataFrame | None = None) -> DataFrame:
    """Adds org and party to rows with device and domain.

    ``owners`` (name, org) are looked up by registered name; a name without an
    owner stands for itself. ``first_parties`` has device and orgs. With
    ``suffixes``, rules of a public suffix list, names are registrable domains,
    so that ``example.co.uk`` is one; a public suffix itself stands for itself.
    """
    from .owners import registrable_domains
    from .summaries import party

    if suffixes is None:
        rows = rows.withColumn("_name", registered_name(F.col("domain")))
    else:
        names = registrable_domains(rows.select(F.col("domain").alias("_domain")).distinct(), suffixes, "_domain").select("_domain", F.coalesce("domain", "_domain").alias("_name"))
        rows = rows.join(names, F.col("domain").eqNullSafe(F.col("_domain")), "left").drop("_domain")
    rows = rows.join(owners.select(F.col("name").alias("_name"), "org"), "_name", "left")
    rows = rows.withColumn("org", F.coalesce("org", "_name")).join(first_parties, "device", "left")
    return rows.withColumn("party", party(F.col("org"), F.col("orgs"), support)).drop("_name", "orgs")


def first_of_each(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row for each of ``keys``: the ``value`` that comes first by ``order``."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(order, value)).alias(value))
