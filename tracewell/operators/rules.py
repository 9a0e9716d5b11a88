"""Correlation rules: each turns links, nodes and clusters into findings.

Links: ``src, dst, rel``; nodes: ``node`` plus what a rule needs; clusters: ``node, component``.
A finding: ``code, entity, severity, confidence, score, members``.  Codes hold the whole
entity, so different entities never share one.  Thresholds are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.normalize import is_private_ip, subnet24

USERS = ("PHONE", "ACCOUNT", "UPI", "EMAIL")
FINANCIAL = ("ACCOUNT", "UPI")
IDENTITY = ("LINKED_VPA", "REGISTERED_ON", "DEVICE_INTERFACE")
SUBSCRIBER = ("a_party", "b_party", "subscriber", "device_msisdn")


def kind_of(node: Column | str) -> Column:
    return F.substring_index(node, "|", 1)


def _finding(df: DataFrame, code: str, severity: Column, confidence: str, score: Column) -> DataFrame:
    return df.select(F.concat(F.lit(code + "-"), F.col("entity")).alias("code"), "entity", severity.alias("severity"), F.lit(confidence).alias("confidence"), score.cast("int").alias("score"), F.array_sort("members").alias("members"))


def _groups(pairs: DataFrame, least: int) -> DataFrame:
    """``entity, members, n``: entities with at least ``least`` distinct members.

    Members are gathered only of entities that qualify; pairs are distinct before the shuffle by entity.
    """
    return pairs.distinct().groupBy("entity").agg(F.collect_set("member").alias("members"), F.count("*").alias("n")).filter(F.col("n") >= least)


def _pairs(links: DataFrame, rels, entity: str, member: str) -> DataFrame:
    return links.filter(F.col("rel").isin(*rels)).select(F.col(entity).alias("entity"), F.col(member).alias("member"))


def _grade(n: Column, from_: int, high, low) -> Column:
    return F.when(n >= from_, high).otherwise(low)


def shared_handset(links: DataFrame, least: int = 2) -> DataFrame:
    """A handset that several numbers use."""
    g = _groups(_pairs(links, ["USES_HANDSET"], "dst", "src").filter(kind_of("member") == "PHONE"), least)
    return _finding(g, "SHARED-HANDSET", _grade(F.col("n"), 3, "HIGH", "MEDIUM"), "HIGH", _grade(F.col("n"), 3, 18, 12))


def sim_velocity(links: DataFrame, sightings: DataFrame, least: int = 3, days: int = 30) -> DataFrame:
    """A handset with several SIMs within some days, or, where none is known, several numbers; ``sightings``: node, ts.

    The days are those of its SIMs and numbers; a handset without a known time counts too.
    """
    cards = _pairs(links, ["SIM_IN_HANDSET"], "dst", "src")
    cards = cards.unionByName(_pairs(links, ["SIM_IN_HANDSET"], "src", "dst")).filter((kind_of("entity") == "IMEI") & (kind_of("member") == "IMSI"))
    phones = _pairs(links, ["USES_HANDSET"], "dst", "src").filter((kind_of("entity") == "IMEI") & (kind_of("member") == "PHONE"))
    seen = sightings.filter("ts is not null").withColumnRenamed("node", "member")
    span = cards.unionByName(phones).distinct().join(seen, "member").groupBy("entity").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    counted = cards.unionByName(phones.join(cards.select("entity").distinct(), "entity", "left_anti"))
    g = _groups(counted, least).join(span, "entity", "left").filter(F.coalesce(F.timestamp_diff("SECOND", "a", "b") <= days * 86400, F.lit(True)))
    return _finding(g, "SIM-VELOCITY", _grade(F.col("n"), 4, "CRITICAL", "HIGH"), "HIGH", _grade(F.col("n"), 4, 22, 16))


def handset_hop(links: DataFrame, least: int = 2) -> DataFrame:
    """A number that several handsets use."""
    g = _groups(_pairs(links, ["USES_HANDSET"], "src", "dst").filter(kind_of("entity") == "PHONE"), least)
    return _finding(g, "HANDSET-HOP", F.lit("MEDIUM"), "HIGH", F.lit(10))


def actors(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add ``actor``: the member's cluster, or itself."""
    return pairs.join(clusters.select(F.col("node").alias("member"), F.col("component")), "member", "left").withColumn("actor", F.coalesce("component", "member")).drop("component")


def _shared(pairs: DataFrame, clusters: DataFrame, victims: DataFrame, users: int) -> DataFrame:
    who = actors(pairs.filter(kind_of("member").isin(*USERS)).distinct(), clusters)
    who = who.join(victims.select(F.col("node").alias("member"), F.lit(True).alias("victim")), "member", "left")
    g = who.groupBy("entity").agg(F.collect_set("member").alias("members"), F.count_distinct("actor").alias("actors"), F.count_if(F.col("victim").isNull()).alias("others"))
    return g.filter((F.size("members") >= users) & (F.col("actors") >= 2) & (F.col("others") > 0))


def shared_ip(links: DataFrame, clusters: DataFrame, victims: DataFrame) -> DataFrame:
    """A public address that several actors use."""
    pairs = _pairs(links, ["USED_IP", "TXN_FROM_IP", "SENT_FROM_IP"], "dst", "src").filter(~is_private_ip(F.substring_index("entity", "|", -1)))
    return _finding(_shared(pairs, clusters, victims, 2), "SHARED-IP", F.lit("HIGH"), "MEDIUM", F.lit(15))


def shared_subnet(links: DataFrame, clusters: DataFrame, victims: DataFrame) -> DataFrame:
    """A /24 network with several addresses that several actors use."""
    pairs = _pairs(links, ["USED_IP", "TXN_FROM_IP", "SENT_FROM_IP"], "dst", "src").filter(~is_private_ip(F.substring_index("entity", "|", -1)))
    nets = pairs.withColumn("net", subnet24(F.substring_index("entity", "|", -1))).filter("net is not null")
    wide = nets.groupBy("net").agg(F.count_distinct("entity").alias("ips")).filter("ips >= 2")
    members = nets.join(wide, "net").select(F.col("net").alias("entity"), "member")
    return _finding(_shared(members, clusters, victims, 2), "SHARED-SUBNET", F.lit("MEDIUM"), "MEDIUM", F.lit(12))


def shared_hardware(links: DataFrame, least: int = 2) -> DataFrame:
    """A device or network card with several numbers, accounts or payment addresses."""
    both = _pairs(links, ["DEVICE_INTERFACE", "USED_DEVICE"], "dst", "src").unionByName(_pairs(links, ["DEVICE_INTERFACE", "USED_DEVICE"], "src", "dst"))
    g = _groups(both.filter(kind_of("entity").isin("MAC", "DEVICE") & kind_of("member").isin("PHONE", "UPI", "ACCOUNT")), least)
    return _finding(g, "SHARED-HW", F.lit("HIGH"), "HIGH", F.lit(16))


def fan_in(links: DataFrame, least: int = 3) -> DataFrame:
    """A node that collects from several senders."""
    g = _groups(_pairs(links, ["FUNDS"], "dst", "src").filter(F.col("entity") != F.col("member")), least)
    return _finding(g, "FAN-IN", _grade(F.col("n"), 4, "HIGH", "MEDIUM"), "HIGH", _grade(F.col("n"), 4, 18, 12))


def equal_packages(packages: DataFrame, least: int = 2) -> DataFrame:
    """One file digest under several package names; ``packages``: node, sha256."""
    g = _groups(packages.filter("sha256 is not null").select(F.col("sha256").alias("entity"), F.col("node").alias("member")), least)
    return _finding(g, "APK-HASH", F.lit("HIGH"), "HIGH", F.lit(15))


def malicious_packages(packages: DataFrame, risk: int = 55, critical: int = 75) -> DataFrame:
    """A package of high risk; ``packages``: node, risk."""
    g = packages.filter(F.col("risk") >= risk).groupBy(F.col("node").alias("entity")).agg(F.max("risk").alias("risk"), F.collect_set("node").alias("members"))
    return _finding(g, "MALICIOUS-APK", F.when(F.col("risk") >= critical, "CRITICAL").otherwise("HIGH"), "HIGH", F.when(F.col("risk") >= critical, 20).otherwise(14))


def domain_pivot(links: DataFrame, least: int = 2) -> DataFrame:
    """A domain that several identities lead to."""
    g = _groups(_pairs(links, ["ON_DOMAIN", "LINKS_TO", "CONTACTS", "CONNECTED_TO"], "dst", "src").filter((kind_of("entity") == "DOMAIN") & kind_of("member").isin("PHONE", "EMAIL", "IMEI", "APK", "IP")), least)
    return _finding(g, "DOMAIN-PIVOT", F.lit("MEDIUM"), "MEDIUM", F.lit(10))


def name_reuse(links: DataFrame, clusters: DataFrame, least: int = 2) -> DataFrame:
    """A name that holds accounts of several actors."""
    who = actors(_pairs(links, ["HOLDS"], "src", "dst").filter(kind_of("member").isin(*FINANCIAL)).distinct(), clusters)
    g = who.groupBy("entity").agg(F.collect_set("member").alias("members"), F.count_distinct("actor").alias("actors")).filter((F.size("members") >= least) & (F.col("actors") >= 2))
    return _finding(g, "NAME-REUSE", F.lit("LOW"), "LOW", F.lit(4))


def masked_match(accounts: DataFrame, tail: int = 4) -> DataFrame:
    """A masked account whose last digits are those of full ones; ``accounts``: node."""
    last = F.right("node", F.lit(tail))
    masked = accounts.filter(F.col("node").startswith("ACCOUNT|MASKED-")).select(F.col("node").alias("entity"), last.alias("tail"))
    full = accounts.filter(F.col("node").startswith("ACCOUNT|") & ~F.col("node").startswith("ACCOUNT|MASKED-")).select(F.col("node").alias("member"), last.alias("tail"))
    members = full.distinct().groupBy("tail").agg(F.array_sort(F.collect_list("member")).alias("members"))  # once a tail, not once a pair
    g = masked.distinct().join(members, "tail")
    return _finding(g, "MASKED-MATCH", F.lit("LOW"), "LOW", F.lit(3))


def rail_bridge(links: DataFrame, roles: DataFrame) -> DataFrame:
    """A number that is registered on accounts and occurs in call records; ``roles``: node, role."""
    telecom = roles.filter(F.col("role").isin(*SUBSCRIBER)).select(F.col("node").alias("entity")).distinct()
    both = _pairs(links, ["REGISTERED_ON"], "src", "dst").unionByName(_pairs(links, ["REGISTERED_ON"], "dst", "src"))
    g = _groups(both.filter((kind_of("entity") == "PHONE") & kind_of("member").isin(*FINANCIAL)).join(telecom, "entity", "left_semi"), 1)
    return _finding(g, "RAIL-BRIDGE", F.lit("MEDIUM"), "HIGH", F.lit(8))


def evidence(findings: DataFrame, observations: DataFrame, most: int = 50) -> DataFrame:
    """``findings`` with ``evidence``: the first ``most`` events (``observations``: node, event_id, seq) that show an entity with a member of its finding.

    Where the entity is no node, such as a digest or a network, they are the events that show a member.
    """
    each = findings.select("code", "entity", F.explode("members").alias("node")).distinct()
    seen = observations.select("node", "event_id", "seq").distinct()
    shown = each.join(seen, "node").select("code", "entity", F.col("node").alias("member"), "event_id", "seq")
    both = shown.join(seen.select(F.col("node").alias("entity"), "event_id"), ["entity", "event_id"], "left_semi")
    found = both.unionByName(shown.join(both.select("code").distinct(), "code", "left_anti"))
    return findings.join(first_events(found, ["code"], most), "code", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


def first_events(rows: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """The ``keys`` and ``evidence``: the first ``most`` distinct events of each by seq; only that many of each are gathered."""
    w = Window.partitionBy(*keys).orderBy("seq", "event_id")
    first = rows.select(*keys, "event_id", "seq").distinct().withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= most)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "event_id"))), lambda x: x["event_id"].cast("string")).alias("evidence"))


def additional_victims(nodes: DataFrame) -> DataFrame:
    """Findings for ``transfers.additional_victims``."""
    g = nodes.select(F.col("node").alias("entity"), F.array("node").alias("members"))
    return _finding(g, "ADDL-VICTIM", F.lit("INFO"), "MEDIUM", F.lit(0))
