"""A case from a folder of exhibits to ranked suspects and a brief."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import rules as R
from tracewell.operators import scoring as S
from tracewell.operators import trace as G
from tracewell.operators import transfers as T
from tracewell.operators.components import connected_components
from tracewell.sources import exhibits as X
from tracewell.sources.events import events
from tracewell.storage import materialize

MONEY_TYPES = ("ACCOUNT", "UPI")


class Case:
    """Frames of a case, each computed when it is first asked for.

    ``logged`` (path, sha256) are digests from acquisition; files that no longer have them give no events.
    """

    def __init__(self, spark: SparkSession, path: str, logged: DataFrame | None = None, max_depth: int = 6):
        self.spark, self.max_depth = spark, max_depth
        self.exhibits = X.manifest(spark, path)
        trusted = X.verified(self.exhibits, logged) if logged is not None else self.exhibits
        self.events = materialize(events(X.records(trusted)))
        self._made: dict[str, DataFrame] = {}

    @classmethod
    def of_events(cls, spark: SparkSession, found: DataFrame, max_depth: int = 6) -> Case:
        """A case of canonical events that were read elsewhere; it has no exhibits."""
        case = cls.__new__(cls)
        case.spark, case.max_depth, case.exhibits, case.events, case._made = spark, max_depth, None, materialize(found), {}
        return case

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialize(make())
        return self._made[name]

    @property
    def observations(self) -> DataFrame:
        return self._once("observations", lambda: self.events.select("event_id", "seq", "ts", "kind", "exhibit", "lure_score", "apk_risk", "flags", F.explode("entities").alias("e")).select("*", "e.*").drop("e"))

    @property
    def links(self) -> DataFrame:
        return self._once("links", lambda: self.events.select("event_id", "seq", "ts", "exhibit", F.explode("links").alias("l")).select("*", "l.*").drop("l"))

    @property
    def transfers(self) -> DataFrame:
        """Moved funds; a transaction without a counterparty pays CASH or is paid by SELF."""

        def make():
            txn = self.events.filter("kind = 'TXN' and amount <> 0")
            moved = F.get(F.filter("links", lambda x: x["rel"] == "FUNDS"), F.lit(0))
            t = txn.select("event_id", "seq", "ts", "amount", "cashout", "crypto", "flow", moved.alias("m")).filter("m is not null or flow is not null")
            out = F.col("flow.direction") == "DR"
            src = F.coalesce(F.col("m.src"), F.when(out, F.col("flow.node")).otherwise("SELF"))
            dst = F.coalesce(F.col("m.dst"), F.when(out, F.lit("CASH")).otherwise(F.col("flow.node")))
            return T.mark_duplicates(t.select("event_id", "seq", "ts", "amount", "cashout", "crypto", src.alias("src"), dst.alias("dst")))

        return self._once("transfers", make)

    @property
    def funds(self) -> DataFrame:
        return self.transfers.filter("not corroborated and src <> 'SELF' and dst <> 'CASH'")

    @property
    def flows(self) -> DataFrame:
        return self._once("flows", lambda: T.node_flows(self.transfers).filter("node not in ('SELF', 'CASH')"))

    @property
    def nodes(self) -> DataFrame:
        """``node, type, roles, exhibits, events, first, last, victim, reported, sha256, risk``; metadata from the first event that has it."""

        def make():
            first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
            return self.observations.groupBy("node", "type").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("exhibit")).alias("exhibits"), F.count_distinct("event_id").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.bool_or("victim").alias("victim"), F.bool_or("reported").alias("reported"), first("sha256"), first("risk"))

        return self._once("nodes", make)

    @property
    def edges(self) -> DataFrame:
        """One row per pair and relation; undirected ones as first seen."""

        def make():
            same = F.when(F.col("directed"), F.concat_ws(">", "src", "dst")).otherwise(F.concat_ws("~", F.least("src", "dst"), F.greatest("src", "dst")))
            twice = self.links.join(self.transfers.filter("corroborated").select("event_id", F.lit(True).alias("twice")), "event_id", "left").withColumn("twice", F.coalesce("twice", F.lit(False)))
            g = twice.groupBy(same.alias("_key"), "rel", "directed").agg(F.min_by("src", "seq").alias("src"), F.min_by("dst", "seq").alias("dst"), F.count("*").alias("count"), F.count_if("twice").alias("corroborated"), F.sum(F.when(~F.col("twice"), T.cents("amount"))).cast("double").alias("amount"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.slice(F.array_sort(F.collect_set("event_id")), 1, 200).alias("events"))
            return g.drop("_key")

        return self._once("edges", make)

    @property
    def clusters(self) -> DataFrame:
        return self._once("clusters", lambda: connected_components(self.links.filter(F.col("rel").isin(*R.IDENTITY)).select("src", "dst")))

    @property
    def victims(self) -> DataFrame:
        """Victims as the complaint names them, and what is one identity with them."""

        def make():
            named = self.nodes.filter("victim").select("node")
            whole = named.join(self.clusters, "node").select("component").distinct().join(self.clusters, "component").select("node")
            return named.unionByName(whole).distinct()

        return self._once("victims", make)

    @property
    def probable_victims(self) -> DataFrame:
        """Other payers to the same collectors; who draws cash or crypto-currency is none."""

        def make():
            cash = self.transfers.filter("cashout or crypto").select(F.col("src").alias("node")).distinct()
            return T.additional_victims(self.funds, self.victims).join(cash, "node", "left_anti")

        return self._once("probable", make)

    @property
    def findings(self) -> DataFrame:
        def make():
            l, c, v = self.links.select("src", "dst", "rel").distinct(), self.clusters, self.victims
            roles = self.observations.select("node", "role").distinct()
            apks = self.nodes.filter("type = 'APK'")
            seen = self.observations.filter("ts is not null").select("node", "ts")
            turned = l.withColumns({"src": F.when(F.col("rel") == "SIM_IN_HANDSET", F.col("dst")).otherwise(F.col("src")), "dst": F.when(F.col("rel") == "SIM_IN_HANDSET", F.col("src")).otherwise(F.col("dst"))})
            parts = [R.shared_handset(l), R.sim_velocity(turned, seen), R.handset_hop(l), R.shared_ip(l, c, v), R.shared_subnet(l, c, v), R.shared_hardware(l), R.fan_in(l), R.equal_packages(apks.select("node", "sha256")), R.malicious_packages(apks.select("node", "risk")), R.domain_pivot(l), R.name_reuse(l, c), R.masked_match(self.nodes.select("node")), R.rail_bridge(l, roles), R.additional_victims(self.probable_victims)]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return R.evidence(materialize(out), self.observations)

        return self._once("findings", make)

    @property
    def origins(self) -> DataFrame:
        """Financial nodes of the victims, or else the node with the largest net loss."""
        own = self._once("own", lambda: self.victims.filter(R.kind_of("node").isin(*MONEY_TYPES)).join(self.flows.filter("out_count > 0").select("node"), "node"))
        return own if own.limit(1).count() else G.default_origins(self.flows)

    @property
    def hops(self) -> DataFrame:
        return self._once("hops", lambda: G.trace(self.funds, self.origins, self.max_depth))

    @property
    def cash_outs(self) -> DataFrame:
        """``node, event_id, mode, amount``: withdrawals by the account that made them."""
        t = self.transfers.filter("not corroborated and (cashout or crypto) and src <> 'SELF'")
        return t.select(F.col("src").alias("node"), "event_id", F.when(F.col("crypto"), "CRYPTO").otherwise("CASH").alias("mode"), "amount", "ts")

    @property
    def layers(self) -> DataFrame:
        return self._once("layers", lambda: G.layers(self.hops, self.origins))

    @property
    def reasons(self) -> DataFrame:
        def make():
            money = S.financial_reasons(self.transfers, self.layers, self.cash_outs).filter("node not in ('SELF', 'CASH')").join(self.victims, "node", "left_anti")
            o = self.observations
            lure = o.filter("lure_score >= 40").filter(F.col("role").isin("a_party", "sender", "sms_peer", "chat_sender"))
            spoof = o.filter("kind = 'EMAIL' and role = 'sender'").filter(F.arrays_overlap("flags", F.array(F.lit("Return-Path differs from sender"), F.lit("Reply-To differs from sender"), F.lit("sender authentication failed"))))
            host = o.filter("apk_risk >= 55 and role = 'package'")
            first = self.debits.agg(F.min("ts").alias("debit_ts"))
            talks = self.links.filter("rel in ('CALL', 'SMS')").select("event_id", F.col("ts").alias("contact_ts"), F.explode(F.array(F.struct(F.col("src").alias("me"), F.col("dst").alias("node")), F.struct(F.col("dst").alias("me"), F.col("src").alias("node")))).alias("x")).select("event_id", "contact_ts", "x.me", "x.node")
            near = talks.join(self.victims.withColumnRenamed("node", "me"), "me", "left_semi").join(self.victims, "node", "left_anti").withColumn("all", F.lit(1))
            calls = T.contacts_before(near, first.filter("debit_ts is not null").withColumn("all", F.lit(1)), "all").select("node", "event_id").distinct()
            return money.unionByName(S._reasons(lure, "LURE_SENDER")).unionByName(S._reasons(spoof, "SPOOFED_HEADER")).unionByName(S._reasons(host, "MALWARE_HOST")).unionByName(S._reasons(calls, "PRE_TXN_CONTACT")).unionByName(S.carried(self.findings))

        return self._once("reasons", make)

    @property
    def scores(self) -> DataFrame:
        return self._once("scores", lambda: S.scores(self.reasons, self.victims, self.probable_victims))

    @property
    def suspects(self) -> DataFrame:
        ranked = self.scores.filter(R.kind_of("node").isin("ACCOUNT", "UPI", "PHONE", "EMAIL", "PERSON")).join(self.probable_victims, "node", "left_anti")

        def make():
            out = S.suspects(ranked, self.clusters, self.flows, self.layers, self.victims).drop("reasons")
            return out.join(S.main_reasons(self.reasons, self.clusters), "cluster", "left")

        return self._once("suspects", make)

    @property
    def evidence(self) -> DataFrame:
        """``node, code, evidence``: the events behind each reason."""
        return self._once("evidence", lambda: S.reason_evidence(self.reasons, self.findings, self.transfers, self.observations))

    @property
    def paths(self) -> DataFrame:
        """The 25 heaviest routes of the trail."""
        return G.paths(self.hops)

    def summary(self) -> DataFrame:
        """``kind, events, entities, first, last``"""
        entities = self.observations.groupBy("kind").agg(F.count_distinct("node").alias("entities"))
        return self.events.groupBy("kind").agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last")).join(entities, "kind", "left")

    @property
    def cash_totals(self) -> DataFrame:
        """``node, mode, count, amount, first, last``: what each node drew, and when."""
        return self.cash_outs.groupBy("node", "mode").agg(F.count("*").alias("count"), F.sum(T.cents("amount")).cast("double").alias("amount"), F.min("ts").alias("first"), F.max("ts").alias("last"))

    @property
    def holders(self) -> DataFrame:
        """``component, nodes, holders``: clusters of two nodes or more, and who holds them."""
        held = self.links.filter("rel = 'HOLDS'").select(F.col("src").alias("holder"), F.col("dst").alias("node")).distinct()
        every = self.clusters.join(held, "node", "left").groupBy("component").agg(F.count_distinct("node").alias("nodes"), F.array_sort(F.collect_set("holder")).alias("holders"))
        return every.filter("nodes >= 2")

    def loss(self) -> DataFrame:
        """``fraud_total, first_debit``: the debits in question, counted once; without any the complaint's amount."""
        once = self.debits.withColumn("minute", F.date_trunc("MINUTE", "ts")).dropDuplicates(["amount", "minute"])
        paid = once.agg(F.sum(T.cents("amount")).cast("double").alias("paid"), F.min("ts").alias("first_debit"))
        said = self.events.filter("kind = 'COMPLAINT'").agg(F.max("amount").alias("said"))
        return paid.withColumn("one", F.lit(1)).join(said.withColumn("one", F.lit(1)), "one").select(F.coalesce("paid", "said").alias("fraud_total"), "first_debit")

    @property
    def debits(self) -> DataFrame:
        """What victims paid from six hours before the complaint on, of 2 % of its amount or more: ordinary spending isn't part of the fraud."""

        def make():
            paid = self.transfers.filter("not corroborated and src <> 'SELF'").join(self.victims.withColumnRenamed("node", "src"), "src", "left_semi")
            case = self.events.filter("kind = 'COMPLAINT' and sub = 0").agg(F.min("ts").alias("c_ts"), F.max("amount").alias("c_amount")).first()
            if case and case.c_ts:
                paid = paid.filter(F.col("ts").isNull() | (F.col("ts") >= F.lit(case.c_ts).cast("timestamp_ntz") - F.expr("interval 6 hours")))
            return paid.filter(F.col("amount") >= 0.02 * case.c_amount) if case and case.c_amount else paid

        return self._once("debits", make)

    def timeline(self, top: int = 40) -> DataFrame:
        """The heaviest events in order of time; weight: flags, lures and money."""
        weight = F.size("flags") * 2 + F.coalesce(F.col("lure_score") / 20, F.lit(0)) + F.when(F.col("amount") > 0, 3).otherwise(0)
        best = self.events.withColumn("weight", weight).orderBy(F.col("weight").desc(), "seq").limit(top)
        return best.orderBy(F.col("ts").asc_nulls_last(), "seq").select("event_id", "kind", "ts", "amount", "flags", "weight")

    def recommendations(self) -> DataFrame:
        """``priority, action, target``: what to do next, most urgent first."""
        s = self.suspects.filter("band in ('CRITICAL', 'HIGH')")
        rows = [
            s.select(F.when(F.col("band") == "CRITICAL", 1).otherwise(2).alias("priority"), F.lit("freeze and serve notice").alias("action"), F.col("primary").alias("target")),
            self.findings.filter("code rlike '^(SHARED-HANDSET|SIM-VELOCITY|SHARED-HW)'").select(F.lit(2).alias("priority"), F.lit("trace the device").alias("action"), F.col("entity").alias("target")),
            self.findings.filter("code rlike '^(APK-HASH|MALICIOUS-APK)'").select(F.lit(2).alias("priority"), F.lit("report the package").alias("action"), F.col("entity").alias("target")),
            self.findings.filter("code rlike '^(SHARED-IP|SHARED-SUBNET)'").select(F.lit(3).alias("priority"), F.lit("ask the provider for subscribers").alias("action"), F.col("entity").alias("target")),
            self.findings.filter("code rlike '^DOMAIN-PIVOT'").select(F.lit(3).alias("priority"), F.lit("take the domain down").alias("action"), F.col("entity").alias("target")),
            self.cash_outs.filter("mode = 'CASH'").select(F.lit(1).alias("priority"), F.lit("secure camera footage").alias("action"), F.col("node").alias("target")),
            self.loss().select(F.lit(1).alias("priority"), F.lit("report the loss to the national portal").alias("action"), F.lit("case").alias("target")),
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.distinct().orderBy("priority", "action", "target")

    def graph(self, top: int = 600) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges to draw: victims, then the highest scores, then the busiest."""
        n = self.nodes.join(self.scores.select("node", "score"), "node", "left").orderBy(F.col("victim").desc(), F.coalesce("score", F.lit(0)).desc(), F.col("events").desc(), "node").limit(top)
        n = materialize(n)
        keep = F.broadcast(n.select("node"))
        e = self.edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
        return n, e

    def brief(self, suspects: int = 12) -> dict:
        """A summary as plain values, with a digest over it; only bounded lists come to the driver."""
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        out = {
            "exhibits": rows(X.custody(self.exhibits).select("exhibit", "source", "size", "sha256", "seal")),
            "loss": rows(self.loss()),
            "counts": rows(self.events.groupBy("kind").count().orderBy("kind")),
            "suspects": rows(S.ranked(self.suspects, suspects)),
            "findings": rows(self.findings.orderBy(F.col("score").desc(), "code").limit(50)),
            "traced": rows(G.traced_total(self.hops)),
            "paths": rows(self.paths),
            "cash_outs": rows(self.cash_totals.orderBy(F.col("amount").desc(), "node", "mode").limit(50)),
            "timeline": rows(self.timeline()),
            "recommendations": rows(self.recommendations().limit(50)),
        }
        text = json.dumps(out, sort_keys=True, separators=(",", ":"), default=str)
        return out | {"report_sha256": hashlib.sha256(text.encode()).hexdigest()}

    def export(self, path: str) -> None:
        """Write events and findings as JSON, by Spark."""
        self.events.write.mode("overwrite").json(f"{path}/events")
        self.findings.write.mode("overwrite").json(f"{path}/findings")
        brief = json.dumps(self.brief(), sort_keys=True, default=str)
        self.spark.createDataFrame([(brief,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/brief")
