"""A small planted case through all layers: containers, events, graph, rules, trail, suspects."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

VICTIM, MULE, LAST = "11112222333344", "55556666777788", "99990000111122"


def sheet(rows):
    """A minimal workbook with inline strings and numbers."""
    body = ""
    for r, row in enumerate(rows, 1):
        cells = ""
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            cells += f'<c r="{at}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if v else ""
        body += f'<row r="{r}">{cells}</row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("case")
    bank = "Statement of account\nBranch: Main\nAccount No,Account Holder,Txn Date,Narration,Ref No,Withdrawal Amt,Deposit Amt,Beneficiary Name,Beneficiary Account,Registered Mobile\n"
    bank += f"{VICTIM},ASHA RAO,08/09/2026 10:32:00,UPI/pay/mule@okbank/x,R1,\"1,00,000.00\",,M K,{MULE},9876543210\n"
    bank += f"{VICTIM},ASHA RAO,08/09/2026 10:40:00,NEFT,R2,\"50,000.00\",,M K,{MULE},9876543210\n"
    bank += f"{VICTIM},ASHA RAO,01/09/2026 09:00:00,groceries,R0,500,,Shop,44445555666677,9876543210\n"
    (d / "bank.csv").write_text(bank)
    rows = [["ACCT NO", "CUSTOMER NAME", "VALUE DATE", "PARTICULARS", "UTR", "DR", "CR", "COUNTERPARTY ACCOUNT", "REGISTERED MOBILE"]]
    rows.append([MULE, "M K", 46273 + (10 * 60 + 32) / 1440, "credit", "U1", "", 100000, VICTIM, "9123456789"])
    rows.append([MULE, "M K", "08-Sep-2026 10:50:00", "out", "U2", 120000, "", LAST, "9123456789"])
    rows.append([MULE, "M K", "08-Sep-2026 11:20:00", "ATM WDL", "U3", 20000, "", "", "9123456789"])
    (d / "mule.xlsx").write_bytes(sheet(rows))
    calls = "caller|called|type|start_time|dur_sec|imei|imsi\n"
    for i, n in enumerate(("9123456789", "9123456780", "9123456781")):
        calls += f"{n}|9876543210|OUT|2026-09-08 0{9 + i if i < 1 else 8 - i}:50:00|60|35987104225664{i}|40401000000000{i}\n" * 2
    (d / "cdr.txt").write_text(calls)
    (d / "chat.txt").write_text("08/09/2026, 09:00 - System notice\n08/09/2026, 09:01 - Ravi: rent your account, give me your account\nand use your account\n08/09/2026, 09:02 - Ravi: a/c no 123456789012 pay x@okbank\n08/09/2026, 09:03 - Mahendra: ok 123456\n")
    (d / "mail.eml").write_bytes(b"From: SBI Rewards <a@rewardz.xyz>\nReturn-Path: <b@other.top>\nTo: asha@mail.example.com\nSubject: KYC expire urgent\nDate: Tue, 08 Sep 2026 08:00:00 +0530\nReceived: from x [45.67.89.10] by y\nAuthentication-Results: mx; spf=fail; dkim=none\nContent-Type: text/html\n\n<a href=\"http://sbi-kyc-update.xyz/a.apk\">share otp, account will be blocked</a>")
    dump = {"device": {"imei": ["359871042256640"], "wifi_mac": "AA:BB:CC:00:11:22"}, "extraction_time": "2026-09-09 10:00:00", "sim": [{"msisdn": "+919123456789", "imsi": "404010000000000"}], "installed_packages": [{"package": p, "sha256": "ab" * 32, "permissions": ["READ_SMS", "RECEIVE_SMS", "SEND_SMS", "BIND_ACCESSIBILITY_SERVICE", "SYSTEM_ALERT_WINDOW"], "contacted_hosts": ["c2.example.top"]} for p in ("com.sbi.rewards", "com.rewards.sbi")], "sms": [{"address": "9876543210", "type": "sent", "body": "share otp cvv kyc urgent anydesk"}]}
    (d / "phone.json").write_text(json.dumps(dump))
    (d / "complaint.json").write_text(json.dumps({"acknowledgement_no": "A1", "incident_time": "2026-09-08 12:00:00", "amount": "1,50,000", "victim": {"name": "asha rao", "phone": "9876543210", "account": VICTIM}, "suspects": [{"phone": "9123456789"}]}))
    (d / "empty.csv").write_text("")
    (d / "bad.json").write_text("{no")
    (d / "prose.txt").write_text("nothing to see here, move on")
    return str(d)


@pytest.fixture(scope="module")
def case(spark, folder):
    from tracewell.plans.case import Case

    return Case(spark, folder)


def test_types_and_robustness(case):
    kinds = {r.source: r.kinds for r in case.events.groupBy("source").agg(F.collect_set("kind").alias("kinds")).collect()}
    assert kinds["bank.csv"] == ["TXN"] and kinds["mule.xlsx"] == ["TXN"] and kinds["cdr.txt"] == ["CALL"] and kinds["chat.txt"] == ["CHAT"]
    assert kinds["mail.eml"] == ["EMAIL"] and set(kinds["phone.json"]) == {"DEVICE", "APP_INSTALL", "SMS"} and kinds["complaint.json"] == ["COMPLAINT"]
    assert not {"empty.csv", "bad.json", "prose.txt"} & set(kinds)
    assert case.events.select("event_id").distinct().count() == case.events.count()


def test_dates_and_amounts(case):
    rows = {r.reference: (str(r.ts), r.amount, r.direction) for r in case.events.filter("kind = 'TXN'").collect()}
    assert rows["R1"] == ("2026-09-08 10:32:00", 100000.0, "DR") and rows["U1"] == ("2026-09-08 10:32:00", 100000.0, "CR") and rows["U2"][0] == "2026-09-08 10:50:00"


def test_transfer_in_two_statements_counts_once(case):
    flows = {r.node: r for r in case.flows.collect()}
    assert flows[f"ACCOUNT|{MULE}"].in_amount == 150000.0 and flows[f"ACCOUNT|{MULE}"].out_amount == 140000.0


def test_loss_leaves_out_groceries(case):
    r = case.loss().first()
    assert r.fraud_total == 150000.0 and str(r.first_debit) == "2026-09-08 10:32:00"


def test_findings(case):
    codes = {r.code: r.severity for r in case.findings.collect()}
    assert codes["SHARED-HANDSET-IMEI|35987104225664"] == "HIGH" and codes["SIM-VELOCITY-IMEI|35987104225664"] == "HIGH"
    assert codes["APK-HASH-" + "ab" * 32] == "HIGH" and codes["MALICIOUS-APK-APK|com.sbi.rewards"] == "CRITICAL"


def test_clusters_join_account_and_mobile_but_not_names(case):
    of = {r.node: r.component for r in case.clusters.collect()}
    assert of[f"ACCOUNT|{MULE}"] == of["PHONE|9123456789"] != of[f"ACCOUNT|{VICTIM}"]
    assert not any(n.startswith("PERSON|") for n in of)


def test_trail_and_cash(case):
    layers = {r.node: r.layer for r in case.layers.collect()}
    assert layers[f"ACCOUNT|{MULE}"] == 1 and layers[f"ACCOUNT|{LAST}"] == 2
    assert [(r.node, r.mode) for r in case.cash_outs.collect()] == [(f"ACCOUNT|{MULE}", "CASH")]


def test_suspects_exclude_the_victim(case):
    top = case.suspects.orderBy(F.col("score").desc()).collect()
    assert top[0].primary in (f"ACCOUNT|{MULE}", "PHONE|9123456789") and top[0].score >= 55
    assert not any(VICTIM in r.primary or "9876543210" in r.primary for r in top)


def test_mail_flags(case):
    flags = case.events.filter("kind = 'EMAIL'").first().flags
    assert {"Return-Path differs from sender", "sender authentication failed", "display name claims a brand", "risky link in mail"} <= set(flags)


def test_chat_is_stitched_and_names_are_no_numbers(case):
    rows = case.events.filter("kind = 'CHAT'").orderBy("row").collect()
    assert len(rows) == 3 and "use your account" in rows[0].text and rows[0].lure_score >= 40
    nodes = {e.node for r in rows for e in r.entities}
    assert "PERSON|Mahendra" in nodes and "ACCOUNT|123456789012" in nodes and "ACCOUNT|123456" not in nodes


def test_tampered_exhibit_gives_no_events(spark, folder):
    from tracewell.sources import exhibits as X

    found = X.manifest(spark, folder)
    logged = found.select("path", F.when(F.col("source") == "bank.csv", "0").otherwise(F.col("sha256")).alias("sha256"))
    assert "bank.csv" not in {r.source for r in X.verified(found, logged).select("source").collect()}


def test_large_tables_are_read_by_spark(spark, folder):
    from tracewell.sources.exhibits import read_delimited

    t = read_delimited(spark, f"{folder}/bank.csv")
    assert t.filter("debit is not null").count() == 3 and {"account", "narration", "cp_account"} <= set(t.columns)


def test_brief(case):
    b = case.brief()
    assert b["recommendations"] and b["timeline"] and len(b["report_sha256"]) == 64
    nodes, edges = case.graph(5)
    assert nodes.count() == 5 and edges.count() >= 1
