"""SLA clock, dates, indicators and reputation on literal rows."""

import pytest
from pyspark.sql import functions as F

from test_query_language import CTX, make
from tracklight.functions import dates, ioc, reputation, sla


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_clock(spark):
    at = "2026-07-30T%s:00Z"
    rows = make(
        spark,
        {"issue_type": "incident", "severity": "sev1", "detected_at": at % "11:30"},
        {"issue_type": "incident", "severity": "sev1", "detected_at": at % "11:10"},
        {"issue_type": "incident", "severity": "sev1", "detected_at": at % "07:00", "responded_at": at % "07:30"},
        {"issue_type": "incident", "severity": "sev1", "detected_at": at % "07:00", "resolved_at": at % "10:59"},
        {"issue_type": "incident", "severity": "sev5", "detected_at": at % "07:00"},
        {"issue_type": "task", "severity": "sev1", "detected_at": at % "07:00"},
        {"issue_type": "incident", "severity": "sev1", "detected_at": "garbage"},
    )
    s = sla.sla_state(CTX)
    out = {r.id: (r.b, r.c and r.c.text) for r in rows.select("id", sla.sla_bucket(s).alias("b"), sla.chip(s).alias("c")).collect()}
    assert out == {
        "0": ("ok", "Respond 30m"), "1": ("warn", "Respond 10m"), "2": ("breached", "Resolve +1h 00m"), "3": ("ok", None),
        "4": ("none", None), "5": ("none", None), "6": ("none", None),
    }


def test_dates(spark):
    rows = make(spark, {"due": "2026-07-28"}, {"due": "2026-08-02"}, {"due": "2026-08-06"}, {"due": "2026-07-28", "status": "done", "completed": "2026-07-30"})
    out = rows.select(dates.relative_due(CTX).alias("r"), dates.due_urgency(CTX).alias("u"), dates.completion_outcome().alias("o")).collect()
    assert [tuple(r) for r in out] == [
        ("2d overdue", "overdue", None), ("In 3d", "normal", None), (None, "normal", None), ("2d overdue", "normal", "2d late")
    ]
    day = lambda x: dates.iso_week_label(F.lit(x).cast("date"))
    assert tuple(one(spark, day("2027-01-01"), day("2026-07-30"))) == ("2026-W53", "2026-W31")


@pytest.mark.parametrize(
    ("raw", "real", "kind", "shown"),
    [
        (" hxxps://evil[.]com/a ", "https://evil.com/a", "url", "hxxps://evil[.]com/a"),
        ("HXXP://E.com", "HTTP://E.com", "url", "HXXP://E[.]com"),
        ("1(.)2[.]3.4", "1.2.3.4", "ip", "1[.]2[.]3[.]4"),
        ("a[AT]b[.]io", "a@b.io", "email", "a[at]b[.]io"),
        ("fe80[:]:1", "fe80::1", "ip", "fe80::1"),
        ("D41D8CD98F00B204E9800998ECF8427E", "D41D8CD98F00B204E9800998ECF8427E", "hash", "D41D8CD98F00B204E9800998ECF8427E"),
        ("evil[.]com", "evil.com", "domain", "evil[.]com"),
    ],
)
def test_fangs(spark, raw, real, kind, shown):
    r = ioc.refang(F.lit(raw))
    out = one(spark, r.alias("r"), ioc.refang(r).alias("again"), ioc.classify(r).alias("k"), ioc.defang(r, ioc.classify(r)).alias("d"), ioc.refang(ioc.defang(r, ioc.classify(r))).alias("back"))
    assert (out.r, out.again, out.k, out.d, out.back) == (real, real, kind, shown, real)


def test_extract(spark):
    note = (
        "Beacon to hxxps://evil[.]com/x?y=1, from 10.0.0.5 and 300.1.1.1.\nMail bad(at)corp[.]de; file.js loads d41d8cd98f00b204e9800998ecf8427e.\n"
        "See evil.com, EVIL[.]com and café1.2.3.4 or intra[.]net[.]local"
    )
    rows = spark.createDataFrame([(note,), (None,), ("",)], "t string")
    out = rows.select(ioc.extract("t", F.array(F.lit("10[.]0[.]0[.]5"))).alias("i")).collect()
    assert [(i.type, i.value) for i in out[0].i] == [
        ("url", "https://evil.com/x?y=1"), ("domain", "evil.com"), ("email", "bad@corp.de"), ("domain", "corp.de"),
        ("hash", "d41d8cd98f00b204e9800998ecf8427e"), ("ip", "1.2.3.4"), ("domain", "intra.net.local"),
    ]
    assert out[1].i == [] and out[2].i == []


def test_paste(spark):
    rows = spark.createDataFrame([("a[.]com, b.com\nA.com c@d.io",)], "t string")
    out = rows.select(ioc.parse_paste("t", F.array(F.lit("B.COM"))).alias("i")).first()
    assert [(i.type, i.value) for i in out.i] == [("domain", "a.com"), ("email", "c@d.io")]


@pytest.mark.parametrize(
    ("provider", "status", "body", "verdict", "summary"),
    [
        ("virustotal", 200, '{"data":{"attributes":{"last_analysis_stats":{"malicious":2,"harmless":8}}}}', "malicious", "2/10 vendors flag malicious"),
        ("virustotal", 200, '{"data":{"attributes":{}}}', "unknown", "no analysis available"),
        ("virustotal", 404, "", "unknown", "not found in VirusTotal"),
        ("abuseipdb", 200, '{"data":{"abuseConfidenceScore":80,"totalReports":1}}', "malicious", "80% confidence · 1 report"),
        ("abuseipdb", 200, '{"data":{"abuseConfidenceScore":0}}', "clean", "no reports"),
        ("abuseipdb", 200, "[1", "unknown", "unreadable response"),
        ("abuseipdb", 200, "null", "unknown", "unreadable response"),
        ("abuseipdb", 429, "", "unknown", "rate limited — retry shortly"),
        ("abuseipdb", 500, "", "unknown", "request failed (HTTP 500)"),
    ],
)
def test_reputation(spark, provider, status, body, verdict, summary):
    o = one(spark, reputation.outcome(F.lit(provider), F.lit(status), F.lit(body)).alias("o")).o
    assert (o.verdict, o.summary) == (verdict, summary)


def test_requests(spark):
    kind, value = F.lit("url"), F.lit("hxxp://e[.]com/?a>b")
    r = one(spark, reputation.requests(kind, value).alias("r"), reputation.skipped(F.lit("ip"), False, False).alias("s"))
    assert r.r[0].url == "https://www.virustotal.com/api/v3/urls/aHR0cDovL2UuY29tLz9hPmI" and len(r.r) == 1
    assert r.s == ["virustotal", "abuseipdb"]
