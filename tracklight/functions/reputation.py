"""Reputation services: the request for an indicator and the meaning of a response. No network is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklight.functions.ioc import refang

# Addresses and paths of the two services.
VT_API, VT_GUI = "https://www.virustotal.com/api/v3", "https://www.virustotal.com/gui"
ABUSE_API, ABUSE_GUI = "https://api.abuseipdb.com/api/v2/check", "https://www.abuseipdb.com/check"
#: Paths of the first service's API and pages by indicator type.
VT_PATHS = {
    "ip": ("ip_addresses", "ip-address"),
    "domain": ("domains", "domain"),
    "hash": ("files", "file"),
    "url": ("urls", "url"),
    "email": ("domains", "domain"),
}


def encode_component(text: Column) -> Column:
    """Percent-encoding of a URL's part, with the marks that need none left alone."""
    out = F.url_encode(text)
    for code, mark in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, code, mark)
    return out


def url_id(url: Column) -> Column:
    """Base64 of a URL for use in URLs, without padding."""
    return F.regexp_replace(F.translate(F.base64(F.encode(url, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def requests(kind: Column, value: Column, virustotal: bool = True, abuseipdb: bool = True) -> Column:
    """array<struct<provider, queried, url, link>> for the services that know the type and have a key."""
    real = refang(value)
    queried = F.when(kind == "email", F.element_at(F.split(real, "@"), -1)).otherwise(real)
    name = encode_component(F.when(kind == "url", url_id(real)).otherwise(queried))
    paths = [F.element_at(F.create_map(*[F.lit(x) for k, v in VT_PATHS.items() for x in (k, v[i])]), kind) for i in (0, 1)]
    first = F.struct(
        F.lit("virustotal").alias("provider"),
        queried.alias("queried"),
        F.concat(F.lit(VT_API + "/"), paths[0], F.lit("/"), name).alias("url"),
        F.concat(F.lit(VT_GUI + "/"), paths[1], F.lit("/"), name).alias("link"),
    )
    part = encode_component(real)
    second = F.struct(
        F.lit("abuseipdb").alias("provider"),
        real.alias("queried"),
        F.concat(F.lit(ABUSE_API + "?ipAddress="), part, F.lit("&maxAgeInDays=90")).alias("url"),
        F.concat(F.lit(ABUSE_GUI + "/"), part).alias("link"),
    )
    wanted = []
    if virustotal:
        wanted.append(F.when(paths[0].isNotNull() & ((kind != "email") | queried.contains(".")), first))
    if abuseipdb:
        wanted.append(F.when(kind == "ip", second))
    return F.array_compact(F.array(*wanted)) if wanted else F.array()


def skipped(kind: Column, virustotal: bool, abuseipdb: bool) -> Column:
    """Services that know the type but have no key."""
    out = [] if virustotal else [F.lit("virustotal")]
    if not abuseipdb:
        out.append(F.when(kind == "ip", "abuseipdb"))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def outcome(provider: Column, status: Column, body: Column) -> Column:
    """struct(verdict, summary) of a response; what can't be read is unknown."""
    json = F.try_parse_json(body)

    def number(path: str) -> Column:
        return F.try_variant_get(json, path, "double")

    def says(verdict: str, summary: Column | str) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), (F.lit(summary) if isinstance(summary, str) else summary).alias("summary"))

    whole = lambda x: x.cast("long").cast("string")
    is_vt = provider == "virustotal"
    data = F.try_variant_get(json, "$.data", "variant")
    readable = data.isNotNull() & (F.substring(F.to_json(data), 1, 1).isin("{", "["))
    stats = F.try_variant_get(json, "$.data.attributes.last_analysis_stats", "variant")
    bad, odd, fine, none = (
        F.coalesce(number(f"$.data.attributes.last_analysis_stats.{x}"), F.lit(0.0))
        for x in ("malicious", "suspicious", "harmless", "undetected")
    )
    total = bad + odd + fine + none
    score = number("$.data.abuseConfidenceScore")
    reports = F.coalesce(number("$.data.totalReports"), F.lit(0.0))
    detail = F.concat(whole(score), F.lit("% confidence · "), whole(reports), F.when(reports == 1, " report").otherwise(" reports"))
    return (
        F.when(status.isin(401, 403), says("unknown", "key rejected"))
        .when(status == 429, says("unknown", "rate limited — retry shortly"))
        .when((status == 404) & is_vt, says("unknown", "not found in VirusTotal"))
        .when(status == 404, says("unknown", "not found"))
        .when(status != 200, says("unknown", F.concat(F.lit("request failed (HTTP "), status.cast("string"), F.lit(")"))))
        .when(json.isNull() | ~F.coalesce(readable, F.lit(False)), says("unknown", "unreadable response"))
        .when(is_vt & (stats.isNull() | (total == 0)), says("unknown", "no analysis available"))
        .when(is_vt & (bad > 0), says("malicious", F.concat(whole(bad), F.lit("/"), whole(total), F.lit(" vendors flag malicious"))))
        .when(is_vt & (odd > 0), says("suspicious", F.concat(whole(odd), F.lit("/"), whole(total), F.lit(" vendors flag suspicious"))))
        .when(is_vt, says("clean", F.concat(F.lit("0/"), whole(total), F.lit(" vendors flag it"))))
        .when(score.isNull(), says("unknown", "unreadable response"))
        .when(score >= 75, says("malicious", detail))
        .when(score >= 25, says("suspicious", detail))
        .when(reports == 0, says("clean", "no reports"))
        .otherwise(says("clean", detail))
    )
