"""Indicators of compromise in text: refang, defang, classify, extract. Columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the case files mean it: with the Unicode spaces.
SPACE = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Borders of ASCII words, before and after; Java's own border knows more letters.
_START, _END = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
_DOT = r"(?:\[\.\]|\(\.\)|\.)"
#: Shapes of indicators in prose, real or defanged, in the order that decides between equals. With each a quick test that any text
#: with a match passes.
SHAPES = (
    ("url", rf"(?i){_START}h(?:xx|tt)ps?(?:\[:\]|:)//[^{SPACE}<>\"')]+", lambda t: t.contains("//")),
    ("ip", rf"{_START}\d{{1,3}}(?:{_DOT}\d{{1,3}}){{3}}{_END}", lambda t: t.rlike(rf"\d{_DOT}\d")),
    ("hash", rf"(?i){_START}(?:[a-f0-9]{{64}}|[a-f0-9]{{40}}|[a-f0-9]{{32}}){_END}", lambda t: t.rlike("[A-Fa-f0-9]{32}")),
    (
        "email",
        rf"(?i){_START}[\w.+-]+(?:@|\[at\]|\(at\))[\w-]+(?:{_DOT}[\w-]+)+{_END}",
        lambda t: t.contains("@") | t.rlike(r"(?i)[\[(]at[\])]"),
    ),
    ("defanged", rf"{_START}[\w-]++(?:(?:\[\.\]|\(\.\))[\w-]+)+{_END}", lambda t: t.contains("[.]") | t.contains("(.)")),
    ("bare", rf"{_START}[\w-]++(?:\.[\w-]+)+{_END}", lambda t: t.rlike(r"[\w-]\.[\w-]")),
)
#: Last labels that make a bare name in prose a domain.
BARE_TLDS = (
    "com net org io ru cn info biz co uk de fr xyz top online site club live pw cc su tk ws".split()
)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def refang(value: Column | str) -> Column:
    """The real indicator: hxxp, [.], (.), [at], (at), [@] and [:] undone, white space trimmed. Idempotent."""
    v = trim_space(value)
    v = F.regexp_replace(v, "^HXXP", "HTTP")
    v = F.regexp_replace(v, "^(?i:hxxp)", "http")
    v = F.regexp_replace(v, r"[\[(]\.[\])]", ".")
    v = F.regexp_replace(v, r"(?i)[\[(]at[\])]", "@")
    v = F.regexp_replace(v, r"\[@\]", "@")
    return F.regexp_replace(v, r"\[:\]", ":")


def defang(value: Column | str, kind: Column | str) -> Column:
    """The indicator made safe to show: http as hxxp, dots as [.], @ of emails and URLs as [at]. Hashes stay."""
    value, kind = _col(value), _col(kind)
    lead = rf"^([{SPACE}]*)"
    v = F.regexp_replace(value, lead + "HTTP", "$1HXXP")
    v = F.regexp_replace(v, lead + "(?i:http)", "$1hxxp")
    v = F.regexp_replace(v, r"\.", "[.]")
    v = F.when(kind.isin("email", "url"), F.regexp_replace(v, "@", "[at]")).otherwise(v)
    return F.when(kind == "hash", value).otherwise(v)


def classify(value: Column | str) -> Column:
    """hash, url, ip, email or domain, by shape."""
    v = trim_space(value)
    return (
        F.when(v.rlike("(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), "hash")
        .when(v.rlike("(?i)^[a-z][a-z0-9+.-]*://"), "url")
        .when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(v.contains(":") & v.rlike("(?i)^[0-9a-f:]+$"), "ip")
        .when(v.contains("@"), "email")
        .otherwise("domain")
    )


def ioc_line(ioc: Column) -> Column:
    """`type: defanged`, with ` — note` where there is one."""
    line = F.concat(ioc["type"], F.lit(": "), defang(ioc["value"], ioc["type"]))
    return F.when(F.coalesce(ioc["note"], F.lit("")) != "", F.concat(line, F.lit(" — "), ioc["note"])).otherwise(line)


def _keep(shape: str, value: Column) -> Column | None:
    if shape == "ip":
        return F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)
    if shape == "defanged":
        return value.contains(".") & ~value.rlike(r"^\d+(\.\d+)*$")
    if shape == "bare":
        labels = F.split(F.lower(value), r"\.")
        return (F.size(labels) >= 2) & F.element_at(labels, -1).isin(*BARE_TLDS)
    return None


def let(value: Column, use) -> Column:
    """use(value), the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hits(text: Column, number: int, shape: str, pattern: str, quick) -> Column:
    """array<struct<at, shape, value>> of a shape's matches; at counts characters before the match."""

    def places(both: Column) -> Column:
        def place(value: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(both["rest"], F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x))
            own = F.aggregate(F.slice(both["found"], F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
            clean = refang(F.regexp_replace(value, r"""[),.;:!?'"\]]+$""", ""))
            return F.struct((before + own).alias("at"), F.lit(number).alias("shape"), clean.alias("value"))

        return F.transform(both["found"], place)

    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    placed = let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("rest")), places)
    if _keep(shape, F.lit("")) is not None:
        placed = F.filter(placed, lambda x: _keep(shape, x["value"]))
    none = F.expr("slice(array(named_struct('at', 0, 'shape', 0, 'value', '')), 1, 0)")
    return F.when(quick(text), placed).otherwise(none)


def first_of_each(rows: Column) -> Column:
    """Of structs with a value, those whose value, in lower case, no earlier one has."""
    names = F.transform(rows, lambda x: F.lower(x["value"]))
    return let(names, lambda n: F.filter(rows, lambda x, i: F.array_position(n, F.lower(x["value"])) == i + 1))


def extract(text: Column | str, existing: Column | None = None) -> Column:
    """array<struct<type, value>>: the new indicators of a prose, in order of first appearance.

    `existing`, an array of values, is left out, whatever its case and fangs. Overlapping matches of different shapes
    are all kept. Null text has none.
    """
    text = F.coalesce(_col(text), F.lit(""))
    hits = F.concat(*(_hits(text, i, *shape) for i, shape in enumerate(SHAPES)))
    return let(F.array_sort(hits), lambda rows: _typed(first_of_each(rows), existing))


def parse_paste(text: Column | str, existing: Column | None = None) -> Column:
    """array<struct<type, value>>: the new indicators of a pasted list, parted by white space and commas."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), rf"[{SPACE},]+")
    rows = F.filter(F.transform(parts, lambda x: F.struct(refang(x).alias("value"))), lambda x: x["value"] != "")
    return let(rows, lambda r: _typed(first_of_each(r), existing))


def _typed(rows: Column, existing: Column | None) -> Column:
    if existing is not None:
        known = F.transform(existing, lambda v: F.lower(refang(v)))
        rows = F.filter(rows, lambda x: ~F.array_contains(known, F.lower(x["value"])))
    return F.transform(rows, lambda x: F.struct(classify(x["value"]).alias("type"), x["value"].alias("value")))
