"""Rules over events: detection rules compiled to columns, and indicators."""

from __future__ import annotations

import ast
import ipaddress
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from logsight.functions.identity import alert_id

# Event columns of rule fields.
FIELDS = (
    dict.fromkeys(("CommandLine", "command_line", "ParentCommandLine", "Image", "ParentImage", "OriginalFileName"), "message")
    | dict.fromkeys(("User", "SourceUser", "TargetUser", "SubjectUserName", "TargetUserName"), "related_users")
    | dict.fromkeys(("SourceIp", "DestinationIp", "IpAddress", "SourceAddress", "DestinationAddress"), "related_ips")
    | dict.fromkeys(("HostName", "ComputerName", "Workstation", "SourceHostname", "DestinationHostname"), "related_hosts")
    | dict.fromkeys(("Hashes", "FileHash", "md5", "sha256"), "related_hashes")
    | dict.fromkeys(("EventID", "EventId"), "template_id")
)
ARRAYS = frozenset({"related_users", "related_ips", "related_hosts", "related_hashes"})
LEVELS = {"informational": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}


@dataclass(frozen=True)
class Rule:
    """selections: name to a list of (field, modifiers, values), or of keywords under field None.

    condition: a function of the selections' columns by name.
    """

    rule_id: str
    title: str
    level: str
    selections: Mapping[str, Sequence[tuple[str | None, tuple[str, ...], tuple]]]
    condition: Callable[[Mapping[str, Column]], Column]
    tags: tuple[str, ...] = ()
    category: str = ""
    product: str = ""
    service: str = ""
    enabled: bool = True


def _any(columns: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def _every(columns: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def any_of(selections: Mapping[str, Column], prefix: str) -> Column:
    return _any([c for n, c in selections.items() if n.startswith(prefix)])


def all_of(selections: Mapping[str, Column], prefix: str) -> Column:
    return _every([c for n, c in selections.items() if n.startswith(prefix)])


def some_of(selections: Mapping[str, Column], prefix: str, least: int) -> Column:
    """At least so many of the selections."""
    found = [F.coalesce(c, F.lit(False)).cast("int") for n, c in selections.items() if n.startswith(prefix)]
    return sum(found, F.lit(0)) >= least


def condition_of(text: str) -> Callable[[Mapping[str, Column]], Column]:
    """A condition in words, such as `selection and not 2 of filter_*` or `all of them`, as a function of the selections."""
    named: dict[str, Callable[[Mapping[str, Column]], Column]] = {}

    def group(m: re.Match) -> str:
        prefix = "" if m[2] == "them" else m[2].rstrip("*")
        named[name := f"group_{len(named)}"] = lambda s: all_of(s, prefix) if m[1] == "all" else some_of(s, prefix, 1 if m[1] == "any" else int(m[1]))
        return name

    tree = ast.parse(re.sub(r"\b([0-9]+|any|all) of ([\w*]+)", group, text).strip(), mode="eval").body

    def column(node: ast.expr, s: Mapping[str, Column]) -> Column:
        match node:
            case ast.Name(id=name):
                return named[name](s) if name in named else s[name]
            case ast.UnaryOp(op=ast.Not(), operand=one):
                return ~column(one, s)
            case ast.BoolOp(op=op, values=parts):
                return (_every if isinstance(op, ast.And) else _any)([column(p, s) for p in parts])
        raise ValueError(f"not a condition: {text}")

    return lambda s: column(tree, s)


def rule_pack(rows: Sequence[Mapping]) -> list[Rule]:
    """Rules from Spark rows or dicts with a condition in words (X2); the first of a repeated id counts.

    selections: name to a list of {field, modifiers, values}; the other keys are those of `Rule`.
    """
    out: dict[str, Rule] = {}
    for r in (r.asDict(recursive=True) if isinstance(r, Row) else r for r in rows):
        picked = {n: [(x.get("field"), tuple(x.get("modifiers") or ()), tuple(x["values"])) for x in parts] for n, parts in r["selections"].items()}
        source = {k: r[k] or "" for k in ("category", "product", "service") if k in r}
        out.setdefault(r["rule_id"], Rule(r["rule_id"], r["title"], r["level"], picked, condition_of(r["condition"]), tuple(r.get("tags") or ()), enabled=r.get("enabled") is not False, **source))
    return list(out.values())


def _in_network(value: Column, network: str) -> Column:
    """An IPv4 address lies in the network, by integer comparison."""
    net = ipaddress.ip_network(network)
    parts = F.split(value, r"\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0))
    return (F.size(parts) == 4) & number.between(int(net.network_address), int(net.broadcast_address))


def _leaf(value: Column, modifiers: tuple[str, ...], wanted: object) -> Column:
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return value == wanted
    text, low = F.lower(value.cast("string")), str(wanted).lower()
    if "cidr" in modifiers:
        return _in_network(value, str(wanted))
    if "contains" in modifiers:
        return F.contains(text, F.lit(low))
    if "startswith" in modifiers:
        return F.startswith(text, F.lit(low))
    if "endswith" in modifiers:
        return F.endswith(text, F.lit(low))
    if "*" in low or "?" in low:
        body = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_- " else "\\" + c for c in low)
        return F.rlike(text, F.lit(f"(?s)^{body}$"))
    return text == low


def item(field: str | None, modifiers: tuple[str, ...], values: Sequence, message: str = "message") -> Column:
    """One line of a selection: any value, or every value with the modifier all; a missing field is false."""
    join = _every if "all" in modifiers else _any
    if field is None:
        return F.coalesce(join([F.contains(F.lower(F.col(message)), F.lit(str(v).lower())) for v in values]), F.lit(False))
    name = FIELDS.get(field, field)
    if name in ARRAYS:
        return F.coalesce(join([_array_leaf(name, modifiers, v) for v in values]), F.lit(False))
    return F.coalesce(join([_leaf(F.col(name), modifiers, v) for v in values]), F.lit(False))


def _array_leaf(name: str, modifiers: tuple[str, ...], wanted: object) -> Column:
    return F.exists(F.col(name), lambda x: _leaf(x, modifiers, wanted))


def compiled(rule: Rule) -> Column:
    """The rule's condition as one boolean column."""
    selections = {n: _every([item(*i) for i in items]) for n, items in rule.selections.items()}
    return F.coalesce(rule.condition(selections), F.lit(False))


def logsource(rule: Rule) -> Column:
    """The rule's key is one of the event's four: category, product and service, each next one left out (R2)."""
    c, p, s = F.coalesce("category", F.lit("")), F.coalesce("product", F.lit("")), F.coalesce("service", F.lit(""))
    own = (rule.category, rule.product, rule.service)
    return ((c == own[0]) & (p == own[1]) & (s == own[2])) | _any([
        (c == own[0]) & (p == own[1]) if own[2] == "" else F.lit(False),
        c == own[0] if own[1:] == ("", "") else F.lit(False),
        F.lit(own == ("", "", "")),
    ])


def rule_matches(events: DataFrame, rules: Sequence[Rule], disabled: Sequence[str] = ()) -> DataFrame:
    """A row for each event and rule that matches; duplicate rule ids: the first counts.

    All rules are evaluated in one pass over the events.
    """
    chosen: dict[str, Rule] = {}
    for r in rules:
        if r.enabled and r.rule_id not in disabled:
            chosen.setdefault(r.rule_id, r)
    hits = F.array(*(F.when(logsource(r) & compiled(r), F.lit(r.rule_id)) for r in chosen.values()))
    return events.withColumn("rule_id", F.explode(F.filter(hits, lambda h: h.isNotNull())))


def tags_of(rule: Rule) -> tuple[list[str], list[str]]:
    """Tactics and techniques of the rule's attack tags; software ids are left out."""
    tactics, techniques = [], []
    for tag in rule.tags:
        name = tag.lower().removeprefix("attack.") if tag.lower().startswith("attack.") else ""
        if not name or (name[0] in "sg" and name[1:].isdigit()):
            continue
        if name[0] == "t" and name[1:5].isdigit():
            techniques.append(name.upper())
        else:
            tactics.append(name.replace("-", "_"))
    return tactics, techniques


def rule_alerts(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Alerts with severity, tactics and techniques of their rule."""
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    facts = F.create_map(*(x for r in rules for x in (F.lit(r.rule_id), F.struct(F.lit(r.title).alias("title"), F.lit(LEVELS.get(r.level, 3)).alias("severity"), strings(tags_of(r)[0]).alias("tactics"), strings(tags_of(r)[1]).alias("techniques")))))
    return matches.withColumn("r", facts[F.col("rule_id")]).select(
        alert_id("sigma", F.col("rule_id"), F.col("event_id")).alias("alert_id"), F.lit("sigma").alias("alert_type"), "event_id", "timestamp_ns", "rule_id", F.col("r.title").alias("rule_name"), F.col("r.severity").alias("severity_id"), F.col("r.tactics").alias("tactics"), F.col("r.techniques").alias("techniques")
    )


# Indicators ---------------------------------------------------------------

#: Observable paths of indicator patterns and their kind.
PATHS = (
    ("ipv4-addr:value", "ipv4"), ("ipv6-addr:value", "ipv6"), ("domain-name:value", "domain"), ("url:value", "url"),
    ("file:hashes.MD5", "md5"), ("file:hashes.'SHA-1'", "sha1"), ("file:hashes.'SHA-256'", "sha256"),
)
#: Tactic ids of kill-chain phase names.
PHASES = {
    "reconnaissance": "TA0043", "resource-development": "TA0042", "initial-access": "TA0001", "execution": "TA0002", "persistence": "TA0003",
    "privilege-escalation": "TA0004", "defense-evasion": "TA0005", "credential-access": "TA0006", "discovery": "TA0007", "lateral-movement": "TA0008",
    "collection": "TA0009", "command-and-control": "TA0011", "exfiltration": "TA0010", "impact": "TA0040",
}
_INDICATOR = "type string, id string, valid_from string, valid_until string, confidence int, pattern string, pattern_type string, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>"


def parse_indicators(raw: DataFrame, column: str = "value", most_chars: int = 4096, most_phases: int = 64) -> DataFrame:
    """Observables of indicator documents, one row each; bad rows are skipped."""
    doc = raw.select("*", F.from_json(column, _INDICATOR).alias("d")).where((F.col("d.type") == "indicator") & (F.coalesce(F.col("d.pattern_type"), F.lit("stix")) == "stix") & (F.length("d.pattern") <= most_chars))
    values = []
    for path, kind in PATHS:
        body = path.replace(".", r"\.") + r"\s*(?:=|!=|LIKE|MATCHES)\s*'((?:[^'\\]|\\.)*)'"
        values.append(_kind_values(body, kind))
    ns = lambda c: F.unix_micros(F.try_to_timestamp(c)) * 1000
    each = doc.withColumn("o", F.explode(F.array_distinct(F.concat(*values))))
    return each.select(
        F.col("o.value").alias("value"), F.col("o.kind").alias("kind"), F.least(F.greatest(F.coalesce("d.confidence", F.lit(0)), F.lit(0)), F.lit(100)).alias("confidence"),
        F.slice(F.transform(F.coalesce("d.kill_chain_phases", F.array().cast("array<struct<kill_chain_name:string,phase_name:string>>")), lambda p: p["phase_name"]), 1, most_phases).alias("phases"), ns("d.valid_from").alias("valid_from_ns"), ns("d.valid_until").alias("valid_until_ns"), F.col("d.id").alias("id"),
    )


def _kind_values(pattern: str, kind: str) -> Column:
    found = F.regexp_extract_all(F.col("d.pattern"), F.lit(pattern), F.lit(1))
    return F.transform(found, lambda v: F.struct(F.regexp_replace(v, r"\\(.)", "$1").alias("value"), F.lit(kind).alias("kind")))


def canonical_indicator(kind: Column, value: Column) -> Column:
    """Domains in lower case without a last dot, hashes and IPv6 in lower case, the rest trimmed."""
    v = F.trim(value)
    return F.when(kind == "domain", F.regexp_replace(F.lower(v), r"\.+$", "")).when(kind.isin("md5", "sha1", "sha256", "ipv6"), F.lower(v)).otherwise(v)


def snapshot(indicators: DataFrame, now_ns: int, grace_ns: int = 0, floor: int = 0, cap: int | None = None, feed: str = "source_feed") -> DataFrame:
    """Indicators still valid, confident enough, at most `cap` a feed."""
    live = indicators.where((F.col("valid_until_ns").isNull() | (F.col("valid_until_ns") >= now_ns - grace_ns)) & (F.col("confidence") >= floor))
    if cap is None:
        return live
    rank = F.row_number().over(Window.partitionBy(feed).orderBy(F.col("confidence").desc(), "kind", "value"))
    return live.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")


def match_indicators(observables: DataFrame, indicators: DataFrame, feed_order: str = "feed_order", floor: int = 0) -> DataFrame:
    """Observables (event_id, kind, value, ...) that are indicators; a later feed overrides.

    No side is forced to be broadcast: Spark does so if its size allows, and
    else adds its runtime filter to a shuffle join.
    """
    key = canonical_indicator(F.col("kind"), F.col("value"))
    one = indicators.where(F.col("confidence") >= floor).withColumn("key", key).groupBy("kind", "key").agg(F.max_by(F.struct("confidence", "phases"), feed_order).alias("i"))
    return observables.withColumn("key", key).join(one, ["kind", "key"]).select(*observables.columns, F.col("i.confidence").alias("confidence"), F.col("i.phases").alias("phases"))


def aligned_entity(values: Column, ids: Column, value: Column) -> Column:
    """The id at the value's place among the raw values; empty without one."""
    at = F.array_position(values, value)
    return F.when(at > 0, F.coalesce(F.try_element_at(ids, at.cast("int")), F.lit(""))).otherwise("")


def indicator_alerts(matches: DataFrame) -> DataFrame:
    """Alerts of matches by confidence (K8)."""
    c = F.greatest(F.lit(0), F.least(F.col("confidence"), F.lit(100)))
    severity = F.when(c < 33, 2).when(c < 67, 3).when(c < 85, 4).otherwise(5)
    ids = F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair))
    tactics = F.array_distinct(F.filter(F.transform("phases", lambda p: F.try_element_at(ids, F.replace(F.lower(F.trim(p)), F.lit("_"), F.lit("-")))), lambda t: t.isNotNull()))
    return matches.select("event_id", "kind", "value", "timestamp_ns", severity.alias("severity_id"), (c / 100).alias("risk_score"), tactics.alias("tactics"))
