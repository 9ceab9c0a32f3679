"""Names of tactics and techniques, and mapping of templates to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tactic ids, names and display names.
TACTICS = {
    "TA0043": ("reconnaissance", "Reconnaissance"),
    "TA0042": ("resource_development", "Resource Development"),
    "TA0001": ("initial_access", "Initial Access"),
    "TA0002": ("execution", "Execution"),
    "TA0003": ("persistence", "Persistence"),
    "TA0004": ("privilege_escalation", "Privilege Escalation"),
    "TA0005": ("defense_evasion", "Defense Evasion"),
    "TA0006": ("credential_access", "Credential Access"),
    "TA0007": ("discovery", "Discovery"),
    "TA0008": ("lateral_movement", "Lateral Movement"),
    "TA0009": ("collection", "Collection"),
    "TA0010": ("exfiltration", "Exfiltration"),
    "TA0011": ("command_and_control", "Command and Control"),
    "TA0040": ("impact", "Impact"),
}
# Patterns of templates (first match wins) with tactics and techniques.
TEMPLATE_RULES = (
    (r"authentication.*(?:fail|exceeded|invalid)|login.*fail|invalid.*password", ("credential-access", "initial-access"), ("T1110", "T1078")),
    (r"ssh.*(?:error|fail|disconnect|maximum)|sshd.*(?:error|fail)", ("credential-access", "initial-access"), ("T1110", "T1078")),
    (r"sudo.*(?:incorrect|NOT|fail)|su.*(?:authentication failure|FAILED)", ("privilege-escalation",), ("T1548",)),
    (r"segfault|core dump|signal 1[14]|SIGSEGV|SIGBUS", ("execution",), ("T1203",)),
    (r"permission denied|access denied|unauthorized|403 Forbidden", ("defense-evasion",), ("T1222",)),
    (r"account.*lock|too many.*attempt|brute.?force", ("credential-access",), ("T1110",)),
)
TECHNIQUE = r"^T[0-9]{4}(?:\.[0-9]{3})?$"


def tactic(value: Column) -> Column:
    """The tactic's name from a name in either spelling or an id; null if unknown."""
    low = F.replace(F.lower(value), F.lit("-"), F.lit("_"))
    out = None
    for number, (name, _) in TACTICS.items():
        hit = (low == name) | (F.upper(value) == number)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def display(name: Column) -> Column:
    """Display name with the id; unknown names as they are."""
    out = None
    for number, (own, shown) in TACTICS.items():
        text = f"{shown} ({number})"
        out = F.when(name == own, text) if out is None else out.when(name == own, text)
    return out.otherwise(name)


def is_technique(value: Column) -> Column:
    return F.rlike(F.upper(value), F.lit(TECHNIQUE))


def parent(value: Column) -> Column:
    """The technique of a sub-technique in upper case; anything malformed unchanged."""
    return F.when(is_technique(value), F.element_at(F.split(F.upper(value), r"\."), 1)).otherwise(value)


def of_template(text: Column) -> Column:
    """struct(tactics, techniques) of the first rule that finds its pattern; null without one."""
    out = None
    for pattern, tactics, techniques in TEMPLATE_RULES:
        value = F.struct(F.array(*map(F.lit, tactics)).alias("tactics"), F.array(*map(F.lit, techniques)).alias("techniques"))
        hit = F.rlike(text, F.lit("(?i)" + pattern))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out
