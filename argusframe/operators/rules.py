"""Detection rules: data compiled to Columns, so that one pass over the events evaluates all of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import OPERATORS, predicate

TYPES = ("detection", "threat_intel", "correlation")
SEVERITIES = ("low", "medium", "high", "critical")
ACTIONS = ("alert", "log", "drop", "tag", "enrich", "webhook", "email", "script", "block", "isolate")
RISK_OF_SEVERITY = {"low": 25.0, "medium": 50.0, "high": 75.0, "critical": 95.0}


@dataclass(frozen=True)
class Schedule:
    """Weekdays (Monday 0) and times of day, in UTC, in which a rule holds."""

    days: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 6)
    start: str = "00:00"
    end: str = "23:59"

    def holds(self, at: Column) -> Column:
        return F.weekday(at).isin(list(self.days)) & F.date_format(at, "HH:mm").between(self.start, self.end)


@dataclass(frozen=True)
class Rule:
    """conditions: groups of (field, operator, value); a group needs all of its conditions, logic joins the groups."""

    rule_id: str
    severity: str
    conditions: tuple
    rule_type: str = "detection"
    logic: str = "or"
    enabled: bool = True
    filters: dict = field(default_factory=dict)
    schedule: Schedule | None = None
    case_sensitive: bool = True
    mitre: tuple[str, ...] = ()
    suppress: int = 0
    window: int = 0
    threshold: int = 0
    group_by: tuple[str, ...] = ()
    confidence: float = 0.8
    actions: tuple[str, ...] = ("alert",)

    def errors(self) -> list[str]:
        """What is wrong with the rule, empty if nothing is."""
        found = [] if self.rule_id else ["rule_id is missing"]
        found += [f"unknown type {self.rule_type!r}"] * (self.rule_type not in TYPES) + [f"unknown severity {self.severity!r}"] * (self.severity not in SEVERITIES)
        found += ["no conditions"] * (not self.conditions) + [f"unknown operator {o!r}" for g in self.conditions for _, o, _ in g if o not in OPERATORS]
        found += [f"unknown action {a!r}" for a in self.actions if a not in ACTIONS]
        return found + ["correlation needs window and threshold"] * (self.rule_type == "correlation" and not (self.window > 0 and self.threshold > 0))

    def matches(self, columns: set[str], at: str = "timestamp") -> Column:
        """A field that the events lack counts as null."""
        if not self.enabled or not self.conditions:
            return F.lit(False)

        def one(name: str, operator: str, value) -> Column:
            if name in columns:
                return predicate(name, operator, value, self.case_sensitive)
            return OPERATORS[operator](F.lit(None).cast("string"), value if not isinstance(value, bool) else str(value).lower(), False)

        groups = [reduce(lambda a, b: a & b, [one(*c) for c in g]) for g in self.conditions]
        out = reduce((lambda a, b: a & b) if self.logic == "and" else (lambda a, b: a | b), groups)
        for name, value in self.filters.items():
            out = out & F.col(name).eqNullSafe(F.lit(value))
        return out & self.schedule.holds(F.col(at)) if self.schedule else out


def parse_rule(data: dict) -> Rule:
    """A rule from parsed YAML: conditions as a flat list (one group) or as a list of lists."""
    groups = data.get("conditions") or []
    groups = [groups] if groups and isinstance(groups[0], dict) else groups
    conditions = tuple(tuple((c["field"], c.get("operator", "eq"), c.get("value")) for c in g) for g in groups)
    rule = Rule(
        data.get("rule_id", ""), data.get("severity", "medium"), conditions, data.get("rule_type", "detection"), data.get("logic", "or"), data.get("enabled", True),
        data.get("filters") or {}, None, data.get("case_sensitive", True), tuple(data.get("mitre_attack") or ()), (data.get("metadata") or {}).get("suppress_duration", 0),
        data.get("window", 0), data.get("threshold", 0), tuple(data.get("group_by") or ()), data.get("confidence", 0.8), tuple(data.get("actions") or ("alert",)),
    )
    if errors := rule.errors():
        raise ValueError(f"{rule.rule_id}: {'; '.join(errors)}")
    return rule


def load_rules(path: str) -> list[Rule]:
    """Rules of a YAML file, a list or a mapping with the key rules."""
    import yaml

    with open(path) as f:
        data = yaml.safe_load(f)
    return [parse_rule(x) for x in (data.get("rules", []) if isinstance(data, dict) else data)]


def matching(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """events with the ids of the rules that each one meets, in rule_ids."""
    columns = set(events.columns)
    return events.withColumn("rule_ids", F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(r.matches(columns), F.lit(r.rule_id)) for r in rules))))


def detect(events: DataFrame, rules: list[Rule], key: str = "event_id") -> DataFrame:
    """One alert for each event and single-event rule that it meets; without a rule there are none."""
    rules = [r for r in rules if r.enabled and r.rule_type != "correlation"]
    facts = F.create_map(*(x for r in [*rules, Rule("", "low", ())] for x in (F.lit(r.rule_id), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.confidence * 50).alias("risk"), F.lit(",".join(r.mitre)).alias("mitre")))))
    hits = matching(events, rules).where(F.size("rule_ids") > 0).withColumn("rule_id", F.explode("rule_ids"))
    fact = facts[F.col("rule_id")]
    risk = F.coalesce(F.col("risk_score"), fact["risk"]) if "risk_score" in events.columns else fact["risk"]
    return hits.select("rule_id", key, "timestamp", "source_ip", fact["severity"].alias("alert_severity"), risk.alias("alert_risk"), fact["mitre"].alias("mitre"))


def back_test(events: DataFrame, rule: Rule) -> DataFrame:
    """The events that a rule would have met."""
    return events.where(rule.matches(set(events.columns)))
