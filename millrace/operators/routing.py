"""Evidence-driven routing: a first-match rule table over stage and signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rule, stages, signals (* any), condition, action, target; the first that holds wins.
RULES = (
    ("budget_exhausted", "*", "*", "budget", "terminal", "dead"),
    ("transitions_capped", "*", "*", "transitions", "terminal", "dead"),
    ("policy_denied", "*", "policy_denied", "", "terminal", "policy_denied"),
    ("throttle_capped", "*", "throttled", "throttles_full", "terminal", "dead"),
    ("throttle_retry", "*", "throttled", "", "throttle", "direct"),
    ("attempts_capped", "*", "transient_failure", "attempts_full", "terminal", "dead"),
    ("transient_retry", "*", "transient_failure", "", "retry", "direct"),
    ("resource_denied", "*", "resource_denied", "", "terminal", "dead"),
    ("permanent_failure", "*", "permanent_failure", "", "terminal", "dead"),
    ("parser_failed_is_not_failure", "*", "parser_failed", "", "terminal", "done"),
    ("classify_done_to_direct", "classify", "*", "", "stage", "direct"),
    ("direct_ok", "direct", "ok", "", "terminal", "done"),
    ("direct_media_to_artifact", "direct", "media_manifest large_object", "", "stage", "artifact"),
    ("direct_stream_candidate", "direct", "stream", "", "candidate", "dead"),
    ("direct_empty_to_browser", "direct", "empty_content", "", "stage", "browser"),
    ("direct_unknown_format_to_artifact", "direct", "unknown_format", "", "stage", "artifact"),
    ("inspect_ok", "inspect", "ok", "", "terminal", "done"),
    ("inspect_empty_to_browser", "inspect", "empty_content", "", "stage", "browser"),
    ("artifact_ok", "artifact", "ok", "", "terminal", "done"),
    ("browser_ok", "browser observe", "ok", "", "terminal", "done"),
    ("browser_network_activity", "browser observe", "network_activity", "", "terminal", "done"),
)


def rules_table(spark) -> DataFrame:
    """The table as data: rule_no, rule, stages, signals, condition, action, target."""
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(RULES)], "rule_no int, rule string, stages string, signals string, condition string, action string, target string")


def route(stage: Column, signal: Column, conditions: dict[str, Column] | None = None, enabled: tuple[str, ...] = ("network", "artifact")) -> Column:
    """STM-01: struct(rule, action, target) of the first rule that holds, as one CASE; no rule: terminal dead.

    conditions: columns for budget, transitions, throttles_full and attempts_full (false where not given). A stage whose
    environment is not enabled ends dead, with the action naming the candidate.
    """
    conditions = conditions or {}
    say = lambda rule, action, target: F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"), F.lit(target).alias("target"))
    out = None
    for rule, stages, signals, cond, action, target in RULES:
        hit = F.lit(True)
        if stages != "*":
            hit = hit & stage.isin(*stages.split())
        if signals != "*":
            hit = hit & signal.isin(*signals.split())
        if cond:
            hit = hit & conditions.get(cond, F.lit(False))
        if action == "stage" and target not in ("direct", *enabled) and rule != "classify_done_to_direct":
            action, target = f"{target}_candidate", "dead"
        out = F.when(hit, say(rule, action, target)) if out is None else out.when(hit, say(rule, action, target))
    return out.otherwise(say("none", "terminal", "dead"))
