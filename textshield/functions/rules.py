"""Rule-based scorer, moderator and rewriter.

These are offline stand-ins for trained models: deterministic and cheap, but not
comparable in accuracy. Every rule is one regular expression that Java, Python and RE2
read alike (word boundaries next to letters outside ASCII aside), compiled into plain
column expressions, so no rule table is joined.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from textshield.functions.vectors import let


class Rule(NamedTuple):
    """A pattern with its meaning.

    ``hints`` are groups of lower-case literals: a match contains a literal of every group, so texts
    without them are dismissed by plain substring search.
    """

    name: str
    issue: str
    pattern: str
    weight: float
    replacement: str
    hints: tuple[tuple[str, ...], ...] = ()


INJECTION, JAILBREAK = "prompt injection attempt", "jailbreak attempt"
HARMFUL, MALICIOUS = "harmful content", "malicious instruction"
SECURITY, PERSONAL = "security vulnerability", "sensitive data exposure"

RULES = [
    Rule("override", INJECTION, r"(?i)\b(?:ignore|disregard|forget|override)\s+(?:\w+\s+){0,3}(?:instructions?|context|prompts?|rules)\b",
         4.0, "", (("ignore", "disregard", "forget", "override"), ("instruction", "context", "prompt", "rule"))),
    Rule("reveal", INJECTION, r"(?i)\b(?:reveal|show|print|tell|give)\s+(?:\w+\s+){0,4}(?:system prompt|hidden prompt|secrets?)\b",
         3.0, "", (("system prompt", "hidden prompt", "secret"), ("reveal", "show", "print", "tell", "give"))),
    Rule("role", JAILBREAK, r"(?i)\b(?:you are now|act as|pretend to be)\s+(?:\w+\s+){0,2}(?:dan|jailbroken|unrestricted|unfiltered)\b",
         5.0, "", (("dan", "jailbroken", "unrestricted", "unfiltered"), ("you are", "act as", "pretend to"))),
    Rule("anything", JAILBREAK, r"(?i)\b(?:do anything now|developer mode|no restrictions)\b",
         4.0, "", (("do anything now", "developer mode", "no restrictions"),)),
    Rule("hostile", HARMFUL, r"(?i)\b(?:hate|kill|murder|weapons?|bombs?|violence)\b",
         2.0, "[removed]", (("hate", "kill", "murder", "weapon", "bomb", "violence"),)),
    Rule("order", MALICIOUS, r"(?i)\b(?:delete|reduce|cut|boost|shutdown)\s+(?:\w+\s+){0,3}(?:budget|accounts?|records)\b",
         3.0, "[removed]", (("budget", "account", "record"), ("delete", "reduce", "cut", "boost", "shutdown"))),
    Rule("crime", MALICIOUS, r"(?i)\b(?:illegal|hacking|malware|phishing)\b",
         2.0, "[removed]", (("illegal", "hacking", "malware", "phishing"),)),
    Rule("credential", SECURITY, r"(?i)\b(?:token|password|api_key|secret)\s*=\s*\"[0-9a-z]{16,}\"",
         4.0, "[secret]", (("token", "password", "api_key", "secret"), ("=",))),
    Rule("email", PERSONAL, r"[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+",
         2.0, "[email]", (("@",),)),
    Rule("card", PERSONAL, r"\b[0-9]{16}\b",
         3.0, "[card]"),
    Rule("address", PERSONAL, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
         1.0, "[address]"),
]

BENIGN_LOGIT = 2.0
ADVICE = {
    INJECTION: "remove the instructions",
    JAILBREAK: "remove the role play",
    HARMFUL: "rephrase without harm",
    MALICIOUS: "check the request with its owner",
    SECURITY: "revoke the credential",
    PERSONAL: "mask the personal data",
}
SEVERITIES = [(7.0, "critical"), (4.0, "high"), (3.0, "medium"), (0.0, "low")]


def _matches(text: Column, lowered: Column, rule: Rule) -> Column:
    hinted = [reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(h)) for h in group]) for group in rule.hints]
    return reduce(lambda a, b: a & b, [*hinted, text.rlike(rule.pattern)])


def rule_flags(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Bit i of the number is set when rule i matches. Put it in a column once, then read it."""
    bits = lambda lowered: [F.when(_matches(text, lowered, r), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)]
    return let(F.lower(text), lambda lowered: reduce(lambda a, b: a + b, bits(lowered))).cast("long")


def _set(flags: Column, chosen: Sequence[int]) -> Column:
    """Whether any of the chosen rules matched."""
    return flags.bitwiseAND(F.lit(sum(1 << i for i in chosen)).cast("long")) != 0


def _of(issues: Sequence[str], rules: Sequence[Rule]) -> list[int]:
    return [i for i, r in enumerate(rules) if r.issue in issues]


def issue_weight(flags: Column, issues: Sequence[str], rules: Sequence[Rule] = RULES) -> Column:
    """Summed weight of the matching rules of some issues."""
    weights = [F.when(_set(flags, [i]), rules[i].weight).otherwise(0.0) for i in _of(issues, rules)]
    return reduce(lambda a, b: a + b, weights, F.lit(0.0))


def rule_logits(flags: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Logits of the classes BENIGN, INJECTION, JAILBREAK."""
    return F.array(
        F.lit(BENIGN_LOGIT), issue_weight(flags, [INJECTION], rules), issue_weight(flags, [JAILBREAK], rules)
    )


def toxicity_score(flags: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Score from 0 to 1 that rises with the weight of harmful and malicious rules."""
    return 1.0 - F.pow(F.lit(0.5), issue_weight(flags, [HARMFUL, MALICIOUS], rules))


_LETTER = r"[\p{L}\p{Nd}]"


def topic_score(text: Column, topics: Mapping[str, Sequence[str]] | Sequence[str]) -> Column:
    """Highest score of banned topics: n / (n + 1) for n mentions of a topic's words or phrases."""
    lexicon = topics if isinstance(topics, Mapping) else {t: [t] for t in topics}
    lowered = F.lower(text)
    scores = []
    for terms in lexicon.values():
        listed = "|".join(re.escape(term.lower()) for term in terms)
        n = F.regexp_count(lowered, F.lit(rf"(?<!{_LETTER})(?:{listed})(?!{_LETTER})")).cast("double")
        scores.append(n / (n + 1.0))
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def own_topic_score(text: Column, topics: Column) -> Column:
    """The same score for a list of topics that every row brings along; null without a topic.

    A topic is a word or phrase and is taken literally, whatever its characters. Only topics that the
    text contains are looked for at word boundaries.
    """
    def mentions(lowered: Column, topic: Column) -> Column:
        literal = F.replace(topic, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
        bounded = F.concat(F.lit(rf"(?<!{_LETTER})\Q"), literal, F.lit(rf"\E(?!{_LETTER})"))
        return F.when(~F.contains(lowered, topic), 0).otherwise(F.regexp_count(lowered, bounded))

    wanted = F.filter(F.transform(topics, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    most = let(F.lower(text), lambda lowered: F.array_max(F.transform(wanted, lambda t: mentions(lowered, t)))).cast("double")
    return let(most, lambda n: n / (n + 1.0))


def rule_verdict(flags: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Verdict struct: harmful when any rule matches, severity by summed weight."""
    issues = list(dict.fromkeys(r.issue for r in rules))

    def severity(total: Column) -> Column:
        named = F.lit("none")
        for least, name in reversed(SEVERITIES):
            named = F.when(total > least, name).otherwise(named)
        return named

    listed = lambda word: F.array_compact(F.array(*[F.when(_set(flags, _of([i], rules)), F.lit(word(i))) for i in issues]))
    return F.struct(
        (flags != 0).alias("is_harmful"),
        let(issue_weight(flags, issues, rules), severity).alias("severity"),
        listed(lambda issue: issue).alias("issues"),
        listed(lambda issue: ADVICE[issue]).alias("recommendations"),
    )


def rule_reply(flags: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The verdict as the JSON reply a moderation model would give."""
    return F.to_json(rule_verdict(flags, rules))


def mask(text: Column, rules: Sequence[Rule] = RULES, flags: Column | None = None) -> Column:
    """The rewriting stand-in: every rule match replaced by the rule's replacement.

    Texts that no rule matches are passed on untouched; pass their flags if they are known.
    """
    replaced = reduce(lambda t, r: F.regexp_replace(t, r.pattern, r.replacement), rules, text)
    return F.when((rule_flags(text, rules) if flags is None else flags) != 0, replaced).otherwise(text)
