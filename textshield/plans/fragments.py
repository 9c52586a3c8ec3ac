"""SQL fragments shared by the registered queries, for DuckDB."""

from __future__ import annotations

from functools import reduce

from textshield.functions.rules import ADVICE, BENIGN_LOGIT, RULES, SEVERITIES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"


def masked(column: str) -> str:
    return reduce(lambda t, r: f"regexp_replace({t}, {text(r.pattern)}, {text(r.replacement)}, 'g')", RULES, column)


def weight(column: str, issues=None) -> str:
    chosen = [r for r in RULES if issues is None or r.issue in issues]
    return "(" + " + ".join(f"CASE WHEN regexp_matches({column}, {text(r.pattern)}) THEN {r.weight} ELSE 0.0 END" for r in chosen) + ")::DOUBLE"


def severity(total: str) -> str:
    return "CASE " + " ".join(f"WHEN {total} > {least} THEN '{name}'" for least, name in SEVERITIES) + " ELSE 'none' END"


def listed(column: str, advice: bool = False) -> str:
    """The matching issues (or the advice on them) as a list, in rule order."""
    entries = []
    for issue in dict.fromkeys(r.issue for r in RULES):
        any_of = " OR ".join(f"regexp_matches({column}, {text(r.pattern)})" for r in RULES if r.issue == issue)
        entries.append(f"CASE WHEN {any_of} THEN {text(ADVICE[issue] if advice else issue)} END")
    return f"list_filter([{', '.join(entries)}], lambda i: i IS NOT NULL)"


def softmax3(injection: str, jailbreak: str) -> tuple[str, str, str]:
    """Probabilities of the three classes from the rule logits."""
    top = f"greatest({BENIGN_LOGIT}, {injection}, {jailbreak})"
    total = f"(exp({BENIGN_LOGIT} - {top}) + exp({injection} - {top}) + exp({jailbreak} - {top}))"
    return tuple(f"exp({x} - {top}) / {total}" for x in (f"{BENIGN_LOGIT}::DOUBLE", injection, jailbreak))


def hashed(source: str, key: str, column: str, name: str, dims: int = 64) -> str:
    """CTEs that end in ``name(key, e)``: the unit vector of word buckets as a list."""
    return f"""{name}_w AS (SELECT {key} AS k, unnest({words(column)}) AS w FROM {source}),
{name}_b AS (SELECT k, ('0x' || substr(md5(w), 1, 2))::BIGINT % {dims} AS d, count(*)::DOUBLE AS c FROM {name}_w GROUP BY ALL),
{name}_n AS (SELECT k, sqrt(sum(c * c)) AS norm FROM {name}_b GROUP BY k),
{name}_g AS (SELECT t.{key} AS k, r.d, coalesce(b.c / n.norm, 0.0) AS v FROM {source} t
  CROSS JOIN (SELECT unnest(range({dims})) AS d) r LEFT JOIN {name}_b b ON b.k = t.{key} AND b.d = r.d
  LEFT JOIN {name}_n n ON n.k = t.{key}),
{name} AS (SELECT k, list(v ORDER BY d) AS e FROM {name}_g GROUP BY k)"""


def distance(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        value = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    elif metric == "ip":
        value = f"1.0 - list_inner_product({a}, {b})"
    else:
        length = f"(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
        value = f"1.0 - CASE WHEN {length} > 0 THEN list_inner_product({a}, {b}) / {length} ELSE 0.0 END"
    return f"{value} + 0.0"


def ranked(metric: str, k: int, queries: str, chunks: str, condition: str = "true") -> str:
    """Body of a CTE with the k nearest ``chunks(k, e)`` of each of ``queries(k, e)``."""
    return f"""SELECT query_id, rank, chunk_id, distance FROM (
  SELECT query_id, chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM (
    SELECT q.k AS query_id, c.k AS chunk_id, {distance(metric, 'q.e', 'c.e')} AS distance
    FROM {queries} q CROSS JOIN {chunks} c WHERE {condition})) WHERE rank <= {k}"""
