"""Secret scans through a trigram index.

From each rule's pattern a Boolean query over trigrams is derived: what every match must contain, in lower case.  The
index has a posting (trigram, doc_id) for each trigram that some query names.  The postings of a document are
intersected with the queries, and only documents that satisfy a rule's query are searched with its pattern.  A rule
whose matches need not contain any trigram (a run of hex digits) searches every document.

Only DataFrame functions are used.  Texts are searched whole.  Rows: null texts count as empty.  Rows that repeat a
doc_id share their postings and are searched each; a row without doc_id is searched with every rule.  An empty table
gives an empty result.  Columns other than the two named are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keyed, materialize, small
from tessera.llm.quality import let

_parser = re._parser  # type: ignore[attr-defined]
_names = re._constants  # type: ignore[attr-defined]
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern, without those whose group has fewer than least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of 24 and more among all runs
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _all(parts):
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts):
    parts = list(parts)
    return None if not parts or any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_string(text: str):
    return _all(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))


def _strings(node) -> set[str] | None:
    """All lower-cased strings that a parsed node can match, if they are few."""
    kind, value = node
    if kind is _names.LITERAL:
        return {chr(value).lower()}
    if kind is _names.IN and all(k is _names.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}
    if kind is _names.SUBPATTERN:
        return _joined(value[-1])
    if kind is _names.BRANCH:
        found = [_joined(x) for x in value[1]]
        return None if any(x is None for x in found) else set().union(*found)
    if kind is _names.MAX_REPEAT and value[:2] == (0, 1):
        inner = _joined(value[2])
        return None if inner is None else inner | {""}
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _of_nodes(nodes):
    parts, run = [], {""}
    for node in nodes:
        strings = _strings(node)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        parts.append(_any(_of_string(x) for x in sorted(run)))
        run = strings if strings is not None and len(strings) <= MOST_STRINGS else {""}
        if strings is None:
            kind, value = node
            if kind is _names.SUBPATTERN:
                parts.append(_of_nodes(value[-1]))
            elif kind is _names.BRANCH:
                parts.append(_any(_of_nodes(x) for x in value[1]))
            elif kind is _names.MAX_REPEAT and value[0] > 0:
                parts.append(_of_nodes(value[2]))
    parts.append(_any(_of_string(x) for x in sorted(run)))
    return _all(parts)


def trigram_query(pattern: str):
    """What the lower-cased text of every match must contain: a trigram, ("and", ...), ("or", ...), or None for anything."""
    return _of_nodes(_parser.parse(pattern))


def trigrams(query) -> set[str]:
    """The trigrams that a query names."""
    return set() if query is None else {query} if isinstance(query, str) else set().union(*(trigrams(x) for x in query[1:]))


def holds(query, has) -> Column:
    """The query as a condition; has(trigram) is the condition for one."""
    if isinstance(query, str):
        return has(query)
    parts = [holds(x, has) for x in query[1:]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def trigram_index(docs: DataFrame, wanted: set[str]) -> DataFrame:
    """Postings (trigram, doc_id) for the wanted trigrams of the lower-cased texts."""
    low = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(wanted))))
    return low.select(F.explode(present).alias("trigram"), "doc_id")


def candidates(postings: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(doc_id, rules): for each document the rules whose queries its postings satisfy.

    A group has at most as many values as there are trigrams in the queries.
    """
    held = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("held"))
    kinds = F.array_compact(F.array(*(F.when(holds(q, lambda t: F.array_contains("held", t)), F.lit(kind)) for kind, q in queries.items())))
    return held.select("doc_id", kinds.alias("rules")).where(F.size("rules") > 0)


def rule_spans(rule: Rule) -> Column:
    """Starts and ends, in code points, of the rule's matches in the column text."""
    size = lambda x: F.transform(x, lambda s: F.length(s))
    found = lambda g: size(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(g)))
    parts = F.named_struct(F.lit("between"), size(F.split("text", rule.pattern, -1)), F.lit("own"), found(0), F.lit("part"), found(rule.group))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def build(x: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.get(x["between"], k)
            end = start + F.get(x["own"], k)
            span = F.named_struct(F.lit("start"), start, F.lit("end"), end)
            keep = F.get(x["part"], k) >= rule.least
            return F.named_struct(F.lit("at"), end, F.lit("spans"), F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]))

        begin = F.named_struct(F.lit("at"), F.lit(0), F.lit("spans"), none)
        return F.aggregate(F.sequence(F.lit(0), F.size(x["own"]) - 1), begin, step, lambda acc: acc["spans"])

    return F.when(F.col("text").rlike(rule.pattern), let(parts, build)).otherwise(none)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row; spans is array<struct<start, kind_order, end, kind>> by start, then by rule order.

    Starts and ends count code points; ends are exclusive.
    """
    docs = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    wanted = set().union(*(trigrams(q) for q in queries.values()))
    if wanted:
        found = materialize(candidates(trigram_index(docs, wanted), queries))
        docs = docs.join(small(found, 24 + 24 * len(queries)), "doc_id", "left")
    else:
        docs = docs.withColumn("rules", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    columns = [rule_spans(r) if r.kind not in queries else F.when(F.col("doc_id").isNull() | F.array_contains("rules", r.kind), rule_spans(r)).otherwise(none) for r in rules]
    docs = docs.select("doc_id", *(c.alias(f"spans_{k}") for k, c in enumerate(columns)))
    named = lambda k, kind: F.transform(f"spans_{k}", lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("kind_order"), F.lit(k), F.lit("end"), s["end"], F.lit("kind"), F.lit(kind)))
    return docs.select("doc_id", F.array_sort(F.concat(*(named(k, r.kind) for k, r in enumerate(rules)))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
