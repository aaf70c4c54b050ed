"""Secrets in texts, found by a trigram inverted index.

1. From each rule's regular expression a Boolean query of trigrams is derived: an OR of ANDs that
   every text with a match satisfies (``trigram_query``). Texts are indexed in lower case, so the
   query holds whatever the case.
2. The trigrams that occur in any query are looked up in every whole text; the posting lists
   (trigram, id) are written as a table.
3. Posting lists are intersected: an id is a candidate of a rule if one AND has all its trigrams.
4. Candidates are verified with the regular expression on the whole text, where each match gets its
   place. Rules without a mandatory trigram (runs of hexadecimal digits) scan every text.

Only expressions of Spark SQL run on the rows; Python derives queries from the nine rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import compute_once
from .common import keep, whole_text


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, leftmost and without overlap; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base kinds. A run of at least 24 hexadecimal digits is the maximal run, and
#: every AKIA within a run that is too short is too short as well, so their bounds may stand in the pattern.
BASE = (
    Rule(
        "assign",
        r"(?i)(password|passwd|secret|token|api_?key)(?-i)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + ADDED

#: Up to so many candidates are broadcast (about 24 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Sets of strings that a part of a pattern stands for are followed up to this size.
_STRINGS = 32


# --- trigram queries ----------------------------------------------------------------


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The OR (list) of ANDs (sets) of lower-case trigrams that every match has; None: no such query."""
    tree = regex_parser.parse(pattern.replace("(?-i)", ""))
    return _needed(list(tree))


def _exact(node) -> set[str] | None:
    """The strings that a part of a pattern stands for, if they are few."""
    op, value = node
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        chars = set()
        for kind, x in value:
            if kind is not sre.LITERAL:
                return None
            chars.add(chr(x).lower())
        return chars if len(chars) <= _STRINGS else None
    if op is sre.SUBPATTERN:
        return _exact_all(value[3])
    if op is sre.BRANCH:
        found = [_exact_all(x) for x in value[1]]
        return None if None in found else set().union(*found)
    if op is sre.MAX_REPEAT and value[1] is not sre.MAXREPEAT and value[1] <= 5:
        one = _exact_all(value[2])
        if one is None:
            return None
        found = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n)}
        return found if len(found) <= _STRINGS else None
    return None


def _exact_all(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        part = _exact(node)
        if part is None or len(part) * len(found) > _STRINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    return [x | y for x in a for y in b]


def _needed(nodes):
    query, run = None, {""}

    def flush():
        nonlocal query, run
        if all(len(s) >= 3 for s in run):
            query = _both(query, [_grams(s) for s in sorted(run)])
        run = {""}

    for node in nodes:
        part = _exact(node)
        if part is not None and len(part) * len(run) <= _STRINGS:
            run = {a + b for a in run for b in part}
            continue
        flush()
        if part is not None:
            run = part
            continue
        op, value = node
        if op is sre.SUBPATTERN:
            query = _both(query, _needed(value[3]))
        elif op is sre.BRANCH:
            found = [_needed(x) for x in value[1]]
            if None not in found:
                query = _both(query, [s for x in found for s in x])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            query = _both(query, _needed(value[2]))
    flush()
    return query


# --- index --------------------------------------------------------------------------


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, id) for every row(id, text) and every given trigram that its lower-case text contains."""
    low = compute_once(rows.select("id", "text"), "text", F.lower("text"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.col("text").contains(t))
    return low.select(F.explode(held).alias("trigram"), "id")


def candidates(index: DataFrame, queries: list[list[frozenset[str]] | None]) -> DataFrame:
    """(id, mask): bit r is set if the id satisfies query r. Posting lists are intersected by counting."""
    spark = index.sparkSession
    wanted = [
        (g, rule, branch, len(grams))
        for rule, query in enumerate(queries)
        for branch, grams in enumerate(query or [])
        for g in sorted(grams)
    ]
    plan = spark.createDataFrame(wanted, "trigram string, rule int, branch int, need int")  # the rules' own size
    met = (
        index.distinct()
        .join(F.broadcast(plan), "trigram")
        .groupBy("id", "rule", "branch", "need")
        .count()
        .filter("count = need")
    )
    return met.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("mask"))


#: Matches whose places are added up at once.
RUN = 256

# --- verification -------------------------------------------------------------------


def _matches(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches; code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        F.transform(checked, F.length).alias("part"),
    )
    none = F.expr("CAST(array() AS array<struct<start:int,k:int,end:int>>)")

    def step(done, x):
        begin = done["at"] + x["gap"]
        stop = begin + F.coalesce(x["size"], F.lit(0))
        here = F.array(F.struct(begin.alias("start"), F.lit(number).alias("k"), stop.alias("end")))
        good = x["size"].isNotNull() & (x["part"] >= rule.least)
        return F.struct(stop.alias("at"), F.when(good, F.concat(done["out"], here)).otherwise(done["out"]).alias("out"))

    # Adding to an array copies it, so places are added up run by run and the runs put together at the end.
    def run_step(done, run):
        mine = F.aggregate(run, F.struct(done["at"].alias("at"), none.alias("out")), step)
        return F.struct(mine["at"].alias("at"), F.concat(done["runs"], F.array(mine["out"])).alias("runs"))

    last = F.floor((F.size(found) - 1) / RUN).cast("int")
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(found, i * RUN + 1, F.lit(RUN)))
    begin = F.struct(F.lit(0).alias("at"), F.array(none).alias("runs"))
    return F.aggregate(runs, begin, run_step, lambda done: F.flatten(done["runs"]))


def spans(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rows(id, text, mask)`` to (id, found): all matches by start, then rule, as (start, k, end)."""
    nothing = F.expr("CAST(array() AS array<struct<start:int,k:int,end:int>>)")
    text = F.col("text")
    parts = []
    for k, rule in enumerate(rules):
        hit = text.rlike(rule.pattern)
        if trigram_query(rule.pattern) is not None:
            hit = (F.col("mask").bitwiseAND(F.lit(1 << k)) != 0) & hit
        parts.append(F.when(hit, _matches(text, rule, k)).otherwise(nothing))
    return compute_once(rows, "found", F.array_sort(F.concat(*parts))).select("id", "found")


def written(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = F.transform(
        found, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per row of ``docs``: id and ``found``, an array of (start, k, end) by start, then k, the
    number of the rule; places are code points of the whole text, end exclusive.

    Null and empty texts have no match. Rows that repeat an id, or have none, are searched each for
    itself. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({g for q in queries for grams in q or [] for g in grams})
    index = keep(postings(rows, trigrams), "secrets-postings")
    chosen = keep(candidates(index, queries), "secrets-candidates").withColumnRenamed("id", "__id")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    joined = rows.join(chosen, F.col("id").eqNullSafe(F.col("__id")), "left")
    return spans(joined.select("id", "text", F.coalesce("mask", F.lit(0)).alias("mask")), rules).withColumnRenamed(
        "id", id_col
    )
