"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression the driver derives a Boolean query over trigrams that every match must hold. One
pass posts, for the trigrams of those queries, which texts hold them; posting lists are kept by segments of the text
hash, so that none grows beyond a segment. Queries intersect and unite posting lists; texts that pass are verified
with the expression itself. A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, spread_join


@dataclass(frozen=True)
class Rule:
    """kind; an expression that Java, RE2 and Python read alike; the group whose length min_chars bounds."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0


#: The base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Kinds that the method adds.
ADDED = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
)
#: Exact strings that one stretch of an expression may stand for, before it is cut.
MOST_STRINGS = 96
#: Texts whose postings share a segment, about.
SEGMENT = 4096

#: A query is a list of clauses, all needed; a clause is a set of alternatives; an alternative is a set of trigrams.
Clause = frozenset


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def clause_of(strings: frozenset[str]) -> Clause | None:
    """What holds if one of the strings stands in a text; None if that needs no trigram."""
    sets = {trigrams(s) for s in strings}
    if not sets or frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _class(items) -> frozenset[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 8:
            out.update(chr(x).lower() for x in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _exact(node) -> frozenset[str] | None:
    """The strings, in lower case, that a part of an expression stands for, if they are few."""
    op, value = node
    if op is C.LITERAL:
        return frozenset([chr(value).lower()])
    if op is C.IN:
        return _class(value)
    if op is C.SUBPATTERN:
        return _joined(value[3])
    if op is C.BRANCH:
        all_ = [_joined(b) for b in value[1]]
        return None if None in all_ else frozenset().union(*all_)
    if op is C.MAX_REPEAT and value[1] is not C.MAXREPEAT and value[1] <= 2:
        one = _joined(value[2])
        if one is not None:
            return frozenset("".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n))
    return None


def _joined(nodes) -> frozenset[str] | None:
    out = frozenset([""])
    for node in nodes:
        one = _exact(node)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = frozenset(a + b for a in out for b in one)
    return out


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses, over text in lower case, that each match of a pattern meets; empty if there is none."""
    return _walk(_parser.parse(pattern))


def _walk(nodes) -> list[Clause]:
    clauses, run = [], frozenset([""])
    for node in nodes:
        op, value = node
        one = _exact(node)
        if one is not None and len(run) * len(one) <= MOST_STRINGS:
            run = frozenset(a + b for a in run for b in one)
            continue
        clauses.append(clause_of(run))
        run = frozenset([""]) if one is None else one
        if op is C.SUBPATTERN:
            clauses += _walk(value[3])
        elif op is C.MAX_REPEAT and value[0] > 0:
            clauses += _walk(value[2])
    clauses.append(clause_of(run))
    return list(dict.fromkeys(c for c in clauses if c))


def _postings(docs: DataFrame, text: Column, vocabulary: list[str], segments: int) -> DataFrame:
    """segment, and by trigram number the sorted keys (text hashes) of texts that hold it."""
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)]))
    pairs = docs.select(F.xxhash64(text).alias("key"), F.lower(text).alias("folded")).select("key", F.explode(held).alias("gram"))
    lists = pairs.groupBy(F.pmod("key", F.lit(segments)).alias("segment"), "gram").agg(F.collect_set("key").alias("keys"))
    return lists.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))


def _met(query: list[Clause], number: dict[str, int]) -> Column:
    """Keys that meet a query: posting lists intersected, alternatives united."""

    def of(gram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(number[gram])), F.array().cast("array<bigint>"))

    def alternative(grams: frozenset[str]) -> Column:
        return reduce(F.array_intersect, [of(g) for g in sorted(grams)])

    clauses = [reduce(F.array_union, [alternative(a) for a in sorted(c, key=sorted)]) for c in query]
    return reduce(F.array_intersect, clauses)


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: Column, segments: int) -> DataFrame:
    """key and mask (a bit for each rule whose query the text meets) of texts that meet any."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    number = {t: i for i, t in enumerate(sorted({t for q in queries.values() for c in q for a in c for t in a}))}
    lists = _postings(docs, text, list(number), segments)

    def marked(i: int) -> Column:
        return F.transform(_met(queries[i], number), lambda k: F.struct(k.alias("key"), F.lit(1 << i).cast("long").alias("bit")))

    met = F.concat(*[marked(i) for i in queries])
    return lists.select(F.explode(met).alias("x")).groupBy("x.key").agg(F.bit_or("x.bit").alias("mask"))


def spans(text: str, rule: Rule, rank: int) -> Column:
    """(start, rank, end) of a rule's leftmost non-overlapping matches, in code points; failing matches are dropped.

    What stands between the matches gives their places.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.min_chars else matches
    between = F.split(F.col(text), rule.pattern, -1)
    parts = F.arrays_zip(matches.alias("m"), groups.alias("g"), F.slice(between, 1, F.size(matches)).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("s"), F.lit(rank).alias("k"), end.alias("e")))
        passed = F.length(x["g"]) >= rule.min_chars
        return F.struct(end.alias("at"), F.when(passed, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """docs with __spans: (s, k, e) of every match of every rule, by start and then rule.

    A null text counts as empty and has none. Equal texts share postings; each row is verified by itself, so a clash of
    hashes costs time only. A text that many rows have is dealt to several tasks by the rows' other columns. docs must
    not have columns __text, __key, __mask, __part or __spans; any other names may occur.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counts = docs.select(F.xxhash64(body).alias("__key")).groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    segments = max(64, -(-total // segment))
    found = candidates(docs, rules, body, segments).select(F.col("key").alias("__key"), F.col("mask").alias("__mask"))
    keyed = docs.withColumn("__text", body).withColumn("__key", F.xxhash64("__text"))
    others = [c for c in docs.columns if c != text] or [text]
    joined = spread_join(keyed, found, "__key", hot_keys(counts, "__key", total), F.xxhash64(*others), "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    each = []
    for i, rule in enumerate(rules):
        wanted = F.col("__text").rlike(rule.pattern)
        if trigram_query(rule.pattern):
            wanted = (F.coalesce(F.col("__mask"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0) & wanted
        each.append(F.when(wanted, spans("__text", rule, i)).otherwise(none))
    return joined.select(*[F.col(c) for c in docs.columns], F.array_sort(F.concat(*each)).alias("__spans"))


def rendered(spans_: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the digest of all rules, without an index."""

    def found(rule: Rule, rank: int) -> str:
        p = rule.pattern.replace("'", "''").replace("(?i:password|passwd|secret|token|api_?key)", "(?:" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")")
        return (
            f"list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{"
            f"'s': list_sum(list_transform(regexp_split_to_array(t, '{p}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda x: length(x))), 0), "
            f"'k': {rank}, "
            f"'n': length(regexp_extract_all(t, '{p}')[i]), 'g': length(regexp_extract_all(t, '{p}', {rule.group})[i])}}), lambda x: x.g >= {rule.min_chars})"
        )

    rules = BASE + ADDED
    columns = ", ".join(f"CASE WHEN regexp_matches(t, '{re.sub(chr(39), chr(39) * 2, r.pattern)}') THEN {found(r, i)} ELSE [] END AS k{i}" for i, r in enumerate(rules))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"

    def joined(lists: range) -> str:
        all_ = " || ".join(f"k{i}" for i in lists)
        return f"array_to_string(list_transform(list_sort({all_}), lambda x: {kinds}[x.k + 1] || ':' || cast(x.s as bigint) || ':' || cast(x.s + x.n as bigint)), ',')"

    return (
        f"WITH found AS (SELECT doc_id, {columns} FROM (SELECT doc_id, coalesce(text, '') AS t FROM {table})) "
        f"SELECT doc_id, cast(len(k0) as bigint) AS n_assign, cast(len(k1) as bigint) AS n_access, cast(len(k2) as bigint) AS n_hex, "
        f"sha256({joined(range(len(BASE)))}) AS base_sha256, {joined(range(len(rules)))} AS spans FROM found"
    )


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
