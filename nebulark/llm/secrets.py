"""Secret scans with a trigram inverted index, by DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived: strings of which one must occur, each an
intersection of its trigrams. Postings of those trigrams are intersected into candidate documents, which the regular
expression then verifies. Rules in which no trigram is mandatory scan every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.llm.common import stash


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` of which group `group` has at least `least` characters; `base` rules count in the digest."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    # Runs of 16 and more are the runs of [0-9a-f]+ that are long enough, as a run ends where no such character follows.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("hub", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
#: Candidate ids that are broadcast with their bits, about 10 MB.
BROADCAST_IDS = 500_000
#: Strings that a run of literals and small classes may stand for before it is cut.
MOST = 64


def mandatory(pattern: str) -> list[set[str]]:
    """Sets of strings, lower case; a match of pattern contains at least one string of each set."""
    found: list[set[str]] = []

    def close(exact: set[str]) -> set[str]:
        if min(map(len, exact)) >= 3:
            low = {x.lower() for x in exact}
            found.append({x for x in low if not any(y in x and y != x for y in low)})  # the others have one of these in them
        return {""}

    def strings(items) -> set[str] | None:
        """All that a part can stand for, if that is few."""
        out = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = {chr(arg)}
            elif name == "SUBPATTERN":
                more = strings(arg[3])
            elif name == "BRANCH":
                parts = [strings(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                more = {chr(a) for _, a in arg}
            elif name == "MAX_REPEAT" and arg[1] <= 1:
                more = strings(arg[2])
                more = more and more | {""}
            else:
                more = None
            if more is None or len(out) * len(more) > MOST:
                return None
            out = {a + b for a, b in product(out, more)}
        return out

    exact = {""}
    for item in re._parser.parse(pattern):  # the standard library's own parser
        more = strings([item])
        if more is None or len(exact) * len(more) > MOST:
            exact = close(exact)
            more = more or {""}
        exact = {a + b for a, b in product(exact, more)}
    close(exact)
    return found


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def has_any(low: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text has a first trigram of any string of a rule's first clause: without one it is no candidate."""
    first = {s[:3] for rule in rules for clause in mandatory(rule.pattern)[:1] for s in clause}
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(g)) for g in sorted(first)), F.lit(False))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """Ids and a bit for each rule that the document may match, by intersecting postings; only rules with a query."""
    clauses = [(r, c, sorted(strings)) for r, rule in enumerate(rules) for c, strings in enumerate(mandatory(rule.pattern))]
    grams = sorted(set().union(*(trigrams(s) for _, _, strings in clauses for s in strings)))
    low = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))
    hits = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams))))
    postings = low.select("id", F.explode(hits).alias("gram"))
    # A string's trigrams, as numbered bits: the postings of a document are intersected when all bits are there.
    uses = [(grams.index(g), r, c, s, 1 << k) for r, c, strings in clauses for s, text in enumerate(strings) for k, g in enumerate(sorted(trigrams(text)))]
    by_gram = {g: [u[1:] for u in uses if u[0] == g] for g in range(len(grams))}
    struct = lambda u: F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(u, "rcsb")))
    table = F.array(*(F.array(*map(struct, by_gram[g])) for g in range(len(grams))))
    used = postings.select("id", F.explode(F.element_at(table, F.col("gram") + 1)).alias("u")).select("id", "u.*")
    whole = used.groupBy("id", "r", "c", "s").agg(F.expr("bit_or(b)").alias("got"))
    need = {(r, c, s): (1 << len(trigrams(text))) - 1 for r, c, strings in clauses for s, text in enumerate(strings)}
    full = F.coalesce(*(F.when((F.col("r") == r) & (F.col("c") == c) & (F.col("s") == s), F.col("got") == n) for (r, c, s), n in need.items()))
    clause_bit = F.coalesce(*(F.when((F.col("r") == r) & (F.col("c") == c), F.lit(1 << k)) for k, (r, c, _) in enumerate(clauses)))
    met = whole.where(full).groupBy("id").agg(F.bit_or(clause_bit).alias("met"))
    bits = F.lit(0)
    for r in range(len(rules)):
        own = sum(1 << k for k, x in enumerate(clauses) if x[0] == r)
        bits = bits + F.when(F.lit(own > 0) & (F.col("met").bitwiseAND(F.lit(own)) == own), F.lit(1 << r)).otherwise(F.lit(0))
    return met.select("id", bits.alias("bits"))


#: Matches of one text that are numbered in a row; the work for n matches is n times this.
RUN = 256


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: str, number: int, rule: Rule) -> Column:
    """Array of (start, number of the rule, end) of a rule's matches, in code points, from what lies between them.

    Places are sums of lengths: within runs of RUN matches first, then over the runs, so that arrays that grow stay short.
    """
    p = F.lit(rule.pattern)
    parts, whole = F.split(F.col(text), rule.pattern, -1), F.regexp_extract_all(F.col(text), p, F.lit(0))
    value = F.regexp_extract_all(F.col(text), p, F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(F.slice(parts, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), value.alias("value"))
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    none, zero = F.array().cast(kind), F.lit(0).cast("long")

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.cast("long").alias("start"), F.lit(number).alias("kind"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["value"]) >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def follow(acc, run):
        moved = F.transform(run["found"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), x["kind"].alias("kind"), (x["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["runs"], F.array(moved)).alias("runs"))

    def numbered(rs):
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(rs), F.lit(1)), F.lit(RUN)), lambda s: F.slice(rs, s, F.lit(RUN)))
        each = F.transform(runs, lambda run: F.aggregate(run, F.struct(zero.alias("at"), none.alias("found")), add))
        return F.flatten(F.aggregate(each, F.struct(zero.alias("at"), F.array().cast(f"array<{kind}>").alias("runs")), follow, lambda acc: acc["runs"]))

    return F.when(F.col(text).rlike(rule.pattern), bound(rows, numbered)).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, found (array of start, kind number, end), a count n_<kind> for each base kind,
    base_sha256 of the base spans and spans, the text form of all of them, by start, then kind as listed.

    Candidate bits are written first. While they are few, up to BROADCAST_IDS ids, they go to the texts, which stay in
    place; beyond that, texts with any of the trigrams meet them in a join, and the others stay in place. A row is judged
    with every rule that any row of its id may match, and the regular expression decides. Null texts count as empty; a
    null id is matched with null; repeated rows are kept; an empty table gives no rows. Python's and Java's syntax must
    agree on the patterns.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = stash(candidates(docs, rules, "id", "text")).alias("c")
    few = bits.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    met = lambda d, bits: d.alias("d").join(bits, F.col("d.id").eqNullSafe(F.col("c.id")), "left").select("d.id", "text", F.coalesce("bits", F.lit(0)).alias("bits"))
    if few:
        d = met(docs, F.broadcast(bits))
    else:
        some = has_any(F.lower("text"), rules)
        d = met(docs.where(some), bits).unionAll(docs.where(~some).select("id", "text", F.lit(0).alias("bits")))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    each = [spans("text", k, r) if not mandatory(r.pattern) else F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) > 0, spans("text", k, r)).otherwise(none) for k, r in enumerate(rules)]
    d = d.select("id", F.array_sort(F.concat(*each)).alias("found"))
    names = F.array(*(F.lit(r.kind) for r in rules))
    text = lambda col: F.array_join(F.transform(col, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    based = [k for k, r in enumerate(rules) if r.base]
    base = F.filter("found", lambda x: x["kind"].isin(based))
    of = lambda k: F.filter("found", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{rules[k].kind}") for k in based]
    return d.select(F.col("id").alias(id_col), "found", *counts, F.sha2(text(base), 256).alias("base_sha256"), text("found").alias("spans"))
