"""Secrets in texts by a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived; a rule without mandatory trigrams scans fully. The index
holds postings (trigram, row) for the trigrams that occur in some rule's query, of the lower-cased texts. Postings are
intersected by counting, for each row and AND-clause of a rule, how many of the clause's trigrams it has. Rows with a
full clause are candidates of that rule, and only there its regex runs. A row is told by a hash of its id and text: if two
rows share it, one is scanned without need, nothing is lost.

Null texts count as empty: no spans. Repeated rows each get their own result; other columns are ignored; empty tables
give no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 64  # elements summed one by one in a prefix sum


@dataclass(frozen=True)
class Rule:
    """pattern: valid alike in Java, RE2 and Python. group: the group that must have min_group characters or more.
    any_case: ASCII letters match in either case."""

    kind: str
    pattern: str
    group: int = 0
    min_group: int = 0
    any_case: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The base rules, in the order of ties, then those that the method adds. For access and hex the least length stands in the
#: repeat: their matches are whole runs, so dropping short runs afterwards gives the same spans.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

MOST = 16  # strings that an exactly known part of a regex may stand for


def trigram_query(regex: str) -> list[frozenset[str]]:
    """The regex's trigram query as OR of AND-clauses, of lower-cased trigrams; an empty clause is true everywhere."""
    exact, clauses = _sequence(parser.parse(regex))
    return _simpler(_both(clauses, _of_strings(exact)) if exact is not None else clauses)


def _of_strings(strings: set[str]) -> list[frozenset[str]]:
    return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]


def _both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
    return _simpler([x | y for x in a for y in b])


def _simpler(clauses: list[frozenset]) -> list[frozenset]:
    """Without clauses that another one's trigrams are a part of."""
    return sorted({x for x in clauses if not any(y < x for y in clauses)}, key=sorted)


def _sequence(items) -> tuple[set[str] | None, list[frozenset]]:
    """Of a concatenation: all strings it stands for (None: unknown), else the clauses of the known runs within it."""
    run: set[str] = {""}
    clauses, open_ended = [frozenset()], False
    for op, arg in items:
        exact, own = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {x + y for x in run for y in exact}
            continue
        clauses = _both(_both(clauses, _of_strings(run)), own if exact is None else _of_strings(exact))
        run, open_ended = {""}, True
    if open_ended:
        return None, _both(clauses, _of_strings(run))
    return run, [frozenset()]


def _node(op, arg) -> tuple[set[str] | None, list[frozenset]]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, [frozenset()]
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(x is not None for x, _ in parts) and sum(len(x) for x, _ in parts) <= MOST:
            return set().union(*(x for x, _ in parts)), [frozenset()]
        return None, _simpler([c for x, own in parts for c in (own if x is None else _of_strings(x))])
    if op is sre.IN and all(x is sre.LITERAL for x, _ in arg) and len(arg) <= MOST:
        return {chr(x).lower() for _, x in arg}, [frozenset()]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact, own = _sequence(inner)
        if high == 1 and low == 0 and exact is not None:
            return exact | {""}, [frozenset()]
        if low == 0:
            return None, [frozenset()]
        return None, own if exact is None else _of_strings(exact)
    return None, [frozenset()]


def clauses(rules: tuple[Rule, ...]) -> tuple[list[tuple[str, int, str, int]], list[str]]:
    """(kind, clause, trigram, trigrams of the clause) of the rules with mandatory trigrams; kinds of those without."""
    rows, full = [], []
    for rule in rules:
        query = trigram_query(rule.regex)
        if any(not clause for clause in query):
            full.append(rule.kind)
        else:
            rows += [(rule.kind, i, t, len(clause)) for i, clause in enumerate(query) for t in sorted(clause)]
    return rows, full


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, row) of docs(row, text) over the given trigrams."""
    low = docs.select("row", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("row", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, query: list[tuple[str, int, str, int]]) -> DataFrame:
    """(row, kinds): rows that the postings of some clause of a rule have in common. One row of the index for each
    trigram and document, so counts are counts of different trigrams once rows are distinct."""
    spark = index.sparkSession
    terms = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("clause"), F.lit(t).alias("trigram"), F.lit(n).alias("need")) for k, i, t, n in query))
    terms = spark.range(1).select(F.inline(terms))  # as many rows as the rules have trigrams
    met = index.distinct().join(F.broadcast(terms), "trigram").groupBy("row", "kind", "clause", "need").agg(F.count("*").alias("n"))
    return met.where("n = need").groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def _prefix(steps: str) -> tuple[str, str]:
    """SQL of sums before each group of STEP of an array, and of the sum before place i given the former."""
    groups = f"transform(sequence(0, int((size({steps}) - 1) div {STEP})), b -> aggregate(slice({steps}, b * {STEP} + 1, {STEP}), 0, (a, x) -> a + x))"
    before = f"aggregate({groups}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    at = f"element_at(before, int(i div {STEP}) + 1) + aggregate(slice({steps}, int(i div {STEP}) * {STEP} + 1, i % {STEP}), 0, (a, x) -> a + x)"
    return before, at


def _spans(docs: DataFrame, rule: Rule, order: int, runs: Column) -> DataFrame:
    """Adds column s_<kind>: array of (start, ord, kind, end) of the rule's matches where runs holds."""
    found, kind = F.lit(rule.regex), rule.kind
    out = docs.withColumn("m", F.when(runs, F.regexp_extract_all("text", found, F.lit(0))))
    some = F.size("m") > 0
    out = out.withColumn("g", F.when(some, F.split("text", rule.regex, -1)))
    if rule.group:
        out = out.withColumn("v", F.when(some, F.regexp_extract_all("text", found, F.lit(rule.group))))
    out = out.withColumn("steps", F.when(some, F.expr("transform(m, (x, i) -> length(g[i]) + length(x))")))
    before, at = _prefix("steps")
    out = out.withColumn("before", F.when(some, F.expr(before)))
    keep = f"length(v[i]) >= {rule.min_group}" if rule.group else "true"
    made = f"transform(filter(sequence(0, size(m) - 1), i -> {keep}), i -> named_struct('start', {at} + length(g[i]), 'ord', {order}, 'kind', '{kind}', 'end', {at} + length(g[i]) + length(m[i])))"
    out = out.withColumn(f"s_{kind}", F.coalesce(F.when(some, F.expr(made)), F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int>>)")))
    return out.drop("m", "g", "v", "steps", "before")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): spans is array<struct<start,ord,kind,end>> in order of start, then of the rules, for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("row"))
    query, full = clauses(rules)
    if query:
        hits = candidates(postings(docs, sorted({t for _, _, t, _ in query})), query)
        docs = docs.join(hits, "row", "left")
    else:
        docs = docs.withColumn("kinds", F.lit(None).cast("array<string>"))
    for k, rule in enumerate(rules):
        runs = F.col("text").rlike(rule.regex) if rule.kind in full else F.array_contains("kinds", rule.kind)
        docs = _spans(docs, rule, k, runs)
    return docs.select(id_col, F.array_sort(F.concat(*(f"s_{r.kind}" for r in rules))).alias("spans"))


def joined(spans: str) -> str:
    """SQL: spans as kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    n = len(base)
    out = found.withColumn("base", F.expr(f"filter(spans, x -> x.ord < {n})"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.ord = {k})) as bigint)").alias(f"n_{r.kind}") for k, r in enumerate(base)]
    return out.select("doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))


def duckdb_sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """The same rows from the documents table in DuckDB, every regex over every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts, spans = [], []
    for k, r in enumerate(rules):
        p = quote(r.regex)
        parts.append(f"regexp_extract_all(t, {p}) AS m{k}, string_split_regex(t, {p}) AS g{k}" + (f", regexp_extract_all(t, {p}, {r.group}) AS v{k}" if r.group else ""))
        keep = f"length(v{k}[i]) >= {r.min_group}" if r.group else "true"
        start = f"(list_sum(list_transform(g{k}[1:i], lambda s: length(s)))::BIGINT + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda s: length(s))), 0)::BIGINT)"
        spans.append(f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: {keep}), lambda i: {{'s': {start}, 'o': {k}, 'k': '{r.kind}', 'e': {start} + length(m{k}[i])}})")
    text = lambda where: f"array_to_string(list_transform(list_filter(a, lambda x: {where}), lambda x: x.k || ':' || x.s || ':' || x.e), ',')"
    counts = ", ".join(f"len(list_filter(a, lambda x: x.o = {k}))::BIGINT AS n_{r.kind}" for k, r in enumerate(base))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {", ".join(parts)} FROM d),
s AS (SELECT doc_id, list_sort({" || ".join(spans)}) AS a FROM f)
SELECT doc_id, {counts}, sha256({text(f"x.o < {len(base)}")}) AS base_sha256, {text("true")} AS spans FROM s"""


def brute(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str, int]]:
    """The spans of one text by Python's regexes; for tests."""
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.regex, text or "", re.ASCII):
            if not r.group or len(m[r.group]) >= r.min_group:
                out.append((m.start(), k, r.kind, m.end()))
    return sorted(out)
