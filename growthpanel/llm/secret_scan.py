"""Secrets in texts: rules are looked up in a trigram index, and only candidates meet the regular expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthpanel.llm.shared import Shelf

#: rows of one posting list
BLOCK = 1 << 14
#: most alternatives that a rule's literals are multiplied out to
_MOST = 64


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has ``least`` characters or more. The pattern must mean the same in Java and Python."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the patterns that results are compared by
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
RULES = (
    *BASE_RULES,
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _runs(tree) -> list[set[str] | None]:
    """A pattern as a sequence of literal alternatives; None stands for anything between them."""
    runs: list[set[str] | None] = []
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            runs.append({chr(value).lower()})
        elif op == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= _MOST:
            runs.append({chr(v).lower() for _, v in value})
        elif op == "SUBPATTERN":
            runs += _runs(value[3])
        elif op == "BRANCH":
            options = [_exact(_joined(_runs(b))) for b in value[1]]
            runs.append(set().union(*options) if all(o is not None for o in options) else None)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            one = _exact(_joined(_runs(inner)))
            if (least, str(most)) == (0, "1") and one is not None:
                runs.append({""} | one)
            else:
                runs += _runs(inner) * min(least, 3) if least else []
                runs.append(None)
        else:
            runs.append(None)
    return runs


def _joined(runs: list[set[str] | None]) -> list[set[str] | None]:
    out: list[set[str] | None] = []
    for run in runs:
        if run is not None and out and out[-1] is not None and len(out[-1]) * len(run) <= _MOST:
            out[-1] = {a + b for a, b in product(out[-1], run)}
        else:
            out.append(run)
    return out


def _exact(runs: list[set[str] | None]) -> set[str] | None:
    return {""} if not runs else runs[0] if len(runs) == 1 else None


def trigram_query(pattern: str) -> list[list[list[str]]] | None:
    """What a lower-cased text must hold to match: all of (any of (all of these trigrams)); None if nothing is sure.

    A literal run of fewer than three characters in any of its alternatives asks for nothing.
    """
    found = []
    for run in _joined(_runs(re._parser.parse(pattern))):
        if run and all(len(x) >= 3 for x in run):
            options = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run}
            # an option that asks for more than another one adds nothing
            found.append(sorted(sorted(o) for o in options if not any(other < o for other in options)))
    return found or None


def trigram_index(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(block, trigram, ids): sorted lists of the doc_ids whose lower-cased text holds a trigram.

    Only the trigrams that rules ask for are indexed, which keeps the index far below the size of the texts. Lists are
    cut into blocks by a hash of the doc_id, so that a trigram of every document is many short lists.
    """
    text = F.lower("text")
    held = F.filter(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.explode(held).alias("trigram"))
    blocks = max(1, -(-docs.agg(F.count("doc_id")).first()[0] // BLOCK))
    spread = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    return spread.groupBy("block", "trigram").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))


def candidates(index: DataFrame, queries: dict[str, list]) -> DataFrame:
    """(doc_id, kinds): the documents whose posting lists, intersected and united by each rule's query, let it match."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    empty = F.array().cast("array<bigint>")

    def posting(trigram: str) -> Column:
        return F.coalesce(F.element_at("lists", F.lit(trigram)), empty)

    def folded(columns: list[Column], join) -> Column:
        out = columns[0]
        for c in columns[1:]:
            out = join(out, c)
        return out

    hits = [
        F.transform(
            folded([folded([folded([posting(t) for t in option], F.array_intersect) for option in run], F.array_union) for run in query], F.array_intersect),
            _named(kind),
        )
        for kind, query in queries.items()
    ]
    rows = lists.select(F.explode(F.concat(*hits)).alias("hit")).select("hit.*")
    return rows.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _named(kind: str):
    return lambda i: F.struct(i.alias("doc_id"), F.lit(kind).alias("kind"))


def _at_least(n: int):
    return lambda v: F.length(v) >= n


def _spans(kind: str, place: int, matches: Column, pieces: Column, valid: Column) -> Column:
    """Structs (start, place, kind, end) from the matches and the pieces of text between them, in code points."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state, match):
        begin = state["at"] + F.length(F.get(pieces, state["i"]))
        end = begin + F.length(match)
        span = F.struct(begin.alias("start"), end.alias("end"))
        kept = F.when(F.get(valid, state["i"]), F.array_append(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), (state["i"] + 1).alias("i"), kept.alias("found"))

    found = F.aggregate(matches, start, step, lambda s: s["found"])
    named = (F.lit(place).alias("place"), F.lit(kind).alias("kind"))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), *named, s["end"].alias("end")))


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, secrets) for every row of ``docs`` (doc_id, text; further columns are ignored).

    ``secrets`` is an array of (start, kind, end), in code points with the end left out, of the leftmost matches of
    each rule that do not overlap, ordered by start and then by the rules' order. A text without matches, an empty and
    a null text have an empty array; rows with a null doc_id are scanned without the index; repeated rows are repeated.

    Every rule is turned into a Boolean query over trigrams. The index holds a posting list per trigram and block of
    documents; the lists are intersected and united, and only the documents left meet the rule's expression, so a
    candidate that does not match costs time and nothing else. A rule without a mandatory trigram, like hex, scans all
    texts. DataFrame functions only; the texts are shuffled once, to meet the candidates.
    """
    found = _scanned(docs.select("doc_id", "text"), rules, shelf or Shelf(docs.sparkSession))
    return found.select("row.doc_id", "secrets")


def _scanned(docs: DataFrame, rules: Sequence[Rule], shelf: Shelf) -> DataFrame:
    """(row, secrets): all columns of a row as a struct, and its spans."""
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("two rules have the same kind")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"))
    marked = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    if queries:
        trigrams = sorted({t for q in queries.values() for run in q for option in run for t in option})
        index = shelf.keep(trigram_index(docs.select("doc_id", "text"), trigrams), "trigrams")
        marked = rows.join(candidates(index, queries), "doc_id", "left")
    text = F.col("row.text")
    for k, rule in enumerate(rules):
        may = F.lit(True)
        if rule.kind in queries:
            may = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        marked = marked.withColumn(f"m{k}", F.when(may & text.isNotNull(), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))))
    for k, rule in enumerate(rules):
        some = F.size(f"m{k}") > 0
        value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.col(f"m{k}")
        valid = F.transform(value, _at_least(rule.least))
        marked = marked.withColumn(f"p{k}", F.when(some, F.split(text, rule.pattern, -1))).withColumn(f"v{k}", F.when(some, valid))
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    spans = [F.coalesce(_spans(r.kind, k, *[F.col(f"{x}{k}") for x in "mpv"]), none) for k, r in enumerate(rules)]
    ordered = F.transform(F.array_sort(F.concat(*spans)), lambda s: F.struct(*[s[x].alias(x) for x in ("start", "kind", "end")]))
    return marked.select("row", ordered.alias("secrets"))


def joined_spans(secrets: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("secrets")).alias("spans")
    )


def mask_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by [kind]; all rows and all other columns stay as they are.

    Of secrets that overlap, the first is named and all that they cover goes.
    """
    found = _scanned(docs, rules, Shelf(docs.sparkSession))
    text, start = F.col("row.text"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, s):
        fresh = s["start"] >= state["at"]
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        parts = F.when(fresh, F.concat(state["parts"], F.array(between, F.concat(F.lit("["), s["kind"], F.lit("]")))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.otherwise(state["parts"]).alias("parts"))

    masked = F.aggregate("secrets", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    new = F.when(F.size("secrets") > 0, masked).otherwise(text)
    fields = [new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*fields)


def duckdb_sql(rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES) -> str:
    """The digest of all documents in DuckDB: every rule over every text, without an index."""
    parts = []
    for k, rule in enumerate(rules):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT row_number, {k} AS place, '{rule.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, p, v, {rule.least} AS least FROM (
            SELECT row_number, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p,
            regexp_extract_all(text, '{pattern}', {rule.group}) AS v FROM d WHERE regexp_matches(text, '{pattern}'))"""
        )
    matches = " UNION ALL ".join(parts)
    kinds = ", ".join(f"'{r.kind}'" for r in base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    joined = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place){}, '')"
    return f"""
    WITH d AS (SELECT *, row_number() OVER () AS row_number FROM documents),
    found AS ({matches}),
    placed AS (SELECT row_number, place, kind, v[i] AS value, least,
        list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM found),
    spans AS (SELECT row_number, place, kind, a::BIGINT AS a, (a + n)::BIGINT AS b FROM placed WHERE length(value) >= least)
    SELECT d.doc_id, {counts}, sha256({joined.format(f" FILTER (kind IN ({kinds}))")}) AS base_sha256, {joined.format("")} AS spans
    FROM d LEFT JOIN spans USING (row_number) GROUP BY d.row_number, d.doc_id"""
