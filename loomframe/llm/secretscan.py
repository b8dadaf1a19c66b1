"""Secret scans over a trigram inverted index, with DataFrame operations only.

From each rule's regular expression a Boolean query is derived: alternatives of trigrams that every
match holds. The index has a posting (trigram, document) for each trigram that some query asks
for. Postings are intersected by counting, for each document and alternative, the trigrams met;
documents that meet all of one are candidates, on which the expression itself is run. Only texts that
hold the trigram of the shortest posting list of some alternative move to meet that verdict. A rule
without mandatory trigrams runs on every text, where it lies.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomframe.llm._common import columns_of, quoted, staged, unused

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as sre
    from re import _parser

#: A query: alternatives, each a set of trigrams that must all occur. One empty set: any text.
Query = list[frozenset]
ANY: Query = [frozenset()]
#: Larger sets of strings or alternatives are given up for a weaker query.
MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts when its group (0: all of it) has at least least characters;
    others are passed over, and what they cover with them."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# A rule whose match ends in one run of characters asks for its length in the pattern itself: the run
# is taken whole either way, so the same matches count, and short runs, which any text has by the
# thousand, are no matches at all.

# The base rules, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# To the END line; if that is missing, headers and lines of base64, of which the last may be short.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s+(?:Proc-Type|DEK-Info):[^\r\n]*+)*+(?:(?:\\[rn]|\s)*+[A-Za-z0-9+/]{40,}+={0,2}+)*+"
    r"(?:(?:(?:\\[rn]|[\r\n])++[A-Za-z0-9+/]++={0,2}+(?![^\r\n\\\"'])|\s[A-Za-z0-9+/]++={1,2}+))?+)"
)
# Further rules.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", PEM),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def grams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def simplified(query: Query) -> Query:
    """Without alternatives that ask for all that another does, and more."""
    kept = [a for a in set(query) if not any(b < a for b in query)]
    return sorted(kept, key=sorted)


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST:
        return min(a, b, key=len)
    return simplified([x | y for x in a for y in b])


def of_strings(strings: set[str]) -> Query:
    return simplified([grams(x) for x in strings])


def analysed(tree) -> tuple[set[str] | None, Query]:
    """The strings that tree can match, if few, and a query that each of its matches fulfils. All
    lower-cased, as the index is."""
    strings: set[str] = {""}  # of the run of few strings that ends here
    query, exact = ANY, True
    for op, arg in tree:
        few, sub = None, ANY
        if op is sre.LITERAL:
            few = {chr(arg).lower()}
        elif op is sre.IN:
            few = _characters(arg)
        elif op is sre.SUBPATTERN:
            few, sub = analysed(arg[3])
        elif op is sre.BRANCH:
            parts = [analysed(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                few = set().union(*(p[0] for p in parts))
            else:
                sub = simplified([a for p in parts for a in (of_strings(p[0]) if p[0] is not None else p[1])])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            strings_in, query_in = analysed(inner)
            if (least, most) == (0, 1) and strings_in is not None:
                few = strings_in | {""}
            elif least == most == 1:
                few, sub = strings_in, query_in
            elif least >= 1:
                sub = of_strings(strings_in) if strings_in is not None else query_in
        elif op is sre.AT:
            few = {""}
        if few is not None and len(few) * len(strings) <= MOST:
            strings = {a + b for a in strings for b in few}
            continue
        query = both(query, of_strings(strings))
        query = both(query, of_strings(few) if few is not None else sub)
        strings, exact = {""}, False
    if exact:
        return strings, of_strings(strings)
    return None, both(query, of_strings(strings))


def _characters(parts) -> set[str] | None:
    found: set[str] = set()
    for op, arg in parts:
        if op is sre.LITERAL:
            found.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def derive(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression."""
    return analysed(_parser.parse(pattern))[1]


def indexed(rules: tuple[Rule, ...]) -> tuple[list[tuple[str, int, int, int]], list[int]]:
    """(trigram, rule, alternative, trigrams of the alternative) of the rules that have a query; numbers
    of the rules that have none."""
    queries = {n: derive(r.pattern) for n, r in enumerate(rules)}
    full = [n for n, q in queries.items() if any(not a for a in q)]
    return [(g, n, i, len(a)) for n, q in queries.items() if n not in full for i, a in enumerate(q) for g in sorted(a)], full


def postings_of(docs: DataFrame, terms: list[tuple[str, int, int, int]]) -> DataFrame:
    """Staged: doc_id, content (hash of the text) and gram, for each trigram asked for that a text holds."""
    held = held_of(F.col("text"), sorted({t[0] for t in terms}), F.filter)
    return staged(docs.select("doc_id", F.xxhash64("text").alias("content"), F.explode(held).alias("gram")), "postings")


def held_of(text: Column, grams: list[str], pick: Callable) -> Column:
    """pick (filter or exists) of grams by whether the lower-cased text, made once, holds them."""
    asked = F.array(*map(F.lit, grams)).cast("array<string>")
    return F.get(F.transform(F.array(F.lower(text)), lambda low: pick(asked, lambda g: F.contains(low, g))), F.lit(0))


def candidates(postings: DataFrame, terms: list[tuple[str, int, int, int]]) -> DataFrame:
    """doc_id, content and rules: numbers of the rules of which a text holds all trigrams of some
    alternative, by intersecting postings; only texts that have one."""
    # As many rows as the queries have trigrams: a bounded broadcast.
    table = postings.sparkSession.createDataFrame(terms, "gram string, rule int, alternative int, asked int")
    met = (
        postings.join(F.broadcast(table), "gram")
        .groupBy("doc_id", "content", "rule", "alternative")
        .agg(F.count("*").alias("met"), F.first("asked").alias("asked"))
        .where(F.col("met") >= F.col("asked"))
    )
    return met.groupBy("doc_id", "content").agg(F.collect_set("rule").alias("rules"))


def rarest(postings: DataFrame, terms: list[tuple[str, int, int, int]]) -> list[str]:
    """Of each alternative the trigram with the shortest posting list. A text without any of them is
    no candidate."""
    met = {r[0]: r[1] for r in postings.groupBy("gram").count().collect()}  # a count for each trigram asked for
    of: dict[tuple[int, int], list[str]] = {}
    for gram, rule, alternative, _ in terms:
        of.setdefault((rule, alternative), []).append(gram)
    return sorted({min(grams, key=lambda g: (met.get(g, 0), g)) for grams in of.values()})


def with_rules(docs: DataFrame, rules: tuple[Rule, ...], name: str) -> DataFrame:
    """docs with name: numbers of the rules to run on the text. Only texts that hold a rarest trigram
    of an alternative are joined with the candidates; the others stay where they lie."""
    columns = docs.columns
    same, content, mark, found = (unused([*columns, name], n) for n in ("same_id", "content", "content_", "rules_"))
    terms, full = indexed(rules)
    always = F.array(*map(F.lit, full)).cast("array<int>")
    if not terms:
        return docs.withColumn(name, always)
    postings = postings_of(docs, terms)
    few = candidates(postings, terms).select(F.col("doc_id").alias(same), F.col("content").alias(content), F.col("rules").alias(found))
    maybe = F.coalesce(held_of(F.col("text"), rarest(postings, terms), F.exists), F.lit(False))
    marked = docs.where(maybe).withColumn(mark, F.xxhash64("text"))
    joined = marked.join(few, marked["doc_id"].eqNullSafe(few[same]) & (marked[mark] == few[content]), "left")
    asked = joined.select(*quoted(columns), F.concat(F.coalesce(found, F.array().cast("array<int>")), always).alias(name))
    return docs.where(~maybe).withColumn(name, always).unionByName(asked)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and secrets (kind, start, end in code points, end exclusive; by start, then by the
    rules' order) of every row.

    A null text counts as empty. Repeated rows and null ids are scanned each. Matches of one rule do
    not overlap, those of different rules may. Other columns are ignored.
    """
    rows = columns_of(docs, "doc_id", "text")
    text = F.col("text")

    def lengths(n: int, rule: Rule) -> Column:
        """Of what stands before each match, of the matches, and of the group that decides."""
        pattern = F.lit(rule.pattern)
        size = lambda parts: F.transform(parts, lambda x: F.length(x))
        whole = size(F.regexp_extract_all(text, pattern, F.lit(0)))
        zipped = F.arrays_zip(
            size(F.split(text, rule.pattern, -1)).alias("before"),
            whole.alias("length"),
            size(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("deciding"),
        )
        hit = F.array_contains("todo", n) & F.regexp_like(text, pattern)
        found = F.transform(zipped, lambda x: F.struct(F.lit(n).alias("rule"), *[x[k].alias(k) for k in ("before", "length", "deciding")]))
        return F.when(hit, found)

    kind = "array<struct<rule:int,before:int,length:int,deciding:int>>"
    marked = with_rules(rows, rules, "todo").withColumn("row_id", F.monotonically_increasing_id())
    measured = staged(
        marked.select("row_id", "doc_id", *[lengths(n, r).cast(kind).alias(f"r{n}") for n, r in enumerate(rules)]), "matches"
    )
    any_found = F.coalesce(*[F.col(f"r{n}.rule") for n in range(len(rules))]).isNotNull()
    every = measured.where(any_found).select("row_id", F.posexplode(F.flatten(F.filter(F.array(*[f"r{n}" for n in range(len(rules))]), lambda a: a.isNotNull()))))
    every = every.select("row_id", "pos", "col.*").where(F.col("length").isNotNull())
    run = Window.partitionBy("row_id", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("length")).over(run)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    spans = (
        every.withColumn("end", end)
        .where(F.col("deciding") >= least)
        .select("row_id", F.struct((F.col("end") - F.col("length")).alias("start"), "rule", "end").alias("s"))
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list("s")).alias("s"))
    )
    names = F.array(*[F.lit(r.kind) for r in rules])
    secrets = F.transform(
        F.coalesce("s", F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")),
        lambda x: F.struct(F.element_at(names, x["rule"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    return measured.select("row_id", "doc_id").join(spans, "row_id", "left").select("doc_id", secrets.alias("secrets"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, from scan()."""
    base = [r.kind for r in BASE_RULES]
    told = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of_base = F.filter("secrets", lambda x: x["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(F.array_join(F.transform(of_base, told), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", told), ",").alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """docs with mark in place of every secret in text, and one mark for secrets of several rules that
    overlap; other columns as they are. All are looked for in the text as it was. Null texts stay
    null, and texts without a secret are unchanged."""
    todo = unused(docs.columns, "todo")
    hits = unused([*docs.columns, todo], "hits")
    text = F.col("text")
    met = [F.when(F.array_contains(todo, n) & F.regexp_like(text, F.lit(r.pattern)), F.lit(n)) for n, r in enumerate(rules)]
    marked = with_rules(docs, rules, todo).withColumn(hits, F.array_compact(F.array(*met)))
    out = F.when(F.size(hits) > 1, _redacted_all(text, F.col(hits), rules, mark))
    for n, rule in enumerate(rules):
        out = out.when(F.array_contains(hits, n), _redacted(text, rule, mark))
    return marked.withColumn("text", out.otherwise(text)).select(*quoted(docs.columns))


def _redacted_all(text: Column, hits: Column, rules: tuple[Rule, ...], mark: str) -> Column:
    """text with mark in place of the union of the rules' spans; spans that only touch stay apart."""
    kind = "array<struct<start:int,end:int>>"

    def spans(rule: Rule) -> Column:
        zipped = F.arrays_zip(
            F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("before"),
            F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x)).alias("length"),
            F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x)).alias("deciding"),
        )

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + x["before"]
            end = start + F.coalesce(x["length"], F.lit(0))
            one = F.array(F.struct(start.alias("start"), end.alias("end"))).cast(kind)
            return F.struct(end.alias("at"), F.when(x["deciding"] >= rule.least, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

        return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])

    every = F.array_sort(F.flatten(F.array(*[F.when(F.array_contains(hits, n), spans(r)).otherwise(F.array().cast(kind)) for n, r in enumerate(rules)])))

    def join(s: Column, x: Column) -> Column:
        """at: the end of what out covers."""
        new = F.concat(s["out"], F.array(F.substr(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when((x["start"] >= s["at"]), new).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(every, start, join, lambda s: F.array_join(F.concat(s["out"], F.array(F.substr(text, s["at"] + 1))), ""))


def _redacted(text: Column, rule: Rule, mark: str) -> Column:
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("deciding"),
    )

    def put(x: Column) -> Column:
        shown = F.when(x["match"].isNull(), "").when(F.length(x["deciding"]) >= rule.least, mark).otherwise(x["match"])
        return F.concat(x["before"], shown)

    return F.array_join(F.transform(zipped, put), "")
