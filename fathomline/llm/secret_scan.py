"""Secrets in texts by a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams: alternatives, each a set of trigrams that a match must
contain. An index of the texts posts those trigrams; the queries intersect and unite posting lists, and the rules' own
expressions verify the candidates. Rules without mandatory trigrams read every text.

The index folds case, so it proposes a superset; a document's key is a hash of its id and text, so two documents under
one key are only both verified. Posting lists lie in shards of the key: a list holds some SHARD keys at most however
many documents share a trigram, and a query never leaves its shard.

Null texts are empty and hold nothing. Every row of the input gives a row, repeated ones and those without an id too.
Only doc_id and text are read. Positions count code points. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as grammar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import written

#: Keys of a shard on average. Alternatives and strings that a query may have before it is weakened; copies of a repeat read.
SHARD, WIDEST, COPIES = 1024, 64, 4
#: Elements of a block of running sums.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression (no empty matches), the group that must have least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The contract's rules, in its order (fixed values).
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # a longest run of 32 or more
)
#: Further public key formats (fixed values).
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url_password", r"://[^\s/:@]{1,256}+:[^\s/:@]{1,256}+@"),
)
RULES = BASE + MORE

# --- Boolean queries from expressions -------------------------------------------------------------------------------

#: A query: alternatives, each a set of trigrams. One alternative without trigrams: every text.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


def _least(query: Query) -> Query:
    """query without alternatives that another one implies."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(a: Query, b: Query) -> Query:
    out = _least(frozenset(x | y for x in a for y in b))
    return out if len(out) <= WIDEST else min(a, b, key=len)


def _either(a: Query, b: Query) -> Query:
    out = _least(a | b)
    return out if len(out) <= WIDEST else ALWAYS


def _holds(strings: frozenset[str]) -> Query:
    """One of the strings occurs."""
    out: Query = frozenset()
    for s in strings:
        out = _either(out, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return out


def _join(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset(x + y for x in a for y in b)


@dataclass(frozen=True)
class Part:
    """What matches of a part look like: all of them (exact) or how they begin and end, and what they need besides."""

    exact: frozenset[str] | None
    begin: frozenset[str]
    end: frozenset[str]
    need: Query = ALWAYS

    def open(self) -> Part:
        """The same without a full list: strings give their trigrams, two characters stay at either side."""
        need = _both(self.need, _both(_holds(self.begin), _holds(self.end)))
        cut = lambda s: s if len(s) <= WIDEST else frozenset([""])
        return Part(None, cut(frozenset(s[:2] for s in self.begin)), cut(frozenset(s[-2:] for s in self.end)), need)


ANY, EMPTY = Part(None, frozenset([""]), frozenset([""])), Part(frozenset([""]), frozenset([""]), frozenset([""]))


def _listed(strings: frozenset[str]) -> Part:
    return Part(strings, strings, strings) if len(strings) <= WIDEST else Part(None, strings, strings).open()


def _after(a: Part, b: Part) -> Part:
    """a, then b."""
    if a.exact and b.exact and len(a.exact) * len(b.exact) <= WIDEST:
        return _listed(_join(a.exact, b.exact))
    need = _both(_both(a.need, b.need), _holds(_join(a.end, b.begin)) if len(a.end) * len(b.begin) <= WIDEST else _both(_holds(a.end), _holds(b.begin)))
    begin = _join(a.exact, b.begin) if a.exact else a.begin
    end = _join(a.end, b.exact) if b.exact else b.end
    return Part(None, begin, end, need).open()


def _one_of(parts: list[Part]) -> Part:
    if all(p.exact for p in parts):
        return _listed(frozenset().union(*(p.exact for p in parts)))
    parts, need = [p.open() for p in parts], frozenset()
    for p in parts:
        need = _either(need, p.need)
    return Part(None, frozenset().union(*(p.begin for p in parts)), frozenset().union(*(p.end for p in parts)), need).open()


def _letters(items: list) -> Part:
    """A character class: all its characters, where they are few."""
    found: set[int] = set()
    for op, x in items:
        if op == grammar.LITERAL:
            found.add(x)
        elif op == grammar.RANGE and x[1] - x[0] < 2 * WIDEST:
            found.update(range(x[0], x[1] + 1))
        else:
            return ANY
    folded = frozenset(chr(c).lower() for c in found)
    return _listed(folded) if len(folded) <= 8 and max(found) < 128 else ANY


def _part(tree) -> Part:
    out = EMPTY
    for op, x in tree:
        if op == grammar.LITERAL:
            got = _listed(frozenset([chr(x).lower()])) if x < 128 else ANY
        elif op == grammar.IN:
            got = _letters(x)
        elif op == grammar.SUBPATTERN:
            got = _part(x[3])
        elif op == grammar.ATOMIC_GROUP:
            got = _part(x)
        elif op == grammar.BRANCH:
            got = _one_of([_part(p) for p in x[1]])
        elif op in (grammar.AT, grammar.ASSERT, grammar.ASSERT_NOT):
            got = EMPTY
        elif op in (grammar.MAX_REPEAT, grammar.MIN_REPEAT, grammar.POSSESSIVE_REPEAT):
            least, most, inner = x
            one = _part(inner)
            if least == 0:
                got = _one_of([one, EMPTY]) if most == 1 else ANY
            else:
                got = one
                for _ in range(min(least, COPIES) - 1):
                    got = _after(got, one)
                got = got if least == most <= COPIES else got.open()
        else:
            got = ANY
        out = _after(out, got)
    return out


def trigram_query(pattern: str) -> Query:
    """Which trigrams (in lower case) a text must hold for the expression to match: one of the sets, whole."""
    found = _part(grammar.parse(pattern))
    return _both(found.need, _holds(found.exact)) if found.exact else found.open().need


# --- index and search -----------------------------------------------------------------------------------------------


def _sign(c: str) -> str:
    return c if c.isalnum() else f"\\x{ord(c):02x}"


def _occurring(trigrams: set[str]) -> str:
    """An expression that captures each of the trigrams at each place without consuming it; shared beginnings are read once."""
    tree: dict[str, dict[str, str]] = {}
    for t in sorted(trigrams):
        tree.setdefault(t[0], {}).setdefault(t[1], "")
        tree[t[0]][t[1]] += _sign(t[2])
    return "(?=(" + "|".join(_sign(a) + "(?:" + "|".join(f"{_sign(b)}[{c}]" for b, c in rest.items()) + ")" for a, rest in tree.items()) + "))"


def postings(texts: DataFrame, trigrams: set[str], shards: int) -> DataFrame:
    """(shard, trigram, keys): which of the texts (key, text) hold which of the trigrams, whatever the case.

    Only trigrams that some query asks for are posted; the lists of a shard come from one exchange.
    """
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_occurring(trigrams)), F.lit(1)))
    rows = texts.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", F.explode(held).alias("trigram"))
    return rows.repartition("shard").groupBy("shard", "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the kinds whose Boolean query a text's trigrams satisfy; intersections and unions of posting lists."""
    none = F.array().cast("array<bigint>")
    asked = F.array(*[F.struct(F.lit(kind).alias("kind"), F.array(*[F.array(*map(F.lit, sorted(t))) for t in sorted(query, key=sorted)]).alias("sets")) for kind, query in queries.items()])
    shards = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists")).select("lists", F.explode(asked).alias("q"))

    def posted(t: Column) -> Column:
        return F.coalesce(F.try_element_at("lists", t), none)

    every = F.transform("q.sets", lambda s: F.aggregate(F.slice(s, 2, F.size(s)), posted(s[0]), lambda a, t: F.array_intersect(a, posted(t))))
    return shards.select(F.col("q.kind").alias("kind"), F.explode(F.array_distinct(F.flatten(every))).alias("key")).groupBy("key").agg(F.collect_set("kind").alias("kinds"))


# --- verification ---------------------------------------------------------------------------------------------------


def running(values: str) -> Column:
    """The running sums of an array column of numbers; by blocks, so that long arrays cost little more than their length."""
    v = F.col(values)

    def sums(a: Column, first: Column) -> Column:
        zero = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(a, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"] + x)).alias("all")), lambda s: s["all"])

    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda s: F.slice(v, s, BLOCK))
    total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
    before = F.zip_with(sums(total, F.lit(0)), total, lambda s, x: s - x)
    return F.flatten(F.zip_with(blocks, before, sums))


def found(docs: DataFrame, rules: tuple[Rule, ...] = RULES, shard: int = SHARD) -> DataFrame:
    """(doc_id, text, spans): each row's spans as {start, place, end, kind}, by start, then the rules' order (place).

    Matches of a rule are leftmost and don't overlap; short ones count as read, but give no span.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: query for kind, query in queries.items() if query != ALWAYS}
    rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    if indexed:
        trigrams = {t for query in indexed.values() for s in query for t in s}
        index = postings(rows, trigrams, max(1, -(-docs.count() // shard)))
        rows = rows.drop("kinds").join(written(candidates(index, indexed)), "key", "left")

    names = [f"{what}{k}" for k in range(len(rules)) for what in ("hit", "end")]
    for k, r in enumerate(rules):
        p, text = F.lit(r.pattern), F.col("text")
        pairs = F.zip_with(F.split(text, r.pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda g, w: F.struct(F.char_length(g).alias("gap"), F.char_length(w).alias("width")))
        hit = F.zip_with(pairs, F.regexp_extract_all(text, p, F.lit(r.group)), lambda x, w: F.struct((x["gap"] + x["width"]).alias("step"), x["width"].alias("width"), F.char_length(w).alias("n")))
        asked = F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind) if r.kind in indexed else F.lit(True)
        rows = rows.withColumn(names[2 * k], F.when(asked & text.rlike(r.pattern), F.filter(hit, lambda x: x["n"].isNotNull())))
    rows = rows.select("doc_id", "text", *[F.col(n) for n in names[::2]], *[F.transform(F.col(n), lambda x: x["step"]).alias(f"step{k}") for k, n in enumerate(names[::2])])
    rows = rows.select("*", *[F.when(F.col(f"step{k}").isNotNull(), running(f"step{k}")).alias(names[2 * k + 1]) for k in range(len(rules))])
    def kept(k: int, r: Rule) -> Column:
        span = lambda h, e: F.struct((e - h["width"]).alias("start"), F.lit(k).alias("place"), e.alias("end"), F.lit(r.kind).alias("kind"))
        return F.zip_with(f"hit{k}", f"end{k}", lambda h, e: F.when(h["n"] >= r.least, span(h, e)))

    empty = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    return rows.select("doc_id", "text", F.sort_array(F.filter(F.concat(*[F.coalesce(kept(k, r), empty) for k, r in enumerate(rules)]), lambda x: x.isNotNull())).alias("spans"))


def shown(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """op11's columns: the base rules' counts and digest, and all spans."""
    rows = found(docs)
    base = rows.withColumn("base", F.filter("spans", lambda x: x["place"] < len(BASE)))
    n = lambda k: F.size(F.filter("base", lambda x: x["place"] == k)).cast("long")
    return base.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


# --- the same by plain reading, in SQL ------------------------------------------------------------------------------


def _sql_spans(k: int, r: Rule) -> str:
    """DuckDB: the spans of a rule by the gaps and lengths of its matches (that dialect knows no possessive repeats)."""
    p = re.sub(r"(?<=\})\+", "", r.pattern).replace("'", "''")
    whole, part = f"regexp_extract_all(text, '{p}')", f"regexp_extract_all(text, '{p}', {r.group})"
    step = f"list_transform(range(1, len({whole}) + 1), lambda i: [length(regexp_split_to_array(text, '{p}')[i]), length({whole}[i]), length({part}[i])])"
    span = f"list_transform(range(1, len(h) + 1), lambda i: {{'start': list_sum(list_transform(h[1:i], lambda x: x[1] + x[2])) - h[i][2], 'place': {k}, 'stop': list_sum(list_transform(h[1:i], lambda x: x[1] + x[2])), 'kind': '{r.kind}', 'n': h[i][3]}})"
    return f"SELECT row, list_filter({span}, lambda x: x.n >= {r.least}) AS s FROM (SELECT row, {step} AS h FROM t WHERE regexp_matches(text, '{p}'))"


_SHOWN = "coalesce(list_aggregate(list_transform({}, lambda x: x.kind || ':' || x.start::BIGINT || ':' || x.stop::BIGINT), 'string_agg', ','), '')"
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(_sql_spans(k, r) for k, r in enumerate(RULES))}),
every AS (SELECT row, list_sort(flatten(list(s))) AS s FROM hits GROUP BY row),
u AS (SELECT doc_id, coalesce(s, []) AS s, list_filter(coalesce(s, []), lambda x: x.place < {len(BASE)}) AS base FROM t LEFT JOIN every USING (row))
SELECT doc_id, len(list_filter(base, lambda x: x.place = 0))::BIGINT AS n_assign, len(list_filter(base, lambda x: x.place = 1))::BIGINT AS n_access, len(list_filter(base, lambda x: x.place = 2))::BIGINT AS n_hex,
       sha256({_SHOWN.format("base")}) AS base_sha256, {_SHOWN.format("s")} AS spans FROM u
"""
