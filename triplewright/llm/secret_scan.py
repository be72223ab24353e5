"""Secret scans through an inverted index of trigrams. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import part_of, rows_of, stored, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of one of its groups (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The patterns of the base kinds, in their listed order.
BASE = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        group=2,
        least=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}", least=16),
)
#: Public formats of further keys.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
#: Most literal strings that a part of a pattern may stand for before its trigrams are taken.
STRINGS = 64
#: Code points of a piece of a text that is masked.
PIECE = 256

Clause = frozenset[str]


def _fold(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _need(strings: set[str]) -> list[list[Clause]]:
    """The condition that one of some strings occurs, if it says anything."""
    clauses = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
    return [] if not all(clauses) else [list(dict.fromkeys(clauses))]


def _item(kind, value) -> tuple[set[str] | None, list[list[Clause]]]:
    """The strings that a part stands for, or None; and what it needs at least."""
    if kind is op.LITERAL:
        return {_fold(value)}, []
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 4:
        return {_fold(v) for _, v in value}, []
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.AT:
        return {""}, []
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(p[0] is not None for p in parts):
            return set().union(*(p[0] for p in parts)), []
    if kind is op.MAX_REPEAT:
        low, high, body = value
        strings, need = _sequence(body)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, []
        if low:
            return None, need if strings is None else _need(strings)
    return None, []


def _sequence(items) -> tuple[set[str] | None, list[list[Clause]]]:
    now, need, whole = {""}, [], True
    for kind, value in items:
        strings, more = _item(kind, value)
        if strings is not None and len(now) * len(strings) <= STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        need, whole = need + _need(now) + more, False
        now = strings if strings is not None else {""}
    return (now, []) if whole else (None, need + _need(now))


def trigram_query(pattern: str) -> list[list[Clause]]:
    """What every match of a pattern must contain: an AND of ORs of sets of trigrams, in lower case.

    An empty list: no trigram is mandatory, so the rule has to scan every text.
    """
    strings, need = _sequence(parser.parse(pattern))
    return _need(strings) if strings is not None else need


def trigrams(text: Column, grams: list[str]) -> Column:
    """Places in ``grams`` of those that a text holds, its letters in lower case once for all of them."""
    held = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), i) for i, g in enumerate(grams)]))
    return F.get(F.transform(F.array(F.lower(text)), held), F.lit(0))


def candidates(docs: DataFrame, queries: dict[int, list[list[Clause]]]) -> DataFrame:
    """(doc_id, part, rules): by doc_id and part, a bit for each rule whose query the posting lists satisfy.

    The index holds the trigrams that some query names; it is written before its lists are intersected, so that each
    text is looked through once. ``docs``: doc_id, part, text.
    """
    spark = docs.sparkSession
    grams = sorted({g for q in queries.values() for group in q for clause in group for g in clause})
    place = {g: i for i, g in enumerate(grams)}
    terms = [
        (place[g], rule, group, clause, 1 << bit, (1 << len(grams_of)) - 1)
        for rule, query in queries.items()
        for group, clauses in enumerate(query)
        for clause, grams_of in enumerate(clauses)
        for bit, g in enumerate(sorted(grams_of))
    ]
    asked = spark.createDataFrame(terms, "gram int, rule int, step int, clause int, bit long, full long")
    need = [(rule, (1 << len(query)) - 1) for rule, query in queries.items()]
    parts = spark.createDataFrame(need, "rule int, steps long")
    index = stored(docs.select("doc_id", "part", trigrams(F.col("text"), grams).alias("grams")))
    postings = index.select("doc_id", "part", F.explode("grams").alias("gram"))
    met = (
        postings.join(F.broadcast(asked), "gram")  # a row per trigram of the fixed rules
        .groupBy("doc_id", "part", "rule", "step", "clause", "full")
        .agg(F.bit_or("bit").alias("bits"))
        .where("bits = full")
    )
    one = F.lit(1).cast("long")
    return (
        met.groupBy("doc_id", "part", "rule")
        .agg(F.bit_or(F.call_function("shiftleft", one, F.col("step"))).alias("got"))
        .join(F.broadcast(parts), "rule")
        .where("got = steps")
        .groupBy("doc_id", "part")
        .agg(F.bit_or(F.call_function("shiftleft", one, F.col("rule"))).alias("rules"))
    )


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each number of an array<int> combined with all before it.

    The array goes in blocks of the cube root of its size: what is copied grows with the power 4/3, not the square.
    """
    none = F.array().cast("array<int>")

    def fold(block: Column) -> Column:
        last = lambda acc, x: F.when(F.size(acc) > 0, combine(F.get(acc, F.size(acc) - 1), x)).otherwise(x)
        return F.aggregate(block, none, lambda acc, x: F.concat(acc, F.array(last(acc, x))))

    def whole(v: Column) -> Column:
        width = F.ceil(F.cbrt(F.size(v))).cast("int")
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), width)).otherwise(none)
        return _bound(F.transform(starts, lambda at: fold(F.slice(v, at, width))), shifted)

    def shifted(blocks: Column) -> Column:
        ends = fold(F.transform(blocks, lambda block: F.get(block, F.size(block) - 1)))
        after = lambda end, x: F.when(end.isNull(), x).otherwise(combine(end, x))
        moved = lambda end, block: _bound(end, lambda e: F.transform(block, lambda x: after(e, x)))
        return _bound(ends, lambda e: F.flatten(F.transform(blocks, lambda block, i: moved(F.get(e, i - 1), block))))

    return _bound(values, whole)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in a text: array<struct<start, kind order, end>>, in code points."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole

    def found(sizes: Column) -> Column:
        ends = running(F.transform(sizes, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        placed = F.filter(F.arrays_zip(sizes.alias("x"), ends.alias("end")), lambda p: p["x"]["counted"] >= rule.least)
        return F.transform(placed, span)

    def span(p: Column) -> Column:
        return F.struct((p["end"] - p["x"]["size"]).alias("start"), F.lit(order).alias("kind"), p["end"].alias("end"))

    parts = lambda w: F.arrays_zip(w.alias("m"), F.slice(gaps, 1, F.size(w)).alias("g"), counted.alias("c"))
    return _bound(_bound(whole, lambda w: F.transform(parts(w), _sizes)), found)


def _sizes(x: Column) -> Column:
    return F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["c"]).alias("counted"))


def secret_scan(
    docs: DataFrame,
    rules: tuple[Rule, ...] = BASE + MORE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """row (the columns of ``docs``), text, spans: array<struct<start, kind, end>>, by start, then the rules' order.

    Rules with mandatory trigrams are verified only in documents that the index leaves; rules
    without any scan every text. Matches of one kind are the leftmost that don't overlap; one whose
    counted group is too short is dropped after it has been found. The candidates are written before the texts meet them,
    so that Spark knows their size and moves no text where they are few.

    A null text counts as empty and gives no spans. Documents that share an id, and equal ones without any, are
    candidates together, but each is verified in its own text. Columns of any name stay in ``row``. Very long texts are scanned whole, in time
    that grows with the power 4/3 of their matches at most. Empty table: empty result.
    """
    queries = {i: q for i, rule in enumerate(rules) if (q := trigram_query(rule.pattern))}
    named = F.col(f"`{id_col}`").alias("doc_id"), part_of(id_col, text_col).alias("part"), text_of(text_col).alias("text")
    base = docs.select(*named[:2], rows_of(docs).alias("row"))
    found = stored(candidates(docs.select(*named), queries).withColumnsRenamed({"doc_id": "of", "part": "of_part"}))
    marked = base.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")), "left")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = []
    for i, rule in enumerate(rules):
        named = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(1 << i) != 0 if i in queries else F.lit(True)
        spans.append(F.when(named & F.rlike(text, F.lit(rule.pattern)), _spans(text, rule, i)).otherwise(none))
    return marked.select("row", text.alias("text"), F.array_sort(reduce(lambda a, b: F.concat(a, b), spans)).alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    text = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(text, ",")


def masked() -> Column:
    """Of secret_scan's rows the text with *** in place of each span; overlapping spans become one.

    What lies between spans is read from pieces of ``PIECE`` code points, so that no place is sought from the start.
    """
    text = F.col("text")
    numbers = lambda name: F.transform("spans", lambda s: s[name])

    def between(pieces: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / PIECE).cast("int")
        near = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
        return F.substr(F.array_join(near, ""), begin % PIECE + 1, end - begin)

    def gaps(reach: Column) -> Column:
        """(begin, end) of the text before each span that begins past all others before it, and after the last."""
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        all_gaps = F.transform(numbers("start"), lambda start, i: F.struct(before(i).alias("begin"), start.alias("end")))
        last = F.struct(before(F.size(reach)).alias("begin"), F.length(text).alias("end"))
        return F.concat(F.filter(all_gaps, lambda g: g["end"] >= g["begin"]), F.array(last))

    kept = _bound(running(numbers("end"), F.greatest), gaps)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _bound(pieces, lambda p: F.array_join(F.transform(kept, lambda g: between(p, g["begin"], g["end"])), "***"))
