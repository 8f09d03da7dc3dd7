"""Personal data: patterns, and terms that reveal what the patterns found. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import doc_texts, staged

# Kinds in the order of the report, and their patterns. Possessive repeats and the look
# behind give the same leftmost matches as the plain patterns in linear time and without recursion.
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
POSSIBLE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": "+"}
TERM = r"[\p{L}][\p{L}\p{N}_-]{3,}"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    twice = lambda i: 2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(i)).otherwise(value(i))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(_digits(match)).between(14, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return match.isNotNull()


#: Array elements of one running block, and characters of one piece of a text: what is looked at for one
#: match does not grow with the text.
_RUN, _PIECE = 128, 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What merge makes of zero and all values up to each one.

    Block by block, each from the last value of the one before, as appending to one long array copies it.
    """

    def over(values: Column) -> Column:
        none = F.transform(F.slice(values, 1, 0), lambda _: zero)

        def block(done: Column, first: Column) -> Column:
            before = F.coalesce(F.try_element_at(F.get(done, F.size(done) - 1), F.lit(-1)), zero)
            put = lambda out, v: F.concat(out, F.array(merge(F.coalesce(F.get(out, F.size(out) - 1), before), v)))
            return F.concat(done, F.array(F.aggregate(F.slice(values, first, _RUN), none, put)))

        firsts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(_RUN))
        return F.flatten(F.aggregate(firsts, F.array(none), block))

    return _let(values, over)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from start to end (exclusive) of a text in pieces."""
    first = F.floor(start / _PIECE).cast("int")
    held = F.slice(pieces, first + 1, F.floor(end / _PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(held, ""), start - first * _PIECE + 1, end - start)


def _walk(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Spans of a pattern's matches: what stands between matches and the matches give the places."""

    def spans(found: Column) -> Column:
        lengths = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
        ends = _running(lengths, F.lit(0), lambda at, n: at + n)
        made = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value")))
        return F.filter(made, lambda s: s["value"].isNotNull() & F.coalesce(valid(s["value"]), F.lit(False))).cast(SPAN)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def base_spans(text: Column) -> Column:
    """All base spans of a text as structs of start, kind number, end and value; by start, then kind."""
    every = []
    for kind in KINDS[:4]:
        may = text.contains(POSSIBLE[kind]) if kind in ("email", "phone") else text.rlike(POSSIBLE[kind])
        spans = _walk(text, PATTERNS[kind], KINDS.index(kind), lambda m, kind=kind: _valid(kind, m))
        every.append(F.when(may, spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*every))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _context(pieces: Column, length: Column, span: Column, reach: int) -> Column:
    """Terms within `reach` characters of a span, whole ones, as spans of their own."""
    term = KINDS.index("term")
    low, high = F.greatest(span["start"] - reach, F.lit(0)), F.least(span["end"] + reach, length)

    def terms(text: Column, by: Callable[[Column], Column]) -> Column:
        moved = lambda t: F.transform(_walk(t, TERM, term, lambda m: m.isNotNull()), lambda s: F.struct((s["start"] + by(t)).alias("start"), s["kind"], (s["end"] + by(t)).alias("end"), F.lower(s["value"]).alias("value")))
        return _let(text, moved)

    before, after = _cut(pieces, low, span["start"]), _cut(pieces, span["end"], high)
    before = F.when(low > 0, F.regexp_replace(before, r"^[\p{L}\p{N}_-]+", "")).otherwise(before)
    after = F.when(high - span["end"] == reach, F.regexp_replace(after, r"[\p{L}\p{N}_-]+$", "")).otherwise(after)
    return F.concat(terms(before, lambda t: span["start"] - F.length(t)), terms(after, lambda t: span["end"]))


def _outside(spans: Column, base: Column) -> Column:
    """The spans that overlap no base span.

    In order of the spans' ends and the base spans' starts, the furthest end of a base span so far tells.
    """
    event = lambda key, n: lambda s: F.struct(s[key].alias("key"), F.lit(n).alias("of_base"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))

    def apart(events: Column) -> Column:
        reached = _running(F.transform(events, lambda e: e["of_base"] * e["end"]), F.lit(0), F.greatest)
        pairs = F.filter(F.arrays_zip(events.alias("e"), reached.alias("upto")), lambda p: (p["e"]["of_base"] == 0) & (p["upto"] <= p["e"]["start"]))
        return F.transform(pairs, lambda p: F.struct(*(p["e"][c].alias(c) for c in ("start", "kind", "end", "value"))))

    both = F.concat(F.transform(spans, event("end", 0)), F.transform(base, event("start", 1)))
    return _let(F.array_sort(both), apart).cast(SPAN)


def scan(docs: DataFrame, *, reach: int = 80, support: int = 2, share: float = 0.5, bits: float = 6.0) -> DataFrame:
    """doc_id, key, counts by base kind, base_sha256, spans, and the spans as structs, of every document.

    Base spans are what the patterns find in the whole text. Then the corpus tells which terms beside
    them give them away: for a term t in the context (`reach` characters) of an entity e, over all
    documents, P(e|t) is the share of the documents with t in which e stands near t. A term reveals e if
    this share is at least `share`, it is 2**`bits` times the entity's own share of documents (the information
    in bits that t gives about e), and different contexts of at least `support` documents show both, so
    that copies of one passage prove nothing. Such terms near the entity become spans of kind term.

    Null text is empty: no spans. A very long text is scanned whole, in time that grows with its length and
    its matches; its row fits one task. Repeated rows are rows of their own; a null doc_id stays null. An empty
    table gives none; other columns are ignored. Only DataFrame functions run.
    """
    rows = doc_texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    beside = lambda t: F.transform("base", lambda s: F.struct(s["value"].alias("entity"), _context(t["pieces"], t["length"], s, reach).alias("terms")))
    # Lengths of whole texts are counted once a text, not at each span.
    contexts = F.when(F.size("base") > 0, _let(F.struct(_pieces(F.col("text")).alias("pieces"), F.length("text").alias("length")), beside))
    found = staged(rows.select("doc_id", "key", base_spans(F.col("text")).alias("base"), "text").select("doc_id", "key", "base", contexts.alias("contexts")))
    near = found.where(F.size("base") > 0).select("doc_id", "key", F.explode("contexts").alias("c"))
    near = near.select("doc_id", "key", F.xxhash64("c.entity").alias("entity"), F.xxhash64("c.terms.value").alias("context"), F.explode("c.terms").alias("term"))
    near = near.select("doc_id", "key", "entity", "context", F.xxhash64("term.value").alias("word"), "term")
    pairs = near.select("entity", "word", "context", "doc_id", "key").distinct().groupBy("entity", "word", "context").agg(F.countDistinct("doc_id", "key").alias("n"), F.min("key").alias("in"))
    pairs = pairs.groupBy("entity", "word").agg(F.sum("n").alias("together"), F.countDistinct("in").alias("contexts")).where(F.col("contexts") >= support)
    entities = near.select("entity", "doc_id", "key").distinct().groupBy("entity").agg(F.count("*").alias("entity_docs"))
    # Terms are counted in every document; counts are combined before they are shuffled, as hashes.
    wide = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    terms = rows.select(F.explode(wide).alias("term")).select(F.xxhash64("term").alias("word")).groupBy("word").agg(F.count("*").alias("term_docs"))
    total = rows.count()
    known = pairs.join(entities, "entity").join(terms, "word")
    given = F.least(F.col("together") / F.col("term_docs"), F.lit(1.0))
    revealing = known.where((given >= share) & (F.log2(given * total / F.col("entity_docs")) >= bits)).select("entity", "word")
    extra = near.join(revealing, ["entity", "word"]).groupBy(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"))
    extra = extra.agg(F.collect_set("term").alias("extra"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key"))
    out = found.join(extra, same, "left").select("doc_id", "key", "base", F.coalesce("extra", F.array().cast(SPAN)).alias("extra"))
    # A term inside a base span adds nothing.
    outside = F.when(F.size("extra") > 0, _outside(F.col("extra"), F.col("base"))).otherwise(F.col("extra"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.withColumn("all", F.concat("base", outside)).select(
        "doc_id",
        "key",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
        "all",
    )


def sanitised(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """doc_id and text with every span generalised to its kind in brackets; overlapping ones as one."""
    rows = doc_texts(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    found = scanned.where(F.size("all") > 0).dropDuplicates(["doc_id", "key"])
    found = found.select(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"), F.array_sort("all").alias("all"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key"))
    names = F.array(*map(F.lit, KINDS))
    text = F.col("text")

    def cleaned(pieces: Column) -> Column:
        reached = _running(F.transform("all", lambda s: s["end"]), F.lit(0), F.greatest)
        before = F.concat(F.array(F.lit(0)), reached)

        def step(s: Column, at: Column) -> Column:
            new = F.concat(_cut(pieces, at, s["start"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))
            return F.when(s["start"].isNull(), _cut(pieces, at, F.length(text))).when(s["start"] >= at, new).otherwise("")

        return F.array_join(F.zip_with("all", before, step), "")

    return rows.join(found, same, "left").select("doc_id", F.when(F.col("all").isNull(), text).otherwise(_let(_pieces(text), cleaned)).alias("text"))
