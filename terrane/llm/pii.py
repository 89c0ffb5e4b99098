"""Personal data: pattern spans, and terms of the corpus that reveal them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
Each distinct (kind, value) is a protected entity. A term (a word of any length
with a letter in it; of words joined by hyphens, the whole and each part) that
keeps close to an entity over the corpus gives the entity away even where
the value itself is masked. The disclosure of an entity c by a term t is its
pointwise mutual information relative to the entity's information content:

    PMI(c; t) / IC(c),  PMI = ln(N n_ct / (n_c n_t)),  IC = ln(N / n_c)

with counts of distinct texts: N of all, n_c with the entity, n_t with the term
anywhere, n_ct with the term next to the entity (within ``CONTEXT`` characters
of it and before the next valid entity of the kind). The ratio is 1 where the term
appears in no text without the entity. Written otherwise it is
1 + ln(n_ct / n_t) / IC, so a term that also stands elsewhere nears 1 as the
corpus grows: an entity in 4 texts and a term in these and a fifth have 0.60
at N = 7 and 0.98 at N = 10**6. A term with at least ``SUPPORT`` texts
is generalised from ``GENERALISE`` on and removed from ``REMOVE`` on, wherever
it stands in any text.

Everything is DataFrame expressions. Positions are sums of the lengths of the
matches and of the gaps between them, in code points.

Edge cases: null and empty texts have no spans; copies of a text count once
and repeated rows get the same spans; a corpus without personal data adds no
term; empty tables give no rows; other columns, whatever their names, pass
through (``sanitise``) or play no part. Patterns use possessive repeats, so very long digit or letter
runs neither recurse nor backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import text_or_empty
from terrane.session import materialize

CONTEXT = 60
SUPPORT = 3
GENERALISE = 0.97
REMOVE = 1.0

_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: kind -> pattern. A match may start only at the start of a run of its first
#: class or right after the match before: any other start fails if that does.
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the kind's pattern to be tried.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

#: A word, or words joined by hyphens, that holds a letter and is no part of an
#: address or number.
_UNIT = r"[\p{L}\p{M}\p{N}]++"
TERM = (r"(?<![\p{L}\p{M}\p{N}@._%+])(?<![\p{L}\p{M}\p{N}@._%+]-)(?=(?:[\p{M}\p{N}]++-)*+[\p{M}\p{N}]*+\p{L})"
        rf"{_UNIT}(?:-{_UNIT})*+(?!-*+[@_%+]|\.[\p{{L}}\p{{N}}])")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        # the check sum is worked out for the right lengths only
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: inside a lambda, any other
    expression would be worked out anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _totals(lengths: Column, block: int) -> Column:
    """Sums of all elements before each block of ``block`` elements."""
    zero = F.lit(0).cast("int")
    add = lambda a, x: a + x
    blocks = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(block)),
                         lambda at: F.aggregate(F.slice(lengths, at + 1, F.lit(block)), zero, add))
    return F.aggregate(blocks, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


_SPANS = "array<struct<start:int,end:int,match:string%s>>"
_MOST = CONTEXT // 2          # so many matches, of two characters at least, fill a context


def _spans(text: Column, pattern: str, needs: str | None = None, kind: str | None = None) -> Column:
    """All matches as struct(start, end, match). A start is the sum of the gaps
    and matches before it, taken in blocks of 64 so that the work stays linear.
    With ``kind``, only its valid matches, and with them before and after: the
    text around a match up to the next valid one, ``CONTEXT`` at most."""
    block = 64
    none = F.array().cast(_SPANS % (",before:string,after:string" if kind else ""))

    def placed(found, gaps, lens, sums):
        def one(m, i):
            inside = F.aggregate(F.slice(lens, (i - i % block) + 1, i % block), F.lit(0), lambda a, x: a + x)
            start = F.get(sums, (i / block).cast("int")) + inside + F.length(F.get(gaps, i))
            return _let(start, lambda at: F.struct(
                at.alias("start"), (at + F.length(m)).alias("end"), m.alias("match"),
                *([i.alias("i")] if kind else [])))
        every = F.transform(found, one)
        if not kind:
            return every
        return _let(F.filter(every, lambda m: _valid(kind, m["match"])), lambda valid: F.when(
            F.size(valid) > 0, around(valid, found, gaps)).otherwise(none))

    def around(valid, found, gaps):
        # what a match and the gap beside it can add to the context of another
        ends = F.transform(found, lambda m, i: F.right(F.concat(F.get(gaps, i), m), F.lit(CONTEXT)))
        heads = F.transform(found, lambda m, i: F.left(F.concat(m, F.get(gaps, i + 1)), F.lit(CONTEXT)))

        def one(ends, heads):
            def context(m, k):
                i = m["i"]
                low = F.greatest(F.coalesce(F.get(valid, k - 1)["i"] + 1, F.lit(0)), i - _MOST)
                high = F.least(F.coalesce(F.get(valid, k + 1)["i"], F.size(found)), i + 1 + _MOST)
                before = F.concat(F.array_join(F.slice(ends, low + 1, i - low), ""), F.get(gaps, i))
                after = F.concat(F.get(gaps, i + 1), F.array_join(F.slice(heads, i + 2, high - i - 1), ""))
                return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"),
                                F.right(before, F.lit(CONTEXT)).alias("before"),
                                F.left(after, F.lit(CONTEXT)).alias("after"))
            return F.transform(valid, context)
        return _let(ends, lambda e: _let(heads, lambda h: one(e, h)))

    def with_gaps(found, gaps):
        lens = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return _let(lens, lambda n: _let(_totals(n, block), lambda sums: placed(found, gaps, n, sums)))

    matched = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, _let(F.split(text, pattern, -1), lambda gaps: with_gaps(found, gaps))).otherwise(none))
    return F.when(text.rlike(needs), matched).otherwise(none) if needs else matched


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus, per kind, an array _<kind> of its valid matches."""
    whole = text_or_empty(text)
    return df.select("*", *[_spans(whole, pattern, _NEEDS[kind], kind).alias(f"_{kind}")
                            for kind, pattern in KINDS.items()])


def _terms(text: Column) -> Column:
    def with_parts(words):
        parts = F.flatten(F.transform(F.filter(words, lambda w: w.contains("-")), lambda w: F.split(w, "-", -1)))
        return F.concat(words, F.filter(parts, lambda p: p.rlike(r"\p{L}")))

    every = _let(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), with_parts)
    return F.array_distinct(F.transform(every, F.lower))


def _parts(word: Column) -> Column:
    """The spans of the parts of a span of words joined by hyphens."""
    def placed(parts):
        def one(p, k):
            start = word["start"] + F.length(F.array_join(F.slice(parts, 1, k), "-")) + F.least(k, F.lit(1))
            return _let(start, lambda at: F.struct(
                at.alias("start"), (at + F.length(p)).alias("end"), p.alias("match")))
        return F.transform(parts, one)
    return _let(F.split(word["match"], "-", -1), placed)


def _ratio(n: int) -> Column:
    """PMI over IC from n_c, n_t and n_ct; null where all texts have the entity."""
    pmi = F.log(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    return F.when(F.col("n_c") < n, pmi / F.log(F.lit(float(n)) / F.col("n_c")))


def disclosing_terms(spans: DataFrame, text: str = "text", generalise: float = GENERALISE,
                     support: int = SUPPORT) -> DataFrame:
    """_digest, term and ratio (the term's largest disclosure) of every text
    with a term whose disclosure of some entity is ``generalise`` or more.
    ``spans``: rows of base_spans with a column _digest of the text."""
    entities = None
    for kind in KINDS:
        some = spans.select("_digest", F.explode(f"_{kind}").alias("m")).select(
            F.lit(kind).alias("kind"), F.col("m.match").alias("value"), "_digest",
            F.concat_ws(" ", F.col("m.before"), F.lit("|"), F.col("m.after")).alias("context"))
        entities = some if entities is None else entities.unionByName(some)
    # a third of all rows may hold one entity: counts are made of partial counts
    near = materialize(
        entities.groupBy("kind", "value", "_digest").agg(F.collect_set("context").alias("c"))
        .select("kind", "value", "_digest", _terms(F.concat_ws(" | ", "c")).alias("terms")), "pii-contexts")
    n_c = near.groupBy("kind", "value").agg(F.count("*").alias("n_c")).filter(F.col("n_c") >= support)
    n_ct = (near.withColumn("term", F.explode("terms")).groupBy("kind", "value", "term")
            .agg(F.count("*").alias("n_ct")).filter(F.col("n_ct") >= support))
    # a term stands in as many texts at least as it stands near any entity in:
    # with that for n_t the ratio is an upper bound, which ordinary words fail
    n = spans.select("_digest").distinct().count()
    n_near = (near.select("_digest", F.explode("terms").alias("term")).distinct()
              .groupBy("term").agg(F.count("*").alias("n_t")))
    pairs = materialize(n_ct.join(n_c, ["kind", "value"]).join(n_near, "term")
                        .filter(_ratio(n) >= generalise - 1e-9).drop("n_t"), "pii-pairs")
    wanted = pairs.select("term").distinct()
    places = materialize(
        spans.select("_digest", F.explode(_terms(text_or_empty(text))).alias("term"))
        .join(wanted, "term", "left_semi").distinct(), "pii-places")
    n_t = places.groupBy("term").agg(F.count("*").alias("n_t"))
    found = (pairs.join(n_t, "term").withColumn("ratio", _ratio(n))
             # a whisker for the rounding of the two logarithms
             .filter(F.col("ratio") >= generalise - 1e-9)
             .groupBy("term").agg(F.max("ratio").alias("ratio")))
    return places.join(found, "term")


def with_spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE,
               support: int = SUPPORT) -> DataFrame:
    """``docs`` plus _<kind> arrays of base spans and _terms, an array of
    struct(start, end, match, action) of disclosing terms; action is
    ``generalised`` or ``removed``."""
    rows = docs.withColumn("_digest", F.unhex(F.sha2(text_or_empty(), 256)))
    found = disclosing_terms(base_spans(rows.select("_digest", "text")), "text", generalise, support)
    held = materialize(found.groupBy("_digest").agg(
        F.map_from_entries(F.collect_set(F.struct("term", "ratio"))).alias("_ratios")), "pii-texts")
    out = base_spans(rows).join(held, "_digest", "left")
    none = F.array().cast("array<struct<start:int,end:int,match:string,action:string>>")
    is_known = lambda w: F.map_contains_key(F.col("_ratios"), F.lower(w["match"]))

    def known_of(words):
        rest = F.filter(words, lambda w: w["match"].contains("-") & ~is_known(w))
        return F.array_sort(F.concat(F.filter(words, is_known),
                                     F.filter(F.flatten(F.transform(rest, _parts)), is_known)))

    known = _let(_spans(text_or_empty(), TERM), known_of)
    named = F.transform(known, lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"), w["match"].alias("match"),
        F.when(F.element_at(F.col("_ratios"), F.lower(w["match"])) >= remove - 1e-9, "removed")
        .otherwise("generalised").alias("action")))
    return (out.withColumn("_terms", F.when(F.col("_ratios").isNotNull(), named).otherwise(none))
            .drop("_ratios", "_digest"))


def _tagged(kind: str) -> Column:
    return F.transform(F.col(f"_{kind}"), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lit(f"[{kind}]").alias("put")))


def _listed(kind: str) -> Column:
    return F.transform(F.col(f"_{kind}"), lambda m: F.concat_ws(
        ":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))


def span_report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans per kind, base_sha256, and spans: all
    spans as kind:start:end (added ones have kind ``term``)."""
    s = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.array_join(F.concat(*[_listed(k) for k in KINDS]), ",")
    added = F.transform(F.col("_terms"), lambda m: F.concat_ws(
        ":", F.lit("term"), m["start"].cast("string"), m["end"].cast("string")))
    return s.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*[_listed(k) for k in KINDS], added), ",").alias("spans"),
        F.size("_terms").cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with base spans replaced by their kind in brackets, generalised
    terms by ``[word]`` and removed terms by nothing; a null text stays null."""
    # the input's columns travel in one struct: whatever their names, none clashes
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_input"), "text")
    s = with_spans(packed, **thresholds)
    tagged = F.concat(
        *[_tagged(k) for k in KINDS],
        F.transform(F.col("_terms"), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"),
            F.when(m["action"] == "removed", F.lit("")).otherwise(F.lit("[word]")).alias("put"))))
    s = s.withColumn("_tags", F.array_sort(tagged))
    # spans of different kinds may overlap: one that starts inside what is
    # already replaced only moves the end
    done = F.aggregate(
        F.col("_tags"), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, m: F.when(m["end"] <= a["at"], a).otherwise(F.struct(
            F.concat(a["out"], F.when(m["start"] >= a["at"], F.concat(
                F.substr(F.col("text"), a["at"] + 1, m["start"] - a["at"]), m["put"])).otherwise(""))
            .alias("out"), m["end"].alias("at"))))
    s = s.withColumn("_done", F.when(F.size("_tags") > 0, done))
    clean = F.when(F.size("_tags") > 0, F.concat(
        F.col("_done.out"), F.substr(F.col("text"), F.col("_done.at") + 1, F.length("text")))).otherwise(F.col("text"))
    out = s.withColumn("text", F.when(F.col("text").isNotNull(), clean))
    return out.select(*[F.col("text") if c == "text" else F.col("_input").getField(c).alias(c)
                        for c in docs.columns])
