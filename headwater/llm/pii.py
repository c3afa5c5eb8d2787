"""Personal data and the terms that reveal it, by DataFrame functions alone.

1. Four kinds are found by pattern in every whole text, leftmost and without overlap;
   matches that fail their test (parts, Luhn's sum, digits) are dropped. Patterns are written with
   possessive runs and start only where a run of their letters starts, so that they take time
   linear in the text. Splitting at a pattern gives the gaps, so positions are sums of lengths.
2. Each value found is a protected entity. Its occurrences' contexts, WINDOW characters on both
   sides, give the terms near it: words of letters between white space. A corpus-wide count
   gives the pointwise mutual information between a term t and an entity e,
   log2(df(e, t) N / (df(e) df(t))), over documents.
3. A term is said to disclose e if that is at least DISCLOSURE of e's information content
   log2(N / df(e)) and MIN_BITS, and SUPPORT different texts hold both. Such a term
   is a further span of kind `term` where it stands in the context of e; documents without e
   are left alone. Terms that give away REVEALED of the content are removed by sanitise(),
   the others generalised to their kind of word.

Neither quantity exceeds log2(N / df(e)), so entities of more than N / 2**MIN_BITS documents
can't be disclosed and are left out exactly before terms are counted: no entity that is
counted is frequent. Contexts keep the rows linear in the occurrences.

Defined cases: a null text is empty and stays null; rows are documents, repeated ones and null ids too;
copies of a text count as one text of SUPPORT; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stage

_LOCAL = "A-Za-z0-9._%+-"
#: A pattern, and what any text with a match that passes must hold.
PATTERNS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
KINDS = (*PATTERNS, "term")
#: A word of letters between white space, but for closing marks.
TERM = r"(?<!\S)\p{L}{3,}+(?=[.,;:!?)]*+(?!\S))"

WINDOW = 128
MIN_BITS = 6.0
DISCLOSURE = 0.8
REVEALED = 0.95
SUPPORT = 5
#: One document in so many is counted first: a term that too many of them hold can't be above the thresholds.
PART = 16
#: Candidate terms that are broadcast to the count of documents; beyond, all terms are counted and joined.
BROADCAST_TERMS = 100_000

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _value(kind: str, m: Column) -> Column:
    """The same for all ways to write an entity."""
    return {"email": F.lower, "ip": lambda x: x}.get(kind, lambda x: F.regexp_replace(x, "[^0-9]", ""))(m)


def _matches(text: Column, pattern: str, keep: Callable[[Column], Column], made: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """made(start, end, match) for the matches of a pattern that pass, in code points; the sum of lengths runs over gaps and matches."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def fold(b: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

        def step(s: Column, m: Column) -> Column:
            start = s["at"] + F.length(m["gaps"])
            end = start + F.length(m["found"])
            more = F.when(keep(m["found"]), F.concat(s["spans"], F.array(made(start, end, m["found"])).cast(kind))).otherwise(s["spans"])
            return F.when(m["found"].isNull(), s).otherwise(F.struct(end.alias("at"), more.alias("spans")))

        return F.aggregate(F.arrays_zip(b["gaps"], b["found"]), zero, step, lambda s: s["spans"])

    return F.get(F.transform(F.array(both), fold), F.lit(0))


def _base(text: Column, kind: str) -> Column:
    pattern, needs = PATTERNS[kind]
    place = KINDS.index(kind)
    made = lambda s, e, m: F.struct(s.alias("start"), F.lit(place).alias("kind"), e.alias("end"), _value(kind, m).alias("value"))
    return F.when(F.coalesce(text.rlike(needs), F.lit(False)), _matches(text, pattern, lambda m: _passes(kind, m), made, _SPAN)).otherwise(F.array().cast(_SPAN))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, texts: bool = False) -> DataFrame:
    """A staged row for each of docs: uid, doc_id, n_email, n_ip, n_card, n_phone, base (spans by start and kind), text and its key.

    text is kept where a span was found, or everywhere if `texts`.
    """
    text = F.col("text")
    own = docs.select("doc_id", "text").select("doc_id", "text", *[_base(text, k).alias(k) for k in PATTERNS])
    base = own.select("doc_id", "text", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], F.array_sort(F.concat(*PATTERNS)).alias("base"))
    kept = F.lit(True) if texts else F.size("base") > 0
    return stage(base.select(F.monotonically_increasing_id().alias("uid"), "doc_id", *[f"n_{k}" for k in PATTERNS], "base", F.when(kept, text).alias("text"), F.when(F.size("base") > 0, F.md5(text)).alias("text_key")), "found")


def _near(text: Column, first: Column, last: Column) -> Column:
    """The terms (start, end, term) that lie wholly in [first, last) of a text."""
    kind = "array<struct<start:int,end:int,term:string>>"
    made = lambda s, e, m: F.struct((s + first).alias("start"), (e + first).alias("end"), F.lower(m).alias("term"))
    found = _matches(F.substring(text, first + 1, last - first), TERM, lambda m: F.lit(True), made, kind)
    return F.filter(found, lambda t: ((t["start"] > first) | (first == 0)) & ((t["end"] < last) | (last == F.length(text))))


def contexts(found: DataFrame, n: int, min_bits: float, support: int, window: int) -> DataFrame:
    """A staged row for each term near an entity that can be disclosed: uid, text_key, value, held (documents with the entity), start, end, term."""
    spans = found.filter(F.size("base") > 0).select("uid", "text_key", "text", F.explode("base").alias("s"))
    named = F.concat_ws(":", F.col("s.kind").cast("string"), F.col("s.value"))
    entities = spans.select(named.alias("value"), "uid", "text_key").groupBy("value").agg(F.countDistinct("uid").alias("held"), F.countDistinct("text_key").alias("texts"))
    entities = entities.filter((F.col("texts") >= support) & (F.col("held") * 2**min_bits <= n)).select("value", "held")
    first, last = F.greatest(F.col("s.start") - window, F.lit(0)), F.least(F.col("s.end") + window, F.length("text"))
    near = F.concat(_near(F.col("text"), first, F.col("s.start")), _near(F.col("text"), F.col("s.end"), last))
    rows = spans.select("uid", "text_key", named.alias("value"), near.alias("near")).join(entities, "value")
    return stage(rows.select("uid", "text_key", "value", "held", F.explode("near").alias("t")).select("uid", "text_key", "value", "held", "t.*"), "contexts")


def document_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted term (one column, distinct) the number of documents that hold it."""
    held = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    if wanted.count() <= BROADCAST_TERMS:
        held = held.join(F.broadcast(wanted), "term", "left_semi")
        return held.groupBy("term").agg(F.count("*").alias("holding"))
    return held.groupBy("term").agg(F.count("*").alias("holding")).join(wanted, "term", "left_semi")


def disclosing(docs: DataFrame, near: DataFrame, n: int, disclosure: float = DISCLOSURE, min_bits: float = MIN_BITS, support: int = SUPPORT) -> DataFrame:
    """The pairs (value, term) above the thresholds, with the share of the entity's information that the term gives."""
    pairs = near.groupBy("value", "held", "term").agg(F.countDistinct("uid").alias("both"), F.countDistinct("text_key").alias("texts"))
    pairs = stage(pairs.filter(F.col("texts") >= support).select("value", "held", "term", "both"), "pairs")
    if not pairs.limit(1).count():
        return pairs.select("value", "term", F.lit(0.0).alias("share"))
    whole = F.log2(F.lit(float(n)) / F.col("held"))
    # a pair is above the thresholds if no more than `most` documents hold the term; a part of the documents shows which terms more hold
    most = F.col("both") * float(n) / (F.col("held") * F.pow(F.lit(2.0), F.greatest(F.lit(min_bits), disclosure * whole))) * (1 + 1e-9)
    wanted = cut(pairs.groupBy("term").agg(F.max(most).alias("most")))
    part = document_counts(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PART)) == 0), wanted.select("term"))
    rare = cut(wanted.join(part, "term", "left").filter(F.coalesce("holding", F.lit(0)) <= F.col("most")).select("term"))
    pairs = pairs.join(document_counts(docs, rare), "term")
    bits = F.log2(F.col("both") * F.lit(float(n)) / (F.col("held") * F.col("holding")))
    return pairs.filter((bits >= min_bits) & (bits >= disclosure * whole)).select("value", "term", (bits / whole).alias("share"))


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, min_bits: float = MIN_BITS, support: int = SUPPORT, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """For each row doc_id, n_email, n_ip, n_card, n_phone, base and spans (base and disclosing terms), both (start, kind, end, value), and text as find() keeps it.

    kind is a place in KINDS; a term's value is the largest share of an entity's information that it gives.
    """
    found = find(docs, texts)
    n = found.count()
    near = contexts(found, n, min_bits, support, window)
    told = disclosing(docs, near, n, disclosure, min_bits, support)
    marks = near.join(told, ["value", "term"]).groupBy("uid", "start", "end").agg(F.max("share").alias("share"))
    term = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", F.round("share", 6).cast("string").alias("value"))
    marks = marks.groupBy(F.col("uid").alias("_uid")).agg(F.collect_list(term).alias("terms"))
    out = found.join(marks, F.col("uid") == F.col("_uid"), "left")
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(_SPAN)))))
    return out.select("doc_id", *[f"n_{k}" for k in PATTERNS], "base", spans.alias("spans"), "text")


def digests(found: DataFrame) -> DataFrame:
    """The columns of personal_data() with base as a digest and spans written out."""
    return found.select("doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id and the text without personal data: base spans become their kind, disclosing terms go or become their kind of word."""
    found = personal_data(docs, texts=True, **thresholds)
    text = F.col("text")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS])
    # overlapping spans are cut as one
    merged = F.aggregate("spans", F.array().cast(_SPAN), lambda out, s: F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] > s["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.get(out, F.size(out) - 1).withField("end", F.greatest(F.get(out, F.size(out) - 1)["end"], s["end"]))))).otherwise(F.concat(out, F.array(s))))
    word = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    general = lambda s: F.when(word(s).rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    instead = lambda s: F.when(s["kind"] < len(PATTERNS), F.get(names, s["kind"])).when(s["value"].cast("double") >= REVEALED, "").otherwise(general(s))
    rest = found.select("doc_id", "text", merged.alias("cut"))
    before = lambda s, i: F.coalesce(F.get(F.col("cut"), i - 1)["end"], F.lit(0))
    parts = F.transform("cut", lambda s, i: F.concat(F.substring(text, before(s, i) + 1, s["start"] - before(s, i)), instead(s)))
    last = F.coalesce(F.get(F.col("cut"), F.size("cut") - 1)["end"], F.lit(0))
    return rest.select("doc_id", F.when(F.size("cut") == 0, text).otherwise(F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))).alias("text"))
