"""Personal data by regular expressions, checksum validators and context, in DataFrame functions only.

A pattern proposes spans: matches are set off by a mark, the marked text is split there, and a fold over the parts
counts code points. Validators confirm (Luhn for cards, mod-97 for account numbers, ranges for addresses), and words
near a span raise its score. Spans of the four base kinds are kept once confirmed; the further kinds need a score of
``THRESHOLD``.

Where Java's matcher would take quadratic time or deep recursion on very long runs, the patterns are possessive or
start at a run's first character only; what they match is the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.5
CONTEXT_CHARS = 40
CHUNK = 256  # even, so that a chunk starts outside a match
#: Longer kinds first, where one may hold another.
REDACT_ORDER = ("email", "iban", "phone", "card", "ip", "ssn")

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A character that a text must hold for the kind to occur, where there is one.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.2}
NEARBY = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": r"ssn|social security|\btax id",
}
NEARBY_SCORE = 0.3

_MARK, _OTHER = "\ue000", "\ue001"
#: In ``redact`` the two characters stand as pairs that no pattern takes in, and are restored at the end.
_PAIRS = {_MARK: "\ue001\ue002", _OTHER: "\ue001\ue003"}


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _octet(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+", "")
    return (F.char_length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)


def mod97(span: Column) -> Column:
    """The account number's check: letters as 10 to 35, first four characters last, remainder 1."""
    bare = F.replace(span, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    digit = lambda c: c.between("0", "9")
    step = lambda r, c: F.when(digit(c), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s, r"\."), _octet),
    "card": lambda s: F.char_length(_digits(s)).between(12, 19) & F.call_function("luhn_check", _digits(s)),
    "phone": lambda s: F.char_length(_digits(s)).between(9, 15),
    "iban": mod97,
    "ssn": lambda s: ~F.substring(s, 1, 3).isin("000", "666") & (F.substring(s, 5, 2) != "00"),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _parts(text: Column, kind: str) -> Column:
    """The text split around the pattern's matches: every second part is one."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), PATTERNS[kind], f"{_MARK}$0{_MARK}")
    if kind in NEEDS:
        marked = F.when(F.contains(text, F.lit(NEEDS[kind])), marked).otherwise(F.lit(""))
    return F.split(marked, _MARK, -1)


def _judged(parts: Column, kind: str) -> Column:
    """array<struct<n, hit, score>> of the parts: code points, whether it is a span to report, its score.

    The context is what lies near the span up to the next one of its kind."""

    def judge(part: Column, i: Column) -> Column:
        after = F.coalesce(F.try_element_at(parts, i + 2), F.lit(""))
        nearby = F.concat(F.substring(F.element_at(parts, F.greatest(i, F.lit(1))), -CONTEXT_CHARS, CONTEXT_CHARS), F.lit(" "), F.substring(after, 1, CONTEXT_CHARS))
        valid = F.when(i % 2 == 1, VALID[kind](part)).otherwise(F.lit(False))
        plus = F.when(F.lower(nearby).rlike(NEARBY[kind]), NEARBY_SCORE).otherwise(0.0)
        score = F.when(valid, F.least(F.lit(SCORES[kind]) + plus, F.lit(1.0)))
        hit = valid if kind in BASE else valid & (score >= THRESHOLD)
        return F.struct(F.char_length(part).alias("n"), F.coalesce(hit, F.lit(False)).alias("hit"), score.alias("score"))

    return F.transform(parts, judge)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _spans(text: Column, kind: str) -> Column:
    """array<struct<start,rank,end,kind,score>> of the kind's spans, in code points, end exclusive.

    Places are sums over the parts before. They are folded in chunks, then the chunks are shifted, so that a text of
    very many spans does not copy a growing array each time."""
    none = F.array().cast(f"array<{_SPAN}>")

    def fold(chunk: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            end = state["at"] + part["n"]
            span = F.struct(state["at"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), part["score"].alias("score"))
            found = F.when(part["hit"], F.concat(state["found"], F.array(span))).otherwise(state["found"])
            return F.struct(end.alias("at"), found.cast(f"array<{_SPAN}>").alias("found"))

        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), none.alias("found")), step)

    def shift(state: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["found"], lambda s: s.withField("start", s["start"] + state["at"]).withField("end", s["end"] + state["at"]))
        return F.struct((state["at"] + chunk["at"]).alias("at"), F.concat(state["out"], F.array(moved.cast(f"array<{_SPAN}>"))).alias("out"))

    def placed(judged: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(judged), F.lit(CHUNK))
        chunks = F.transform(starts, lambda i: fold(F.slice(judged, i, CHUNK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        return F.flatten(F.aggregate(chunks, start, shift, lambda s: s["out"]))

    return _let(_parts(text, kind), lambda parts: F.when(F.size(parts) > 1, _let(_judged(parts, kind), placed)).otherwise(none))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: array<struct<start,rank,end,kind,score>> by start, then kind.

    A null text counts as empty and has no spans; repeated rows each get theirs. A column ``pii`` of the input is
    replaced, other columns stay. Whole texts are read whatever their length.
    """
    return docs.withColumn("pii", F.array_sort(F.concat(*[_spans(whole("text"), k) for k in KINDS])))


def _redacted(text: Column, kind: str) -> Column:
    def joined(parts: Column) -> Column:
        tag = F.lit(f"<{kind.upper()}>")
        return _let(_judged(parts, kind), lambda judged: F.array_join(
            F.transform(parts, lambda p, i: F.when(F.element_at(judged, i + 1)["hit"], tag).otherwise(p)), ""))

    return _let(_parts(text, kind), lambda parts: F.when(F.size(parts) > 1, joined(parts)).otherwise(text))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets, one kind after another in
    REDACT_ORDER; a later kind is judged on the text that the kinds before left.

    All rows stay; null, empty and spanless texts are unchanged, and so is every character outside the spans. Whole texts
    are read whatever their length. ``n_chars`` is brought up to date if there is such a column and the text changed.
    All other columns keep their values, whatever their names; an empty table stays empty.
    """
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("was"))
    strange = F.col("was").rlike(f"[{_MARK}{_OTHER}]")
    swap = lambda c, pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)
    # the second character goes first, for the first one's pair holds it
    paired = swap(F.col("was"), [(_OTHER, _PAIRS[_OTHER]), (_MARK, _PAIRS[_MARK])])
    work = work.withColumn("now", F.when(strange, paired).otherwise(F.col("was")))
    for kind in REDACT_ORDER:
        work = work.withColumn("now", _redacted(F.col("now"), kind))
    restored = swap(F.col("now"), [(v, k) for k, v in _PAIRS.items()])
    work = work.withColumn("now", F.when(strange, restored).otherwise(F.col("now")))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("now").alias(name)
        own = F.col(f"row.`{name}`")
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.when(F.col("now") != F.col("was"), F.char_length("now")).otherwise(own).cast(kind).alias(name)
        return own.alias(name)

    return work.select(*[column(c) for c in docs.columns])


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("doc_id").cast("long"),
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_named(base), 256).alias("base_sha256"),
        _named(F.col("pii")).alias("spans"),
    )
