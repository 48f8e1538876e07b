"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is built-in expressions over one row; there is no shuffle. Positions come from splitting the text at a
pattern's matches: the lengths of gaps and matches, summed up, are the spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

#: Characters before and behind a span in which context words count.
NEAR, BEHIND = 48, 24
#: Added to the score of a span with a context word nearby.
LIFT = 0.3
#: Score from which a span of an added kind is reported.
REPORT_FROM = 0.5
#: Matches summed up in one go; longer lists are summed by parts, so the work stays linear.
PART = 128
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    pattern: Java regular expression. Its quantifiers are possessive where that changes no match, so that long runs of
    the same characters neither recurse nor backtrack. hint: a cheap test that a text with a match always passes.
    """

    name: str
    pattern: str
    hint: str
    score: float
    context: str
    always: bool = True


#: Fixed values. The first four are the base kinds; the last two need their score.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, r"e-?mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|host|server|addr"),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", "", 0.7, r"card|visa|credit|debit|amex"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, r"phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "", 0.6, r"iban|account|bank|konto|compte|cuenta", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"ssn|social security|tax id", False),
)


def _confirmed(kind: str, m: Column) -> Column:
    """The kind's checksum or range test on a match."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        short = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.when(F.length(short(p)) == 0, 0).otherwise(999)) <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        plain = F.replace(m, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
        # Letters count as 10 to 35; the remainder by 97 is carried from sign to sign.
        value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(F.pmod(r * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))))
        return F.length(plain).between(15, 34) & (rest == 1)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$")
    return F.lit(True)


def _summed(items: Column) -> Column:
    """From structs of gap length, match length and match to structs of start, end and match."""
    state = "struct<pos:int,done:array<struct<start:int,end:int,m:string>>>"

    def step(s: Column, x: Column) -> Column:
        start = s["pos"] + x["gap"]
        one = F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["m"].alias("m"))
        return F.struct((start + x["len"]).alias("pos"), F.concat(s["done"], F.array(one)).alias("done"))

    def part(s: Column, p: Column) -> Column:
        begin = F.struct(s["pos"].alias("pos"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("done")).cast(state)
        r = F.aggregate(p, begin, step)
        return let(r, lambda r: F.struct(r["pos"].alias("pos"), F.concat(s["parts"], F.array(r["done"])).alias("parts")))

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<array<struct<start:int,end:int,m:string>>>").alias("parts"))
    begin = begin.cast("struct<pos:int,parts:array<array<struct<start:int,end:int,m:string>>>>")
    last = F.floor((F.size(items) - 1) / PART).cast("int")
    parts = let(items, lambda i: F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(i, k * PART + 1, PART)))
    return F.flatten(F.aggregate(parts, begin, part, lambda s: s["parts"]))


def spans_of(kind: Kind, text: Column) -> Column:
    """All spans of a kind in a text that is not null: code points, end exclusive, in order."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    seen = text.contains(kind.hint) if kind.hint else text.rlike("[0-9]")

    def located(ms: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        items = let(gaps, lambda g: F.transform(ms, lambda m, i: F.struct(F.char_length(F.get(g, i)).alias("gap"), F.char_length(m).alias("len"), m.alias("m"))))
        good = F.filter(let(items, _summed), lambda x: _confirmed(kind.name, x["m"]))

        def scored(x: Column) -> Column:
            first = F.greatest(x["start"] - NEAR, F.lit(0))
            near = F.lower(F.concat(F.substring(text, first + 1, x["start"] - first), F.lit(" "), F.substring(text, x["end"] + 1, F.lit(BEHIND)))).rlike(kind.context)
            return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (F.lit(kind.score) + F.when(near, LIFT).otherwise(0.0)).alias("score"))

        spans = F.transform(good, scored)
        return spans if kind.always else F.filter(spans, lambda s: s["score"] >= REPORT_FROM)

    none = F.array().cast(SPANS)
    return F.when(~seen, none).otherwise(let(found, lambda ms: F.when(F.size(ms) == 0, none).otherwise(located(ms).cast(SPANS))))


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, score), by kind as listed and then by start.

    Null text counts as empty and has no spans. Spans of one kind never overlap; spans of two kinds may. Rows are
    handled one by one: repeated rows, ties and an empty table need no rule, and all other columns stay.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(spans_col, F.concat(*[spans_of(k, text) for k in kinds]))


def mask_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, as in ``[EMAIL]``; overlapping spans become one.

    A null text stays null; all other columns stay, whatever their names.
    """
    text = F.col(text_col)
    held = fresh("__pii", docs)
    marked = find_pii(docs, text_col, held, kinds)
    one = "array<struct<start:int,end:int,kind:string>>"

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        apart = (F.size(done) == 0) | (x["start"] >= F.try_element_at(done, F.lit(-1))["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))

    order = F.array_sort(F.transform(held, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.aggregate(order, F.array().cast(one), merge)

    def rebuilt(s: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"])
            return F.concat(F.substring(text, begin + 1, x["start"] - begin), F.lit("["), F.upper(x["kind"]), F.lit("]"))

        tail = F.substring(text, F.element_at(s, -1)["end"] + 1, F.char_length(text))
        return F.concat(F.array_join(F.transform(s, piece), ""), tail)

    masked = F.when(text.isNull() | (F.size(held) == 0), text).otherwise(let(spans, rebuilt))
    return marked.withColumn(text_col, masked).drop(held)
