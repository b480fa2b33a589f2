"""Personal data: patterns propose spans, checksums confirm, context words adjust the score.

Everything is a column expression (regular expressions, array functions); no
Python runs on the rows.  Per kind the text is cut at the matches, so that
the lengths of gaps and matches add up to code point positions.  Patterns are
written so that each character is looked at a bounded number of times
(possessive runs, starts only where a run starts), with the same leftmost
non-overlapping matches as the plain forms, and a cheap test skips texts
that cannot match.

Base kinds: ``email``, ``ip`` (parts up to 255), ``card`` (12 to 19 digits,
Luhn), ``phone`` (9 to 15 digits).  Added by the method: ``iban`` (mod 97)
and ``ssn`` (three-two-four digits in valid ranges, reported only with a
context word near).  A span's score starts at the kind's prior and gains when
a context word of the kind stands within ``REACH`` characters before it.

Defined results: a null or empty text has no spans; repeated rows are scanned
alike; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm import common

REACH = 40                   # characters before a span in which a context word counts
BOOST = 0.3

_LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str             # its matches are the candidates
    hint: str                # a text without this has none
    prior: float
    context: str             # context words, any case
    needs_context: bool = False


KINDS = (
    # A mailbox part starts where its run starts, or right after the match before.
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         0.7, "e-?mail|mail|contact|write|reach|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]",
         0.5, "ip|address|host|server|login|client|adresse"),
    # A run of digits with single separators between them, 12 to 19 digits in all.
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", r"[0-9](?:[ -]?[0-9]){11}",
         0.6, "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]",
         0.6, "phone|tel|call|mobile|fax|cell|telefon|teléfono|téléphone"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}",
         0.8, "iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]",
         0.3, "ssn|social|security|tax", needs_context=True),
)
BASE_KINDS = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def place(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + place(i))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def mod97(account: Column) -> Column:
    """Whether country, check digits and account number leave 1 when divided by 97, letters counting from 10."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(add(a, c))) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        flat = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(flat).between(15, 34) & mod97(flat)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _cut(text: Column, kind: Kind) -> Column:
    """Gaps and matches of a text, null where the cheap test fails."""
    cut = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(kind.hint), cut)


def _lengths(cut: Column) -> Column:
    return F.zip_with(F.slice(cut["gaps"], 1, F.size(cut["found"])), cut["found"], lambda g, m: F.length(g) + F.length(m))


def _blocks(lengths: Column) -> Column:
    """The lengths in about as many blocks as a block has lengths."""
    width = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    starts = F.sequence(F.lit(1), F.size(lengths), F.greatest(width, F.lit(1)))
    return F.when(F.size(lengths) > 0, F.transform(starts, lambda a: F.slice(lengths, a, width)))


def _running(numbers: Column, start: Column) -> Column:
    """Running sums of a short array, from ``start`` on."""
    return F.aggregate(numbers, F.struct(start.alias("at"), F.array().cast("array<int>").alias("all")),
                       lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"] + n)).alias("all")))["all"]


def _totals(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))


def _ends(blocks: Column, block_ends: Column) -> Column:
    """Where each match ends: running sums within the blocks, from the end of the block before."""
    return F.flatten(F.transform(blocks, lambda b, i: _running(b, F.coalesce(F.get(block_ends, i - 1), F.lit(0)))))


def _spans(cut: Column, ends: Column, kind: Kind) -> Column:
    gaps, found = cut["gaps"], cut["found"]

    def span(m: Column, i: Column) -> Column:
        end = F.get(ends, i)
        near = F.get(gaps, i)
        seen = F.substring(near, F.greatest(F.length(near) - REACH + 1, F.lit(1)), F.lit(REACH)).rlike(rf"(?iu)\b(?:{kind.context})s?\b")
        score = F.round(F.least(F.lit(kind.prior) + F.when(seen, F.lit(BOOST)).otherwise(F.lit(0.0)), F.lit(1.0)), 2)
        full = F.struct(F.lit(kind.name).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), score.alias("score"))
        holds = _valid(kind.name, m) & seen if kind.needs_context else _valid(kind.name, m)
        return F.when(holds, full)

    return F.coalesce(F.filter(F.transform(found, span), lambda s: s.isNotNull()), F.array().cast(_SPAN)).cast(_SPAN)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: per row an array of ``kind, start, end, score`` by start, then kind as listed.

    What a lambda reads of a whole array (gaps, ends) is a column of a step before, computed once a row; running sums
    go over blocks of blocks, so that n matches cost about n times the root of n.
    """
    def each(of) -> list[Column]:
        return [F.when(F.col(k.name).isNotNull(), of(k)).alias(k.name) for k in KINDS]

    def part(name: str, k: Kind) -> Column:
        return F.col(k.name)[name]

    text = F.coalesce(F.col("text"), F.lit(""))
    cuts = common.settled(docs.select("doc_id", *[_cut(text, k).alias(k.name) for k in KINDS]))
    lengths = common.settled(cuts.select("doc_id", *each(lambda k: F.struct(F.col(k.name).alias("cut"), _lengths(F.col(k.name)).alias("lengths")))))
    blocks = common.settled(lengths.select("doc_id", *each(lambda k: F.struct(
        part("cut", k).alias("cut"), _blocks(part("lengths", k)).alias("blocks")))))
    sums = common.settled(blocks.select("doc_id", *each(lambda k: F.struct(
        part("cut", k).alias("cut"), part("blocks", k).alias("blocks"), _running(_totals(part("blocks", k)), F.lit(0)).alias("block_ends")))))
    ends = common.settled(sums.select("doc_id", *each(lambda k: F.struct(
        part("cut", k).alias("cut"), _ends(part("blocks", k), part("block_ends", k)).alias("ends")))))
    spans = ends.select("doc_id", *each(lambda k: _spans(part("cut", k), part("ends", k), k)))
    keyed = [F.transform(F.coalesce(F.col(k.name), F.array().cast(_SPAN)),
                         lambda s, n=n: F.struct(s["start"].alias("start"), F.lit(n).alias("turn"), s.alias("span")))
             for n, k in enumerate(KINDS)]
    ordered = F.transform(F.sort_array(F.concat(*keyed)), lambda s: s["span"])
    return common.settled(spans.select("doc_id", ordered.alias("spans")))


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` strings, of some kinds only if given."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
