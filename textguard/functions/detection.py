"""Detection columns: ``text -> array<struct<type,value,start,end>>``, no shuffle.

Offsets count code points, so ``substring(text, start + 1, end - start) = value``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions.binding import (
    BLOCK, bind, cut_blocks, cut_piece, fold_into_array, remember,
)

#: Matches up to which each is looked up in the text.
FEW = 8
SPANS = "array<struct<type:string,value:string,start:int,end:int>>"
_LOCATED = "array<struct<value:string,start:int>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def with_offsets(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of ``pattern`` with its start: ``array<struct<value,start>>``.

    In short texts a match whose value stands nowhere else is simply looked up. Otherwise the text is
    also split on the pattern, which gives the gaps between the matches; starts are running sums of
    both. Texts without a match pay for one pass. With ``group`` the value is that group of the match,
    which must reach to its end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def looked_up(values: Column) -> Column:
        few = (F.size(values) <= FEW) & (F.length(text) <= BLOCK)
        return F.when(few, F.transform(
            values, lambda v: F.struct(v.alias("value"), (F.position(v, text) - 1).alias("start")),
        ))

    def alone(h: Column) -> Column:
        return (h["start"] >= 0) & (F.position(h["value"], text, h["start"] + 2) == 0)

    def located(values: Column) -> Column:
        if not group:
            return _sum_gaps(values, F.split(text, pattern, -1))
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.zip_with(
            _sum_gaps(matches, F.split(text, pattern, -1)), values,
            lambda p, v: F.struct(
                v.alias("value"),
                (p["start"] + F.length(p["value"]) - F.length(v)).alias("start"),
            ),
        )

    return bind(
        found,
        lambda m: F.when(
            F.size(m) > 0,
            bind(looked_up(m), lambda p: F.when(F.forall(p, alone), p).otherwise(located(m))),
        ).otherwise(F.array().cast(_LOCATED)),
    )


def _hit(value: Column, start: Column) -> Column:
    return F.array(F.struct(value.alias("value"), start.alias("start")))


def _sum_gaps(matches: Column, gaps: Column) -> Column:
    """Starts as running sums of the lengths of gaps and matches."""
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(matches)), matches,
        lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")),
    )

    def step(pos: Column, pair: Column) -> tuple[Column, Column]:
        begin = pos + pair["gap"]
        return begin + F.length(pair["value"]), _hit(pair["value"], begin)

    return fold_into_array(pairs, F.lit(0), F.array().cast(_LOCATED), step)


def _spans(
    text: Column,
    kind: str,
    pattern: str,
    tail: str | None = None,
    valid: Callable[[Column], Column] | None = None,
    group: int = 0,
) -> Column:
    def span(hit: Column) -> Column:
        value = F.rtrim(hit["value"], F.lit(tail)) if tail else hit["value"]
        return F.struct(
            F.lit(kind).alias("type"),
            value.alias("value"),
            hit["start"].alias("start"),
            (hit["start"] + F.length(value)).alias("end"),
        )

    spans = F.transform(with_offsets(text, pattern, group), span)
    return F.filter(spans, lambda s: valid(s["value"])) if valid else spans


def _guarded(text: Column, hint: Column, body: Callable[[Column], Column]) -> Column:
    return F.when(hint, body(text)).otherwise(no_spans())


# --- value checks -----------------------------------------------------------------


def is_ipv4(value: Column) -> Column:
    """Four dot-separated groups of one to three digits, none above 255."""
    shaped = value.rlike(r"\A\d{1,3}(?:\.\d{1,3}){3}\z")
    small = F.forall(F.split(value, r"\.", -1), lambda o: o.cast("int") <= P.MAX_OCTET)
    return F.coalesce(F.when(shaped, small).otherwise(F.lit(False)), F.lit(False))


def is_card(value: Column) -> Column:
    """13-19 digits split only by space, hyphen or dot, Luhn-valid, not all the same."""
    digits = F.regexp_replace(value, "[^0-9]+", "")
    plain = ~value.rlike("[^0-9 .-]")
    sized = F.length(digits).between(*P.CARD_DIGITS)
    uniform = digits.rlike(r"\A(.)\1*\z")
    return F.coalesce(
        F.when(plain & sized, ~uniform & F.call_function("luhn_check", digits)).otherwise(F.lit(False)),
        F.lit(False),
    )


def is_phone(value: Column) -> Column:
    """7-15 digits; exactly 10 when nothing separates them; never a dotted quad."""
    n_digits = F.length(F.regexp_replace(value, "[^0-9]+", ""))
    separated = value.rlike("[^0-9+()]")
    quad = value.rlike(r"\A\d{1,3}(?:\.\d{1,3}){3}\z")
    return (
        n_digits.between(*P.PHONE_DIGITS)
        & (separated | (n_digits == P.PLAIN_PHONE_DIGITS))
        & ~quad
    )


# --- the six detectors ------------------------------------------------------------


@remember
def detect_email(text: Column) -> Column:
    return _guarded(text, F.contains(text, F.lit(P.EMAIL_HINT)),
                    lambda t: _spans(t, "EMAIL", P.EMAIL_RUN, group=1))


@remember
def detect_url(text: Column) -> Column:
    return _guarded(text, F.contains(text, F.lit(P.URL_HINT)),
                    lambda t: _spans(t, "URL", P.URL, tail=P.URL_TAIL))


@remember
def detect_ipv4(text: Column) -> Column:
    return _guarded(text, text.rlike(P.DIGITS_HINT),
                    lambda t: _spans(t, "IP_ADDRESS", P.IP_ADDRESS, valid=is_ipv4))


@remember
def detect_credit_card(text: Column) -> Column:
    return _guarded(text, text.rlike(P.DIGITS_HINT),
                    lambda t: _spans(t, "CREDIT_CARD", P.CREDIT_CARD, P.CARD_TAIL, is_card))


@remember
def detect_ssn(text: Column) -> Column:
    return _guarded(text, F.contains(text, F.lit(P.SSN_HINT)),
                    lambda t: _spans(t, "SSN", P.SSN))


@remember
def detect_phone(text: Column) -> Column:
    return _guarded(text, text.rlike(P.DIGITS_HINT),
                    lambda t: _spans(t, "PHONE", P.PHONE, valid=is_phone))


def _digit_spans(text: Column) -> Column:
    """IP, card, SSN and phone candidates behind one shared digit hint."""
    return _guarded(
        text,
        text.rlike(P.DIGITS_HINT),
        lambda t: F.concat(
            _spans(t, "IP_ADDRESS", P.IP_ADDRESS, valid=is_ipv4),
            _spans(t, "CREDIT_CARD", P.CREDIT_CARD, P.CARD_TAIL, is_card),
            detect_ssn(t),
            _spans(t, "PHONE", P.PHONE, valid=is_phone),
        ),
    )


@remember
def may_contain_pii(text: Column) -> Column:
    """Cheap necessary condition for any of the six types; safe as a row filter."""
    return (
        F.contains(text, F.lit(P.EMAIL_HINT))
        | F.contains(text, F.lit(P.URL_HINT))
        | text.rlike(P.DIGITS_HINT)
    )


# --- extra detectors --------------------------------------------------------------


@dataclass(frozen=True)
class Detector:
    """An added type: ``spans(text)`` returns the span array (or null) for one text.

    ``spans`` may be built from Spark functions or be a vectorised ``pandas_udf``.
    """

    type: str
    priority: int
    spans: Callable[[Column], Column]


def _candidates(text: Column, extra: tuple[Detector, ...]) -> Column:
    """Spans of every detector with their sort keys, in detector order."""
    builtin = bind(
        text, lambda t: F.concat(detect_email(t), detect_url(t), _digit_spans(t))
    )
    lists = [F.coalesce(builtin, no_spans())]
    lists += [F.coalesce(d.spans(text).cast(SPANS), no_spans()) for d in extra]
    return F.concat(*lists)


@remember
def union_candidates(text: Column, detectors: tuple[Detector, ...] = ()) -> Column:
    """Validated spans of all detectors before overlaps are resolved."""
    return _candidates(text, detectors)


def keep_disjoint(ordered: Column) -> Column:
    """Walk spans left to right and keep each that starts at or after the last kept end.

    With spans in start order this equals "overlaps no kept span". A running maximum
    over all spans would be wrong: rejected spans must not block later ones.
    """

    def step(last: Column, s: Column) -> tuple[Column, Column]:
        item = F.struct(*[s[f].alias(f) for f in ("type", "value", "start", "end")])
        free = s["start"] >= last
        return (
            F.when(free, s["end"]).otherwise(last),
            F.when(free, F.array(item)).otherwise(no_spans()),
        )

    return fold_into_array(ordered, F.lit(0), no_spans(), step)


def resolve_overlaps(spans: Column, detectors: tuple[Detector, ...] = ()) -> Column:
    """Greedy choice in the order start, type priority, longer span, detector order."""
    priority = dict(P.PRIORITY)
    for d in detectors:
        priority.setdefault(d.type, d.priority)

    def keyed(s: Column, i: Column) -> Column:
        rank = F.lit(max(priority.values()) + 1)
        for kind, value in priority.items():
            rank = F.when(s["type"] == kind, F.lit(value)).otherwise(rank)
        return F.struct(
            s["start"].alias("start"), rank.alias("rank"), (-s["end"]).alias("neg_end"),
            i.alias("i"), s["type"].alias("type"), s["value"].alias("value"),
            s["end"].alias("end"),
        )

    return bind(
        spans,
        lambda c: F.when(F.size(c) == 0, no_spans()).otherwise(
            keep_disjoint(F.array_sort(F.transform(c, keyed)))
        ),
    )


@remember
def detect(text: Column, detectors: tuple[Detector, ...] = ()) -> Column:
    """Resolved, sorted, disjoint spans of one text; null or empty text gives none."""
    return resolve_overlaps(_candidates(text, detectors), detectors)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def to_utf16_offsets(text: Column, spans: Column) -> Column:
    """The same spans, sorted and disjoint, with offsets in UTF-16 units."""

    def shift(blocks: Column) -> Column:
        def step(state: Column, s: Column) -> tuple[Column, Column]:
            gap = cut_piece(blocks, state["end"], s["start"])

            def place(start: Column) -> Column:
                return F.struct(
                    s["type"].alias("type"), s["value"].alias("value"),
                    start.alias("start"), (start + utf16_length(s["value"])).alias("end"),
                )

            moved = bind(state["units"] + utf16_length(gap), place)
            units = state["units"] + utf16_length(gap) + utf16_length(s["value"])
            return F.struct(s["end"].alias("end"), units.alias("units")), F.array(moved)

        begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("units"))
        return fold_into_array(spans, begin, no_spans(), step)

    return F.when(F.size(spans) == 0, no_spans()).otherwise(bind(cut_blocks(text), shift))
