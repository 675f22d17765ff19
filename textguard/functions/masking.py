"""Token and masking columns. All row-local; spans come from ``detection.detect``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions.binding import (
    BLOCK, bind, cut_blocks, cut_piece, fold_into_array, remember,
)
from textguard.functions.detection import (
    SPANS, Detector, detect, keep_disjoint,
)

#: Spans up to which tokens are found by comparing keys.
FEW = 32
TOKENS = "array<struct<type:string,value:string,start:int,end:int,token:string>>"
MAPPINGS = "array<struct<token:string,type:string,original_value:string,start:int,end:int>>"


def value_key(kind: Column, value: Column) -> Column:
    """Two values share a token when this key is equal; e-mails ignore case."""
    return F.concat(
        kind, F.lit("\0"), F.when(kind == "EMAIL", F.lower(value)).otherwise(value)
    )


def valid_span(span: Column) -> Column:
    return (
        span["type"].isNotNull() & span["value"].isNotNull()
        & (span["start"] >= 0) & (span["end"] > span["start"])
    )


def clean_spans(spans: Column) -> Column:
    """Sort by start, drop broken spans and those overlapping an earlier kept one.

    ``detect`` output needs none of this; spans from elsewhere do.
    """

    def by_start(s: Column, i: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), i.alias("i"), s["type"].alias("type"),
            s["value"].alias("value"), s["end"].alias("end"),
        )

    usable = F.filter(F.coalesce(spans, F.array().cast(SPANS)), valid_span)
    return keep_disjoint(F.array_sort(F.transform(usable, by_start)))


def assign_tokens(spans: Column) -> Column:
    """Add ``token`` to sorted disjoint spans.

    One sequence per text across all types, by first occurrence; repeats reuse theirs. Few values are
    looked up among the distinct ones; more are brought together by sorting, so n spans cost n log n.
    """

    def few(keys: Column) -> Column:
        return bind(
            F.array_distinct(keys),
            lambda known: F.transform(keys, lambda k: F.array_position(known, k).cast("int")),
        )

    def numbers(keys: Column) -> Column:
        small = (F.size(keys) <= FEW) & F.forall(keys, lambda k: k.isNotNull())
        return F.when(small, few(keys)).otherwise(_sorted_numbers(keys))

    def numbered(spans: Column) -> Column:
        keys = F.transform(spans, lambda s: value_key(s["type"], s["value"]))
        return F.zip_with(
            spans, bind(keys, numbers),
            lambda s, n: F.struct(
                *[s[f].alias(f) for f in ("type", "value", "start", "end")],
                F.format_string(P.TOKEN_FORMAT, s["type"], n).alias("token"),
            ),
        )

    return bind(spans, numbered)


def _sorted_numbers(keys: Column) -> Column:
    """The number of each key by first occurrence, from sorting; a null key is like no other."""
    first_spec = "array<struct<first:int,i:int>>"

    def to_first(state: Column, x: Column) -> tuple[Column, Column]:
        same = F.coalesce(state["key"] == x["key"], F.lit(False))
        first = F.when(same, state["first"]).otherwise(x["i"])
        following = F.struct(x["key"].alias("key"), first.alias("first"))
        return following, F.array(F.struct(first.alias("first"), x["i"].alias("i")))

    def to_number(state: Column, x: Column) -> tuple[Column, Column]:
        number = state["number"] + F.when(x["first"] == state["first"], 0).otherwise(1)
        following = F.struct(x["first"].alias("first"), number.alias("number"))
        return following, F.array(F.struct(x["i"].alias("i"), number.alias("number")))

    keyed = F.array_sort(F.transform(
        keys, lambda k, i: F.struct(k.alias("key"), i.alias("i")),
    ))
    before = F.struct(F.lit(None).cast("string").alias("key"), F.lit(-1).alias("first"))
    firsts = fold_into_array(keyed, before, F.array().cast(first_spec), to_first)
    start = F.struct(F.lit(-1).alias("first"), F.lit(0).alias("number"))
    numbered = fold_into_array(
        F.array_sort(firsts), start, F.array().cast("array<struct<i:int,number:int>>"), to_number
    )
    return F.transform(F.array_sort(numbered), lambda n: n["number"])


def token_mappings(tokens: Column) -> Column:
    """One mapping per token with the value and span seen first, in token order.

    Numbers rise by first occurrence, so a token is new exactly if its number is the next one.
    """

    def mapping(t: Column) -> Column:
        return F.struct(
            t["token"].alias("token"), t["type"].alias("type"),
            t["value"].alias("original_value"), t["start"].alias("start"), t["end"].alias("end"),
        )

    def step(seen: Column, t: Column) -> tuple[Column, Column]:
        new = F.regexp_extract(t["token"], P.TOKEN_NUMBER, 1).cast("int") > seen
        return (
            F.when(new, seen + 1).otherwise(seen),
            F.when(new, F.array(mapping(t))).otherwise(F.array().cast(MAPPINGS)),
        )

    names = tokens["token"]
    few = F.size(tokens) <= FEW
    firsts = F.filter(tokens, lambda t, i: F.array_position(names, t["token"]) == i + 1)
    return F.when(few, F.transform(firsts, mapping)).otherwise(
        fold_into_array(tokens, F.lit(0), F.array().cast(MAPPINGS), step)
    )


def splice(text: Column, tokens: Column) -> Column:
    """Replace each span by its token in one pass; everything else stays as it is."""

    def pieces(r: Column) -> Column:
        kept, length = r["kept"], r["length"]

        def short(t: Column, i: Column) -> Column:
            before = F.coalesce(F.get(kept, i - 1)["end"], F.lit(0))
            return F.concat(F.substring(text, before + 1, t["start"] - before), t["token"])

        end = F.element_at(kept, -1)["end"]
        in_one = F.concat(
            F.array_join(F.transform(kept, short), ""), F.substring(text, end + 1, length - end)
        )
        return F.when(length <= BLOCK, in_one).otherwise(
            bind(cut_blocks(text), lambda blocks: across(kept, blocks, length))
        )

    def across(kept: Column, blocks: Column, length: Column) -> Column:
        def piece(t: Column, i: Column) -> Column:
            before = F.coalesce(F.get(kept, i - 1)["end"], F.lit(0))
            return F.concat(cut_piece(blocks, before, t["start"]), t["token"])

        tail = cut_piece(blocks, F.element_at(kept, -1)["end"], length)
        return F.concat(F.array_join(F.transform(kept, piece), ""), tail)

    def inside(length: Column) -> Column:
        kept = F.filter(tokens, lambda t: t["end"] <= length)
        return bind(
            F.struct(kept.alias("kept"), length.alias("length")),
            lambda r: F.when(F.size(r["kept"]) == 0, text).otherwise(pieces(r)),
        )

    return F.coalesce(bind(F.length(text), inside), F.lit(""))


def mask_text(text: Column, spans: Column) -> Column:
    """Masked text for spans from any source."""
    return bind(clean_spans(spans), lambda s: splice(text, assign_tokens(s)))


@remember
def analyze_text(text: Column, detectors: tuple[Detector, ...] = ()) -> Column:
    """``struct<masked_text, detections, mappings>`` from one detection pass."""

    def result(t: Column, spans: Column) -> Column:
        def build(tokens: Column) -> Column:
            return F.struct(
                splice(t, tokens).alias("masked_text"),
                spans.alias("detections"),
                token_mappings(tokens).alias("mappings"),
            )

        untouched = F.struct(
            F.coalesce(t, F.lit("")).alias("masked_text"),
            spans.alias("detections"),
            F.array().cast(MAPPINGS).alias("mappings"),
        )
        return F.when(F.size(spans) == 0, untouched).otherwise(
            bind(assign_tokens(spans), build)
        )

    return bind(
        F.struct(text.alias("text"), detect(text, detectors).alias("spans")),
        lambda r: result(r["text"], r["spans"]),
    )


def passthrough(text: Column) -> Column:
    """Same shape as ``analyze_text`` with nothing detected; the cost floor."""
    return F.struct(
        F.coalesce(text, F.lit("")).alias("masked_text"),
        F.array().cast(SPANS).alias("detections"),
        F.array().cast(MAPPINGS).alias("mappings"),
    )


# --- tokens in a text -------------------------------------------------------------


def token_pattern(types: Iterable[str] = tuple(P.PRIORITY)) -> str:
    return P.TOKEN_TEMPLATE % "|".join(types)


@remember
def find_tokens(text: Column, types: tuple[str, ...] = tuple(P.PRIORITY)) -> Column:
    """Distinct well-formed tokens of known types in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(token_pattern(types)), F.lit(0)))
    return F.when(F.contains(text, F.lit(P.TOKEN_HINT)), found).otherwise(
        F.when(text.isNotNull(), F.array().cast("array<string>"))
    )


def look_up(names: Column, entries: Column, kind: str = "string") -> Column:
    """The value of each name out of ``array<struct<key,value>>``, null where there is none.

    Names and entries are sorted together, so n names and m entries cost (n + m) log (n + m)
    instead of a search through the entries for each name. Of equal keys the first counts.
    """
    asked = f"array<struct<name:string,asked:int,i:int,value:{kind}>>"

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        same = F.coalesce(state["name"] == x["name"], F.lit(False))
        keep = same | (x["asked"] == 1)
        following = F.struct(
            F.when(keep, state["name"]).otherwise(x["name"]).alias("name"),
            F.when(keep, state["value"]).otherwise(x["value"]).alias("value"),
        )
        hit = F.struct(x["i"].alias("i"), F.when(same, state["value"]).alias("value"))
        none = F.array().cast(f"array<struct<i:int,value:{kind}>>")
        return following, F.when(x["asked"] == 1, F.array(hit)).otherwise(none)

    known = F.transform(
        entries,
        lambda e, i: F.struct(
            e["key"].alias("name"), F.lit(0).alias("asked"), i.alias("i"), e["value"].alias("value")
        ),
    ).cast(asked)
    wanted = F.transform(
        names,
        lambda n, i: F.struct(
            n.alias("name"), F.lit(1).alias("asked"), i.alias("i"), F.lit(None).cast(kind).alias("value")
        ),
    ).cast(asked)
    before = F.struct(
        F.lit(None).cast("string").alias("name"), F.lit(None).cast(kind).alias("value")
    )
    found = fold_into_array(
        F.array_sort(F.concat(known, wanted)), before,
        F.array().cast(f"array<struct<i:int,value:{kind}>>"), step,
    )
    return F.transform(F.array_sort(found), lambda h: h["value"])


def splice_tokens(
    text: Column, values: Column, types: Iterable[str] = tuple(P.PRIORITY)
) -> Column:
    """Put ``values[token]`` in place of each token; tokens without a value stay.

    One pass over the original text: inserted values are never scanned again and
    ``$`` or ``\\`` in them mean nothing.
    """
    pattern = token_pattern(types)

    def weave(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        none = F.array().cast("array<struct<key:string,value:string>>")
        entries = F.coalesce(F.map_entries(values), none)
        put = F.zip_with(look_up(found, entries), found, lambda v, t: F.coalesce(v, t))
        woven = F.zip_with(gaps, put, lambda gap, v: F.concat(gap, F.coalesce(v, F.lit(""))))
        return F.array_join(woven, "")

    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(tokens, lambda found: F.when(F.size(found) == 0, text).otherwise(weave(found)))


@remember
def segment_masked(masked: Column) -> Column:
    """Masked text as ``array<struct<pos,is_token,piece>>`` for display, pieces in order.

    Plain pieces may be empty; even positions are plain text, odd ones tokens.
    """

    def interleave(tokens: Column) -> Column:
        return F.flatten(
            F.zip_with(
                F.split(masked, P.DISPLAY_TOKEN, -1), tokens,
                lambda gap, t: F.when(t.isNull(), F.array(gap)).otherwise(F.array(gap, t)),
            )
        )

    tokens = F.regexp_extract_all(masked, F.lit(P.DISPLAY_TOKEN), F.lit(0))
    return F.transform(
        bind(tokens, interleave),
        lambda piece, i: F.struct(
            i.alias("pos"), (i % 2 == 1).alias("is_token"), piece.alias("piece")
        ),
    )


def token_collision(text: Column) -> Column:
    """Tokens already standing in an input text; they cannot be told from assigned ones."""
    return F.size(find_tokens(text))
