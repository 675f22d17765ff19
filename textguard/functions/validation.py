"""Request checks, failure kinds and messages as columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions.binding import bind
from textguard.functions.detection import utf16_length


def require_non_blank(value: Column) -> Column:
    """True unless null or made of characters up to U+0020 only."""
    return value.isNotNull() & value.rlike(r"[^\x00-\x20]")


def within_size(text: Column, max_length: int | None = P.MAX_TEXT_LENGTH) -> Column:
    """True while the text has at most ``max_length`` UTF-16 units; null passes, None sets no limit.

    A code point takes one or two units, so the exact count is only taken where the
    number of code points does not already decide.
    """
    if max_length is None:
        return F.lit(True)
    points = F.length(text)
    return (
        text.isNull()
        | (points <= max_length // 2)
        | ((points <= max_length) & (utf16_length(text) <= max_length))
    )


def resolve_provider(name: Column, providers: Iterable[str] = P.PROVIDERS) -> Column:
    """Canonical provider name, ignoring case and surrounding blanks; null if unknown."""
    wanted = F.lower(F.regexp_replace(name, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""))
    known = F.lit(None).cast("string")
    for provider in reversed(tuple(providers)):
        known = F.when(wanted == provider.strip().lower(), F.lit(provider)).otherwise(known)
    return known


def reject_kind(
    text: Column,
    provider: Column,
    providers: Iterable[str] = P.PROVIDERS,
    max_length: int | None = None,
) -> Column:
    """First failing check (blank, size, provider) or null if the row is accepted."""
    blank = ~require_non_blank(text) | ~require_non_blank(provider)
    return (
        F.when(blank, F.lit("bad_input"))
        .when(~within_size(text, max_length), F.lit("too_large"))
        .when(resolve_provider(provider, providers).isNull(), F.lit("unsupported_provider"))
    )


def _lookup(kind: Column, position: int) -> Column:
    chosen = F.lit(P.ERRORS["other"][position])
    for name, row in P.ERRORS.items():
        chosen = F.when(kind == name, F.lit(row[position])).otherwise(chosen)
    return chosen


def classify_error(kind: Column, max_length: int | None = None) -> Column:
    """``struct<status,error,message>`` for a failure kind; unknown kinds are 500."""
    max_length = P.MAX_TEXT_LENGTH if max_length is None else max_length
    message = F.when(
        kind == "too_large", F.lit(P.ERRORS["too_large"][2] % max_length)
    ).otherwise(_lookup(kind, 2))
    return F.struct(
        _lookup(kind, 0).alias("status"), _lookup(kind, 1).alias("error"),
        message.alias("message"),
    )


def unsupported_provider_message(provider: Column) -> Column:
    """Names the provider that was asked for, cut like any other message."""
    return F.when(
        is_blank(provider), F.lit(P.ERRORS["unsupported_provider"][2])
    ).otherwise(F.concat(F.lit("Unsupported provider: "), sanitize_message(provider)))


def is_blank(value: Column) -> Column:
    """Null, empty, or Unicode white space only (no-break spaces count as text)."""
    return value.isNull() | ~value.rlike(r"\P{javaWhitespace}")


def sanitize_message(message: Column) -> Column:
    """Blank becomes a fixed text; longer ones are cut to 300 UTF-16 units.

    A character of two units that would be cut in half goes.
    """
    head = F.substring(message, 1, P.MESSAGE_LIMIT)

    def fitting(h: Column) -> Column:
        points = F.filter(F.split(h, ""), lambda c: c != "")
        ends = F.transform(
            F.sequence(F.lit(1), F.size(points)),
            lambda n: F.struct(utf16_length(F.substring(h, F.lit(1), n)).alias("units"), n.alias("n")),
        )
        inside = F.filter(ends, lambda e: e["units"] <= P.MESSAGE_LIMIT)
        return F.substring(h, F.lit(1), F.element_at(inside, -1)["n"])

    cut = bind(
        head, lambda h: F.when(utf16_length(h) <= P.MESSAGE_LIMIT, h).otherwise(fitting(h))
    )
    return F.when(is_blank(message), F.lit(P.FALLBACK_MESSAGE)).otherwise(cut)


def reply_outcome(status: Column) -> Column:
    """Outcome kind of an HTTP status."""
    kind = F.when(status.between(200, 299), F.lit("success")).otherwise(F.lit("unknown"))
    for code, name in P.OUTCOMES.items():
        kind = F.when(status == code, F.lit(name)).otherwise(kind)
    return kind


def client_key(credential: Column) -> Column:
    """Lower-case hex SHA-256 of a credential."""
    return F.sha2(credential, 256)
