"""Provider request bodies and reply bodies as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions.binding import bind
from textguard.functions.validation import is_blank


def mock_reply(masked: Column) -> Column:
    return F.concat(masked, F.lit(P.MOCK_SUFFIX))


def openai_request(masked: Column, model: str = P.OPENAI_MODEL) -> Column:
    return F.to_json(F.struct(F.lit(model).alias("model"), masked.alias("input")))


def anthropic_request(masked: Column, model: str = P.ANTHROPIC_MODEL) -> Column:
    message = F.struct(F.lit("user").alias("role"), masked.alias("content"))
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.lit(P.ANTHROPIC_MAX_TOKENS).alias("max_tokens"),
            F.array(message).alias("messages"),
        )
    )


def _scalar(node: Column, path: str) -> Column:
    """The text of a string, number or truth value; empty for an object or a list; else null."""
    kind = F.schema_of_variant(F.try_variant_get(node, path, "variant"))
    return F.when(kind.rlike("^(OBJECT|ARRAY)"), F.lit("")).otherwise(
        F.try_variant_get(node, path, "string")
    )


def _parts(node: Column, path: str) -> Column:
    """The elements of a list, each on its own; none if there is no list."""
    none = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), none)


def _joined(parts: Column, kind: str) -> Column:
    """Concatenated ``text`` of the parts of one type; null if that is blank."""
    chosen = F.filter(parts, lambda p: _scalar(p, "$.type") == kind)
    text = F.array_join(F.transform(chosen, lambda p: _scalar(p, "$.text")), "")
    return bind(text, lambda t: F.when(~is_blank(t), t))


def extract_openai_text(body: Column) -> Column:
    """Message output parts joined, else the top-level ``output_text``; null = failure.

    Elements are looked at one by one, so an odd one does not hide its neighbours.
    """

    def text(root: Column) -> Column:
        messages = F.filter(_parts(root, "$.output"), lambda m: _scalar(m, "$.type") == "message")
        contents = F.flatten(F.transform(messages, lambda m: _parts(m, "$.content")))
        convenience = bind(_scalar(root, "$.output_text"), lambda c: F.when(~is_blank(c), c))
        return F.coalesce(_joined(contents, "output_text"), convenience)

    return bind(F.try_parse_json(body), text)


def extract_anthropic_text(body: Column) -> Column:
    """Text blocks of ``content`` joined; null = failure."""
    return bind(F.try_parse_json(body), lambda root: _joined(_parts(root, "$.content"), "text"))
