"""Putting original values back into token-bearing replies."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import masking as M
from textguard.functions import patterns as P
from textguard.functions import sealing as S
from textguard.functions.binding import attach, bind, remember
from textguard.operators.protection import stored_live_sets
from textguard.operators.routing import error_rows
from textguard.sources.storage import Scratch

TYPES = tuple(P.PRIORITY)
RESTORED = "struct<response:string,token_count:int,failure_kind:string>"


def reply_tokens(
    replies: DataFrame, text_col: str = "response_text", types: Iterable[str] = TYPES
) -> DataFrame:
    """One row per distinct known token of each reply: ``request_id, token``."""
    hit = replies.filter(F.contains(F.col(text_col), F.lit(P.TOKEN_HINT)))
    tokens = F.explode_outer(M.find_tokens(text_col, tuple(types))).alias("token")
    return hit.select("request_id", tokens).filter(F.col("token").isNotNull())


@remember
def restore(
    text: Column, mappings: Column | str, key: str | None, types: tuple[str, ...] = TYPES
) -> Column:
    """``struct<response, token_count, failure_kind>`` for one reply and its sealed set.

    Every token found is opened before anything is replaced. If one cannot be opened,
    the whole reply fails and ``response`` is null: never a partly restored text.
    """
    mappings = F.col(mappings) if isinstance(mappings, str) else mappings

    def outcome(opened: Column) -> Column:
        values = F.map_from_entries(opened)
        failed = F.exists(opened, lambda m: m["plain"].isNull())
        good = F.struct(
            M.splice_tokens(text, values, types).alias("response"),
            F.size(opened).alias("token_count"),
            F.lit(None).cast("string").alias("failure_kind"),
        )
        bad = F.struct(
            F.lit(None).cast("string").alias("response"), F.lit(0).alias("token_count"),
            F.lit("protection").alias("failure_kind"),
        )
        return F.when(failed, bad).otherwise(good)

    def opened(tokens: Column) -> Column:
        entries = F.transform(
            mappings,
            lambda m: F.struct(
                m["token"].alias("key"), F.coalesce(m["sealed"], F.lit(b"")).alias("value")
            ),
        )
        sealed = F.zip_with(
            tokens, M.look_up(tokens, entries, "binary"),
            lambda t, s: F.struct(t.alias("token"), s.alias("sealed")),
        )
        return F.transform(
            F.filter(sealed, lambda m: m["sealed"].isNotNull()),
            lambda m: F.struct(
                m["token"].alias("token"), S.try_open(m["sealed"], key).alias("plain")
            ),
        )

    untouched = F.struct(
        text.alias("response"), F.lit(0).alias("token_count"),
        F.when(text.isNull(), F.lit("bad_input")).alias("failure_kind"),
    )
    return F.when(text.isNull() | mappings.isNull(), untouched).otherwise(
        bind(bind(M.find_tokens(text, types), opened), outcome)
    )


def rehydrate(
    replies: DataFrame,
    sets: DataFrame,
    key: str | None,
    now: Column,
    one_ttl: bool = False,
    newest: bool = False,
    types: Iterable[str] = TYPES,
    max_ttl: timedelta | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Restore stored replies: ``request_id, provider, response, token_count, failure_kind``.

    One equi-join on ``request_id``; opening and splicing are row-local after it.
    Replies without a token never enter the join. Unknown, expired and foreign tokens
    stay as they are. ``one_ttl``, ``newest`` and ``max_ttl`` say what is known about ``sets``, see
    ``live_sets`` and ``stored_live_sets``. The newest sets are copied to ``scratch``; discard it once
    the result has been used.
    """
    types = tuple(types)
    S.hide_keys(replies.sparkSession)
    text = F.col("response_text")
    with_token = F.coalesce(F.contains(text, F.lit(P.TOKEN_HINT)), F.lit(False))
    sealed = stored_live_sets(sets, now, one_ttl, newest, max_ttl, scratch)

    joined = attach(
        replies.filter(with_token).join(sealed, "request_id", "left"),
        "restored", restore("response_text", "mappings", key, types),
    )
    plain = replies.filter(~with_token).withColumn(
        "restored",
        F.struct(
            text.alias("response"), F.lit(0).alias("token_count"),
            F.when(text.isNull(), F.lit("bad_input")).alias("failure_kind"),
        ).cast(RESTORED),
    )
    columns = [c for c in replies.columns if c != "response_text"]
    return joined.select(*columns, "restored.*").unionByName(
        plain.select(*columns, "restored.*")
    )


def failed_replies(restored: DataFrame, at: Column | None = None) -> DataFrame:
    """Reject rows of replies that could not be restored."""
    at = F.current_timestamp() if at is None else at
    failed = restored.filter(F.col("failure_kind").isNotNull())
    return error_rows(failed, F.col("failure_kind"), at)


def restored_replies(restored: DataFrame) -> DataFrame:
    return restored.filter(F.col("failure_kind").isNull()).drop("failure_kind")


def rehydrate_local(text: Column, mappings: Column, types: Iterable[str] = TYPES) -> Column:
    """Restore a reply from the transient mappings of the same row, without a join."""
    plain = F.map_from_entries(
        F.transform(mappings, lambda m: F.struct(m["token"], m["original_value"]))
    )
    return bind(plain, lambda values: M.splice_tokens(text, values, types))
