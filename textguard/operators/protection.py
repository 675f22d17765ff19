"""Sealed mapping sets and their lifetime.

A mapping set is one row per stored text: ``request_id, mappings, stored_at,
expires_at`` with ``mappings array<struct<token,type,sealed,start,end>>``. Keeping a
text's mappings in one row makes storing row-local and lets restoring join once on
``request_id``; ``mapping_rows`` gives the flat form, one row per token.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions import sealing as S
from textguard.sources.storage import Scratch

SET_SCHEMA = (
    "request_id string, mappings array<struct<token:string,type:string,sealed:binary,"
    "start:int,end:int>>, stored_at timestamp, expires_at timestamp"
)


def utc_day(ts: str) -> Column:
    """The day of a timestamp in UTC, whatever the session's zone."""
    return F.expr(f"date_from_unix_date(cast(floor(unix_micros({ts}) / 86400000000) as int))")


def with_expiry(df: DataFrame, ttl: timedelta | None = None) -> DataFrame:
    """Add ``expires_at = stored_at + ttl``; no, zero or negative ttl means ten minutes."""
    seconds = ttl.total_seconds() if ttl is not None else 0
    if seconds <= 0:
        seconds = P.MAPPING_TTL_SECONDS
    lifetime = F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return df.withColumn("expires_at", F.col("stored_at") + lifetime)


def seal_mappings(mappings: Column, key: str | None) -> Column:
    """``array<struct<token,type,sealed,start,end>>`` from plain mappings.

    An unusable key is an error on the first mapping, so texts without any need no key.
    """
    try:
        S.check_key(key)
        problem = None
    except S.KeyConfigError as error:
        problem = str(error)

    def sealed(m: Column) -> Column:
        if problem:
            return F.raise_error(F.lit(problem)).cast("binary")
        return S.seal(m["original_value"], key)

    return F.transform(
        mappings,
        lambda m: F.struct(
            m["token"].alias("token"), m["type"].alias("type"), sealed(m).alias("sealed"),
            m["start"].alias("start"), m["end"].alias("end"),
        ),
    )


def protect(
    analyzed: DataFrame,
    key: str | None,
    stored_at: Column | None = None,
    ttl: timedelta | None = None,
) -> DataFrame:
    """Seal every mapping of every analysed text into mapping sets.

    Texts without mappings store nothing. A failure anywhere fails the whole job, so
    nothing is committed. Write the result once before using it twice; each evaluation
    draws fresh nonces.
    """
    S.hide_keys(analyzed.sparkSession)
    stored_at = F.current_timestamp() if stored_at is None else stored_at
    sets = analyzed.filter(F.size("analysis.mappings") > 0).select(
        F.col("request_id").cast("string").alias("request_id"),
        seal_mappings(F.col("analysis.mappings"), key).alias("mappings"),
        stored_at.cast("timestamp").alias("stored_at"),
    )
    return with_expiry(sets, ttl)


def newest_sets(sets: DataFrame) -> DataFrame:
    """The last stored set of each request: a later store replaces the whole set.

    ``row_number() = 1`` is cut to one row per key on the map side before the
    shuffle, so a request stored very often does not fill one partition. Of sets stored at the
    same instant the one with the least hash is taken, on every run.
    """
    tie = [F.xxhash64("mappings")] if "mappings" in sets.columns else []
    latest = Window.partitionBy("request_id").orderBy(
        F.col("stored_at").desc(), F.col("expires_at").desc(), *tie
    )
    ranked = sets.withColumn("_rank", F.row_number().over(latest))
    return ranked.filter("_rank = 1").drop("_rank")


def live(df: DataFrame, now: Column) -> DataFrame:
    """Entries still valid at ``now``; one that expires exactly then is gone."""
    alive = F.col("expires_at") > now
    if "expires_on" in df.columns:  # prune date partitions of a stored table
        alive = alive & (F.col("expires_on") >= F.to_date(now))
    return df.filter(alive)


def recent(sets: DataFrame, now: Column, max_ttl: timedelta | None) -> DataFrame:
    """The days of a stored table that can matter at ``now`` if no set lives longer than ``max_ttl``.

    Whatever replaces a set that is still live was stored after it, so after ``now - max_ttl``,
    and expires later than that. Older days hold neither live sets nor their successors.
    """
    if max_ttl is None or "expires_on" not in sets.columns:
        return sets
    earliest = now - F.make_dt_interval(secs=F.lit(max_ttl.total_seconds()).cast("decimal(18,6)"))
    return sets.filter(F.col("expires_on") >= F.to_date(earliest))


def live_sets(
    sets: DataFrame, now: Column, one_ttl: bool = False, max_ttl: timedelta | None = None
) -> DataFrame:
    """Newest set per request if it is still live.

    A replaced set never comes back, so the newest is chosen before expiry is checked.
    ``one_ttl=True`` states that all sets were stored with the same ttl; then a set
    expires no later than its successor and the expiry filter can prune partitions
    before the shuffle with the same result. ``max_ttl`` states the longest ttl in use and
    prunes to the days that can matter, see ``recent``.
    """
    sets = recent(sets, now, max_ttl)
    if one_ttl:
        return newest_sets(live(sets, now))
    return live(newest_sets(sets), now)


def mapping_rows(sets: DataFrame) -> DataFrame:
    """One row per token: ``request_id, token, type, sealed, start, end, stored_at, ...``."""
    flat = sets.select("request_id", F.explode("mappings").alias("m"), "stored_at", "expires_at")
    return flat.select("request_id", "m.*", "stored_at", "expires_at")


def live_request_count(
    sets: DataFrame, now: Column, one_ttl: bool = False, max_ttl: timedelta | None = None
) -> DataFrame:
    """Number of requests with a live mapping set; no sealed value is read."""
    narrow = recent(sets, now, max_ttl).drop("mappings")
    return live_sets(narrow, now, one_ttl).agg(F.count("*").alias("live_requests"))


def stored_live_sets(
    sets: DataFrame,
    now: Column,
    one_ttl: bool = False,
    newest: bool = False,
    max_ttl: timedelta | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Live sets ready to be joined: ``request_id, mappings``.

    The newest sets are written before the join. That leaves a plain scan under the
    join's shuffle, which is what adaptive execution needs to split a hot request's
    rows on the other side over many tasks. ``newest=True`` states that there is one
    set per request already (a purged table); then nothing is written. What is written goes to
    ``scratch``: sealed values are copied there, so discard it once the result has been used.
    """
    sets = recent(sets, now, max_ttl)
    if not newest:
        columns = ["request_id", "mappings", "stored_at", "expires_at"]
        chosen = newest_sets(live(sets, now) if one_ttl else sets)
        scratch = Scratch(sets.sparkSession) if scratch is None else scratch
        sets = scratch.write(chosen.select(*columns), "newest-sets")
    return live(sets, now).select("request_id", "mappings")


def _token_side(sets: DataFrame, now: Column, max_ttl: timedelta | None, scratch: Scratch | None) -> DataFrame:
    scratch = Scratch(sets.sparkSession) if scratch is None else scratch
    flat = newest_sets(recent(sets, now, max_ttl)).select("request_id", F.explode("mappings").alias("m"), "expires_at")
    rows = scratch.write(flat.select("request_id", "m.*", "expires_at"), "mapping-rows")
    return live(rows, now).drop("expires_at")


def lookup_mappings(
    tokens: DataFrame, sets: DataFrame, now: Column, max_ttl: timedelta | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """Left equi-join of ``(request_id, token)`` rows to their live sealed value.

    Unknown request, unknown token and expired set all give null. The sets are flattened to
    ``scratch``; discard it once the result has been used.
    """
    return tokens.join(_token_side(sets, now, max_ttl, scratch), ["request_id", "token"], "left")


def unresolved_tokens(
    tokens: DataFrame, sets: DataFrame, now: Column, max_ttl: timedelta | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """``(request_id, token)`` rows with no live mapping."""
    known = _token_side(sets, now, max_ttl, scratch).select("request_id", "token")
    return tokens.join(known, ["request_id", "token"], "left_anti")
