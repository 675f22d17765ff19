"""The whole chain from requests to results."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import patterns as P
from textguard.functions.binding import attach, bind
from textguard.functions.detection import Detector
from textguard.functions.sealing import KeyConfigError, check_key, hide_keys, open_sealed, seal
from textguard.operators import rehydration
from textguard.operators.protection import seal_mappings, with_expiry
from textguard.operators.routing import route_requests
from textguard.operators.texts import with_analysis
from textguard.sources.mappings import write_mappings
from textguard.sources.providers import mock_replies, outbound
from textguard.sources.storage import new_path, remove

ReplyFn = Callable[[DataFrame], DataFrame]
ANALYZED = "ANALYZED"


@dataclass(frozen=True)
class Analysis:
    results: DataFrame
    rejects: DataFrame
    staged: str | None = None
    public: DataFrame | None = None

    def discard(self) -> None:
        """Remove what was written in between, once results and rejects have been used."""
        if self.staged:
            remove(self.results.sparkSession, self.staged)


def _result(original: str, provider: str, response: Column) -> list[Column]:
    return [
        F.col("request_id"), F.col(original).alias("original_text"),
        F.col("analysis.masked_text").alias("processed_text"), F.col(provider),
        F.lit(ANALYZED).alias("status"), F.col("analysis.detections").alias("detections"),
        response.alias("response"),
    ]


def analyze(
    requests: DataFrame,
    providers: Iterable[str] = P.PROVIDERS,
    max_length: int | None = None,
    detectors: Iterable[Detector] = (),
    at: Column | None = None,
) -> Analysis:
    """Route, detect, mask, answer with the stand-in provider and restore, in one pass.

    Nothing is stored: tokens are restored from the transient mappings of the same
    row, so the plan is a scan and projections without any shuffle. For replies that
    come back later use ``analyze_stored``; both give the same rows.
    """
    accepted, rejects = route_requests(requests, providers, max_length, at)
    analyzed = with_analysis(accepted, "text", detectors)
    types = (*P.PRIORITY, *(d.type for d in detectors))
    reply = F.concat(F.col("analysis.masked_text"), F.lit(P.MOCK_SUFFIX))
    response = rehydration.rehydrate_local(reply, F.col("analysis.mappings"), types)
    return Analysis(analyzed.select(*_result("text", "provider", response)), rejects)


def analyze_stored(
    requests: DataFrame,
    key: str | None,
    mapping_path: str,
    reply_fn: ReplyFn = mock_replies,
    now: Column | None = None,
    stored_at: Column | None = None,
    ttl: timedelta | None = None,
    providers: Iterable[str] = P.PROVIDERS,
    max_length: int | None = None,
    at: Column | None = None,
    detectors: Iterable[Detector] = (),
) -> Analysis:
    """The same chain with sealed mappings written before any reply is asked for.

    Texts are detected and masked once. What is written in between is masked texts, places of
    detections, and sealed values, nothing in the clear: the mapping table, the outbound
    columns and the results are read from it, and replies meet it in one join on
    ``request_id``. Only ``results`` reads the texts again, for its ``original_text``; ``public`` holds the same
    rows without raw text and values. ``discard`` of the outcome removes what was written.
    ``reply_fn`` sees ``request_id, provider, masked_text`` only.

    Every accepted request gives a result or a reject row: one without a reply is a provider
    failure, one whose reply cannot be restored is rejected as a whole. Request ids must be
    unique among accepted requests.
    """
    spark = requests.sparkSession
    hide_keys(spark)
    now = F.current_timestamp() if now is None else now
    stored_at = F.current_timestamp() if stored_at is None else stored_at
    detectors = tuple(detectors)
    types = (*P.PRIORITY, *(d.type for d in detectors))
    accepted, rejects = route_requests(requests, providers, max_length, at)
    analyzed = with_analysis(accepted, "text", detectors)
    places = F.transform("analysis.detections", lambda d: F.struct(d["type"].alias("type"), d["start"].alias("start"), d["end"].alias("end")))
    staged = with_expiry(
        analyzed.select(
            "request_id", "provider", F.struct("analysis.masked_text").alias("analysis"), places.alias("places"),
            _sealed_values(F.col("analysis.detections.value"), key).alias("values"),
            seal_mappings(F.col("analysis.mappings"), key).alias("mappings"),
            stored_at.cast("timestamp").alias("stored_at"),
        ), ttl,
    )
    path = new_path(spark, "analyzed")
    staged.write.parquet(path)
    staged = spark.read.schema(staged.schema).parquet(path)
    if staged.groupBy("request_id").count().filter("count > 1").head(1):
        remove(spark, path)
        raise ValueError("Request ids must be unique.")
    sets = staged.filter(F.size("mappings") > 0)
    write_mappings(sets.select("request_id", "mappings", "stored_at", "expires_at"), mapping_path)

    replies = reply_fn(outbound(staged)).select("request_id", "response_text", F.lit(True).alias("answered"))
    live = F.when((F.size("mappings") > 0) & (F.col("expires_at") > now), F.col("mappings"))
    waiting = staged.select("request_id", "provider", "analysis", "places", "values", live.alias("mappings"))
    restored = attach(
        waiting.join(replies, "request_id", "left"), "restored",
        rehydration.restore("response_text", "mappings", key, types),
    ).select(
        "request_id", "provider", "analysis", "places", "values", "restored.response",
        F.when(F.col("answered").isNull(), F.lit("provider_failure"))
        .otherwise(F.col("restored.failure_kind")).alias("failure_kind"),
    )
    good = restored.filter(F.col("failure_kind").isNull())
    opened = open_sealed(F.col("values"), key) if _usable(key) else F.lit(None).cast("string")
    values = F.from_json(F.when(F.size("places") > 0, opened), "array<string>")
    found = bind(values, lambda v: F.transform("places", lambda d, i: F.struct(
        d["type"].alias("type"), F.get(v, i).alias("value"), d["start"].alias("start"), d["end"].alias("end")
    )))
    raw = good.join(accepted.select("request_id", "text"), "request_id").withColumn("analysis", F.struct("analysis.masked_text", found.alias("detections")))
    return Analysis(
        raw.select(*_result("text", "provider", F.col("response"))),
        rejects.unionByName(rehydration.failed_replies(restored, at)),
        path,
        good.select(
            "request_id", F.col("analysis.masked_text").alias("processed_text"), "provider", F.lit(ANALYZED).alias("status"),
            F.col("places").alias("detections"), "response",
        ),
    )


def _sealed_values(values: Column, key: str | None) -> Column:
    """The values of a text's detections, sealed together; null without any. With an unusable key the
    mappings of the same row raise the error."""
    if not _usable(key):
        return F.lit(None).cast("binary")
    return F.when(F.size(values) > 0, seal(F.to_json(values), key))


def _usable(key: str | None) -> bool:
    try:
        check_key(key)
    except KeyConfigError:
        return False
    return True
