"""Named queries over the given tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textguard.functions import detection as D
from textguard.functions import masking as M
from textguard.functions import patterns as P
from textguard.functions import replies as R
from textguard.functions import sealing as S
from textguard.functions import validation as V
from textguard.operators import protection as PR
from textguard.operators import rehydration as RH
from textguard.operators import reports, routing, sketches, texts
from textguard.operators.throttle import token_bucket
from textguard.plans.analyze import analyze, analyze_stored
from textguard.plans.inputs import KEY, NOW_SECONDS, OTHER_KEY, all_texts, at, now, requests, table
from textguard.sources import mappings, providers
from textguard.sources import texts as text_sources
from textguard.sources.storage import new_path, write_once
from textguard.streaming.mask import MASKED_SCHEMA, mask_and_protect, mask_stream
from textguard.streaming.rehydrate import rehydrate_batches, rehydrate_stream
from textguard.streaming.sinks import to_parquet
from textguard.streaming.throttle import throttle_batches, throttle_stream

TTL = timedelta(seconds=P.MAPPING_TTL_SECONDS)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _analyzed(spark: SparkSession, sf: str) -> DataFrame:
    return texts.with_analysis(all_texts(spark, sf))


def _stored_at() -> Column:
    """A storing time between 0 and 19 minutes after the start, by text length."""
    return F.timestamp_add("MINUTE", F.length("text") % 20, at())


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    return PR.protect(_analyzed(spark, sf), KEY, _stored_at())


def _stored_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Mapping sets written to a table and read back, each request stored once."""
    path = new_path(spark, "mappings")
    mappings.write_mappings(_sets(spark, sf), path)
    return mappings.read_mappings(spark, path)


def _twice_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Some requests stored again five minutes later, for three minutes, e-mails only."""
    path = new_path(spark, "mappings")
    analyzed = _analyzed(spark, sf)
    mappings.write_mappings(PR.protect(analyzed, KEY, _stored_at()), path)
    emails = F.filter("analysis.mappings", lambda m: m["type"] == "EMAIL")
    again = analyzed.filter(F.length("text") % 2 == 0).withColumn(
        "analysis", F.struct(emails.alias("mappings"))
    )
    later = F.timestamp_add("MINUTE", F.lit(5), _stored_at())
    mappings.write_mappings(PR.protect(again, KEY, later, timedelta(minutes=3)), path)
    return mappings.read_mappings(spark, path)


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies as they come back later: from a table, not from the texts."""
    analyzed = _analyzed(spark, sf).withColumn("provider", F.lit("mock"))
    return write_once(providers.mock_replies(providers.outbound(analyzed)), "replies")


def _seconds(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, F.unix_seconds(name))
    return df


# --- detection --------------------------------------------------------------------


def _one_detector(name: str, column: Callable[..., Column]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = all_texts(spark, sf)
        return texts.spans_table(rows, "request_id", column("text"))

    run.__name__ = name
    query(run)


_one_detector("detect_email", D.detect_email)
_one_detector("detect_url", D.detect_url)
_one_detector("detect_ipv4", D.detect_ipv4)
_one_detector("detect_credit_card", D.detect_credit_card)
_one_detector("detect_ssn", D.detect_ssn)
_one_detector("detect_phone", D.detect_phone)


@query
def match_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Every raw candidate with its offset, before any check."""

    def raw(kind: str, pattern: str) -> Column:
        return F.transform(
            D.with_offsets(F.col("text"), pattern),
            lambda h: F.struct(F.lit(kind).alias("type"), h["value"].alias("value"),
                               h["start"].alias("start")),
        )

    found = F.concat(
        raw("EMAIL", P.EMAIL), raw("URL", P.URL), raw("IP_ADDRESS", P.IP_ADDRESS),
        raw("CREDIT_CARD", P.CREDIT_CARD), raw("SSN", P.SSN), raw("PHONE", P.PHONE),
    )
    return texts.spans_table(all_texts(spark, sf), "request_id", found)


@query
def checked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The IPv4, card and phone checks on every phone-shaped, card-shaped or dotted value."""
    value = F.col("value")
    return match_offsets(spark, sf).filter(
        F.col("type").isin("IP_ADDRESS", "CREDIT_CARD", "PHONE")
    ).select(
        "request_id", "type", "start", "value", D.is_ipv4(value).alias("ipv4"),
        D.is_card(F.rtrim(value, F.lit(P.CARD_TAIL))).alias("card"),
        D.is_phone(value).alias("phone"),
    )


@query
def union_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = D.union_candidates("text")
    return texts.spans_table(all_texts(spark, sf), "request_id", found)


@query
def detections(spark: SparkSession, sf: str) -> DataFrame:
    return texts.detections_table(all_texts(spark, sf))


@query
def utf16_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets in UTF-16 units; an emoji is put in front of every text to move them."""
    shifted = all_texts(spark, sf).select(
        "request_id", F.concat(F.lit("\U0001F600 "), F.col("text")).alias("text")
    )
    found = D.to_utf16_offsets(F.col("text"), D.detect("text"))
    rows = shifted.filter(D.may_contain_pii("text"))
    return texts.spans_table(rows, "request_id", found)


# --- tokens and masking -----------------------------------------------------------


@query
def assigned_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = all_texts(spark, sf).filter(D.may_contain_pii("text"))
    found = M.assign_tokens(M.clean_spans(D.detect("text")))
    return texts.spans_table(rows, "request_id", found)


@query
def token_mappings(spark: SparkSession, sf: str) -> DataFrame:
    return texts.mappings_table(_analyzed(spark, sf))


@query
def masked_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _analyzed(spark, sf).select(
        "request_id", F.col("analysis.masked_text").alias("masked_text")
    )


@query
def mask_given_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Masking with unresolved candidates: overlaps are cut by start order alone."""
    spans = F.filter(
        D.union_candidates("text"), lambda s: s["type"].isin("PHONE", "SSN")
    )
    return all_texts(spark, sf).select(
        "request_id", M.mask_text(F.col("text"), spans).alias("masked_text")
    )


@query
def masked_broken_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Masking with broken spans among the good ones: they are left out."""

    def broken(kind: str | None, value: str | None, start: int | None, end: int | None) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), F.lit(value).alias("value"), F.lit(start).alias("start"),
            F.lit(end).alias("end"),
        )

    bad = F.array(
        broken(None, "x", 0, 1), broken("EMAIL", None, 0, 1), broken("PHONE", "x", -1, 2),
        broken("SSN", "x", 3, 3), broken("URL", "x", 5, 2), broken("URL", "x", None, 2),
    ).cast(D.SPANS)
    spans = F.concat(bad, D.detect("text"))
    return all_texts(spark, sf).select(
        "request_id", M.mask_text(F.col("text"), spans).alias("masked_text")
    )


def _digests(text: Column) -> Column:
    found = D.with_offsets(text, "\\b[0-9a-f]{40}\\b")
    return F.transform(
        found,
        lambda h: F.struct(
            F.lit("DIGEST").alias("type"), h["value"].alias("value"), h["start"].alias("start"),
            (h["start"] + F.length(h["value"])).alias("end"),
        ),
    )


@query
def added_detector(spark: SparkSession, sf: str) -> DataFrame:
    """Hexadecimal digests as a seventh type, found by an added detector."""
    found = texts.detections_table(
        all_texts(spark, sf), detectors=[D.Detector("DIGEST", 5, _digests)]
    )
    return found.filter("type = 'DIGEST'").select("request_id", "value")


@query
def passthrough(spark: SparkSession, sf: str) -> DataFrame:
    return texts.masked_table(texts.with_passthrough(all_texts(spark, sf)))


@query
def masked_segments(spark: SparkSession, sf: str) -> DataFrame:
    return texts.segments_table(masked_texts(spark, sf), "request_id")


@query
def token_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens already in the input, counted on raw and on masked texts."""
    both = _analyzed(spark, sf).select(
        "request_id", M.token_collision(F.col("text")).alias("in_text"),
        M.token_collision(F.col("analysis.masked_text")).alias("in_masked"),
    )
    return both


# --- validation -------------------------------------------------------------------


@query
def accepted_requests(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = routing.route_requests(requests(spark, sf), max_length=P.MAX_TEXT_LENGTH, at=at())
    return accepted.select("request_id", "provider", F.length("text").alias("text_length"))


@query
def rejected_requests(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = routing.route_requests(requests(spark, sf), max_length=P.MAX_TEXT_LENGTH, at=at())
    return _seconds(rejected, "at")


@query
def reject_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = routing.route_requests(requests(spark, sf), max_length=P.MAX_TEXT_LENGTH, at=at())
    return reports.reject_summary(rejected)


@query
def request_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Each check on its own for every request."""
    text, provider = F.col("text"), F.col("provider")
    return requests(spark, sf).select(
        "request_id", V.require_non_blank(text).alias("has_text"),
        V.require_non_blank(provider).alias("has_provider"),
        V.within_size(text).alias("within_size"),
        V.resolve_provider(provider).alias("resolved"),
    )


@query
def classified_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A failure kind for each event, turned into status, error and message."""
    kinds = F.array(*[F.lit(k) for k in (*P.ERRORS, "never-heard-of")])
    kind = F.get(kinds, (F.col("event_id") % (len(P.ERRORS) + 1)).cast("int"))
    error = V.classify_error(kind)
    events = table(spark, sf, "events", "event_id")
    return events.select("event_id", kind.alias("kind"), error.alias("e")).select(
        "event_id", "kind", "e.*"
    )


@query
def sanitized_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of failed events: blank ones replaced, long ones cut, at 300 UTF-16 units."""
    events = table(spark, sf, "events", "event_id", "event_type", "props")
    many = F.repeat(F.lit("\U0001F600x"), (F.col("event_id") % 211).cast("int"))
    message = F.when(F.col("event_id") % 7 == 0, F.lit(" \n ")).otherwise(
        F.concat("event_type", F.lit(" failed: "), F.coalesce("props", F.lit("")), many)
    )
    return events.select("event_id", V.sanitize_message(message).alias("message"))


@query
def reply_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome counts of a request log with a status per event."""
    codes = F.array(*[F.lit(c) for c in (200, 201, 400, 401, 403, 413, 429, 500, 502, 504)])
    status = F.get(codes, (F.col("event_id") % 10).cast("int"))
    events = table(spark, sf, "events", "event_id", "event_type")
    return events.groupBy("event_type", V.reply_outcome(status).alias("outcome")).agg(
        F.count("*").alias("requests")
    )


@query
def json_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests written as JSON lines, some cut short, read back with their rejects."""
    path = new_path(spark, "requests")
    line = F.to_json(F.struct("request_id", "text", "provider"))
    broken = F.length(F.coalesce("text", F.lit(""))) % 17 == 0
    lines = requests(spark, sf).select(
        F.when(broken, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
        .alias("value")
    )
    # requests without an id, each line twice
    nameless = requests(spark, sf).filter(F.length("text") % 19 == 0).select(
        F.explode(F.array_repeat(F.to_json(F.struct("text", "provider")), 2)).alias("value")
    )
    lines.unionByName(nameless).write.text(path)
    good, bad = text_sources.read_json_requests(spark, path, at())
    drawn = F.col("request_id").rlike("^[0-9a-f]{64}$")
    kept = good.filter(~drawn).select(
        "request_id", F.lit("read").alias("outcome"), F.length("text").alias("n")
    )
    ids = good.filter(drawn).agg(F.countDistinct("request_id").cast("int").alias("n"))
    kept = kept.unionByName(
        ids.select(F.lit(None).cast("string").alias("request_id"), F.lit("drawn ids").alias("outcome"), "n")
    )
    # rejects carry a digest for an id: compare how many there are
    counted = bad.groupBy("message").agg(F.count("*").cast("int").alias("n"))
    return kept.unionByName(
        counted.select(F.lit(None).cast("string").alias("request_id"),
                       F.col("message").alias("outcome"), "n")
    )


# --- protection, lookup and lifetime ----------------------------------------------


@query
def protected_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """The stored mapping table in flat form with the size of each sealed value."""
    rows = PR.mapping_rows(_stored_sets(spark, sf))
    sized = rows.withColumn("sealed_bytes", F.octet_length("sealed")).drop("sealed")
    return _seconds(sized, "stored_at", "expires_at")


@query
def sealed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every mapping sealed, stored, and opened with the right and with another key."""
    rows = PR.mapping_rows(_stored_sets(spark, sf))
    return rows.select(
        "request_id", "token", S.open_sealed(F.col("sealed"), KEY).alias("opened"),
        S.try_open(F.col("sealed"), OTHER_KEY).alias("wrong_key"),
    )


@query
def key_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Keys made of customers' names in good and bad forms, and what is wrong with each."""
    raw = F.unhex(F.sha2("c_name", 256))
    text, kind = F.base64(raw), F.col("c_custkey") % 7
    key = (
        F.when(kind == 0, text).when(kind == 1, F.rtrim(text, F.lit("="))).when(kind == 2, F.concat(F.lit(" "), text, F.lit("\n")))
        .when(kind == 3, F.base64(F.substring(raw, 1, 31))).when(kind == 4, F.concat(F.lit("*"), text)).when(kind == 5, F.lit("  "))
    )
    return table(spark, sf, "customer", "c_custkey", "c_name").select("c_custkey", S.key_problem(key).alias("problem"))


@query
def base64_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The Base64 form of every sealed value, its lengths, and the way back."""
    pair = S.to_base64_pair(F.col("sealed"))
    rows = PR.mapping_rows(_stored_sets(spark, sf)).withColumn("pair", pair)
    back = S.from_base64_pair(F.col("pair.ciphertext_base64"), F.col("pair.iv_base64"))
    return rows.select(
        "request_id", "token", F.length("pair.iv_base64").alias("iv_length"),
        F.length("pair.ciphertext_base64").alias("ciphertext_length"),
        (back == F.col("sealed")).alias("same"),
    )


@query
def nonce_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    """Sealed values and distinct nonces among them; the two counts must be equal."""
    nonce = F.substring("sealed", 1, S.NONCE_BYTES)
    per_nonce = PR.mapping_rows(_stored_sets(spark, sf)).groupBy(nonce.alias("nonce")).agg(
        F.count("*").alias("n")
    )
    return per_nonce.agg(F.sum("n").alias("sealed_values"), F.count("*").alias("nonces"))


@query
def newest_sets(spark: SparkSession, sf: str) -> DataFrame:
    newest = PR.newest_sets(_twice_stored(spark, sf))
    return newest.select(
        "request_id", F.size("mappings").alias("tokens"),
        F.unix_seconds("stored_at").alias("stored_at"),
        F.unix_seconds("expires_at").alias("expires_at"),
    )


@query
def live_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """What is still live of a table in which some sets were replaced."""
    return PR.live_sets(_twice_stored(spark, sf), now(), max_ttl=TTL).select(
        "request_id", F.size("mappings").alias("tokens"),
        F.unix_seconds("expires_at").alias("expires_at"),
    )


@query
def live_request_count(spark: SparkSession, sf: str) -> DataFrame:
    return PR.live_request_count(_twice_stored(spark, sf), now(), max_ttl=TTL)


@query
def purged_mappings(spark: SparkSession, sf: str) -> DataFrame:
    path, target = new_path(spark, "mappings"), new_path(spark, "mappings-live")
    mappings.write_mappings(_sets(spark, sf), path)
    kept = mappings.purge_expired(spark, path, target, now())
    return kept.select("request_id", F.unix_seconds("expires_at").alias("expires_at"))


@query
def kept_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """A kept table whose sets were stored in parts and again, merged and purged: what is live then."""
    kept = mappings.MappingTable(spark, new_path(spark, "table"))
    sets = _sets(spark, sf)
    for part in range(3):
        kept.store(sets.filter(F.pmod(F.xxhash64("request_id"), F.lit(3)) == part), "texts", part)
    kept.store(sets.filter(F.pmod(F.xxhash64("request_id"), F.lit(3)) == 2), "texts", 2)
    kept.compact()
    moment = datetime.fromtimestamp(NOW_SECONDS, timezone.utc)
    kept.purge(moment, TTL)
    kept.vacuum(timedelta(0))
    live = PR.live_sets(kept.read(mappings.day_of(moment - TTL)), now(), max_ttl=TTL)
    return live.select("request_id", F.size("mappings").alias("values"), F.unix_seconds("expires_at").alias("expires_at"))


@query
def looked_up_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """The value behind each reply token; null where nothing live is stored."""
    tokens = RH.reply_tokens(_replies(spark, sf))
    found = PR.lookup_mappings(tokens, _twice_stored(spark, sf), now(), TTL)
    return found.select(
        "request_id", "token", "type", "start", "end",
        S.try_open(F.col("sealed"), KEY).alias("value"),
    )


@query
def unresolved_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = RH.reply_tokens(_replies(spark, sf))
    return PR.unresolved_tokens(tokens, _twice_stored(spark, sf), now(), TTL)


# --- replies ----------------------------------------------------------------------


@query
def reply_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return RH.reply_tokens(_replies(spark, sf))


@query
def mock_replies(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf)


@query
def rehydrated_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Stored replies joined to stored mappings; expired ones keep their tokens."""
    return RH.rehydrate(_replies(spark, sf), _stored_sets(spark, sf), KEY, now(), max_ttl=TTL)


@query
def rehydrated_locally(spark: SparkSession, sf: str) -> DataFrame:
    reply = R.mock_reply(F.col("analysis.masked_text"))
    restored = RH.rehydrate_local(reply, F.col("analysis.mappings"))
    return _analyzed(spark, sf).select("request_id", restored.alias("response"))


@query
def failed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Under a wrong key every reply that holds a live token fails as a whole."""
    restored = RH.rehydrate(_replies(spark, sf), _stored_sets(spark, sf), OTHER_KEY, now(), max_ttl=TTL)
    return _seconds(RH.failed_replies(restored, at()), "at")


@query
def leak_check(spark: SparkSession, sf: str) -> DataFrame:
    """Violations by stage: none after masking, all of them when masking is skipped."""

    def stage(name: str, outbound: str) -> Column:
        found = texts.leaks(outbound, "analysis.mappings")
        return F.transform(
            found, lambda v: F.struct(F.lit(name).alias("stage"), v["reason"], v["type"])
        )

    both = F.concat(stage("masked", "analysis.masked_text"), stage("raw", "text"))
    violations = texts.spans_table(_analyzed(spark, sf), "request_id", both)
    return violations.groupBy("stage", "reason", "type").agg(F.count("*").alias("violations"))


def _outbound(spark: SparkSession, sf: str) -> DataFrame:
    provider = F.when(F.length("text") % 2 == 0, F.lit("openai")).otherwise(F.lit("anthropic"))
    return providers.outbound(_analyzed(spark, sf).withColumn("provider", provider))


@query
def provider_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies written as JSON lines and read back, per provider."""
    sent = _outbound(spark, sf)
    bodies = None
    for name in ("openai", "anthropic"):
        path = new_path(spark, f"requests-{name}")
        providers.export_provider_requests(sent, name, path)
        read = spark.read.text(path).select(F.lit(name).alias("provider"), F.col("value").alias("body"))
        bodies = read if bodies is None else bodies.unionByName(read)
    return bodies


@query
def parsed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Reply bodies of all shapes: usable text comes out, anything else is a 502."""
    masked, shape = F.col("masked_text"), F.length("masked_text") % 10
    part = F.struct(F.lit("output_text").alias("type"), masked.alias("text"))
    tail = F.struct(F.lit("output_text").alias("type"), F.lit(" End.").alias("text"))
    other = F.struct(F.lit("refusal").alias("type"), F.lit("no").alias("text"))
    blank = F.struct(F.lit("output_text").alias("type"), F.lit("  ").alias("text"))

    def message(*parts: Column) -> Column:
        item = F.struct(F.lit("message").alias("type"), F.array(*parts).alias("content"))
        return F.to_json(F.struct(F.array(item).alias("output")))

    def around(before: str, value: Column, after: str, field: str | None = None) -> Column:
        json = F.to_json(value)
        if field:  # the value alone, without {"field": and }
            json = F.substring(json, len(field) + 5, F.length(json) - len(field) - 5)
        return F.concat(F.lit(before), json, F.lit(after))

    openai = (
        F.when(shape == 0, message(part, other, tail))
        .when(shape == 1, around('{"output_text":"first","output_text":', F.struct(masked.alias("v")), "}", "v"))
        .when(shape == 2, F.lit('{"output":[{"type":"reasoning"}]}'))
        .when(shape == 3, message(blank))
        .when(shape == 4, F.lit("not json at all{{{"))
        .when(shape == 5, F.lit("{}"))
        .when(shape == 7, around('{"output":["str",{"type":"message","content":[', part, "]}]}"))
        .when(shape == 8, around('{"output":[{"type":"message","content":[5,', part, ']}],"output_text":"other"}'))
        .when(shape == 9, around('{"output":[{"type":"message","content":[{"type":"output_text","text":{"k":1}},', part, "]}]}"))
        .otherwise(message(part))
    )
    block = F.struct(F.lit("text").alias("type"), masked.alias("text"))
    more = F.struct(F.lit("text").alias("type"), F.lit(" End.").alias("text"))
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("x").alias("text"))

    def content(*parts: Column) -> Column:
        return F.to_json(F.struct(F.array(*parts).alias("content")))

    anthropic = (
        F.when(shape == 0, content(block, tool, more))
        .when(shape == 1, around('{"content":[{"type":"text","text":"first"}],"content":[', block, "]}"))
        .when(shape == 2, content(tool))
        .when(shape == 3, F.lit('{"content":[]}'))
        .when(shape == 4, F.lit("not json at all{{{"))
        .when(shape == 5, F.lit("{}"))
        .when(shape == 7, around('{"content":[', block, ',"str"]}'))
        .when(shape == 8, around('{"content":[5,null,', block, "]}"))
        .when(shape == 9, around('{"content":[{"type":"text","text":[1]},', block, "]}"))
        .otherwise(content(more))
    )
    body = F.when(F.col("provider") == "openai", openai).otherwise(anthropic)
    bodies = _outbound(spark, sf).select("request_id", "provider", body.alias("body"))
    replies, rejects = providers.parse_replies(bodies, at())
    failed = rejects.select(
        "request_id", F.concat_ws(" ", F.col("status").cast("string"), "message").alias("outcome")
    )
    return replies.select("request_id", F.col("response_text").alias("outcome")).unionByName(failed)


# --- reports ----------------------------------------------------------------------


@query
def per_text_report(spark: SparkSession, sf: str) -> DataFrame:
    return _analyzed(spark, sf).select("request_id", *texts.report_columns())


@query
def rehydrate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Replies by number of tokens put back."""
    restored = RH.rehydrate(_replies(spark, sf), _stored_sets(spark, sf), KEY, now(), max_ttl=TTL)
    return RH.restored_replies(restored).groupBy("token_count").agg(
        F.count("*").alias("replies")
    )


@query
def detections_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return reports.detections_by_type(texts.detections_table(all_texts(spark, sf)))


def _near(estimate: str, exact: str) -> Column:
    """Within five hundredths, or one."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1.0), 0.05 * F.col(exact))


@query
def sketched_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Exact counts by type, and whether sketches kept for parts and then merged come near them."""
    found = texts.detections_table(all_texts(spark, sf))
    parts = found.withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(4)))
    kept = write_once(sketches.value_sketches(parts, "part"), "sketches")
    about = sketches.estimated(sketches.merged(kept.drop("part"), "type"), "values")
    exact = reports.detections_by_type(found)
    return exact.join(about, "type").select(
        "type", "detection_count", "value_count",
        (_near("values", "value_count") & (F.col("detections") == F.col("detection_count"))).alias("near"),
    )


@query
def sketched_live_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Live requests of a kept table, exactly and whether its sketches come near."""
    kept = mappings.MappingTable(spark, new_path(spark, "table"))
    for _ in range(2):
        kept.store(_sets(spark, sf))
    about = kept.sketched_requests(datetime.fromtimestamp(NOW_SECONDS, timezone.utc)).withColumnRenamed("live_requests", "about")
    exact = PR.live_request_count(kept.read(), now())
    return exact.join(about, F.lit(True)).select("live_requests", _near("about", "live_requests").alias("near"))


@query
def detections_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents only: counts by type, source and language."""
    docs = table(spark, sf, "documents", "doc_id", "text", "source", "lang").filter(
        D.may_contain_pii("text")
    )
    found = F.explode_outer(D.detect("text")).alias("span")
    spans = docs.select("source", "lang", found).filter(F.col("span").isNotNull())
    return reports.detections_by_type(spans.select("source", "lang", "span.*"), "source", "lang")


# --- throttling -------------------------------------------------------------------


@query
def client_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer", "c_custkey", "c_name").select(
        "c_custkey", V.client_key(F.col("c_name")).alias("client")
    )


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events", "event_id", "ts", "event_type")
    return token_bucket(events, "event_type", "ts", "event_id", capacity=1, refill_per_minute=1)


@query
def throttled_events(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).select("event_type", "event_id", "allowed", "retry_after")


@query
def unthrottled_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event passes where throttling is switched off."""
    events = table(spark, sf, "events", "event_id", "ts", "event_type")
    passed = token_bucket(events, "event_type", "ts", "event_id", capacity=1, refill_per_minute=1, enabled=False)
    return passed.select("event_type", "event_id", "allowed", "retry_after")


@query
def throttle_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.throttle_summary(_decisions(spark, sf), "event_type")


# --- whole chain ------------------------------------------------------------------


def _flat(results: DataFrame) -> DataFrame:
    spans = F.transform(
        "detections",
        lambda d: F.concat_ws(":", d["type"], d["start"].cast("string"), d["end"].cast("string")),
    )
    return results.withColumn("detections", F.array_join(spans, " "))


@query
def analyzed_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(analyze(requests(spark, sf), at=at()).results)


def _some_replies(sent: DataFrame) -> DataFrame:
    """The stand-in provider, which now and then does not answer."""
    return providers.mock_replies(sent.filter(F.length("masked_text") % 9 > 0))


@query
def analyzed_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same chain by way of stored mappings and a join; unanswered requests as rejects."""
    path = new_path(spark, "mappings")
    done = analyze_stored(
        requests(spark, sf), KEY, path, _some_replies, now=now(), stored_at=now(), at=at()
    )
    failed = done.rejects.select(
        "request_id", F.concat_ws(" ", F.col("status").cast("string"), "message").alias("status")
    )
    return _flat(done.results).unionByName(failed, allowMissingColumns=True)


@query
def results_without_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Results written without raw text and values, read back."""
    path = new_path(spark, "results")
    text_sources.write_results(analyze(requests(spark, sf), at=at()).results, path)
    return _flat(spark.read.parquet(path))


# --- streams ----------------------------------------------------------------------


def _as_stream(df: DataFrame, name: str, files: int = 16) -> DataFrame:
    """A table as a file stream, a few files at a time."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path)


@query
def masked_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = mask_stream(_as_stream(all_texts(spark, sf), "texts"))
    path = new_path(spark, "masked")
    to_parquet(stream, path, "mask").awaitTermination()
    return spark.read.schema(MASKED_SCHEMA).parquet(path)


@query
def masked_and_protected_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of the masked rows beside the sizes of the stored sets."""
    masked_path, mapping_path = new_path(spark, "masked"), new_path(spark, "mappings")
    stream = _as_stream(all_texts(spark, sf), "texts")
    mask_and_protect(stream, KEY, masked_path, mapping_path).awaitTermination()
    masked = spark.read.schema(MASKED_SCHEMA).parquet(f"{masked_path}/batch=*")
    sets = PR.newest_sets(mappings.MappingTable(spark, mapping_path).read())
    stored = sets.select("request_id", F.size("mappings").alias("stored"))
    return masked.select("request_id", "token_count").join(stored, "request_id", "left")


@query
def rehydrated_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of replies against stored mappings, of which each batch was stored twice."""
    path = new_path(spark, "mappings")
    for _ in range(2):
        mappings.write_mappings(_sets(spark, sf), path)
    sets = mappings.read_mappings(spark, path)
    replies = _replies(spark, sf).withColumn("reply_ts", now())
    stream = rehydrate_stream(_as_stream(replies, "replies"), sets, KEY)
    path = new_path(spark, "restored")
    to_parquet(stream, path, "rehydrate").awaitTermination()
    kept = spark.read.schema(stream.schema).parquet(path)
    return kept.drop("reply_ts")


@query
def rehydrated_stream_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of replies in several batches against a kept table that was stored twice and merged."""
    path, out = new_path(spark, "table"), new_path(spark, "restored")
    kept = mappings.MappingTable(spark, path)
    for _ in range(2):
        kept.store(_sets(spark, sf))
    kept.compact()
    replies = _replies(spark, sf).withColumn("reply_ts", now())
    rehydrate_batches(_as_stream(replies, "replies", files=2), path, KEY, out, TTL).awaitTermination()
    spec = "request_id string, provider string, response string, token_count int, failure_kind string"
    return spark.read.schema(spec).parquet(f"{out}/batch=*")


def _with_end(df: DataFrame, name: str, last: DataFrame) -> DataFrame:
    """A table as a file stream that ends in a later row, which lets the watermark pass all others."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    end = last.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema])
    end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1_000).parquet(path)


@query
def rehydrated_stream_join(spark: SparkSession, sf: str) -> DataFrame:
    """Replies and mapping sets both as streams, each set stored twice: every reply once, matched or not."""
    end, later = "end of stream", F.timestamp_add("DAY", F.lit(1), now())
    stored = new_path(spark, "mappings")
    for _ in range(2):
        mappings.write_mappings(_sets(spark, sf), stored)
    sets = mappings.read_mappings(spark, stored).drop("expires_on")
    none = F.array().cast(sets.schema["mappings"].dataType).alias("mappings")
    one = spark.range(1)
    last_set = one.select(
        F.lit(end).alias("request_id"), none, later.alias("stored_at"), later.alias("expires_at")
    )
    replies = _replies(spark, sf).withColumn("reply_ts", now())
    last_reply = one.select(
        F.lit(end).alias("request_id"), F.lit("mock").alias("provider"),
        F.lit("").alias("response_text"), later.alias("reply_ts"),
    )
    stream = rehydrate_stream(
        _with_end(replies, "replies", last_reply), _with_end(sets, "sets", last_set), KEY,
        lateness=timedelta(hours=1),
    )
    path = new_path(spark, "restored")
    to_parquet(stream, path, "rehydrate").awaitTermination()
    kept = spark.read.schema(stream.schema).parquet(path)
    return kept.filter(F.col("request_id") != end).drop("reply_ts")


BATCHES = 5


def _in_turn(spark: SparkSession, sf: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """All events in batches that follow one another, by ranges of time; every fiftieth event comes a
    batch late. ``run`` goes on from its checkpoint each time."""
    events = table(spark, sf, "events", "event_id", "ts", "event_type")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(us), F.max(us)).head()
    batch = F.expr(f"(us - {low or 0}) * {BATCHES} div {(high or 0) - (low or 0) + 1} + if(event_id % 50 = 0, 1, 0)")
    dealt = write_once(events.withColumn("us", us).withColumn("batch", batch).drop("us"), "batches")
    path = new_path(spark, "events")
    for number in range(BATCHES + 1):
        dealt.filter(F.col("batch") == number).drop("batch").write.mode("append").parquet(path)
        run(spark.readStream.schema(events.schema).parquet(path)).awaitTermination()


@query
def throttled_stream(spark: SparkSession, sf: str) -> DataFrame:
    """State carried over batches, one of which brings late events."""
    path, checkpoint = new_path(spark, "decisions"), new_path(spark, "throttle-offsets")

    def run(events: DataFrame) -> StreamingQuery:
        stream = throttle_stream(events, "event_type", "ts", "event_id", capacity=1, refill_per_minute=1)
        return to_parquet(stream, path, "throttle", checkpoint)

    _in_turn(spark, sf, run)
    spec = "client string, event_id bigint, allowed boolean, retry_after bigint"
    return spark.read.schema(spec).parquet(path).withColumnRenamed("client", "event_type")


@query
def throttled_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The same by way of the batch operator."""
    out, state, checkpoint = new_path(spark, "decisions"), new_path(spark, "buckets"), new_path(spark, "throttle-offsets")

    def run(events: DataFrame) -> StreamingQuery:
        return throttle_batches(
            events, "event_type", "ts", "event_id", out, state, capacity=1, refill_per_minute=1, checkpoint=checkpoint
        )

    _in_turn(spark, sf, run)
    spec = "event_type string, event_id bigint, allowed boolean, retry_after bigint"
    return spark.read.schema(spec).parquet(f"{out}/batch=*")
