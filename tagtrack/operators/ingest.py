"""Messages to typed ranges, log rows and device telemetry: map-only jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrack import constants as K
from tagtrack.functions import text as X
from tagtrack.operators import clock
from tagtrack.plans.barrier import shared_checkpoint


FORMS = (K.ANCHOR_D1, K.ANCHOR_INDEXED, K.D_INDEXED, K.WORD_INDEXED)


def _with_keys(messages: DataFrame) -> DataFrame:
    return messages.withColumns(
        {"_keys": X.field_keys(F.col("message")), "_values": X.field_values(F.col("message"))}
    )


def with_fields(messages: DataFrame) -> DataFrame:
    """Add ``fields``: the key/value map of each message, lower-cased keys."""
    out = _with_keys(messages).withColumn("fields", X.fields_map(F.col("_keys"), F.col("_values")))
    return out.drop("_keys", "_values")


def with_event(messages: DataFrame) -> DataFrame:
    """Add ``event``: the label of each message."""
    out = _with_keys(messages).withColumn("event", X.event_label(F.col("_keys"), F.col("_values")))
    return out.drop("_keys", "_values")


def with_distances(messages: DataFrame, mode: str = "compat") -> DataFrame:
    """Add ``distances``: one (anchor, cm) per anchor, later forms overwriting earlier ones.

    ``compat`` takes the anchor from the text as written, so a device line that
    only carries ``d1=`` lands on anchor 1.  ``session`` maps well-formed device
    lines to the anchor of their session and leaves other messages as in compat.
    """
    return _with_distances(_with_keys(messages), mode).drop("_keys", "_values")


def _with_distances(keyed: DataFrame, mode: str) -> DataFrame:
    if mode not in ("compat", "session"):
        raise ValueError(f"unknown mode {mode!r}")
    up = F.col("_up")
    df = keyed.withColumn("_up", F.upper(F.col("message")))
    df = df.withColumns({f"_n{i}": X.indexed_anchors(up, p) for i, p in enumerate(FORMS)})
    named = F.array(X.keyed_distance(F.col("_keys"), F.col("_values"))).cast(X.PAIRS)
    forms = [X.indexed_distances(up, p, F.col(f"_n{i}")) for i, p in enumerate(FORMS)]
    df = df.withColumn("_named", named)
    usable = F.col("_named")[0]["anchor_id"].isNotNull() & F.col("_named")[0]["distance_cm"].isNotNull()
    df = df.withColumn("_found", F.concat(F.when(usable, F.col("_named")).otherwise(F.array().cast(X.PAIRS)), *forms))
    df = df.withColumn("distances", X.last_per_anchor(F.col("_found")))
    if mode == "session":
        anchor, d1 = session_anchor(F.col("_tel.session")), F.col("_tel.d1")
        one = F.array(F.struct(anchor.alias("anchor_id"), d1.cast("double").alias("distance_cm")))
        mapped = F.when(anchor.isNotNull() & d1.isNotNull(), one.cast(X.PAIRS)).otherwise(
            F.array().cast(X.PAIRS)
        )
        df = df.withColumn("_tel", telemetry_struct(F.col("message")))
        df = df.withColumn("distances", F.when(F.col("_tel").isNotNull(), mapped).otherwise(F.col("distances")))
        df = df.drop("_tel")
    return df.drop("_up", "_found", "_named", *[f"_n{i}" for i in range(len(FORMS))])


def parse_ranges(messages: DataFrame, mode: str = "compat") -> DataFrame:
    """One row per (message, anchor); messages without a distance give none.

    The outer explode keeps the optimizer from deriving a size filter, which it
    would push down by parsing every message a second time.
    """
    keep = [c for c in messages.columns]
    rows = with_distances(messages, mode).select(*keep, F.explode_outer("distances").alias("_d"))
    return rows.where(F.col("_d").isNotNull()).select(*keep, "_d.anchor_id", "_d.distance_cm")


def oversized(messages: DataFrame) -> DataFrame:
    """Messages with an anchor number that fits no 64-bit integer; their other anchors are parsed."""
    up = F.upper(F.col("message"))
    wide = F.lit(False)
    for p in FORMS:
        wide = wide | F.exists(X.indexed_anchors(up, p), lambda a: a.try_cast("bigint").isNull())
    return messages.where(wide)


def ranges_of(messages: DataFrame, mode: str = "compat", time: str = "ingest") -> tuple[DataFrame, DataFrame]:
    """Ranges (run_id, tag_id, t, arrival, anchor_id, distance_cm) of messages, and the rejected rows.

    ``t`` is in seconds: of the stamp; with ``time="clock"`` of the board's own clock, put on the base of the
    stamps by :mod:`tagtrack.operators.clock`, so that boards and boots share one time; with ``time="device"`` the
    board's milliseconds as they are, which begin again at every restart.  Missing run, tag and arrival columns stand for
    one run, one tag and one arrival.  Rows without a tag or a time, and with a
    distance that is no finite number, have no place in an ordered result: they are
    the second table, with a ``reason``.
    """
    if time not in ("ingest", "device", "clock"):
        raise ValueError(f"unknown time basis {time!r}")
    for name in ("run_id", "tag_id", "arrival"):
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(0).cast("long"))
    if time == "clock":
        rows = parse_ranges(_device_stamped(messages), mode)
    else:
        stamp = F.unix_micros("ingest_ts") if time == "ingest" else telemetry_struct(F.col("message"))["ms"] * 1000
        rows = parse_ranges(messages.withColumn("_us", stamp), mode)
    bad = F.isnan("distance_cm") | (F.abs("distance_cm") == float("inf"))
    reason = (
        F.when(F.col("run_id").isNull() | F.col("tag_id").isNull(), F.lit("no tag"))
        .when(F.col("_us").isNull(), F.lit("no time"))
        .when(bad, F.lit("no distance"))
    )
    rows = rows.withColumn("reason", reason)
    kept = rows.where(F.col("reason").isNull()).select(
        "run_id", "tag_id", (F.col("_us") / F.lit(1e6)).alias("t"), "arrival", "anchor_id", "distance_cm"
    )
    return kept, rows.where(F.col("reason").isNotNull()).drop("_us")


def _device_stamped(messages: DataFrame) -> DataFrame:
    """Messages with ``_us``, the device time of device lines; NULL for other messages and without a stamp or a tag."""
    fields = F.struct(*[F.col(f"`{c}`") for c in messages.columns]).alias("_m")
    told = messages.select(fields, F.array(telemetry_struct(F.col("message"))).alias("_t"))
    # decoded once: the boots, the fits and the lines themselves are three readers
    told = shared_checkpoint(told.select("_m", F.explode_outer("_t").alias("_t")))
    whole = F.col("_t").isNotNull() & F.col("_m.ingest_ts").isNotNull() & F.col("_m.run_id").isNotNull() & F.col("_m.tag_id").isNotNull()
    lines = told.where(whole).select(
        "_m", "_m.run_id", "_m.tag_id", "_t.session", "_t.src", "_t.ms", "_t.cb",
        F.unix_micros("_m.ingest_ts").alias("us"), F.coalesce("_m.arrival", F.lit(0)).alias("arrival"),
    )
    timed = clock.with_device_time(lines, barrier=shared_checkpoint).select("_m.*", F.col("device_us").alias("_us"))
    return timed.unionByName(told.where(~whole).select("_m.*", F.lit(None).cast("long").alias("_us")))


def log_rows(messages: DataFrame, mode: str = "compat") -> DataFrame:
    """The nine calibration-log columns, one row per (message, anchor)."""
    df = _with_distances(_with_keys(messages), mode)
    df = df.withColumn("_fields", X.fields_map(F.col("_keys"), F.col("_values"))).select(
        X.iso_millis(F.col("ingest_ts")).alias("timestamp_iso"),
        (F.unix_micros("ingest_ts") / F.lit(1e6)).alias("timestamp_s"),
        "source_ip",
        "source_port",
        X.event_label(F.col("_keys"), F.col("_values")).alias("event"),
        F.explode_outer("distances").alias("_d"),
        F.col("message").alias("raw_message"),
        X.fields_json(F.col("_fields")).alias("fields_json"),
    )
    return df.where(F.col("_d").isNotNull()).select(
        "timestamp_iso",
        "timestamp_s",
        "source_ip",
        "source_port",
        "event",
        "_d.anchor_id",
        "_d.distance_cm",
        "raw_message",
        "fields_json",
    )


def _device_field(message: Column, key: str) -> Column:
    # device lines are strict: a comma, the exact key, a value up to the next comma
    value = F.regexp_extract(message, f",{key}=([^,]*)", 1)
    return F.when(value != "", value)


def telemetry_struct(message: Column) -> Column:
    """Typed device record, or NULL when the line is not a complete one.

    The sentinels for "no measurement" become NULL; text that is not a number
    rejects the line.
    """
    raw = {k: _device_field(message, k) for k in K.TELEMETRY_KEYS}
    cb, ms = raw["cb"].try_cast("long"), raw["ms"].try_cast("long")
    status, last, d1 = (raw[k].try_cast("int") for k in ("status", "lastDist", "d1"))
    complete = message.startswith(K.TELEMETRY_PREFIX)
    for part in (raw["session"], raw["src"], raw["dst"], cb, status, last, d1, ms):
        complete = complete & part.isNotNull()
    return F.when(
        complete,
        F.struct(
            raw["session"].alias("session"),
            raw["src"].alias("src"),
            raw["dst"].alias("dst"),
            cb.alias("cb"),
            status.alias("status"),
            F.when(last != K.NO_DISTANCE, last).alias("lastDist"),
            F.when(d1 >= 0, d1).alias("d1"),
            ms.alias("ms"),
        ),
    )


def session_anchor(session: Column) -> Column:
    """Anchor number of a ranging session; four fixed sessions, so no join is needed."""
    out = F.lit(None).cast("int")
    for name, anchor, _ in reversed(K.SESSION_ANCHORS):
        out = F.when(F.lower(session) == name, F.lit(anchor)).otherwise(out)
    return out


def session_address(session: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, address in reversed(K.SESSION_ANCHORS):
        out = F.when(F.lower(session) == name, F.lit(address)).otherwise(out)
    return out


def telemetry(messages: DataFrame) -> DataFrame:
    """Complete device lines as typed rows beside the message columns.

    The prefix test is cheap and spares other messages the field extraction.
    """
    keep = messages.columns
    device = messages.where(F.col("message").startswith(K.TELEMETRY_PREFIX))
    rows = device.select(*keep, F.array(telemetry_struct(F.col("message"))).alias("_one"))
    # a generator keeps the NULL test from being pushed below, where it would decode twice
    return rows.select(*keep, F.explode_outer("_one").alias("_tel")).where(F.col("_tel").isNotNull()).select(*keep, "_tel.*")


def telemetry_rejects(messages: DataFrame) -> DataFrame:
    """Everything the device decoder ignores."""
    return messages.where(telemetry_struct(F.col("message")).isNull())


def measured(tel: DataFrame) -> DataFrame:
    """Add ``measured``: the line reports a real, new-style measurement."""
    return tel.withColumn("measured", (F.col("status") == 0) & F.col("lastDist").isNotNull())
