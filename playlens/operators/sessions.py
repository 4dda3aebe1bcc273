"""Sessions, quotas, throttles and byte accounting over event logs.

Times are unix seconds (whole or fractional) unless a name says otherwise. Windows over a visitor, owner or site are either
limited to a few rows a group before the shuffle, or scanned in time chunks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.operators.ordered import Scan, flag_first, scan, top_n
from playlens.operators.quantiles import with_quantiles

# Seconds, and counts.
UNATTENDED_IDLE = 60
SESSION_IDLE = 600
SESSION_GRACE = 3600
SESSION_MAX = 6 * 3600
STARTS_PER_MINUTE = 10
REPORTS_PER_SESSION = 3
SPEED_TESTS_PER_SESSION = 2
LOG_EVERY = 60
REPLACE_GRACE = 60
VERDICT_TTL = 7 * 86400

DAY = 86400
_c = F.col


def session_summary(events: DataFrame) -> DataFrame:
    """One row a session: why it ended, what it played, and what was served. A HEAD carries no body and is not counted.

    ``events``: (session, at, event, seconds, head, reason, audio, subtitle, transcoded).
    """
    served = (_c("event") == "segment") & ~_c("head")

    def latest(col: str) -> Column:
        return F.max_by(col, F.when(_c(col).isNotNull(), F.struct("at", "event_id")))

    return events.groupBy("session").agg(
        latest("reason").alias("reason"),
        latest("audio").alias("audio"),
        F.coalesce(latest("subtitle"), F.lit("none")).alias("subtitle"),
        F.bool_or("transcoded").alias("transcoded"),
        F.count_if(served).alias("segments"),
        F.coalesce(F.sum(F.when(served, _c("seconds"))), F.lit(0.0)).alias("seconds"),
    )


def session_end(events: DataFrame, idle: int = SESSION_IDLE, unattended: int = UNATTENDED_IDLE) -> DataFrame:
    """(session, ended_at, reason): the earliest of an explicit end, the idle deadline and the expiry.

    ``events``: (session, at, event, duration). Idle runs from the last heartbeat where it is newer than the last
    request; it is short there, and where nothing was ever served.
    """
    request = _c("event").isin("request", "segment")
    s = events.groupBy("session").agg(
        F.min("at").alias("created"),
        F.max(F.when(request, _c("at"))).alias("seen"),
        F.max(F.when(_c("event") == "heartbeat", _c("at"))).alias("beat"),
        F.count_if(_c("event") == "segment").alias("served"),
        F.min(F.when(_c("event") == "end", _c("at"))).alias("told"),
        F.max("duration").alias("duration"),
    )
    seen = F.coalesce("seen", "created")
    deadline = (
        F.when(_c("beat") > seen, _c("beat") + unattended)
        .when(_c("served") == 0, seen + unattended)
        .otherwise(seen + idle)
    )
    why = F.array_min(
        F.filter(
            F.array(
                F.struct(_c("told").alias("at"), F.lit("deleted").alias("reason")),
                F.struct(session_expiry(_c("created"), _c("duration")).alias("at"), F.lit("expired").alias("reason")),
                F.struct(deadline.alias("at"), F.lit("idle").alias("reason")),
            ),
            lambda x: x["at"].isNotNull(),
        )
    )
    return s.select("session", why["at"].alias("ended_at"), why["reason"].alias("reason"))


def session_expiry(created: Column, duration: Column) -> Column:
    return created + F.least(F.ceil(duration) + SESSION_GRACE, F.lit(SESSION_MAX))


def sessionize(events: DataFrame, owner: str, at: str, gap: Column, width: float) -> DataFrame:
    """(owner, start, end, n): an owner's events split where none came within the gap of those before.

    The gap is each event's own, so a session reaches to the largest ``at + gap`` so far.
    """
    rows = events.select(owner, at, "event_id", (_c(at) + gap).alias("__until"))
    chunk = F.floor(_c(at) / F.lit(float(width)))
    order = [at, "event_id"]
    reach = scan(rows, [owner], order, chunk, [Scan("__reach", "max", _c("__until"), inclusive=False)])
    opened = reach.withColumn("__new", F.when(_c(at) <= _c("__reach"), 0).otherwise(1))
    numbered = scan(opened, [owner], order, chunk, [Scan("__session", "sum", _c("__new"))])
    return (
        numbered.groupBy(owner, "__session")
        .agg(F.min(at).alias("start"), F.max("__until").alias("end"), F.count("*").alias("n"))
        .drop("__session")
    )


def usage_by_grant(sessions: DataFrame) -> DataFrame:
    """Seconds played on each guest grant. ``sessions``: (owner, seconds)."""
    guests = sessions.where(_c("owner").rlike("^grant:[0-9a-f]{8}$") & (_c("seconds") > 0))
    return guests.groupBy(F.substr("owner", F.lit(7)).alias("grant")).agg(
        F.sum("seconds").alias("seconds"), F.count("*").alias("sessions")
    )


def byte_accounting(steps: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """(pull, requested, consumed, abandoned): what was asked for, delivered, and at most left outstanding.

    ``steps``: (pull, requested, consumed, failed) in whole bytes, each row a step of its pull.
    """
    due = _c("requested") - _c("consumed") - _c("failed")
    running = scan(steps, ["pull"], order, chunk, [Scan("__due", "sum", due)])
    return running.groupBy("pull").agg(
        F.sum("requested").alias("requested"),
        F.sum("consumed").alias("consumed"),
        F.max(F.greatest(_c("__due"), F.lit(0))).alias("abandoned"),
    )


def service_metrics(events: DataFrame) -> DataFrame:
    """(name, kind, help, value): gauges and counters in one pass. ``events``: (session, event, public, bytes)."""
    ended = F.max(F.when(_c("event") == "end", 1).otherwise(0))
    per = events.groupBy("session").agg(
        ended.alias("ended"), F.bool_or("public").alias("public"), F.sum("bytes").alias("bytes"),
        F.count_if(_c("event") == "segment").alias("runs"), F.sum(F.when(_c("event") == "segment", _c("bytes"))).alias("sent"),
    )
    live = _c("ended") == 0
    metrics = (
        ("sessions", "gauge", "Sessions playing now.", F.count_if(live)),
        ("public_sessions", "gauge", "Sessions playing now that came through the public origin.", F.count_if(live & _c("public"))),
        ("scratch_bytes", "gauge", "Bytes held for sessions playing now.", F.coalesce(F.sum(F.when(live, _c("bytes"))), F.lit(0))),
        ("sessions_started_total", "counter", "Sessions created.", F.count(F.lit(1))),
        ("runs_total", "counter", "Producer runs started.", F.coalesce(F.sum("runs"), F.lit(0))),
        ("source_bytes_consumed_total", "counter", "Bytes delivered.", F.coalesce(F.sum("sent"), F.lit(0))),
    )
    one = per.agg(*[value.cast("bigint").alias(name) for name, _, _, value in metrics])
    rows = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(h).alias("help"), _c(n).alias("value")) for n, k, h, _ in metrics]
    )
    return one.select(F.explode(rows).alias("m")).select("m.*")


def live_by_owner(events: DataFrame) -> DataFrame:
    live = events.groupBy("owner", "session").agg(F.max(F.when(_c("event") == "end", 1).otherwise(0)).alias("ended"))
    return live.groupBy("owner").agg(F.count_if(_c("ended") == 0).alias("live"), F.count("*").alias("started"))


def scan_costs(scans: DataFrame) -> DataFrame:
    """By result and reason: how many scans, what they read and how long they took."""
    return scans.groupBy("result", "reason").agg(
        F.count("*").alias("scans"), F.sum("bytes").alias("bytes"), F.avg("wall").alias("wall")
    )


def parse_timing(header: Column) -> dict[str, Column]:
    """Milliseconds and the releases tried, from a Server-Timing header."""

    def number(pattern: str) -> Column:
        text = F.regexp_extract(header, pattern, 1)
        return F.when(text != "", text.cast("bigint"))

    return {
        "resolve_ms": number(r"(?:^|,)resolve;dur=([0-9]+)"),
        "open_ms": number(r"(?:^|,)open;dur=([0-9]+)"),
        "init_ms": number(r"(?:^|,)init;dur=([0-9]+)"),
        "tried": number(r'desc="([0-9]+) tried"'),
    }


def selection_timing(sessions: DataFrame) -> DataFrame:
    """``sessions`` (client, outcome, header) rolled up: counts, means and exact percentiles of each stretch."""
    parts = parse_timing(_c("header"))
    rows = sessions.select("client", "outcome", *[v.alias(k) for k, v in parts.items()])
    by, stretches = ["client", "outcome"], ["resolve_ms", "open_ms", "init_ms"]
    totals = rows.groupBy(*by).agg(F.count("*").alias("sessions"), F.avg("tried").alias("tried"), *[F.avg(k).alias(k) for k in stretches])
    return with_quantiles(totals, rows, by, stretches, {"p50": 0.5, "p95": 0.95})


def first_n_per_session(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each session's reports, malformed ones counted like any other."""
    return top_n(events, ["session"], [_c("at"), _c("event_id")], n)


def rate_limit(starts: DataFrame, per: int = STARTS_PER_MINUTE, minute: int = 60) -> DataFrame:
    """``starts`` (visitor, at, event_id, ...) with ``admitted``: the first ``per`` of each visitor in each clock minute."""
    rows = starts.withColumn("__minute", F.floor(_c("at") / minute))
    return flag_first(rows, ["visitor", "__minute"], [_c("at"), _c("event_id")], per, "admitted").drop("__minute")


def daily_quota(asks: DataFrame, cap: int) -> DataFrame:
    """(key, day, at, id, status): each key once a day, the first ``cap`` of the day queued and the rest busy."""
    day = F.floor(_c("at") / DAY)
    once = (
        asks.groupBy("key", day.alias("day"))
        .agg(F.min(F.struct("at", "id")).alias("first"))
        .select("key", "day", _c("first.at").alias("at"), _c("first.id").alias("id"))
    )
    flagged = flag_first(once, ["day"], [_c("at"), _c("id")], cap, "__in")
    return flagged.select("key", "day", "at", "id", F.when(_c("__in"), "queued").otherwise("busy").alias("status"))


def newest_per_owner(sessions: DataFrame, share: int) -> DataFrame:
    """``sessions`` (owner, started, id) with ``fate``: the newest ``share`` of an owner are kept, the rest replaced."""
    flagged = flag_first(sessions, ["owner"], [-_c("started"), -_c("id")], share, "__kept")
    return flagged.select(*sessions.columns, F.when(_c("__kept"), "kept").otherwise("replaced").alias("fate"))


def latest_verdicts(found: DataFrame, now: int, ttl: int | None = VERDICT_TTL, cap: int | None = None) -> DataFrame:
    """The latest verdict of each key, still young; only the newest ``cap`` of them if that is given. ``found``: (key, at, id, why)."""
    latest = found.groupBy("key").agg(F.max(F.struct("at", "id", "why")).alias("v"))
    rows = latest.select("key", _c("v.at").alias("at"), _c("v.why").alias("why"))
    if ttl is not None:
        rows = rows.where(F.lit(now) - _c("at") < ttl)
    return rows if cap is None else rows.orderBy(_c("at").desc(), "key").limit(cap)


def longest_idle(jobs: DataFrame, min_idle: float) -> DataFrame:
    """For each waiting session of a site, the running job of *another* session idle longest: (site, waiter, victim).

    The two idlest of a site answer for everyone: the second is only for the idlest one itself. ``jobs``:
    (site, session, idle, running, waiting).
    """
    able = jobs.where(_c("running") & (_c("idle") >= min_idle))
    two = top_n(able.select("site", "session", "idle"), ["site"], [_c("idle").desc(), _c("session")], 2)
    best = two.groupBy("site").agg(
        F.max(F.when(_c("rank") == 1, _c("session"))).alias("one"), F.max(F.when(_c("rank") == 2, _c("session"))).alias("two")
    )
    victim = F.when(_c("session") != _c("one"), _c("one")).otherwise(_c("two"))
    return (
        jobs.where(_c("waiting"))
        .join(best, "site", "left")
        .select("site", _c("session").alias("waiter"), victim.alias("victim"))
    )


def concurrency(sessions: DataFrame, by: list[str], width: float) -> DataFrame:
    """(by, at, active): how many sessions are open from each moment anything starts or ends.

    A session ending at the moment another starts makes room for it. ``sessions``: (by, start, end).
    """
    steps = F.array(
        F.struct(_c("start").alias("at"), F.lit(1).alias("delta")), F.struct(_c("end").alias("at"), F.lit(-1).alias("delta"))
    )
    moments = sessions.select(*by, F.explode(steps).alias("s")).groupBy(*by, _c("s.at").alias("at")).agg(
        F.sum("s.delta").alias("delta")
    )
    out = scan(moments, by, ["at"], F.floor(_c("at") / F.lit(float(width))), [Scan("active", "sum", _c("delta"))])
    return out.select(*by, "at", "active")


def replacements(sessions: DataFrame, width: float) -> DataFrame:
    """(owner, id, replaces, overlap): starts by an owner whose session before is still open, and for how long."""
    prev = F.struct(_c("id").alias("id"), _c("end").alias("end"))
    rows = scan(
        sessions, ["owner"], ["start", "id"], F.floor(_c("start") / F.lit(float(width))),
        [Scan("__prev", "last", prev, inclusive=False)],
    )
    overlap = F.least(_c("__prev.end"), _c("end")) - _c("start")
    return rows.where(_c("__prev.end") > _c("start")).select(
        "owner", "id", _c("__prev.id").alias("replaces"), overlap.alias("overlap")
    )


def throttle(lines: DataFrame, every: int = LOG_EVERY, width: int = 3600) -> DataFrame:
    """(condition, at, held): at most one line per ``every`` seconds counted from the last one let through.

    Who is let through depends on who was before, yet no condition is folded in one task. Lines are first counted by
    their exact time. Each chunk of ``width`` seconds then says where it would end for each moment it could be entered
    at; those few steps are followed chunk to chunk; and each chunk is replayed from where it was truly entered.
    ``lines``: (condition, at) with ``at`` in whole microseconds, and ``n`` where a row stands for several lines.
    """
    import numpy as np

    step, span = every * 1_000_000, max(width, every) * 1_000_000
    many = F.sum("n") if "n" in lines.columns else F.count("*")
    counted = lines.groupBy("condition", "at").agg(many.alias("n")).withColumn("chunk", F.floor(_c("at") / span))

    def summarise(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["at"].to_numpy())
        after = np.searchsorted(t, t + step, side="left")
        jump = np.where(after < len(t), after, np.arange(len(t)))
        for _ in range(int(np.ceil(np.log2(span / step + 2))) + 1):
            jump = jump[jump]
        # It can be entered at any line of its first ``every`` seconds, else at the first line after.
        entries = min(int(np.searchsorted(t, key[1] * span + step, side="left")) + 1, len(t))
        last = t[jump[:entries]]
        turns = np.flatnonzero(np.append(last[1:] != last[:-1], True))
        return pd.DataFrame({"condition": key[0], "chunk": key[1], "upto": t[turns], "last": last[turns]})

    def follow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ready, rows = None, []
        for chunk, part in pdf.sort_values(["chunk", "upto"]).groupby("chunk", sort=True):
            rows.append((key[0], chunk, ready if ready is not None else -(2**62)))
            upto, last = part["upto"].to_numpy(), part["last"].to_numpy()
            i = 0 if ready is None else int(np.searchsorted(upto, ready, side="left"))
            if i < len(upto):
                ready = int(last[i]) + step
        return pd.DataFrame(rows, columns=["condition", "chunk", "ready"])

    def replay(key, pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["at"].to_numpy())
        out, ready = [], int(pdf["ready"].iloc[0])
        i = int(np.searchsorted(t, ready, side="left"))
        while i < len(t):
            out.append(t[i])
            i = int(np.searchsorted(t, t[i] + step, side="left"))
        return pd.DataFrame({"condition": key[0], "at": np.array(out, dtype="int64")})

    moves = counted.groupBy("condition", "chunk").applyInPandas(
        summarise, "condition string, chunk bigint, upto bigint, last bigint"
    )
    entered = moves.groupBy("condition").applyInPandas(follow, "condition string, chunk bigint, ready bigint")
    passed = (
        counted.join(entered, ["condition", "chunk"])
        .groupBy("condition", "chunk")
        .applyInPandas(replay, "condition string, at bigint")
    )
    # Lines up to each moment, so that what was held back is a difference. The lines let through are few.
    totals = scan(counted, ["condition"], ["at"], _c("chunk"), [Scan("__upto", "sum", _c("n"))])
    w = Window.partitionBy("condition").orderBy("at")
    shown = passed.join(totals, ["condition", "at"])
    before = F.lag(_c("__upto") - _c("n")).over(w)
    held = F.when(before.isNull(), 0).otherwise(_c("__upto") - _c("n") - before - 1)
    return shown.select("condition", "at", held.cast("bigint").alias("held"))


def correlate_logs(access: DataFrame, sessions: DataFrame) -> DataFrame:
    """One timeline a session: its own lines, and the access lines that created it or carry its request id.

    ``access``: (at, rid, session, line); ``sessions``: (at, session, rid, line).
    """
    ids = sessions.where(_c("rid").isNotNull()).select("session", "rid").distinct()
    by_session = access.where(_c("session").isNotNull()).select("session", "at", "line")
    by_rid = access.where(_c("rid").isNotNull()).select("rid", "at", "line").join(ids, "rid").select("session", "at", "line")
    own = sessions.select("session", "at", "line")
    # Both joins can bring the same access line; a session's own lines are all kept.
    return by_session.unionByName(by_rid).distinct().unionByName(own)


def url_status(requests: DataFrame, live: DataFrame, ended: DataFrame, now: Column) -> DataFrame:
    """``requests`` (sid, signed_ok, ...) with the status each URL answers.

    ``live`` and ``ended``: (sid, exp). Only the holder of a valid signature learns that a session ever was.
    """
    rows = requests.join(live.select("sid", _c("exp").alias("__live")), "sid", "left").join(
        ended.select("sid", _c("exp").alias("__ended")), "sid", "left"
    )
    status = (
        F.when(~_c("signed_ok"), 404)
        .when(_c("__live") > now, 200)
        .when(_c("__live").isNotNull(), 410)
        .when(_c("__ended") > now, 410)
        .otherwise(404)
    )
    return rows.select(*requests.columns, status.alias("status"))


def visitor(requests: DataFrame, proxies: DataFrame) -> DataFrame:
    """``requests`` (peer, forwarded) with ``visitor``: the peer, or what a trusted proxy says it saw. ``proxies``: (proxy)."""
    known = proxies.select(_c("proxy").alias("peer"), F.lit(True).alias("__trusted"))
    entries = F.filter(F.transform(F.split(F.coalesce("forwarded", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    named = F.try_element_at(entries, F.lit(-1))
    address = F.when(named.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"), named)
    return requests.join(known, "peer", "left").select(
        *requests.columns, F.when(_c("__trusted"), F.coalesce(address, _c("peer"))).otherwise(_c("peer")).alias("visitor")
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """``requests`` with ``refused``: the first reason not to serve each, null where there is none."""
    from playlens.operators.releases import is_imdb

    def long_tags(col: str) -> Column:
        return (F.size(col) > 8) | F.exists(col, lambda t: F.octet_length(t) > 35)

    bad_tags = F.lit(False)
    for col in ("audio", "subtitle_languages", "video_codecs"):
        bad_tags = bad_tags | F.coalesce(long_tags(col), F.lit(False))
    checks = (
        ("transcode", ~F.coalesce(_c("transcode").isin("allow", "never"), F.lit(True))),
        ("exclude", (F.size("exclude") > 16) | F.exists("exclude", lambda f: F.octet_length(f) > 512)),
        ("start_at", F.isnan("start_at") | F.abs("start_at").eqNullSafe(F.lit(float("inf"))) | (_c("start_at") < 0)),
        ("max_bitrate", _c("max_bitrate") == 0),
        ("imdb", ~is_imdb(_c("imdb"))),
        ("episode", _c("season").isNull() != _c("episode").isNull()),
        ("tags", bad_tags),
    )
    refused = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        refused = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(refused)
    return requests.select("*", refused.alias("refused"))


def audit_signatures(log: DataFrame, sessions: DataFrame, key: bytes, domain: str) -> DataFrame:
    """``log`` (sid, sig, at) with ``valid``: a signature of a session not yet expired. ``sessions``: (sid, exp).

    Each session's signature is worked out once, whatever its traffic.
    """
    from playlens.functions.text import url_signature

    signed = sessions.select("sid", "exp", url_signature(key, domain, _c("sid"), _c("exp")).alias("__sig"))
    ok = (_c("sig") == _c("__sig")) & (_c("at") < _c("exp"))
    return log.join(signed, "sid", "left").select(*log.columns, F.coalesce(ok, F.lit(False)).alias("valid"))
