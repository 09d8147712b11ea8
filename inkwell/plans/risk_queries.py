"""Registered risk, rate and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import columns as C
from inkwell.operators import rates, risk
from inkwell.plans.registry import ORACLES, query
from inkwell.plans.views import view, with_views

_L1 = f"""case when user_agent = '' or {' or '.join(f"contains(lower(user_agent), '{x}')" for x in risk.UA_BLOCKED)} then 'L1_UA'
when perf_nav = 'prerender' then 'L1_PRERENDER' when sf_mode <> '' and sf_mode not in ('cors', 'same-origin', 'navigate', 'no-cors') then 'L1_HEADER' end"""
_SAME = "contains(lower(accept_language), split_part(lower(lang), '-', 1))"
_L2 = f"""cast(greatest(0, least(100, 80 - case when lang <> '' and accept_language <> '' and not {_SAME} then 30 else 0 end
- case when regexp_full_match(screen, '[0-9]+x[0-9]+') and (try_cast(split_part(screen, 'x', 1) as bigint) < 320 or try_cast(split_part(screen, 'x', 2) as bigint) < 480) then 20 else 0 end
- case when sf_mode = '' then 15 else 0 end - case when sf_site = '' then 15 else 0 end - case when sf_dest = '' then 15 else 0 end - case when accept_language = '' then 15 else 0 end
+ case when sf_site = 'same-origin' or (sf_site = '' and starts_with(referer, 'https://')) then 5 else 0 end + case when lang <> '' and accept_language <> '' and {_SAME} then 3 else 0 end
+ case when {' or '.join(f"contains(lower(user_agent), '{x}')" for x in risk.UA_KNOWN)} then 3 else 0 end + case when perf_nav = 'navigate' then 5 else 0 end)) as bigint)"""
_R = [("speed_std < 0.05 and sample_count > 20", -40, "SPEED_CONST"), ("jerk_mean < 0.001 and sample_count > 20", -30, "JERK_LOW"), ("click_count > 0 and click_dwell_ms < 30", -25, "CLICK_FAST"), ("keydown_count > 5 and key_flight_ms between 1 and 29", -30, "KEY_FAST"), ("(flags & 3) <> 0", 10, "HUMAN_FOCUS_HINT")]
_TOTAL = "(sample_count + click_count + keydown_count + wheel_count)"
_FULL = "greatest(0, least(100, 100 " + " ".join(f"+ case when {c} then {n} else 0 end" for c, n, _ in _R) + "))"
_NAMES = "concat_ws(',', " + ", ".join(f"case when {c} then '{x}' end" for c, _, x in _R) + ")"
_GRADES = [("duration_ms < 3000", 0, "DWELL_TOO_SHORT"), (f"{_TOTAL} = 0 and flags = 0", 30, "ALL_ZERO_LONG"), ("(flags & 3) <> 0 and sample_count < 5", 70, "EARLY_LEAVE_OK"), (f"sample_count < 5 and {_TOTAL} > 0", 60, "WEAK_SAMPLES"), (f"{_TOTAL} = 0", 50, "NO_INTERACTION")]
_B = "cast(case " + " ".join(f"when {c} then {n}" for c, n, _ in _GRADES) + f" else {_FULL} end as bigint)"
_BR = "case " + " ".join(f"when {c} then '{x}'" for c, _, x in _GRADES) + f" else 'score=' || {_FULL} || case when {_NAMES} <> '' then '|' || {_NAMES} else '' end end"


def _req(spark, sf):
    return view(spark, sf, "risk_request")


@query("l1_blocklist", with_views("risk_request", f"select request_id, {_L1} as l1_reason from risk_request"))
def _(spark, sf):
    return risk.l1_blocklist(_req(spark, sf)).select("request_id", "l1_reason")


@query("l2_score", with_views("risk_request", f"select request_id, {_L2} as l2 from risk_request"))
def _(spark, sf):
    return _req(spark, sf).select("request_id", risk.l2_score().alias("l2"))


@query("behavior_score", with_views("risk_request", f"select request_id, {_B} as behavior_score, {_BR} as behavior_reason from risk_request"))
def _(spark, sf):
    return risk.behavior_score(_req(spark, sf)).select("request_id", "behavior_score", "behavior_reason")


@query("combine_scores", with_views("risk_request", f"select request_id, cast(case when scene = 'view-log' then ({_L2} * 70 + {_B} * 30) // 100 else ({_L2} * 60 + {_B} * 40) // 100 end as bigint) as combined from risk_request"))
def _(spark, sf):
    return _req(spark, sf).select("request_id", risk.combined_score(F.col("scene"), risk.l2_score(), risk.behavior_columns()[0]).alias("combined"))


@query("clock_skew", with_views("risk_request", "select request_id from risk_request where abs(server_ms - client_ms) > 120000"))
def _(spark, sf):
    return _req(spark, sf).where(risk.skewed(F.col("server_ms"), F.col("client_ms"))).select("request_id")


_META = "json_object('tz', 'Asia/Shanghai', 'lang', lang, 'screen', repeat(screen, 20), 'perfNav', perf_nav)"


@query(
    "apply_client_meta",
    with_views("risk_request", "select request_id, 'Asia/Shanghai' as tz, case when request_id % 3 = 0 then 'xx' else lang end as lang, '' as langs, substr(repeat(screen, 20), 1, 128) as screen, '' as viewport, perf_nav from risk_request"),
)
def _(spark, sf):
    r = _req(spark, sf)
    meta = F.to_json(F.struct(F.lit("Asia/Shanghai").alias("tz"), "lang", F.repeat("screen", 20).alias("screen"), F.col("perf_nav").alias("perfNav")))
    src = r.select("request_id", meta.alias("client_meta"), F.expr("case when request_id % 3 = 0 then 'xx' else '' end").alias("lang"))
    return risk.apply_client_meta(src).drop("client_meta")


@query("decode_behavior_summary", with_views("risk_request", "select request_id, cast(sample_count as integer) as sample_count, case when request_id % 7 = 0 then null else duration_ms end as duration_ms, cast(flags as integer) as flags from risk_request where request_id % 7 <> 0 union all select request_id, null, null, null from risk_request where request_id % 7 = 0"))
def _(spark, sf):
    r = _req(spark, sf)
    digits = F.concat(F.lpad(F.hex("sample_count"), 4, "0"), F.lpad(F.hex("duration_ms"), 8, "0"), F.repeat(F.lit("0"), 88), F.lpad(F.hex("flags"), 4, "0"), F.repeat(F.lit("0"), 24))
    blob = F.unhex(F.when(F.expr("request_id % 7 = 0"), F.substring(digits, 1, 120)).otherwise(digits))
    return r.select("request_id", risk.decode_behavior_summary(blob).alias("s")).select("request_id", "s.sample_count", "s.duration_ms", "s.flags")


_THROTTLE = """, n as (select *, row_number() over (partition by {k} order by server_ms, request_id) as rn from risk_request),
r as (select {k}, rn, request_id, server_ms as kept_at, true as kept from n where rn = 1
union all select {nk}, n.rn, n.request_id, case when n.server_ms > r.kept_at + {ttl} then n.server_ms else r.kept_at end, n.server_ms > r.kept_at + {ttl} from r join n on {on} and n.rn = r.rn + 1)
select request_id, kept from r"""


def _recursive(names: str, sql: str) -> str:
    return with_views(names, sql).replace("with ", "with recursive ", 1)


@query("throttle_first_nonce", _recursive("risk_request", _THROTTLE.format(k="scene, nonce", nk="n.scene, n.nonce", ttl=60000, on="n.scene = r.scene and n.nonce = r.nonce")))
def _(spark, sf):
    return rates.throttle_first(_req(spark, sf), ["scene", "nonce"], 60_000, "server_ms", "request_id").select("request_id", "kept")


@query("throttle_first_view", _recursive("risk_request", _THROTTLE.format(k="scene, fp, target_id", nk="n.scene, n.fp, n.target_id", ttl=60000, on="n.scene = r.scene and n.fp = r.fp and n.target_id = r.target_id")))
def _(spark, sf):
    return rates.throttle_first(_req(spark, sf), ["scene", "fp", "target_id"], 60_000, "server_ms", "request_id").select("request_id", "kept")


@query(
    "anchored_rate",
    _recursive(
        "risk_request",
        """, n as (select *, row_number() over (partition by scene, ip order by server_ms, request_id) as rn from risk_request),
r as (select scene, ip, rn, request_id, server_ms as started, cast(1 as bigint) as n from n where rn = 1
union all select n.scene, n.ip, n.rn, n.request_id, case when n.server_ms > r.started + 60000 then n.server_ms else r.started end, case when n.server_ms > r.started + 60000 then 1 else r.n + 1 end
from r join n on n.scene = r.scene and n.ip = r.ip and n.rn = r.rn + 1)
select request_id, n as rate_count, n > 3 as rate_exceeded from r""",
    ),
)
def _(spark, sf):
    r = _req(spark, sf).withColumn("limit", F.lit(3).cast("long"))
    return rates.anchored_rate(r, ["scene", "ip"], 60_000, "limit", "server_ms", "request_id").select("request_id", "rate_count", "rate_exceeded")


# The same with every key cut at silences: rows of one address are folded in many tasks.


@query("throttle_first_split", ORACLES["throttle_first_view"])
def _(spark, sf):
    return rates.throttle_first(_req(spark, sf), ["scene", "fp", "target_id"], 60_000, "server_ms", "request_id", split_rows=2).select("request_id", "kept")


@query("anchored_rate_split", ORACLES["anchored_rate"])
def _(spark, sf):
    r = _req(spark, sf).withColumn("limit", F.lit(3).cast("long"))
    return rates.anchored_rate(r, ["scene", "ip"], 60_000, "limit", "server_ms", "request_id", split_rows=2).select("request_id", "rate_count", "rate_exceeded")


_TIGHT = {"share-create": (3, 120, 2), None: (3, 300, 2)}


_COUNT = """, n{k} as (select *, scene || '/' || {key} as key, row_number() over (partition by scene, {key} order by server_ms, request_id) as rn from {source}),
f{k} as (select key, rn, request_id, server_ms as started, cast(1 as bigint) as n, scene from n{k} where rn = 1
union all select n.key, n.rn, n.request_id, case when n.server_ms > f.started + {window} then n.server_ms else f.started end, case when n.server_ms > f.started + {window} then 1 else f.n + 1 end, n.scene from f{k} f join n{k} n on n.key = f.key and n.rn = f.rn + 1),
a{k} as (select s.* from {source} s join f{k} using (request_id) where n <= {limit})"""


def _rates(source: str) -> str:
    """Counts of the three windows one after the other; a request over a limit does not reach the next one."""
    return (
        _COUNT.format(k=1, key="ip", source=source, window=60_000, limit=3)
        + _COUNT.format(k=2, key="ip", source="a1", window=3_600_000, limit="case when f2.scene = 'share-create' then 120 else 300 end")
        + _COUNT.format(k=3, key="fp", source="a2", window=60_000, limit=2)
    )


_RATE = "case when f1.n > 3 then 'L3_RATE_IP' when f2.n > case when f2.scene = 'share-create' then 120 else 300 end then 'L3_RATE_IP' when f3.n > 2 then 'L3_RATE_FP' end"


@query("risk_rate_chain", _recursive("risk_request", _rates("risk_request") + f" select r.request_id, {_RATE} as rate_reason from risk_request r join f1 using (request_id) left join f2 using (request_id) left join f3 using (request_id)"))
def _(spark, sf):
    return risk.risk_rate_chain(_req(spark, sf), _TIGHT).select("request_id", "rate_reason")


def _kept(k: str, keys: str, source: str) -> str:
    """The first event of a key and each one over a minute after the last kept one."""
    return f""", n{k} as (select request_id, server_ms, concat_ws('/', {keys}) as key, row_number() over (partition by concat_ws('/', {keys}) order by server_ms, request_id) as rn from {source}),
f{k} as (select key, rn, request_id, server_ms as kept_at, true as kept from n{k} where rn = 1
union all select n.key, n.rn, n.request_id, case when n.server_ms > f.kept_at + 60000 then n.server_ms else f.kept_at end, n.server_ms > f.kept_at + 60000 from f{k} f join n{k} n on n.key = f.key and n.rn = f.rn + 1)"""


# Each layer sees what the ones before it have let through.
_DECIDE = (
    f", base as (select *, {_L1} as l1, {_L2} as l2, {_B} as b, {_BR} as br, target_id <> repeat('0', 32) as real, case when fp = '' then 'FINGERPRINT_BAD' when abs(server_ms - client_ms) > 120000 then 'TS_SKEW' end as bad from risk_request), s0 as (select * from base where bad is null)"
    + _kept("n", "scene, nonce", "s0")
    + ", s1 as (select s0.* from s0 join fn using (request_id) where kept and l1 is null and l2 >= 60)"
    + _rates("s1")
    + f""", s2 as (select *, case when real and scene = 'view-log' then greatest(0, least(100, (l2 * 70 + b * 30) // 100)) else greatest(0, least(100, (l2 * 60 + b * 40) // 100)) end as total from a3),
s3 as (select *, case when real and scene = 'view-log' and br = 'DWELL_TOO_SHORT' then 'VIEWLOG_DWELL_TOO_SHORT' when real and scene = 'view-log' and total < {risk.VIEW_MIN} then 'VIEWLOG_COMBINED:' || br when real and scene <> 'view-log' and b < {risk.BEHAVIOR_MIN} then 'L4_BEHAVIOR:' || br end as weak from s2),
s4 as (select * from s3 where weak is null and real)"""
    + _kept("d", "scene, fp, target_id", "s4")
    + f""" select r.request_id, r.scene, case when r.bad is not null or not fn.kept then 'bad_request' when r.l1 is not null or r.l2 < 60 then 'silent' when {_RATE} is not null then 'rate_limited' when weak is not null or not fd.kept then 'silent' else 'accept' end as decision,
coalesce(r.bad, case when not fn.kept then 'NONCE_REPLAY' end, r.l1, case when r.l2 < 60 then 'L2_SCORE' end, {_RATE}, weak, case when not fd.kept then 'L3_DEDUP' end, 'ACCEPTED') as reason,
cast(case when r.bad is not null or not fn.kept then 0 when r.l1 is not null then {risk.L2_START} when s3.request_id is null or weak = 'VIEWLOG_DWELL_TOO_SHORT' then r.l2 else s3.total end as bigint) as score
from base r left join fn using (request_id) left join f1 using (request_id) left join f2 using (request_id) left join f3 using (request_id) left join s3 using (request_id) left join fd using (request_id)"""
)


@query("risk_decisions", _recursive("risk_request", _DECIDE))
def risk_decisions(spark, sf):
    return risk.risk_decisions(_req(spark, sf), _TIGHT).select("request_id", "scene", "decision", "reason", "score")


@query(
    "audit_level",
    with_views(
        "risk_request",
        f"""select request_id, case when {_L1} is not null then 'info' when {_L2} < 60 then 'warn' else 'info' end as level, user_agent from risk_request""",
    ),
)
def _(spark, sf):
    r = _req(spark, sf).withColumn("reason", F.coalesce(risk.l1_reason(), F.when(risk.l2_score() < 60, "L2_SCORE"), F.lit("ACCEPTED")))
    r = r.withColumn("decision", F.when(F.col("reason") == "ACCEPTED", "accept").otherwise("silent"))
    return risk.audit_level(r).select("request_id", "level", "user_agent")


@query("risk_reason_stats", with_views("risk_request", f", a as (select scene, coalesce({_L1}, case when {_L2} < 60 then 'L2_SCORE' end) as family from risk_request) select scene, family, 'silent' as decision, count(*) as n from a where family is not null group by all"))
def _(spark, sf):
    r = _req(spark, sf).withColumn("reason", F.coalesce(risk.l1_reason(), F.when(risk.l2_score() < 60, "L2_SCORE:x"), F.lit("ACCEPTED")))
    return risk.risk_reason_stats(r.withColumn("decision", F.when(F.col("reason") == "ACCEPTED", "accept").otherwise("silent")))


def _attempts(spark, sf):
    return view(spark, sf, "attempt")


@query(
    "sliding_admission",
    _recursive(
        "attempt",
        """, n as (select *, row_number() over (partition by username order by ts_ms, attempt_id) as rn from attempt),
f as (select username, rn, attempt_id, [ts_ms] as held, true as allowed, cast(0 as bigint) as retry_ms from n where rn = 1
union all select n.username, n.rn, n.attempt_id, case when len(list_filter(f.held, lambda x: x > n.ts_ms - 120000)) >= 3 then list_filter(f.held, lambda x: x > n.ts_ms - 120000) else list_append(list_filter(f.held, lambda x: x > n.ts_ms - 120000), n.ts_ms) end,
len(list_filter(f.held, lambda x: x > n.ts_ms - 120000)) < 3, case when len(list_filter(f.held, lambda x: x > n.ts_ms - 120000)) < 3 then 0 else greatest(list_filter(f.held, lambda x: x > n.ts_ms - 120000)[1] + 120000 - n.ts_ms, 1000) end
from f join n on n.username = f.username and n.rn = f.rn + 1)
select attempt_id, allowed, cast(len(held) as bigint) as admitted, retry_ms, greatest(cast(ceil(retry_ms / 1000.0) as bigint), 1) as retry_seconds from f""",
    ),
)
def _(spark, sf):
    out = rates.sliding_admission(_attempts(spark, sf), ["username"], 3, 120_000, "ts_ms", "attempt_id")
    return out.select("attempt_id", "allowed", "admitted", "retry_ms", C.retry_after_seconds(F.col("retry_ms")).alias("retry_seconds"))


@query("sliding_admission_split", ORACLES["sliding_admission"])
def _(spark, sf):
    out = rates.sliding_admission(_attempts(spark, sf), ["username"], 3, 120_000, "ts_ms", "attempt_id", split_rows=2)
    return out.select("attempt_id", "allowed", "admitted", "retry_ms", C.retry_after_seconds(F.col("retry_ms")).alias("retry_seconds"))


_STEP = """, n{k} as (select attempt_id, ts_ms, {key} as key, row_number() over (partition by {key} order by ts_ms, attempt_id) as rn from {source}),
f{k} as (select key, rn, attempt_id, [ts_ms] as held, true as ok, cast(0 as bigint) as wait from n{k} where rn = 1
union all select n.key, n.rn, n.attempt_id, case when len(list_filter(f.held, lambda x: x > n.ts_ms - 60000)) >= {limit} then list_filter(f.held, lambda x: x > n.ts_ms - 60000) else list_append(list_filter(f.held, lambda x: x > n.ts_ms - 60000), n.ts_ms) end,
len(list_filter(f.held, lambda x: x > n.ts_ms - 60000)) < {limit}, case when len(list_filter(f.held, lambda x: x > n.ts_ms - 60000)) < {limit} then 0 else greatest(list_filter(f.held, lambda x: x > n.ts_ms - 60000)[1] + 60000 - n.ts_ms, 1000) end
from f{k} f join n{k} n on n.key = f.key and n.rn = f.rn + 1), a{k} as (select s.* from {source} s join f{k} using (attempt_id) where ok)"""
_CHAIN = (
    _STEP.format(k=1, key="ip", source="attempt", limit=6)
    + _STEP.format(k=2, key="username", source="a1", limit=4)
    + _STEP.format(k=3, key="username || '/' || ip", source="a2", limit=2)
    + """ select a.*, case when not f1.ok then 'ip' when not f2.ok then 'user' when not f3.ok then 'user_ip' end as refused_by, coalesce(f3.wait, f2.wait, f1.wait) as retry_ms
from attempt a join f1 using (attempt_id) left join f2 using (attempt_id) left join f3 using (attempt_id)"""
)


@query("admission_chain", _recursive("attempt", _CHAIN))
def admission_chain(spark, sf):
    rules = [rates.Rule("ip", ("ip",), 6, 60_000), rates.Rule("user", ("username",), 4, 60_000), rates.Rule("user_ip", ("username", "ip"), 2, 60_000)]
    return rates.admission_chain(_attempts(spark, sf), rules, "ts_ms", "attempt_id")


def _login_step(k: int, key: str, source: str, limit: int, window: int) -> str:
    return _STEP.format(k=k, key=key, source=source, limit=limit).replace("60000", str(window))


@query(
    "login_admission",
    _recursive(
        "attempt",
        _login_step(1, "ip", "attempt", 8, 600_000) + _login_step(2, "username", "a1", 5, 1_800_000) + _login_step(3, "username || '/' || ip", "a2", 3, 600_000)
        + """ select a.*, case when not f1.ok then 'ip' when not f2.ok then 'username' when not f3.ok then 'username_ip' end as refused_by, coalesce(f3.wait, f2.wait, f1.wait) as retry_ms
from attempt a join f1 using (attempt_id) left join f2 using (attempt_id) left join f3 using (attempt_id)""",
    ),
)
def _(spark, sf):
    """The rules of logins as they stand."""
    return rates.admission_chain(_attempts(spark, sf), rates.rules_for("account_login"), "ts_ms", "attempt_id")


# State after each attempt: failures n from start, level from since, locked until. The first attempt meets the state of none.
_BACKOFF = """, o as (select *, row_number() over (partition by username order by ts_ms, attempt_id) as rn from attempt),
z as (select username, cast(0 as bigint) as rn, cast(null as bigint) as attempt_id, cast(0 as bigint) as n, cast(0 as bigint) as start, cast(0 as bigint) as level, cast(0 as bigint) as since, cast(-1 as bigint) as until, '' as outcome, cast(0 as bigint) as shown, cast(0 as bigint) as wait_ms from (select distinct username from attempt)
union all select username, rn, attempt_id, case when kind = 'failed' then m else case when kind = 'locked' then n else 0 end end, case kind when 'failed' then first when 'locked' then start else 0 end,
  case kind when 'ok' then 0 when 'lock' then next else level end, case kind when 'ok' then 0 when 'lock' then next_since else since end, case kind when 'locked' then until when 'lock' then ts_ms + wait else -1 end,
  kind, case kind when 'ok' then 0 when 'lock' then next else level end, case kind when 'locked' then until - ts_ms when 'lock' then wait else 0 end
from (select *, case when ts_ms <= until then 'locked' when success then 'ok' when m < 5 then 'failed' else 'lock' end as kind, case least(next, 4) when 1 then 300000 when 2 then 900000 when 3 then 3600000 else 21600000 end as wait
  from (select o.username, o.rn, o.attempt_id, o.ts_ms, o.success, z.n, z.start, z.level, z.since, z.until, case when z.n = 0 or o.ts_ms > z.start + 900000 then 1 else z.n + 1 end as m, case when z.n = 0 or o.ts_ms > z.start + 900000 then o.ts_ms else z.start end as first,
    case when z.level = 0 or o.ts_ms > z.since + 86400000 then 1 else z.level + 1 end as next, case when z.level = 0 or o.ts_ms > z.since + 86400000 then o.ts_ms else z.since end as next_since
    from z join o on o.username = z.username and o.rn = z.rn + 1)))
select a.*, outcome, shown as level, wait_ms from attempt a join z using (attempt_id)"""


@query("failure_backoff", _recursive("attempt", _BACKOFF))
def _(spark, sf):
    return rates.failure_backoff(_attempts(spark, sf), ["username"], 5, 900_000, 86_400_000, ts="ts_ms", tie="attempt_id")


_CHALLENGE = """, b as (select *, username || '-' || cast(ts_ms // 600000 as varchar) as challenge from attempt), o as (select *, row_number() over (partition by challenge order by ts_ms, attempt_id) as rn from b),
z as (select challenge, cast(0 as bigint) as rn, cast(null as bigint) as attempt_id, cast(0 as bigint) as start, cast(0 as bigint) as n, false as over, '' as outcome from (select distinct challenge from b)
union all select challenge, rn, attempt_id, case when void or (success and started) then start when success or fresh then ts_ms else start end, case when void or success then n when fresh then 1 else n + 1 end,
  void or (not success and case when fresh then 1 else n + 1 end >= 4), case when void then 'void' when success then 'ok' when case when fresh then 1 else n + 1 end >= 4 then 'invalidated' else 'failed' end
from (select o.challenge, o.rn, o.attempt_id, o.ts_ms, o.success, z.start, z.n, z.over as void, z.rn > 0 as started, z.n = 0 or o.ts_ms > z.start + 300000 as fresh from z join o on o.challenge = z.challenge and o.rn = z.rn + 1))
select b.*, outcome, n as failures from b join z using (attempt_id)"""


@query("challenge_failures", _recursive("attempt", _CHALLENGE))
def _(spark, sf):
    a = _attempts(spark, sf).withColumn("challenge", F.concat_ws("-", "username", F.floor(F.col("ts_ms") / 600_000).cast("string")))
    return rates.challenge_failures(a, ["challenge"], 4, 300_000, "ts_ms", "attempt_id")


@query("rate_key", with_views("attempt", "select attempt_id, sha256(coalesce(nullif(lower(trim(ip)), ''), 'unknown')) as ip_key, sha256(sha256(username) || ':' || sha256('unknown')) as pair_key from attempt"))
def _(spark, sf):
    return _attempts(spark, sf).select("attempt_id", C.rate_key(F.col("ip")).alias("ip_key"), C.rate_key(F.col("username"), F.lit(" ")).alias("pair_key"))


@query(
    "redact_log",
    with_views("attempt", "select attempt_id, 'user=' || username || '&access_token=[REDACTED]&page=2&Login_Challenge=[REDACTED]' as query, '[REDACTED]' as cookie, ip as via from attempt"),
)
def _(spark, sf):
    a = _attempts(spark, sf)
    q = F.concat(F.lit("user="), "username", F.lit("&access_token=abc"), "username", F.lit("&page=2&Login_Challenge="), "ip")
    src = a.select("attempt_id", q.alias("query"), F.create_map(F.lit("Cookie"), "username", F.lit("Via"), "ip").alias("headers"))
    return risk.redact_log(src, "query", "headers").select("attempt_id", "query", F.col("headers")["Cookie"].alias("cookie"), F.col("headers")["Via"].alias("via"))
