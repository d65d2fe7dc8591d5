"""Queries over the driver's tables, each with the same question in DuckDB's SQL where it has one.

Every query calls the library's operators on whole tables, or on captures that Spark derives from them (plans/captures.py).
"""

from __future__ import annotations

from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.apps import app_code, app_name, classify_host, classify_sql
from .functions.network import five_tuple_hash, protocol_name, tcp_flags_name
from .functions.text import content_hash, entropy, estimate_tokens, leftmost_label, redact_secrets, sanitize_hostname
from .operators import aggregates, checks, chunking, context, decode, evaluation, export, flows, patterns, report, rule_times, schemas, search, signals
from .operators.inspect import block_reason, block_reason_by_join, inspect
from .plans import captures
from .plans.pipeline import kept, shared_folder
from .sources.pcap import read_captures, write_captures
from .sources.rules import Rules
from .sources.store import Refused, VectorStore, batch_problems, finite
from .streaming import states
from .streaming.flows import flow_sessions

#: The rules that the rule queries block by.
RULES = Rules().block_ip("10.0.0.5").block_ip("93.184.0.7").block_port(9001).block_app("HTTP").block_domain("*.example.net").block_domain("cdn*.example.com")


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return captures.frames(_read(spark, d, "events"), _read(spark, d, "pages"))


def _packets(spark: SparkSession, d: str) -> DataFrame:
    return decode.transport_packets(_frames(spark, d))


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", F.expr("parse_url(url, 'HOST')").alias("host"))


# DuckDB: what captures.tuples() derives, by its own formulas.
_KNOWN = "[" + ", ".join(f"'{h}'" for h, _ in captures.KNOWN_HOSTS) + "]"
_PAGE_HOST = f"case when page_id % 2 = 1 then {_KNOWN}[cast(page_id // 2 % {len(captures.KNOWN_HOSTS)} as int) + 1] else regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) end"
_TUPLES = f"""
with e as (select *, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) as k, (select greatest({captures.CAPTURES}, count(*) // {captures.CAPTURE_EVENTS}) from events) as nc from events),
h as (select page_id, {_PAGE_HOST} as host from pages),
c as (
  select e.*, h.host as page_host, event_id % 3 = 0 as back, 10 + 65536 * ((user_id // 256) % 256) + 16777216 * (user_id % 256) as client,
    93 + 184 * 256 + 65536 * ((k // 256) % 256) + 16777216 * (k % 256) as server, [443, 80, 53, 8080, 9001][cast(k % 5 as int) + 1] as service, 40000 + user_id % 20000 as port
  from e left join h on h.page_id = e.event_id % (select count(*) from pages)
),
t as (
  select 'events-' || (event_id % nc) || '.pcap' as capture, event_id // nc as packet_no, event_id, ts,
    case when back then server else client end as src_ip, case when back then client else server end as dst_ip,
    case when back then service else port end as src_port, case when back then port else service end as dst_port,
    case when service = 53 then 17 else 6 end as protocol,
    case event_type when 'signup' then 2 when 'view' then 18 when 'click' then 24 when 'purchase' then 17 when 'error' then 4 end as tcp_flags,
    case when event_type = 'click' and not back then page_host end as host, cast(floor(abs(value)) as int) as pad
  from c
),
p as (
  select *, case when host is null then pad % 40 when dst_port = 443 then length(host) + 61 when dst_port = 53 then length(host) + 18 else length(host) + 39 end as payload_length from t
),
q as (
  select *, payload_length + case when protocol = 17 then 42 else 54 end as frame_len,
    (src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port)) as is_lo from p
)"""
_IP = "(({0}) % 256) || '.' || (({0}) // 256 % 256) || '.' || (({0}) // 65536 % 256) || '.' || (({0}) // 16777216)"


def host_applications(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each application (all groups of names are met: see captures.KNOWN_HOSTS)."""
    named = captures.page_hosts(_read(spark, d, "pages")).select(classify_host(F.col("host")).alias("app"))
    return aggregates.distribution(named, "app").select("app", "n", F.round("percent", 6).alias("percent"))


_HOSTS = "h as (select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host from pages)"
# The applications of the well-known hosts are written out, so that this doesn't ask the same patterns again.
HOST_APPLICATIONS = f"""with k(host, app) as (values {", ".join(f"('{h}', '{a}')" for h, a in captures.KNOWN_HOSTS)}), h as (select page_id, {_PAGE_HOST} as host from pages),
a as (select coalesce(app, 'HTTPS') as app from h left join k using (host)) select app, count(*) as n, round(100.0 * count(*) / (select count(*) from a), 6) as percent from a group by app"""


def capture_applications(spark: SparkSession, d: str) -> DataFrame:
    """Flows of each application in the derived captures, by the first packet that names one: the flagship query."""
    p = flows.with_flow_key(inspect(_packets(spark, d)))
    named = F.when(F.col("cand_app").isNotNull(), F.col("packet_no"))
    by = p.groupBy(*flows.KEY).agg(F.min_by(app_code(F.col("cand_app")), named).alias("code"))  # a number, so that it is a hash aggregate
    return by.groupBy("capture", app_name(F.coalesce("code", F.lit(0))).alias("app")).agg(F.count("*").alias("flows"))


_NAMED = _TUPLES + f""",
n as (
  select *, case when payload_length = 0 then null when host is not null and dst_port = 443 then 'tls' when host is not null and dst_port in (80, 8080) then 'http'
    when host is not null and dst_port = 53 then 'dns' when (dst_port = 53 or src_port = 53) then null when dst_port in (80, 8000, 8080, 8888) or dst_port = 443 then 'port' end as kind from q
),
m as (select *, case kind when 'tls' then {classify_sql('host')} when 'http' then {classify_sql('host')} when 'dns' then 'DNS' when 'port' then case when dst_port = 443 then 'HTTPS' else 'HTTP' end end as cand_app,
  case when kind = 'port' then '' else host end as cand_name,
  case when is_lo then src_ip else dst_ip end as lo_ip, case when is_lo then src_port else dst_port end as lo_port, case when is_lo then dst_ip else src_ip end as hi_ip, case when is_lo then dst_port else src_port end as hi_port from n)
"""  # fmt: skip
CAPTURE_APPLICATIONS = _NAMED + """, f as (select capture, lo_ip, lo_port, hi_ip, hi_port, protocol, coalesce(arg_min(cand_app, packet_no) filter (cand_app is not null), 'Unknown') as app from m group by all)
select capture, app, count(*) as flows from f group by all"""


def capture_reports(spark: SparkSession, d: str) -> DataFrame:
    """The report of each derived capture as text, where packets to one port are dropped."""
    p = flows.with_flow_key(inspect(_packets(spark, d)))
    named, told = F.when(F.col("cand_app").isNotNull(), F.col("packet_no")), F.when(F.col("cand_app").isNotNull() & (F.col("cand_name") != ""), F.col("packet_no"))
    by = p.groupBy(*flows.KEY).agg(F.min_by(app_code(F.col("cand_app")), named).alias("code"), F.min_by("cand_name", told).alias("sni"), F.min("packet_no").alias("first_packet_no"))
    found = by.select("capture", app_name(F.coalesce("code", F.lit(0))).alias("app"), F.when(F.col("sni").isNotNull(), F.col("sni")).otherwise("").alias("sni"), "first_packet_no")
    judged = _packets(spark, d).withColumn("reason", F.when(F.col("dst_port") == 9001, "PORT"))
    return report.capture_texts(aggregates.capture_totals(judged), found)


_PERCENT = "cast((({0}) // {2}) as varchar) || '.' || lpad(cast(({0}) % {2} as varchar), {1}, '0')"
_DROPPED, _SHARE = _PERCENT.format("(20000 * dropped + packets) // (2 * packets)", 2, 100), _PERCENT.format("(2000 * n + total) // (2 * total)", 1, 10)
CAPTURE_REPORTS = _NAMED + f""", fl as (select capture, coalesce(arg_min(cand_app, packet_no) filter (cand_app is not null), 'Unknown') as app, coalesce(arg_min(cand_name, packet_no) filter (cand_app is not null and cand_name <> ''), '') as sni, min(packet_no) as first_seen from m group by capture, lo_ip, lo_port, hi_ip, hi_port, protocol),
tot as (select capture, count(*) as packets, sum(frame_len) as bytes, count(*) filter (protocol = 6) as tcp, count(*) filter (protocol = 17) as udp, count(*) filter (dst_port = 9001) as dropped from q group by capture),
apps as (select capture, app, count(*) as n, sum(count(*)) over (partition by capture)::bigint as total from fl group by capture, app),
sn as (select capture, sni, count(*) as n, min(first_seen) as first_seen from fl where sni <> '' group by all), tops as (select *, row_number() over (partition by capture order by n desc, first_seen, sni) as rank from sn),
rep as (
  select capture, 0 as section, 0 as pos, '' as tie, capture || ': ' || packets || ' packets, ' || bytes || ' bytes, ' || tcp || ' TCP, ' || udp || ' UDP, ' || (packets - dropped) || ' forwarded, ' || dropped || ' dropped (' || {_DROPPED} || '%)' as line from tot
  union all select capture, 1, -n, app, '  ' || rpad(app, 16, ' ') || lpad(cast(n as varchar), cast(greatest(8, length(cast(n as varchar))) as int), ' ') || '  ' || lpad({_SHARE}, 5, ' ') || '%  ' || repeat('#', cast((20 * n) // total as int)) from apps
  union all select capture, 2, rank, '', '  ' || rpad(case when length(sni) > 35 then substr(sni, 1, 32) || '...' else sni end, 36, ' ') || lpad(cast(n as varchar), cast(greatest(6, length(cast(n as varchar))) as int), ' ') from tops where rank <= 20)
select capture, string_agg(line, chr(10) order by section, pos, tie) as text from rep group by capture"""


def decoded_packets(spark: SparkSession, d: str) -> DataFrame:
    """Header fields of every frame."""
    p = _packets(spark, d)
    return p.select("capture", "packet_no", "src_ip_s", "dst_ip_s", "src_port", "dst_port", protocol_name(F.col("protocol")).alias("protocol"), F.when(F.col("has_tcp"), tcp_flags_name(F.col("tcp_flags"))).alias("flags"), "ttl", "payload_offset", "payload_length", "frame_len", "src_mac")


DECODED_PACKETS = _TUPLES + f"""
select capture, packet_no, {_IP.format('src_ip')} as src_ip_s, {_IP.format('dst_ip')} as dst_ip_s, src_port, dst_port, case protocol when 6 then 'TCP' else 'UDP' end as protocol,
  case when protocol = 6 then case tcp_flags when 2 then 'SYN' when 18 then 'SYN ACK' when 24 then 'ACK PSH' when 17 then 'ACK FIN' when 4 then 'RST' end end as flags,
  64 as ttl, case when protocol = 6 then 54 else 42 end as payload_offset, payload_length, frame_len, '02:00:00:00:00:02' as src_mac from q"""


def payload_names(spark: SparkSession, d: str) -> DataFrame:
    """What every packet's payload tells of its flow."""
    return inspect(_packets(spark, d)).where("cand_kind is not null").select("capture", "packet_no", "cand_kind", "cand_app", "cand_name")


PAYLOAD_NAMES = _NAMED + "select capture, packet_no, kind as cand_kind, cand_app, cand_name from m where kind is not null"


def flow_counters(spark: SparkSession, d: str) -> DataFrame:
    """Packets and bytes each way of every flow."""
    f = flows.counters(flows.with_flow_key(_packets(spark, d)))
    return f.select("capture", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "packets_out", "packets_in", "bytes_out", "bytes_in", "syn_seen", "syn_ack_seen", "fin_seen", "first_packet_no", "last_packet_no")


_FLOWS = """, o as (
  select *, first_value(src_ip) over w as o_ip, first_value(src_port) over w as o_port, first_value(dst_ip) over w as o_dst, first_value(dst_port) over w as o_dport
  from (select *, least(src_ip, dst_ip) as a_ip, case when is_lo then src_port else dst_port end as lo_p, case when is_lo then dst_port else src_port end as hi_p, greatest(src_ip, dst_ip) as b_ip from q)
  window w as (partition by capture, a_ip, lo_p, b_ip, hi_p, protocol order by packet_no)
)"""
FLOW_COUNTERS = _TUPLES + _FLOWS + """
select capture, o_ip as src_ip, o_port as src_port, o_dst as dst_ip, o_dport as dst_port, protocol, count(*) filter (src_ip = o_ip and src_port = o_port) as packets_out, count(*) filter (not (src_ip = o_ip and src_port = o_port)) as packets_in,
  sum(case when src_ip = o_ip and src_port = o_port then frame_len else 0 end) as bytes_out, sum(case when src_ip = o_ip and src_port = o_port then 0 else frame_len end) as bytes_in,
  bool_or(protocol = 6 and tcp_flags = 2) as syn_seen, bool_or(protocol = 6 and tcp_flags = 18) as syn_ack_seen, bool_or(protocol = 6 and tcp_flags = 17) as fin_seen, min(packet_no) as first_packet_no, max(packet_no) as last_packet_no
from o group by all"""


def engine_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows after the engine's state machine and rules."""
    judged = kept(flows.judged_packets(_packets(spark, d), RULES))
    f = flows.engine_flows(judged, kept(flows.verdicts(judged, RULES)))
    return f.select("capture", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "state", "app", "sni", "action", "packets_out", "packets_in", "dropped", "blocked_events")


# The state machine packet by packet, as a recursive query over the places of packets in their flows.
_FLOW = "capture, lo_ip, lo_port, hi_ip, hi_port, protocol"


def _walk_sql(packets: str, before: str = "") -> str:
    """Walks the flows of `packets` (m, or a table that `before` makes of it)."""
    return _NAMED.replace("with e as", "with recursive e as", 1) + before + f""", j as (
  select *, case when src_ip in ({", ".join(map(str, RULES.ips))}) then 'IP' when dst_port = 9001 then 'PORT' end as own,
    case when cand_app = 'HTTP' then 'APP' when cand_name <> '' and (lower(cand_name) = 'example.net' or lower(cand_name) like '%.example.net' or lower(cand_name) glob 'cdn*.example.com') then 'DOMAIN' end as cr,
    case when protocol = 6 then tcp_flags else 0 end as f, row_number() over (partition by {_FLOW} order by packet_no) as k from {packets}
), w as (
  select distinct {_FLOW}, cast(0 as bigint) as k, 0 as ph, false as syn, false as sa, false as fin, cast(null as varchar) as named, 'Unknown' as app, '' as name, cast(null as varchar) as reason, false as told from j
  union all
  select {_FLOW}, k, case when ph <> 3 and r is not null then 3 else ph end, syn, sa, fin, named, app, name, case when ph = 3 then 'FLOW' else r end, told from (
    select {_FLOW}, k, syn, sa, fin, case when told then 2 else ph end as ph, case when told then cr else named end as named, case when told then cand_app else app end as app,
      case when told then cand_name else name end as name, coalesce(own, case when told then cr else named end) as r, told from (
      select *, cand_app is not null and ph not in (2, 3) as told from (
        select * replace (case when (f & 4) > 0 or (fin and (f & 16) > 0) then 4 when ph = 0 and syn and sa and (f & 16) > 0 then 1 else ph end as ph) from (
          select {", ".join("j." + c for c in _FLOW.split(", "))}, j.k, j.f, j.own, j.cr, j.cand_app, j.cand_name, w.ph, w.named, w.app, w.name,
            w.syn or ((j.f & 2) > 0 and (j.f & 16) = 0) as syn, w.sa or ((j.f & 2) > 0 and (j.f & 16) > 0) as sa, w.fin or (j.f & 1) > 0 as fin
          from w join j on {" and ".join(f"w.{c} = j.{c}" for c in _FLOW.split(", "))} and j.k = w.k + 1))))
)"""  # fmt: skip


_WALK = _walk_sql("m")


def _flows_sql(packets: str) -> str:
    """One row a flow of what _walk_sql has walked."""
    return f""", d as (select {_FLOW}, arg_max(ph, k) as ph, arg_max(app, k) as app, arg_max(name, k) as sni, count(reason) as dropped, count(*) filter (reason <> 'FLOW') as blocked_events from w where k > 0 group by all),
o as (select {_FLOW}, arg_min(is_lo, packet_no) as opened, count(*) filter (is_lo) as n_lo, count(*) filter (not is_lo) as n_hi from {packets} group by all)
select capture, case when opened then lo_ip else hi_ip end as src_ip, case when opened then lo_port else hi_port end as src_port, case when opened then hi_ip else lo_ip end as dst_ip, case when opened then hi_port else lo_port end as dst_port, protocol,
  ['NEW', 'ESTABLISHED', 'CLASSIFIED', 'BLOCKED', 'CLOSED'][ph + 1] as state, app, sni, case when blocked_events > 0 then 'DROP' else 'FORWARD' end as action, case when opened then n_lo else n_hi end as packets_out, case when opened then n_hi else n_lo end as packets_in, dropped, blocked_events
from d join o using ({_FLOW})"""


ENGINE_FLOWS = _WALK + _flows_sql("m")


def inspection_counters(spark: SparkSession, d: str) -> DataFrame:
    """Names taken from packets, and applications told by them."""
    judged = kept(flows.judged_packets(_packets(spark, d), RULES))
    return aggregates.inspection_counters(judged, flows.verdicts(judged, RULES))


INSPECTION_COUNTERS = _WALK + f""" select capture, count(*) as classified, count(*) filter (kind = 'tls') as sni_extractions, count(*) filter ((kind = 'tls' and cand_app not in ('Unknown', 'HTTPS')) or (kind = 'http' and cand_app not in ('Unknown', 'HTTP'))) as classification_hits
from w join j using ({_FLOW}, k) where told group by capture"""


def directed_flows(spark: SparkSession, d: str) -> DataFrame:
    """The `working` policy's flows: application, name and first dropped packet."""
    f = flows.simple_flows(_packets(spark, d), Rules().block_app("DNS").block_domain("example.net"), "working")
    return f.select("capture", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "app", "sni", "packets", "bytes", "block_from")


DIRECTED_FLOWS = _TUPLES + f""", g as (
  select capture, src_ip, src_port, dst_ip, dst_port, protocol, count(*) as packets, sum(frame_len) as bytes, min(packet_no) as first_no,
    min(packet_no) filter (host is not null and protocol = 6 and dst_port in (443, 80)) as named_from, arg_min(host, packet_no) filter (host is not null and protocol = 6 and dst_port in (443, 80)) as sni from q group by all
), a as (select *, case when dst_port = 53 or src_port = 53 then 'DNS' when dst_port = 443 then 'HTTPS' when dst_port = 80 then 'HTTP' else 'Unknown' end as before, {classify_sql('sni')} as told from g)
select capture, src_ip, src_port, dst_ip, dst_port, protocol, case when sni is null then before else told end as app, coalesce(sni, '') as sni, packets, bytes,
  case when before = 'DNS' then first_no when sni is not null and contains(sni, 'example.net') then named_from end as block_from from a"""


def rule_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that blocks each packet by its own address, port, application or name."""
    p = inspect(_packets(spark, d))
    reason = block_reason(F.col("src_ip"), F.col("dst_port"), F.col("cand_app"), F.col("cand_name"), RULES)
    return p.select("capture", reason.alias("reason")).groupBy("capture", "reason").agg(F.count("*").alias("n"))


RULE_REASONS = _NAMED + f"""select capture, case when src_ip in ({", ".join(map(str, RULES.ips))}) then 'IP' when dst_port = 9001 then 'PORT' when cand_app = 'HTTP' then 'APP'
  when cand_name <> '' and (lower(cand_name) = 'example.net' or lower(cand_name) like '%.example.net' or lower(cand_name) glob 'cdn*.example.com') then 'DOMAIN' end as reason, count(*) as n from m group by all"""


def _rule_edits(spark: SparkSession, d: str) -> DataFrame:
    """Events as edits of rules: signups block, errors unblock, one purchase in 97 clears; what they are about follows from the event's number."""
    hosts = captures.page_hosts(_read(spark, d, "pages")).withColumnRenamed("page_id", "_page")
    e = _read(spark, d, "events").withColumn("_page", F.col("event_id") % max(1, _read(spark, d, "pages").count())).join(hosts, "_page", "left")
    n = F.col("event_id") % 7
    kind = F.when(n < 3, "IP").when(n == 3, "PORT").when(n == 4, "APP").when(n == 5, "DOMAIN").otherwise("PATTERN")
    client = F.concat(F.lit("10.0."), (F.floor(F.col("user_id") / 256) % 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    which = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.floor(F.col("event_id") / 7) % len(v)).cast("int") + 1)
    value = F.when(n < 3, client).when(n == 3, which("443", "80", "53", "9001")).when(n == 4, which("HTTP", "DNS", "YouTube")).when(n == 5, F.upper("host")).otherwise(which("*.example.net", "cdn*.example.com", "?eb.*", "*tube*"))
    action = F.when(F.col("event_type") == "signup", "block").when(F.col("event_type") == "error", "unblock").when((F.col("event_type") == "purchase") & (F.col("event_id") % 97 == 0), "clear")
    at = states.event_time(F.unix_timestamp(F.col("ts").cast("timestamp")), F.col("event_id") % 1_000_000, F.lit(False))
    return e.select(at.alias("at"), F.col("event_id").alias("seq"), action.alias("action"), kind.alias("kind"), value.alias("value")).where("action is not null")


def timed_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rule in force that blocks each packet, while rules come and go."""
    p = inspect(_packets(spark, d)).withColumn("event_ts", states.event_time(F.col("ts_sec"), F.col("ts_frac"), F.col("nanos")))
    p = p.select("capture", "packet_no", "event_ts", "src_ip_s", "dst_port", F.col("cand_app").alias("app"), F.coalesce("cand_name", F.lit("")).alias("name"))
    return rule_times.block_reason_as_of(p, _rule_edits(spark, d), F.col("event_ts")).select("capture", "packet_no", "reason")


TIMED_RULES = _NAMED.replace("select 'events-' ||", "select floor(epoch(ts))::bigint * 1000000 + event_id % 1000000 as us, 'events-' ||", 1) + f""", g0 as (
  select floor(epoch(ts))::bigint * 1000000 + event_id % 1000000 as us, event_id % 7 as n, case event_type when 'signup' then 1 when 'error' then -1 when 'purchase' then case when event_id % 97 = 0 then 0 end end as step,
    case when event_id % 7 < 3 then '10.0.' || (user_id // 256 % 256) || '.' || (user_id % 256) when event_id % 7 = 3 then ['443', '80', '53', '9001'][event_id // 7 % 4 + 1] when event_id % 7 = 4 then ['HTTP', 'DNS', 'YouTube'][event_id // 7 % 3 + 1]
      when event_id % 7 = 5 then lower(host) else ['*.example.net', 'cdn*.example.com', '?eb.*', '*tube*'][event_id // 7 % 4 + 1] end as value from events left join h on h.page_id = event_id % (select count(*) from pages)),
g as (select *, case when n < 3 then 'IP' when n = 3 then 'PORT' when n = 4 then 'APP' when n = 5 then 'DOMAIN' else 'PATTERN' end as kind, count(*) filter (step = 0) over (order by us) as epoch from g0 where step is not null),
g1 as (select kind, value, us, epoch, step, sum(step) over w as run from g where step <> 0 window w as (partition by kind, value, epoch order by us)),
v as (select kind, value, us, epoch, case when kind = 'PATTERN' then run - least(0, min(run) over (partition by kind, value, epoch order by us)) > 0 else step = 1 end as blocked from g1),
cl as (select us, epoch from g where step = 0),
pk as (select capture, packet_no, us, {_IP.format("src_ip")} as ip, cast(dst_port as varchar) as port, cand_app as app, case when kind is not null then lower(cand_name) end as name from m),
ask as (select capture, packet_no, us, 0 as r, 'IP' as kind, ip as value from pk union all select capture, packet_no, us, 1, 'PORT', port from pk union all select capture, packet_no, us, 2, 'APP', app from pk where app is not null
  union all select capture, packet_no, us, 3, 'DOMAIN', name from pk where name <> '' union all select capture, packet_no, us, 3, 'PATTERN', p from pk, unnest(['*.example.net', 'cdn*.example.com', '?eb.*', '*tube*']) as u(p) where name <> '' and (name glob p or (p = '*.example.net' and name = 'example.net'))),
ac as (select ask.*, coalesce(cl.epoch, 0) as epoch from ask asof left join cl on ask.us >= cl.us),
f as (select ac.*, v.blocked, v.epoch as since from ac asof left join v on ac.kind = v.kind and ac.value = v.value and ac.us >= v.us),
b as (select capture, packet_no, min(r) as r from f where blocked and since = epoch group by all)
select capture, packet_no, ['IP', 'PORT', 'APP', 'DOMAIN'][r + 1] as reason from pk left join b using (capture, packet_no)"""  # fmt: skip


def pattern_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Names that are parts of pages' hosts, judged by a rule table with a pattern or a name for every page."""
    h = _hosts(spark, d)
    n, host = F.col("page_id") % 4, F.col("host")
    value = (
        F.when(n == 0, F.concat(F.lit("*."), F.expr("substr(host, locate('.', host) + 1)"))).when(n == 1, F.concat(F.substring(host, 1, 6), F.lit("*"), F.expr("right(host, 4)")))
        .when(n == 2, F.concat(F.lit("*"), F.substring(host, 5, 3), F.lit("?"), F.expr("right(host, 9)"))).otherwise(F.concat(F.lit("www."), host))
    )
    table = h.select(F.when(n == 3, "DOMAIN").otherwise("PATTERN").alias("kind"), value.alias("value"))
    names = h.select("page_id", F.lit("10.0.0.1").alias("src_ip_s"), F.lit(9).alias("dst_port"), F.lit("HTTP").alias("app"), F.expr("substr(host, cast(2 + page_id % 3 as int))").alias("name"))
    return block_reason_by_join(names, table).select("page_id", "name", "reason")


PATTERN_REASONS = f"""with {_HOSTS}, r as (select distinct page_id % 4 as n, case page_id % 4 when 0 then '*.' || substr(host, strpos(host, '.') + 1) when 1 then substr(host, 1, 6) || '*' || right(host, 4)
  when 2 then '*' || substr(host, 5, 3) || '?' || right(host, 9) else 'www.' || host end as v from h), x as (select distinct substr(host, cast(2 + page_id % 3 as int)) as name from h),
y as (select name, exists(select 1 from r where case n when 0 then name = substr(v, 3) or ends_with(name, substr(v, 2)) when 3 then name = v else name glob v end) as hit from x)
select page_id, name, case when hit then 'DOMAIN' end as reason from (select page_id, substr(host, cast(2 + page_id % 3 as int)) as name from h) join y using (name)"""


def forbidden_terms(spark: SparkSession, d: str) -> DataFrame:
    """Which of the benchmark's longer words stand in each turn of a conversation, as parts of words too."""
    terms = _read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("value"))
    turns = _read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    found = patterns.term_counts(turns, terms).groupBy("id").agg(F.count("*").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))
    at = F.split("id", ":")
    return found.select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "n_terms", "first_term", "last_term")


FORBIDDEN_TERMS = """with t as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) as term from benchmark)
select conv_id, turn, count(*) as n_terms, min(term) as first_term, max(term) as last_term from conversations, t where contains(lower(text), term) group by all"""


def capture_totals(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.capture_totals(_packets(spark, d))


CAPTURE_TOTALS = _TUPLES + "select capture, count(*) as total_packets, sum(frame_len) as total_bytes, count(*) filter (protocol = 6) as tcp_packets, count(*) filter (protocol = 17) as udp_packets from q group by all"


def limited_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the first thousand packets of each capture."""
    return aggregates.capture_totals(decode.first_packets(_packets(spark, d), 1000))


LIMITED_TOTALS = CAPTURE_TOTALS.replace("from q group", "from q where packet_no < 1000 group")


def _written(spark: SparkSession, d: str) -> str:
    """A new folder of the checkpoint folder that holds the derived captures as files."""
    path = shared_folder(spark, "captures")
    write_captures(_frames(spark, d), path)
    return path


def _capture_of_file() -> Column:
    """The capture that a numbered file belongs to."""
    return F.regexp_replace("capture", r"-\d+\.pcap$", ".pcap").alias("capture")


def written_captures(spark: SparkSession, d: str) -> DataFrame:
    """The derived captures written as files, read back and summed up."""
    p = decode.transport_packets(read_captures(spark, _written(spark, d)))
    return p.groupBy(_capture_of_file()).agg(F.count("*").alias("packets"), F.sum("frame_len").alias("bytes"), F.sum("payload_length").alias("payload_bytes"), F.countDistinct("src_ip").alias("sources"))


#: Bytes of a range in `ranged_captures`: small, so that each file has several.
SMALL_RANGE = 96 << 10


def ranged_captures(spark: SparkSession, d: str) -> DataFrame:
    """The derived captures written as files and read in ranges: packets by their numbers."""
    raw = read_captures(spark, _written(spark, d), SMALL_RANGE)
    block = F.floor(F.col("packet_no") / 500).alias("block")
    by = raw.groupBy(_capture_of_file(), block).agg(F.count("*").alias("packets"), F.sum("incl_len").alias("bytes"), F.min("packet_no").alias("lo"), F.max("packet_no").alias("hi"), F.sum(F.col("packet_no") * F.col("ts_frac")).alias("mark"))
    return by.select("capture", "block", "packets", "bytes", "lo", "hi", "mark")


RANGED_CAPTURES = _TUPLES + """, n as (select capture, frame_len, event_id % 1000000 as ts_frac, row_number() over (partition by capture order by packet_no) - 1 as packet_no from q)
select capture, packet_no // 500 as block, count(*) as packets, sum(frame_len) as bytes, min(packet_no) as lo, max(packet_no) as hi, sum(packet_no * ts_frac) as mark from n group by all"""


WRITTEN_CAPTURES = _TUPLES + "select capture, count(*) as packets, sum(frame_len) as bytes, sum(payload_length) as payload_bytes, count(distinct src_ip) as sources from q group by all"


def top_names(spark: SparkSession, d: str) -> DataFrame:
    """The 20 hosts with the most pages of each language folder; ties to the first page, then the lesser name."""
    p = _read(spark, d, "pages").select(F.regexp_extract("url", "/(de|en|es|fr)/", 1).alias("capture"), F.expr("parse_url(url, 'HOST')").alias("sni"), F.col("page_id").alias("first_packet_no"))
    return aggregates.top_names(p).select("capture", "sni", "n", "first_seen", "rank")


TOP_NAMES = """with p as (select regexp_extract(url, '/(de|en|es|fr)/', 1) as capture, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as sni, page_id from pages),
c as (select capture, sni, count(*) as n, min(page_id) as first_seen from p group by all), r as (select *, row_number() over (partition by capture order by n desc, first_seen, sni) as rank from c) select * from r where rank <= 20"""


def shard_loads(spark: SparkSession, d: str) -> DataFrame:
    """Order lines that two levels of hashing by a five-tuple of keys would give each worker (both levels by the same hash)."""
    t = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src_ip"), F.col("l_partkey").alias("dst_ip"), F.col("l_suppkey").alias("src_port"), F.col("l_linenumber").alias("dst_port"), F.lit(6).alias("protocol"))
    h = five_tuple_hash(*(F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")))
    return t.select(h.alias("h")).groupBy((F.col("h") % 4).cast("int").alias("balancer"), (F.shiftright("h", 2) % 4).cast("int").alias("path")).agg(F.count("*").alias("lines"), F.min("h").alias("least"), F.max("h").alias("largest"))


def _hash_sql() -> str:
    h = "cast(0 as bigint)"
    steps = []
    for k, field in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "6"]):
        prev = f"h{k}" if k else h
        steps.append(f"s{k + 1} as (select *, xor({prev}, cast({field} as bigint) + 2654435769 + ({prev} << 6) + ({prev} >> 2)) as h{k + 1} from {f's{k}' if k else 'lineitem'})")
    return "with " + ", ".join(steps)


SHARD_LOADS = _hash_sql() + " select cast(h5 % 4 as int) as balancer, cast((h5 // 4) % 4 as int) as path, count(*) as lines, min(h5) as least, max(h5) as largest from s5 group by all"


def reported_flows(spark: SparkSession, d: str) -> DataFrame:
    """The 40 flows of each capture that a report shows, numbered, by bytes (nothing is named or blocked here)."""
    f = flows.counters(flows.with_flow_key(_packets(spark, d))).withColumns({"state": F.lit("NEW"), "sni": F.lit("")})
    return report.select_flows(f).select("capture", "flow_id", "dst_port", "src_port", "src_ip", F.col("bytes_out").cast("long").alias("bytes_out"), F.col("bytes_in").cast("long").alias("bytes_in"))


REPORTED_FLOWS = f"""with f as ({FLOW_COUNTERS.replace("with e as", "with e as", 1)}), r as (select *, row_number() over (partition by capture order by bytes_out + bytes_in desc, first_packet_no) as rk from f)
select capture, cast(row_number() over (partition by capture order by dst_port, src_port, src_ip, rk) - 1 as int) as flow_id, dst_port, src_port, src_ip, bytes_out, bytes_in from r where rk <= 40"""


def redacted_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Reported flows with pseudonyms for internal addresses."""
    f = flows.counters(flows.with_flow_key(_packets(spark, d))).withColumns({"state": F.lit("NEW"), "sni": F.lit("")})
    return report.redact(report.select_flows(f)).select("capture", "flow_id", "src_ip_s", "dst_ip_s")


REDACTED_ADDRESSES = f"""with f as ({FLOW_COUNTERS}), r as (select *, row_number() over (partition by capture order by bytes_out + bytes_in desc, first_packet_no) as rk from f),
j as (select capture, cast(row_number() over (partition by capture order by dst_port, src_port, src_ip, rk) - 1 as int) as flow_id, src_ip, dst_ip from r where rk <= 40),
u as (select capture, flow_id * 2 as pos, src_ip as ip from j union all select capture, flow_id * 2 + 1, dst_ip from j), n as (select capture, ip, row_number() over (partition by capture order by first_at) - 1 as k from (select capture, ip, min(pos) as first_at from u group by all) where ip % 256 = 10),
l as (select capture, ip, 'host_' || case when k >= 26 then chr(cast(97 + k // 26 - 1 as int)) else '' end || chr(cast(97 + k % 26 as int)) as label from n)
select j.capture, j.flow_id, coalesce(a.label, {_IP.format('j.src_ip')}) as src_ip_s, coalesce(b.label, {_IP.format('j.dst_ip')}) as dst_ip_s from j left join l a on a.capture = j.capture and a.ip = j.src_ip left join l b on b.capture = j.capture and b.ip = j.dst_ip"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Events as flow records: captures by user, eight at least and one for every 1,250 events."""
    captures_ = max(8, _read(spark, d, "events").count() // 1250)
    e = _read(spark, d, "events").join(_hosts(spark, d).withColumnRenamed("page_id", "_p"), F.col("event_id") % max(1, _read(spark, d, "pages").count()) == F.col("_p"), "left")
    return e.selectExpr(
        f"concat('c', user_id % {captures_}) as capture", "cast(event_id as int) as flow_id", "case when user_id % 5 = 0 then 'UDP' else 'TCP' end as protocol",
        "case when user_id % 5 = 0 then case when event_id % 3 = 0 then 443 else 53 end else case event_id % 4 when 0 then 443 when 1 then 80 when 2 then 8443 else cast(9000 + event_id % 50 as int) end end as dst_port",
        "case when event_id % 7 < 4 then host end as server_name", "case when event_type in ('view', 'error') then 'Unknown' else 'HTTPS' end as application", "case when event_type = 'error' then 'BLOCKED' else 'NEW' end as state",
        "case when event_type = 'error' then 'DROP' else 'FORWARD' end as verdict", "cast(floor(abs(value) * 40) as bigint) as bytes_out", "cast(floor(abs(value) * 7) as bigint) as bytes_in",
        "event_type <> 'view' as syn_seen", "event_type = 'purchase' as syn_ack_seen", "concat('h', user_id % 16) as src_ip",
    )


_RECORDS = f"""with {_HOSTS}, r as (select 'c' || (user_id % (select greatest(8, count(*) // 1250) from events)) as capture, event_id as flow_id, case when user_id % 5 = 0 then 'UDP' else 'TCP' end as protocol,
  case when user_id % 5 = 0 then case when event_id % 3 = 0 then 443 else 53 end else case event_id % 4 when 0 then 443 when 1 then 80 when 2 then 8443 else 9000 + event_id % 50 end end as dst_port,
  case when event_id % 7 < 4 then host end as server_name, case when event_type in ('view', 'error') then 'Unknown' else 'HTTPS' end as application, event_type = 'error' as blocked,
  cast(floor(abs(value) * 40) as bigint) as bytes_out, cast(floor(abs(value) * 7) as bigint) as bytes_in, event_type <> 'view' as syn_seen, event_type = 'purchase' as syn_ack_seen, 'h' || (user_id % 16) as src_ip
  from events left join h on page_id = event_id % (select count(*) from pages))"""


def capture_signals(spark: SparkSession, d: str) -> DataFrame:
    """The signals of each capture with their main figures."""
    s = signals.signals(_records(spark, d))
    first = F.coalesce(*[F.col("evidence")[k] for k in ("unknown_flow_count", "dns_flow_count", "distinct_destination_ports", "half_open_count", "tls_without_sni_count", "http_flow_count", "quic_flow_count", "flagged_flow_count", "blocked_flow_count", "total_flow_count")])
    return s.select("capture", "signal", "severity", F.round("confidence", 4).alias("confidence"), first.cast("long").alias("count"), F.size("flow_ids").cast("long").alias("n_flows"), "position")


def _signal_rows() -> str:
    conf = lambda v, t, c: f"round_even(least(0.95, greatest(0.5, 0.5 + 0.45 * ({v} - {t}) / ({c} - {t}))), 4)"
    rat = lambda n, d: f"case when {d} > 0 then round_even({n} / {d}, 6) else 0.0 end"
    rows = [
        ("unknown_app_share", f"unk >= 3 and {rat('unk', 'n')} >= 0.2", f"case when {rat('unk', 'n')} >= 0.5 then 'MEDIUM' else 'LOW' end", conf(rat("unk", "n"), 0.2, 0.8), "unk", "unk"),
        ("dns_high_volume", f"dns >= 5 and {rat('dns', 'n')} >= 0.15", "'LOW'", conf(rat("dns", "n"), 0.15, 0.6), "dns", "dns"),
        ("dns_high_cardinality", f"dnsn >= 5 and {rat('dnsd', 'dnsn')} >= 0.9", "'MEDIUM'", conf(rat("dnsd", "dnsn"), 0.9, 1.0), "dnsn", "dnsn"),
        ("dns_anomalous_label", "odd > 0", "'MEDIUM'", conf("maxent", 3.5, 4.5), "odd", "odd"),
        ("scan_port_fanout", "fan >= 8", "'MEDIUM'", conf("fan", 8, 32), "fan", "fanflows"),
        ("scan_half_open", f"half >= 3 and {rat('half', 'syn')} >= 0.5", "'MEDIUM'", conf(rat("half", "syn"), 0.5, 1.0), "half", "half"),
        ("tls_without_sni", "bare >= 1", "'LOW'", conf(rat("bare", "tls"), 0.0, 1.0), "bare", "bare"),
        ("plaintext_http", "http >= 1", "'LOW'", "0.9", "http", "http"), ("quic_present", "quic >= 1", "'INFO'", "0.9", "quic", "quic"),
        ("upload_asymmetry", "up > 0", "'MEDIUM'", conf("round_even(upo / greatest(upi, 1), 4)", 3.0, 30.0), "up", "up"),
        ("nonstandard_port_egress", "oddp >= 2", "'LOW'", conf("oddp", 2, 10), "oddp", "oddp"), ("blocked_traffic_present", "blk > 0", "'LOW'", "0.95", "blk", "blk"),
        ("baseline_web_browsing", "n > 0", "'INFO'", f"round_even(least(0.95, greatest(0.1, round_even(({rat('web', 'n')} + {rat('named', 'n')} + {rat('down', 'n')} + {rat('done', 'tcp')}) / 4, 4))), 4)", "n", "0"),
    ]
    return " union all ".join(f"select capture, '{s}' as signal, {sev} as severity, cast({c} as double) as confidence, cast({n} as bigint) as count, cast({f} as bigint) as n_flows from m where {test}" for s, test, sev, c, n, f in rows)


CAPTURE_SIGNALS = _RECORDS + """, ent as (select host, split_part(host, '.', 1) as label from (select distinct host from h)), en as (select host, label, sum(-(c / length(label)) * log2(c / length(label))) as e from (select host, label, ch, count(*) as c from (select host, label, unnest(string_split(label, '')) as ch from ent) group by all) group by all),
x as (select r.*, en.e, en.label, server_name is not null as nm, protocol = 'UDP' and dst_port = 53 as isdns from r left join en on en.host = r.server_name),
fo as (select capture, src_ip, count(distinct dst_port) as ports, count(*) as fl from x group by all), fb as (select capture, max(ports) as fan, arg_min(fl, src_ip) filter (ports = mx) as fanflows from (select *, max(ports) over (partition by capture) as mx from fo) group by capture),
m0 as (select capture, count(*)::double as n, count(*) filter (application = 'Unknown')::double as unk, count(*) filter (isdns)::double as dns, count(*) filter (isdns and nm)::double as dnsn, count(distinct server_name) filter (isdns)::double as dnsd,
 count(*) filter (isdns and nm and (length(label) >= 30 or e >= 3.5)) as odd, max(e) filter (isdns and nm and (length(label) >= 30 or e >= 3.5)) as maxent, count(*) filter (protocol = 'TCP' and syn_seen)::double as syn, count(*) filter (protocol = 'TCP' and syn_seen and not syn_ack_seen)::double as half,
 count(*) filter (protocol = 'TCP' and dst_port = 443)::double as tls, count(*) filter (protocol = 'TCP' and dst_port = 443 and not nm)::double as bare, count(*) filter (protocol = 'TCP' and dst_port = 80) as http, count(*) filter (protocol = 'UDP' and dst_port = 443) as quic,
 count(*) filter (bytes_out >= 4096 and bytes_out >= 3.0 * greatest(bytes_in, 1)) as up, sum(bytes_out) filter (bytes_out >= 4096 and bytes_out >= 3.0 * greatest(bytes_in, 1))::double as upo, sum(bytes_in) filter (bytes_out >= 4096 and bytes_out >= 3.0 * greatest(bytes_in, 1))::double as upi,
 count(*) filter (dst_port not in (20, 21, 22, 25, 53, 67, 68, 80, 110, 123, 143, 161, 389, 443, 445, 465, 587, 636, 853, 993, 995, 1900, 3478, 5353, 8080, 8443) and bytes_out + bytes_in >= 512)::double as oddp, count(*) filter (blocked) as blk,
 count(*) filter (dst_port in (80, 443))::double as web, count(*) filter (nm)::double as named, count(*) filter (bytes_in > bytes_out)::double as down, count(*) filter (protocol = 'TCP')::double as tcp, count(*) filter (protocol = 'TCP' and syn_ack_seen)::double as done from x group by capture),
m as (select m0.*, fb.fan::double as fan, fb.fanflows from m0 left join fb using (capture)), s as (""" + _signal_rows() + """)
select *, row_number() over (partition by capture order by case severity when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end desc, confidence desc, signal) as position from s"""  # fmt: skip


def capture_profile(spark: SparkSession, d: str) -> DataFrame:
    return signals.profile(_records(spark, d)).select("capture", "kind", "value", "n", "position")


CAPTURE_PROFILE = _RECORDS + """, v as (select capture, 'protocol' as kind, protocol as value, 0 as number from r union all select capture, 'verdict', case when blocked then 'DROP' else 'FORWARD' end, 0 from r union all select capture, 'state', case when blocked then 'BLOCKED' else 'NEW' end, 0 from r
 union all select capture, 'port', cast(dst_port as varchar), dst_port from r), c as (select capture, kind, value, number, count(*) as n from v group by all), k as (select *, row_number() over (partition by capture, kind order by n desc, number, value) as position from c)
select capture, kind, value, n, position from k where kind <> 'port' or position <= 10"""  # fmt: skip


def sanitized_names(spark: SparkSession, d: str) -> DataFrame:
    """Part names made into host names."""
    return _read(spark, d, "part").select("p_partkey", sanitize_hostname(F.concat(F.lit(" ."), F.col("p_name"), F.lit("!_"))).alias("name"))


SANITIZED_NAMES = "select p_partkey, regexp_replace(regexp_replace(lower(trim(' .' || p_name || '!_')), '[^a-z0-9.\\-_]', '', 'g'), '^[.\\-_]+|[.\\-_]+$', '', 'g') as name from part"


def label_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the first label of every page's host."""
    label = leftmost_label(F.col("host"))
    return _hosts(spark, d).select("page_id", label.alias("label"), F.round(entropy(label), 6).alias("bits"))


LABEL_ENTROPY = f"""with {_HOSTS}, l as (select page_id, split_part(host, '.', 1) as label from h), c as (select page_id, label, ch, count(*) as c from (select page_id, label, unnest(string_split(label, '')) as ch from l) group by all)
select page_id, label, round(abs(sum((c / length(label)) * log2(c / length(label)))), 6) as bits from c group by all"""


def document_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Content hash and size estimate of every document."""
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", content_hash(F.col("doc_id").cast("string"), F.col("source"), F.col("text")).alias("sha256"), estimate_tokens(F.col("text")).alias("tokens"))


DOCUMENT_HASHES = "select doc_id, sha256(doc_id || chr(10) || source || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g'))) as sha256, cast(ceil(length(text) / 3.5) as bigint) as tokens from documents"


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document in chunks (a sequential cut: no SQL form)."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("section"), "text")
    return chunking.chunks(docs).select("document_id", "chunk_index", "chunk_count", "overlap_chars", "char_count", "chunk_id")


def redacted_messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as one line without what looks like a secret."""
    return _read(spark, d, "conversations").select("conv_id", "turn", redact_secrets(F.concat(F.lit("api_key="), F.col("role"), F.lit("12345 "), F.col("text"))).alias("message"))


REDACTED_MESSAGES = """with t as (select conv_id, turn, trim(regexp_replace('api_key=' || role || '12345 ' || text, '\\s+', ' ', 'g')) as m from conversations),
a as (select conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?i)\\b(?:sk|gsk|xai|pk|api)[-_][A-Za-z0-9_\\-]{6,}', '[redacted]', 'g'), '(?i)\\bbearer\\s+[A-Za-z0-9._\\-]{6,}', '[redacted]', 'g'),
 '(?i)\\b(?:api[-_]?key|authorization|access[-_]?token|secret|password)\\b\\s*[:=]\\s*"?[^\\s"'',}]{4,}', '[redacted]', 'g'), '\\b[A-Za-z0-9_\\-]{40,}\\b', '[redacted]', 'g') as m from t)
select conv_id, turn, case when length(m) > 300 then substr(m, 1, 300) || '...' else m end as message from a"""


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = _read(spark, d, "embeddings")
    index = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("label"), F.col("embedding").alias("vector"))
    return search.search(queries, index, k)


def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The eight entries nearest to every fiftieth vector, itself included."""
    return _hits(spark, d, 8).select(F.col("label").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


_HITS = """with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0), s as (select query_id, e.vec_id, least(1.0, greatest(-1.0, list_cosine_similarity(q.v, e.embedding::double[]))) as similarity from q, embeddings e),
k as (select *, row_number() over (partition by query_id order by similarity desc, cast(vec_id as varchar)) - 1 as rank from s)"""
SIMILAR_VECTORS = _HITS + " select query_id, vec_id, round(similarity, 6) as similarity, rank from k where rank < 8"


def merged_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """All queries' four best, merged by entry, at most two of a label and eight in all for each of ten query groups."""
    hits = _hits(spark, d, 4).withColumn("g", (F.col("label").cast("long") / 50 % 10).cast("int"))
    labels = _read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").alias("document_id"))
    m = search.merge(hits, ["g"]).join(labels, "chunk_id")
    out = search.select_chunks(m, final_k=8, per_document=2, by=["g"])
    return out.select("g", F.col("chunk_id").cast("long").alias("vec_id"), "document_id", F.round("similarity", 6).alias("similarity"), F.size("per_query").cast("long").alias("queries"), "rank")


MERGED_RETRIEVAL = _HITS + """, h as (select *, cast(query_id // 50 % 10 as int) as g from k where rank < 4), m as (select g, vec_id, max(similarity) as similarity, count(*) as queries from h group by all),
l as (select m.*, e.label as document_id from m join embeddings e using (vec_id)), c as (select *, row_number() over (partition by g, document_id order by round_even(similarity, 12) desc, cast(vec_id as varchar)) as dn from l),
r as (select *, row_number() over (partition by g order by round_even(similarity, 12) desc, cast(vec_id as varchar)) - 1 as rank from c where dn <= 2) select g, vec_id, document_id, round(similarity, 6) as similarity, queries, rank from r where rank < 8"""


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Hit, recall, precision and reciprocal rank of the nearest 20; entries with the query's label are relevant."""
    e = _read(spark, d, "embeddings")
    ranking = _hits(spark, d, 20).select(F.col("label").cast("long").alias("query_id"), F.col("chunk_id").cast("long").alias("item"), (F.col("rank") + 1).alias("rank"))
    # A label has a fixed part of all entries, so pairs of queries and relevant entries would grow with the square of the table: a label's entries are counted once.
    labels = e.where("label is not null").select(F.col("vec_id").alias("item"), "label").distinct()
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").distinct()
    size = asked.join(labels.groupBy("label").agg(F.count("*").alias("n")), "label").groupBy("query_id").agg(F.sum("n").alias("relevant"))
    found = ranking.join(asked, "query_id").join(labels.withColumn("_rel", F.lit(True)), ["item", "label"], "left")
    found = found.groupBy("query_id", "item").agg(F.min("rank").alias("rank"), F.max(F.col("_rel").isNotNull()).alias("found"))
    m = evaluation.judged_metrics(found, size, ["query_id"], ks=(5,))
    return m.select("query_id", "hit_5", F.round("recall_5", 8).alias("recall_5"), F.round("precision_5", 8).alias("precision_5"), F.round("reciprocal_rank", 8).alias("reciprocal_rank"))


RETRIEVAL_METRICS = _HITS + """, x as (select k.query_id, k.rank + 1 as rank, a.label = b.label as rel, a.label from k join embeddings a on a.vec_id = k.query_id join embeddings b on b.vec_id = k.vec_id where rank < 20), n as (select label, count(*) as total from embeddings group by label)
select query_id, cast(coalesce(max(case when rel and rank <= 5 then 1 end), 0) as double) as hit_5, round(count(*) filter (rel and rank <= 5) / any_value(total), 8) as recall_5, round(count(*) filter (rel and rank <= 5) / count(*) filter (rank <= 5), 8) as precision_5,
 round(coalesce(1.0 / min(rank) filter (rel), 0.0), 8) as reciprocal_rank from x join n using (label) group by query_id"""


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Which turns of each conversation fit a budget, in order."""
    t = _read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max(F.length("text")).alias("n"))
    ranked = t.select(F.col("conv_id").cast("string").alias("capture"), F.col("turn").cast("int").alias("rank"), F.col("turn").cast("string").alias("chunk_id"), (F.col("n") + 100).alias("size"))
    return context.fit_budget(ranked).select(F.col("capture").cast("long").alias("conv_id"), F.col("chunk_id").cast("long").alias("turn"), "position", "reason")


_BUDGET = f"""with recursive r as (select conv_id, turn, cast(max(length(text)) + 100 as bigint) as size, row_number() over (partition by conv_id order by turn) as k from conversations group by conv_id, turn),
w as (
  select distinct conv_id, cast(0 as bigint) as k, cast(0 as bigint) as n, cast(0 as bigint) as used, cast(null as bigint) as turn, cast(null as varchar) as reason, cast(null as int) as position from r
  union all
  select conv_id, k, case when reason is null then n + 1 else n end, case when reason is null then total else used end, turn, reason, case when reason is null then cast(n as int) end from (
    select *, case when n >= {context.MAX_ITEMS} then 'max_items' when total > {context.MAX_CHARS} then 'max_chars' when ceil(total / 3.5) > {context.MAX_TOKENS} then 'max_tokens' end as reason from (
      select w.conv_id, r.k, w.n, w.used, r.turn, w.used + r.size + length(cast(w.n + 1 as varchar)) + case when w.n > 0 then 2 else 0 end as total from w join r on r.conv_id = w.conv_id and r.k = w.k + 1))
)"""
CONTEXT_BUDGET = _BUDGET + " select conv_id, turn, position, reason from w where k > 0"


def context_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the budget's walk once a place in every seventh conversation is moved and every eleventh loses its reasons."""
    walked = context_budget(spark, d).withColumns({"position": F.when(F.col("conv_id") % 7 == 3, F.col("position") + 1).otherwise(F.col("position")), "reason": F.when(F.col("conv_id") % 11 != 5, F.col("reason"))})
    return checks.context_problems(walked.withColumn("chunk_id", F.col("turn")), max_items=context.MAX_ITEMS, by="conv_id")


CONTEXT_CHECKS = _BUDGET + f""", v as (select conv_id, case when conv_id % 7 = 3 then position + 1 else position end as position, case when conv_id % 11 <> 5 then reason end as reason, position as was from w where k > 0),
c as (select count(*) filter ((position is null) <> (reason is not null)) as a, count(*) filter (position <> was) as b, count(*) filter (position >= {context.MAX_ITEMS}) as e from v)
select * from (select 'taken or left out' as problem, a as n from c union all select 'places', b from c union all select 'too many', e from c) where n > 0"""


def record_checks(spark: SparkSession, d: str) -> DataFrame:
    """Event records with planted faults: ports out of range, control characters, negative bytes, and numbers with gaps."""
    r = _records(spark, d).withColumns({
        "src_port": F.lit(5), "dst_port": F.when(F.col("flow_id") % 97 == 5, F.col("dst_port") + 100_000).otherwise(F.col("dst_port")),
        "server_name": F.when(F.col("flow_id") % 101 == 7, F.concat(F.coalesce("server_name", F.lit("x")), F.lit("\n"))).otherwise(F.col("server_name")), "bytes_in": F.when(F.col("flow_id") % 89 == 2, F.lit(-1)).otherwise(F.col("bytes_in")),
    })
    return checks.record_problems(r)


RECORD_CHECKS = """with c as (select count(*) filter (event_id % 97 = 5) as a, count(*) filter (event_id % 89 = 2) as b, count(*) filter (event_id % 101 = 7) as e,
 (select count(*) from (select count(*) as n, min(event_id) as lo, max(event_id) as hi from events group by user_id % (select greatest(8, count(*) // 1250) from events)) where lo <> 0 or hi <> n - 1) as f from events)
select * from (select 'destination port' as problem, a as n from c union all select 'negative bytes', b from c union all select 'control character', e from c union all select 'numbering', f from c) where n > 0"""


def chunk_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the documents' chunks once every fiftieth document's count is off and every fortieth section unknown."""
    sections = _read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("section"), "text")
    made = chunking.chunks(sections).withColumn("chunk_count", F.when(F.col("document_id") % 50 == 3, F.col("chunk_count") + 1).otherwise(F.col("chunk_count")))
    found = checks.chunk_problems(made, sections.where("document_id % 40 <> 1"))
    return found.groupBy("problem").agg(F.sum(F.when(F.col("problem") == "unknown section", 1).otherwise(F.col("n"))).alias("n"))  # how many chunks a document has, SQL can't tell


CHUNK_CHECKS = """select * from (select 'places' as problem, count(*) as n from documents where doc_id % 50 = 3 union all select 'unknown section', least(1, count(*)) from documents where doc_id % 40 = 1
union all select 'empty text', count(*) from documents where doc_id % 50 = 3 and trim(regexp_replace(text, '\\s+', ' ', 'g')) = '') where n > 0"""


def ranking_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the merged ranking without a cap, held against a cap of one, once a score is raised in every third group."""
    hits = _hits(spark, d, 4).withColumn("g", (F.col("label").cast("long") / 50 % 10).cast("int"))
    labels = _read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").alias("document_id"))
    out = search.select_chunks(search.merge(hits, ["g"]).join(labels, "chunk_id"), final_k=8, per_document=None, by=["g"])
    raised = out.withColumn("similarity", F.when(F.col("g") % 3 == 1, F.col("similarity") + 3).otherwise(F.col("similarity")))
    return checks.ranking_problems(raised, ["g"], per_document=1)


RANKING_CHECKS = _HITS + """, h as (select *, cast(query_id // 50 % 10 as int) as g from k where rank < 4), m as (select g, vec_id, max(similarity) as similarity from h group by all),
r as (select g, e.label, row_number() over (partition by g order by round_even(similarity, 12) desc, cast(m.vec_id as varchar)) as rank from m join embeddings e using (vec_id)), t as (select *, count(*) over (partition by g, label) as same from r where rank <= 8),
c as (select count(*) filter (g % 3 = 1) as a, count(*) filter (same > 1) as b from t)
select * from (select 'similarity' as problem, a as n from c union all select 'best of its queries', a from c union all select 'cap', b from c) where n > 0"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as a store takes them."""
    e = _read(spark, d, "embeddings").where(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    return e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), F.lit("given").alias("model_name"), "vec_id", F.col("label").alias("document_id"))


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings kept in a lasting store in three batches, the second after a refused one, then compacted, opened again and asked for the ids that events cite."""
    folder, rows = shared_folder(spark, "store"), _entries(spark, d)
    store = VectorStore.create(spark, folder)
    for k in range(3):
        some = rows.where(F.pmod("vec_id", F.lit(3)) == k)
        if k == 1:
            with suppress(Refused):
                store.add(some.unionByName(rows.where(F.pmod("vec_id", F.lit(3)) == 0)))  # ids that the store has: none of these rows comes in
        store.add(some)
    store.compact()
    cited = _read(spark, d, "events").select(F.col("user_id").cast("string").alias("chunk_id"))
    found = VectorStore(spark, folder).lookup(cited)
    return found.select("vec_id", "batch", "document_id", F.size("vector").cast("long").alias("length"), F.floor(F.col("vector")[0] * 1e6).alias("first_e6"), F.floor(F.element_at("vector", -1) * 1e6).alias("last_e6"))


STORED_VECTORS = """select vec_id, cast(1 + vec_id % 3 as bigint) as batch, label as document_id, cast(len(embedding) as bigint) as length, cast(floor(cast(embedding[1] as double) * 1e6) as bigint) as first_e6, cast(floor(cast(embedding[-1] as double) * 1e6) as bigint) as last_e6
from embeddings where vec_id in (select user_id from events)"""


def stored_problems(spark: SparkSession, d: str) -> DataFrame:
    """Why a store with every fourth embedding refuses a batch of the rest that has planted faults of each kind."""
    rows = _entries(spark, d)
    id_, vector = F.col("vec_id"), F.col("vector").cast("array<double>")
    zero, short, holes = id_ % 7 == 3, id_ % 11 == 1, id_ % 17 == 5
    bad = rows.where("vec_id % 4 <> 0 or vec_id % 5 = 0").withColumns({
        "vector": F.when(holes, F.transform(vector, lambda x: x * F.lit(float("nan")))).when(short, F.slice(vector, 1, 2)).when(zero, F.transform(vector, lambda x: x * 0.0)).otherwise(vector),
        "model_name": F.when(id_ % 13 == 2, "other").otherwise(F.col("model_name")), "chunk_id": F.when(id_ % 19 != 4, F.col("chunk_id")),
    })
    known = rows.where("vec_id % 4 = 0")
    one = known.select(F.size("vector")).first()
    return batch_problems(bad.union(bad.where("vec_id % 23 = 6")), known, one and one[0], "given")


STORED_PROBLEMS = """with b as (select * from embeddings where vec_id % 4 <> 0 or vec_id % 5 = 0), c as (select * from b union all select * from b where vec_id % 23 = 6)
select * from (select 'null id' as problem, count(*) as n from c where vec_id % 19 = 4 union all select 'not finite', count(*) from c where vec_id % 17 = 5 union all select 'another length', count(*) from c where vec_id % 11 = 1 and vec_id % 17 <> 5
 union all select 'zero vector', count(*) from c where vec_id % 7 = 3 and vec_id % 11 <> 1 and vec_id % 17 <> 5 union all select 'another model', count(*) from c where vec_id % 13 = 2
 union all select 'repeated id', count(*) from b where vec_id % 23 = 6 and vec_id % 19 <> 4 union all select 'known id', count(*) from b where vec_id % 4 = 0 and vec_id % 19 <> 4) where n > 0"""


#: What an event's properties may hold.
PROPERTIES = {
    "type": "object", "required": ["k"], "additionalProperties": False,
    "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 90}, "tags": {"type": "array", "maxItems": 3, "items": {"type": "string", "maxLength": 4}}, "who": {"type": "object", "required": ["user"], "properties": {"user": {"type": "integer", "minimum": 3}, "role": {"enum": ["view", "click"]}}}},
}


def property_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with events' properties by their schema, once every eleventh event in each of five ways is changed."""
    def case(k: int) -> Column:
        return F.pmod("event_id", F.lit(11)) == k

    k = F.get_json_object("props", "$.k")
    who = F.to_json(F.struct(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("role")).alias("who")))
    changed = (
        F.when(case(1), F.regexp_replace("props", r"\}$", ', "x": 1}')).when(case(2), F.concat(F.lit('{"k": "'), k, F.lit('"}'))).when(case(3), who).when(case(4), F.regexp_replace("props", r"\}$", ', "tags": ["ab", 5, "abcde", null]}'))
        .when(case(5), F.rtrim(F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    )
    return schemas.row_problems(_read(spark, d, "events").withColumn("_props", changed), "_props", PROPERTIES, ["event_id"])


PROPERTY_PROBLEMS = """with e as (select *, event_id % 11 as c, cast(json_extract_string(props, '$.k') as bigint) as k from events where props is not null)
select event_id, '$' as path, 'not JSON' as problem from events where props is null or event_id % 11 = 5 union all select event_id, '$.k', 'maximum' from e where k > 90 and c not in (2, 3, 5) union all select event_id, '$.x', 'not allowed' from e where c = 1
union all select event_id, '$.k', 'type' from e where c = 2 union all select event_id, '$.k', 'required' from e where c = 3 union all select event_id, '$.who.user', 'minimum' from e where c = 3 and user_id < 3 union all select event_id, '$.who.role', 'enum' from e where c = 3 and event_type not in ('view', 'click')
union all select event_id, p, q from e, (values ('$.tags', 'maxItems'), ('$.tags[1]', 'type'), ('$.tags[2]', 'maxLength'), ('$.tags[3]', 'type')) as t(p, q) where c = 4"""


def candidate_settings(spark: SparkSession, d: str) -> DataFrame:
    """Eleven settings of retrieval and budget over cases of four queries each: what they recall, what they cost, and which may replace the baseline."""
    case = F.floor(F.col("vec_id") / 200).alias("case")
    e = _read(spark, d, "embeddings").select("vec_id", case, F.col("label").alias("document_id"))
    size = (F.col("vec_id") * 37 % 1100 + 100).alias("size")
    hits = _hits(spark, d, 6).withColumn("case", F.floor(F.col("label").cast("long") / 200)).join(e.select(F.col("vec_id").cast("string").alias("chunk_id"), "document_id", size), "chunk_id")
    labels = e.groupBy("case", "document_id").agg((F.max((F.col("vec_id") % 50 == 0).cast("int")) == 1).alias("relevant"))
    judged = evaluation.candidate_cases(hits, labels, evaluation.CANDIDATES, "case")
    prompts = judged.withColumns({"prompt_tokens": F.ceil(F.col("supplied_chars") / 3.5) + 1000, "capture_tokens": F.lit(1000), "alongside_tokens": F.lit(500)})
    found = evaluation.admissible(evaluation.candidates(kept(evaluation.accounts(prompts))), "baseline")
    return found.select("candidate", F.bround("recall", 8).alias("recall"), F.bround("precision", 8).alias("precision"), F.col("irrelevant").cast("long").alias("irrelevant"), F.col("largest").cast("long").alias("largest"), "ok", "place")


def _sql_value(x: object) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_GRID = ", ".join("(" + ", ".join(_sql_value(v) for v in s.values()) + ")" for s in evaluation.CANDIDATES)
CANDIDATE_SETTINGS = _HITS.replace("with ", "with recursive ", 1) + f""", st as (select * from (values {_GRID}) as t(s, pq, fk, pd, least, mi, mc, mt)),
m as (select st.*, query_id // 200 as c, vec_id, max(similarity) as sim from k join st on k.rank < pq group by all), l as (select m.*, label, vec_id * 37 % 1100 + 100 as size from m join embeddings using (vec_id) where least is null or sim >= least),
d as (select *, row_number() over (partition by s, c, label order by round_even(sim, 12) desc, cast(vec_id as varchar)) as dn from l),
r as (select *, row_number() over (partition by s, c order by round_even(sim, 12) desc, cast(vec_id as varchar)) as i from d where pd is null or dn <= pd qualify i <= fk),
w as (
  select distinct s, c, cast(0 as bigint) as i, cast(0 as bigint) as n, cast(0 as bigint) as used, cast(0 as bigint) as size, cast(null as int) as label, false as took from r
  union all
  select s, c, i, case when fits then n + 1 else n end, case when fits then total else used end, size, label, fits from (
    select *, n < mi and total <= mc and (mt is null or ceil(total / 3.5) <= mt) as fits from (
      select w.s, w.c, r.i, w.n, w.used, r.size, r.label, mi, mc, mt, w.used + r.size + length(cast(w.n + 1 as varchar)) + case when w.n > 0 then 2 else 0 end as total from w join r on r.s = w.s and r.c = w.c and r.i = w.i + 1))
),
lab as (select vec_id // 200 as c, label, bool_or(vec_id % 50 = 0) as rel from embeddings group by all), sup as (select s, c, label, sum(size) as chars from w where took group by all),
x as (select st.s, lab.c, count(*) filter (rel) as nrel, count(sup.label) filter (rel) as hit, count(sup.label) filter (not rel) as irr from st cross join lab left join sup on sup.s = st.s and sup.c = lab.c and sup.label = lab.label group by all),
y as (select s, c, count(*) as nsup, sum(chars) as chars from sup group by all),
t as (select s, avg(hit / nrel) filter (nrel > 0) as recall, avg(hit / nsup) as precision, sum(irr) as irrelevant, max(ceil(coalesce(chars, 0) / 3.5) + 1500) as largest from x left join y using (s, c) group by s), b as (select * from t where s = 'baseline'),
o as (select t.*, coalesce(t.recall + 1e-9 >= b.recall and t.irrelevant <= b.irrelevant and (t.largest < {evaluation.FAILING_TOKENS} or b.largest >= {evaluation.FAILING_TOKENS}) and t.s <> 'unbounded', false) as ok from t left join b on true where t.s <> 'baseline')
select s as candidate, round_even(recall, 8) as recall, round_even(precision, 8) as precision, cast(irrelevant as bigint) as irrelevant, cast(largest as bigint) as largest, ok,
 case when ok then row_number() over (partition by ok order by round_even(1000.0 * recall / largest, 9) desc, round_even(precision, 9) desc nulls last, largest, s desc) end as place from o"""


def exported_hits(spark: SparkSession, d: str) -> DataFrame:
    """The nearest entries as JSON lines with ordered keys; scores stay out."""
    hits = _hits(spark, d, 3).withColumn("source", F.create_map(F.lit("z"), F.lit("index"), F.lit("a"), F.col("chunk_id")))
    return export.json_lines(hits, ["label", "rank"], drop=("similarity",)).select(F.col("label").cast("long").alias("query_id"), "rank", "json")


EXPORTED_HITS = _HITS + """ select query_id, rank, '{"chunk_id":"' || vec_id || '","label":"' || query_id || '","rank":' || rank || ',"source":{"a":"' || vec_id || '","z":"index"}}' as json from k where rank < 3"""


def unknown_references(spark: SparkSession, d: str) -> DataFrame:
    """Keys cited by events that no document supplies as its id."""
    cited = _read(spark, d, "events").select((F.col("user_id") * 7).alias("doc_id")).distinct()
    return context.unknown_references(cited, _read(spark, d, "documents").select("doc_id"), ["doc_id"])


UNKNOWN_REFERENCES = "select distinct user_id * 7 as doc_id from events where user_id * 7 not in (select doc_id from documents)"


#: Idle seconds and lateness of the streamed flows (the events of a pair of users and keys are days apart), and slices of time that come one after another.
STREAM_IDLE, STREAM_LATE, STREAM_SLICES = 10 * 86_400, "1 hour", 3
_STREAMED = ["capture", "lo_ip", "lo_port", "hi_ip", "hi_port", "protocol", "started", "ended", "state", "app", "sni", "packets_out", "packets_in", "dropped", "blocked_events"]


def _timed(spark: SparkSession, d: str) -> DataFrame:
    p = _packets(spark, d)
    return states.timed_packets(p.withColumn("event_ts", states.event_time(F.col("ts_sec"), F.col("ts_frac"), F.col("nanos"))), RULES)


def _ended(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.unix_micros(c) for c in ("started", "ended")}).select(*_STREAMED)


def idle_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows after the state machine and rules, each over when it was idle."""
    return _ended(states.ended_flows(kept(_timed(spark, d)), RULES, STREAM_IDLE))


def streamed_flows(spark: SparkSession, d: str) -> DataFrame:
    """The same of a stream that gets its packets in slices and is stopped and started between them; flows that end a day before the watermark can be told."""
    folder = shared_folder(spark, "stream")
    timed = kept(_timed(spark, d))
    low, high = timed.agg(F.min(F.unix_micros("event_ts")), F.max(F.unix_micros("event_ts"))).first()
    if low is None:
        return _ended(states.ended_flows(timed, RULES, STREAM_IDLE))
    width = (high - low) // STREAM_SLICES + 1
    for k in range(STREAM_SLICES):
        timed.where(F.floor((F.unix_micros("event_ts") - low) / width) == k).write.mode("append").parquet(f"{folder}/packets")
        found = states.run_stream(spark, f"{folder}/packets", timed.schema, RULES, folder, files=1_000_000, late=STREAM_LATE, idle=STREAM_IDLE)
    return _ended(found).where(F.col("ended") < high - (STREAM_IDLE + 86_400) * 1_000_000)


# Every flow and episode is a flow of its own: the number goes into the first part of the key.
_EPISODES = f""", y as (select *, (cast(floor(epoch(ts)) as bigint) * 1000000 + event_id % 1000000) as us from m),
z as (select *, us // 1000000 as s, lag(us) over (partition by {_FLOW} order by packet_no) as before from y),
ep as (select * replace (lpad(cast(sum(case when floor((us - before) / 1000000) > {STREAM_IDLE} then 1 else 0 end) over (partition by {_FLOW} order by packet_no) as varchar), 12, '0') || '/' || capture as capture) from z)"""
IDLE_FLOWS = _walk_sql("ep", _EPISODES) + f""", d as (select {_FLOW}, arg_max(ph, k) as ph, arg_max(app, k) as app, arg_max(name, k) as sni, count(reason) as dropped, count(*) filter (reason <> 'FLOW') as blocked_events from w where k > 0 group by all),
o as (select {_FLOW}, arg_min(is_lo, packet_no) as opened, count(*) filter (is_lo) as n_lo, count(*) filter (not is_lo) as n_hi, arg_min(us, packet_no) as started, arg_max(us, packet_no) as ended from ep group by all)
select substr(capture, 14) as capture, lo_ip, lo_port, hi_ip, hi_port, protocol, started, ended, ['NEW', 'ESTABLISHED', 'CLASSIFIED', 'BLOCKED', 'CLOSED'][ph + 1] as state, app, sni,
  case when opened then n_lo else n_hi end as packets_out, case when opened then n_hi else n_lo end as packets_in, dropped, blocked_events from d join o using ({_FLOW})"""  # fmt: skip
STREAMED_FLOWS = f"select * from ({IDLE_FLOWS}) where ended < (select max(cast(floor(epoch(ts)) as bigint) * 1000000 + event_id % 1000000) from events) - {(STREAM_IDLE + 86_400) * 1_000_000}"


def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions of events without a gap of five minutes."""
    e = _read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("event_ts"), F.lit(1).alias("frame_len"))
    s = flow_sessions(e, ["user_id"])
    return s.select("user_id", F.unix_timestamp("session_start").alias("start_s"), F.unix_timestamp("session_end").alias("end_s"), "packets")


IDLE_SESSIONS = """with a as (select user_id, ts, case when lag(ts) over w is null or epoch(ts) - epoch(lag(ts) over w) >= 300 then 1 else 0 end as new from events window w as (partition by user_id order by ts)),
b as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from a) select user_id, cast(floor(epoch(min(ts))) as bigint) as start_s, cast(floor(epoch(max(ts)) + 300) as bigint) as end_s, count(*) as packets from b group by user_id, s"""

_QUERIES = [
    host_applications, capture_applications, capture_reports, decoded_packets, payload_names, flow_counters, engine_flows, inspection_counters, directed_flows, rule_reasons, timed_rules, pattern_reasons, forbidden_terms, limited_totals, capture_totals, written_captures, ranged_captures, top_names, shard_loads,
    reported_flows, redacted_addresses, capture_signals, capture_profile, sanitized_names, label_entropy, document_hashes, document_chunks, redacted_messages, similar_vectors, merged_retrieval,
    retrieval_metrics, context_budget, context_checks, record_checks, chunk_checks, ranking_checks, stored_vectors, stored_problems, property_problems, candidate_settings, exported_hits, unknown_references, idle_sessions, idle_flows, streamed_flows,
]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {q.__name__: globals()[q.__name__.upper()] for q in _QUERIES if q.__name__.upper() in globals()}
