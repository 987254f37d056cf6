"""The engine's queries over the capture views, and what they are in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import views
from framelake.dissect import app, hpack, options, someip, wire
from framelake.functions import signals
from framelake.functions import text as T
from framelake.functions import wire as W
from framelake.operators import boundaries, merge, presence, projection, reassembly, series
from framelake.plans.compiler import Layout, apply_filter
from framelake.sinks import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: What a packet's timestamp is in SQL.
TS = "(epoch_us(ts) * 1000)"
LINES = "(select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) - 1 as occ, * from lineitem)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def event_filter(name: str, text: str, where: str, short_circuit: bool = False) -> None:
    """Matches over C1, shown by id, time and first values."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lay = views.events_layout()
        return apply_filter(views.events(spark, sf_dir), text, lay, short_circuit).select("packet_id", "timestamp_ns", projection.first(lay, "event.type").alias("type"), projection.first(lay, "event.value").alias("value"))

    query(name, f"select event_id as packet_id, {TS} as timestamp_ns, event_type as type, value from events where {where}")(run)


K = "try_cast(props->>'$.k' as bigint)"
for _name, _text, _where in [
    ("flt_empty", "", "true"),
    ("flt_presence_protocol", "click", "event_type = 'click'"),
    ("flt_presence_field", "event.props.k", f"{K} is not null"),
    ("flt_absence_protocol", "!error", "event_type <> 'error'"),
    ("flt_compare_eq", "event.user_id == 7", "user_id = 7"),
    ("flt_compare_ne", "event.user_id != 7", "user_id <> 7"),
    ("flt_compare_lt", "event.value < 20.25", "value < 20.25"),
    ("flt_compare_le", "event.user_id <= 0x0A", "user_id <= 10"),
    ("flt_compare_gt", "event.value > 100", "value > 100"),
    ("flt_compare_ge", "event.value >= 100.5", "value >= 100.5"),
    ("flt_set", "event.user_id in {1, 3, 0b101}", "user_id in (1, 3, 5)"),
    ("flt_range", "event.value in 50..100", "value between 50 and 100"),
    ("flt_contains_event", 'event.props contains "7"', "contains(props, '7')"),
    ("flt_and_or", 'event.type == "click" && event.value > 100 || event.type == "error" and event.value < 10', "(event_type = 'click' and value > 100) or (event_type = 'error' and value < 10)"),
    ("flt_nested_bool", '!(event.type == "click" || (event.value > 50 && !(event.user_id < 20)))', "not (event_type = 'click' or (value > 50 and not (user_id < 20)))"),
    ("flt_type_mix_const", "event.type != 5 && !(event.type == 5)", "event_type is not null"),
    ("flt_type_mix_order", "event.type > 5 && !(event.type < 5)", "event_type is not null"),
    ("flt_negative", "event.value > -1 && event.props.k >= -5", f"value > -1 and coalesce({K} >= -5, false)"),
    ("flt_big_literal", "event.user_id < 18446744073709551615", "user_id is not null"),
    ("flt_alias_number", "event.number == 7", f"user_id = 7 or coalesce({K} = 7, false)"),
    ("flt_alias_ne", "event.number != 7", f"user_id <> 7 or coalesce({K} <> 7, false)"),
    ("flt_constants", "true && !false && event.value > 200", "value > 200"),
]:
    event_filter(_name, _text, _where)


def order_filter(name: str, text: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_filter(views.orders(spark, sf_dir), text, views.orders_layout()).select("packet_id", F.size(F.col("`line.qty`")).cast("bigint").alias("lines"))

    query(name, f"with l as {LINES}, n as (select k, count(*) as c from l group by k) select o_orderkey as packet_id, coalesce(c, 0)::bigint as lines from orders left join n on k = o_orderkey where {where}")(run)


def some(condition: str) -> str:
    return f"exists (select 1 from l where l.k = o_orderkey and {condition})"


for _name, _text, _where in [
    ("flt_any_occurrence_eq", "line.qty == 10", some("l_quantity = 10")),
    ("flt_any_occurrence_ne", 'line.flag != "R"', some("l_returnflag <> 'R'")),
    ("flt_not_eq", '!(line.flag == "R")', "not " + some("l_returnflag = 'R'")),
    ("flt_field_absent", "!line.qty", "not " + some("true")),
    ("flt_bool_number", "line.returned == 1", some("l_returnflag = 'R'")),
    ("flt_alias_any", "any.price > 100000", f"(o_totalprice > 100000 or {some('l_extendedprice > 100000')})"),
    ("flt_len_number", 'len(line.qty) == 8 && len(order.status) == 1', some("true") + " and octet_length(o_orderstatus::blob) = 1"),
    ("scope_exists", '$line { line.qty > 40 && line.flag == "R" }', some("l_quantity > 40 and l_returnflag = 'R'")),
    ("scope_unscoped", 'line.qty > 40 && line.flag == "R"', some("l_quantity > 40") + " and " + some("l_returnflag = 'R'")),
    ("scope_index", "$line[1] { line.qty > 25 }", some("occ = 1 and l_quantity > 25")),
    ("scope_missing_index", "$line[9] { true }", some("occ = 9")),
    ("scope_nested", "$order { $line[0] { line.qty >= 20 } && order.price > 1000 }", some("occ = 0 and l_quantity >= 20") + " and o_totalprice > 1000"),
    ("scope_leaf", "$line.qty { line.qty == 7 }", some("l_quantity = 7")),
    ("scope_not", '!$line { line.flag == "R" } && order.status == "F"', "not " + some("l_returnflag = 'R'") + " and o_orderstatus = 'F'"),
    ("scope_presence", "$order { line }", some("true")),
]:
    order_filter(_name, _text, _where)


def text_filter(name: str, view, layout, text: str, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: apply_filter(view(spark, sf_dir), text, layout()).select("packet_id"))


text_filter("flt_contains", views.documents, views.documents_layout, 'doc.text contains "the"', "select doc_id as packet_id from documents where contains(text, 'the')")
text_filter("flt_len", views.documents, views.documents_layout, "len(doc.text) > 500", "select doc_id as packet_id from documents where strlen(text) > 500")
text_filter("flt_matches", views.pages, views.pages_layout, 'http.host matches "^(www|blog)[.]|[0-9]+"', r"select page_id as packet_id from pages where regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^(www|blog)[.]|[0-9]+')")
text_filter("flt_matches_case", views.documents, views.documents_layout, 'doc.text matches "(?i)^the[a-z]* "', "select doc_id as packet_id from documents where regexp_matches(text, '(?i)^the[a-z]* ')")

# flank

_SEEN = "select event_id as p, epoch_us(ts) * 1000 as t, user_id as u, value as v, event_type as e from events"


def flank_query(name: str, text: str, condition: str, gate: str = "true", extra: str = "true") -> None:
    """Pairwise modes: lag over the visible samples."""
    sql = f"""with s as ({_SEEN}), w as (select *, lag(p) over (order by p) as pp, lag(t) over (order by p) as pt, lag(u) over (order by p) as pu, lag(v) over (order by p) as pv from s where {gate})
        select p as packet_id from w where pp is not null and {condition} and {extra}"""
    query(name, sql)(lambda spark, sf_dir: apply_filter(views.events(spark, sf_dir), text, views.events_layout()).select("packet_id"))


flank_query("flank_changed", "flank(event.user_id, changed, within: 5packets)", "u <> pu and p - pp <= 5")
flank_query("flank_arrival", "flank(event.value, to: >= 100, within: 5packets)", "v >= 100 and not pv >= 100 and p - pp <= 5")
flank_query("flank_departure", "flank(event.value, from: < 20, within: 3packets)", "pv < 20 and not v < 20 and p - pp <= 3")
flank_query("flank_by", "flank(event.user_id, by: >= 3, within: 2packets)", "u - pu >= 3 and p - pp <= 2")
flank_query("flank_time_window", "flank(event.user_id, changed, within: 90s)", "u <> pu and t - pt between 0 and 90000000000")
flank_query("flank_when", "flank(event.user_id, by: > 0, within: 20packets, when: click)", "u - pu > 0 and p - pp <= 20", "e = 'click'")
flank_query("flank_gated_observer", "click && flank(event.user_id, changed, within: 4packets)", "u <> pu and p - pp <= 4", extra="e = 'click'")
query("flank_gated_short_circuit", f"""with s as ({_SEEN}), w as (select *, lag(p) over (order by p) as pp, lag(u) over (order by p) as pu from s where e = 'click')
    select p as packet_id from w where u <> pu and p - pp <= 4""")(lambda spark, sf_dir: apply_filter(views.events(spark, sf_dir), "click && flank(event.user_id, changed, within: 4packets)", views.events_layout(), short_circuit=True).select("packet_id"))


def armed_sql(sample: str, from_: str, fire: str, at: str, most: int) -> str:
    """The latch of two slots as a recursive query. Columns of a step: the slots' packet, time and value before the sample.

    Times rise with packets in this table, so that the two oldest are the two first offered.
    """
    old = "{r}." + f"{at} is not null and s.{at} - " + "{r}." + f"{at} > {most}"
    by_packets = at == "p"
    return f"""with recursive s as (select row_number() over (order by event_id) as n, event_id as p, epoch_us(ts) * 1000 as t, {sample} as x from events where {sample} is not null),
    st(n, ap, at_, ax, np, nt, nx, fired, p) as (
      select 0::bigint, null::bigint, null::bigint, null::{'bigint' if sample == 'user_id' else 'double'}, null::bigint, null::bigint, null::{'bigint' if sample == 'user_id' else 'double'}, false, null::bigint
      union all
      select q.n, case when q.f then null when q.offer1 then q.p else q.ap end, case when q.f then null when q.offer1 then q.t else q.at_ end, case when q.f then null when q.offer1 then q.x else q.ax end,
             case when q.f then null when q.offer2 then q.p else q.np end, case when q.f then null when q.offer2 then q.t else q.nt end, case when q.f then null when q.offer2 then q.x else q.nx end, q.f, q.p
      from (select *, (not f and {from_} and ap is null) as offer1, (not f and {from_} and ap is not null and np is null{' and not promoted' if by_packets else ''}) as offer2
            from (select *, coalesce(ap is not null and {fire}, false) as f
                  from (select n, p, t, x, case when aold then nk.np else oap end as ap, case when aold then nk.nt else oat end as at_, case when aold then nk.nx else oax end as ax,
                               case when aold then null else nk.np end as np, case when aold then null else nk.nt end as nt, case when aold then null else nk.nx end as nx, aold and nk.np is not null as promoted
                        from (select s.n, s.p, s.t, s.x, st.ap as oap, st.at_ as oat, st.ax as oax,
                                     case when st.{'np' if by_packets else 'nt'} is not null and s.{at} - st.{'np' if by_packets else 'nt'} > {most} then null else st.np end as np,
                                     case when st.{'np' if by_packets else 'nt'} is not null and s.{at} - st.{'np' if by_packets else 'nt'} > {most} then null else st.nt end as nt,
                                     case when st.{'np' if by_packets else 'nt'} is not null and s.{at} - st.{'np' if by_packets else 'nt'} > {most} then null else st.nx end as nx,
                                     coalesce(st.{'ap' if by_packets else 'at_'} is not null and s.{at} - st.{'ap' if by_packets else 'at_'} > {most}, false) as aold
                              from st join s on s.n = st.n + 1) as nk))) as q)
    select p as packet_id from st where fired"""


def armed_query(name: str, text: str, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: apply_filter(views.events(spark, sf_dir), text, views.events_layout()).select("packet_id"))


armed_query("flank_armed_packets", "flank(event.value, from: < 20, to: >= 150, within: 10packets)", armed_sql("value", "x < 20", "x >= 150", "p", 10))
armed_query("flank_armed_by", "flank(event.user_id, from: < 30, by: > 40, within: 6packets)", armed_sql("user_id", "x < 30", "x - ax > 40", "p", 6))
armed_query("flank_armed_time", "flank(event.value, from: < 20, to: >= 150, within: 5m)", armed_sql("value", "x < 20", "x >= 150", "t", 300_000_000_000))
armed_query("flank_armed_both", "flank(event.user_id, from: < 30, to: >= 50, by: > 40, within: 6packets)", armed_sql("user_id", "x < 30", "x >= 50 and x - ax > 40", "p", 6))

# projections and shapes

for _occ, _sql in {
    "all": f"with l as {LINES} select k as packet_id, occ::int as occurrence, l_quantity as value from l",
    "first": f"with l as {LINES} select k as packet_id, 0 as occurrence, l_quantity as value from l where occ = 0",
    "last": f"with l as {LINES} select k as packet_id, 0 as occurrence, arg_max(l_quantity, occ) as value from l group by k",
}.items():
    query(f"proj_{_occ}", _sql)(lambda spark, sf_dir, o=_occ: projection.field_table(views.orders(spark, sf_dir), views.orders_layout(), "line.qty", o))


@query("shape_hierarchy", f"""with l as {LINES}, n as (select k, count(*) as c from l group by k)
    select o_orderkey as packet_id, 0 as node_id, -1 as parent, 1 as depth, (3 + 6 * coalesce(c, 0))::int as stop, 'order' as name, null::double as f64, null::varchar as str from orders left join n on k = o_orderkey
    union all select o_orderkey, 1, 0, 2, 1, 'order.key', null, null from orders union all select o_orderkey, 2, 0, 2, 2, 'order.price', o_totalprice, null from orders union all select o_orderkey, 3, 0, 2, 3, 'order.status', null, o_orderstatus from orders
    union all select k, (4 + 6 * occ)::int, 0, 2, (9 + 6 * occ)::int, 'line', null, null from l union all select k, (5 + 6 * occ)::int, (4 + 6 * occ)::int, 3, (5 + 6 * occ)::int, 'line.qty', l_quantity, null from l
    union all select k, (6 + 6 * occ)::int, (4 + 6 * occ)::int, 3, (6 + 6 * occ)::int, 'line.price', l_extendedprice, null from l union all select k, (7 + 6 * occ)::int, (4 + 6 * occ)::int, 3, (7 + 6 * occ)::int, 'line.flag', null, l_returnflag from l
    union all select k, (8 + 6 * occ)::int, (4 + 6 * occ)::int, 3, (8 + 6 * occ)::int, 'line.shipdate', null, null from l union all select k, (9 + 6 * occ)::int, (4 + 6 * occ)::int, 3, (9 + 6 * occ)::int, 'line.returned', null, null from l""")
def shape_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.node_rows(views.orders(spark, sf_dir), views.orders_layout()).select("packet_id", "node_id", "parent", "depth", "stop", "name", "f64", "str")


@query("shape_descendants", f"with l as {LINES} select k as packet_id, (4 + 6 * occ)::int as anchor, count(*)::bigint as below from l, range(5) group by 1, 2")
def shape_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.descendants(views.orders(spark, sf_dir), views.orders_layout(), "line").groupBy("packet_id", "anchor").agg(F.count("*").alias("below"))


_LONG = ["line.flag", "order.status"]


@query("csv_long", f"with l as {LINES} select k as packet_id, 'line.flag' as field, occ::int as occurrence, l_returnflag as value from l union all select o_orderkey, 'order.status', 0, o_orderstatus from orders")
def csv_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.long_rows(views.orders(spark, sf_dir), views.orders_layout(), _LONG)


@query("csv_wide", f"with l as {LINES}, n as (select k, string_agg(l_returnflag, '|' order by occ) as f from l group by k) select o_orderkey as packet_id, coalesce(f, '') as line_flag, o_orderstatus as order_status from orders left join n on k = o_orderkey")
def csv_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.wide_rows(views.orders(spark, sf_dir), views.orders_layout(), _LONG)


@query("csv_tree_path", f"with l as {LINES} select k as packet_id, (7 + 6 * occ)::int as node_id, (4 + 6 * occ)::int as parent_node_id, 'order/line/line.flag' as path, 'line.flag' as field, l_returnflag as value from l")
def csv_tree_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.tree_rows(views.orders(spark, sf_dir), views.orders_layout()).filter("field = 'line.flag'")


@query("csv_formula_guard", "select event_id as packet_id, case when left(x, 1) in ('=', '+', '-', '@') then '''' || x else x end as cell from (select event_id, ['=', '+', '-', '@', 'a'][event_id % 5 + 1] || event_type as x from events)")
def csv_formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.element_at(F.array(*[F.lit(c) for c in "=+-@a"]), (F.col("event_id") % 5 + 1).cast("int")), F.col("event_type"))
    return views.read(spark, sf_dir, "events").select(F.col("event_id").alias("packet_id"), T.formula_guard(raw).alias("cell"))


@query("json_packet", """select event_id as packet_id, '{"type":"' || event_type || '","user":' || user_id || ',"props":' || to_json(props)::varchar || '}' as json from events""")
def json_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("packet_id"), writers.json_object(F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.col("props")).alias("json"))


@query("display_rebuild", "select event_id as packet_id, 'Type: ' || event_type as line, 'User: ' || user_id as line2 from events")
def display_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = views.events_layout()
    fields = lay.catalog.fields

    def line(name: str):
        v = projection.first(lay, name)
        null = F.lit(None).cast("string")
        return T.display_line(F.lit(fields[name].ui_name), v.cast("string"), null, null, v.isNotNull())

    return views.events(spark, sf_dir).select("packet_id", line("event.type").alias("line"), line("event.user_id").alias("line2"))


# presence: users by the types of their events


def _users(spark: SparkSession, sf_dir: str, kind: str) -> presence.Presence:
    df = views.events(spark, sf_dir).withColumn("user", projection.first(views.events_layout(), "event.user_id"))
    return presence.Presence.of_protocol(df, views.events_layout(), kind, "user")


_U = "select distinct user_id as \"user\" from events where event_type = '{}'"
_A, _B = _U.format("purchase"), _U.format("error")
query("presence_and", f"{_A} intersect {_B}")(lambda s, d: _users(s, d, "purchase").and_(_users(s, d, "error")).ids)
query("presence_or", f"{_A} union {_B}")(lambda s, d: _users(s, d, "purchase").or_(_users(s, d, "error")).ids)
query("presence_andnot", f"{_A} except {_B}")(lambda s, d: _users(s, d, "purchase").and_not(_users(s, d, "error")).ids)
query("presence_xor", f"({_A} except {_B}) union ({_B} except {_A})")(lambda s, d: _users(s, d, "purchase").xor(_users(s, d, "error")).ids)
query("presence_count", f"select count(*) as n from ({_A})")(lambda s, d: _users(s, d, "purchase").count())
query("presence_minmax", f"select min(\"user\") as lo, max(\"user\") as hi from ({_A})")(lambda s, d: _users(s, d, "purchase").bounds())
query("presence_rank", f"select count(*) as n from ({_A}) where \"user\" <= 50")(lambda s, d: _users(s, d, "purchase").rank(50))
query("presence_rank_select", f"select \"user\", row_number() over (order by \"user\") - 1 as rank from ({_A})")(lambda s, d: _users(s, d, "purchase").numbered())
query("presence_cardinality", "select event_type as protocol, count(*) as n from events group by 1 union all select 'event', count(*) from events")(lambda s, d: presence.cardinalities(views.events(s, d), views.events_layout()))
query("presence_bitmap", f"select count(*)::bigint as n from ({_A})")(lambda s, d: _users(s, d, "purchase").bitmaps().agg(F.sum(F.bitmap_count("bitmap")).alias("n")))

# series

_S = f"select event_id as packet_id, {TS} as timestamp_ns, 0 as occurrence, value from events"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series(views.events(spark, sf_dir), views.events_layout(), "event.value", "first")


query("series_scan", _S)(_series)
query("series_id_range", f"{_S} where event_id between 100 and 299")(lambda s, d: series.id_range(_series(s, d), 100, 299))
query("series_time_range", f"{_S} where {TS} between 1704067200000000000 and 1704153600000000000")(lambda s, d: series.time_range(_series(s, d), 1704067200000000000, 1704153600000000000))
query("series_tail", f"{_S} where event_id >= 500")(lambda s, d: series.tail(_series(s, d), 500))
query("series_monotone", "select true as ids_ascend, bool_and(coalesce(p <= ts, true)) as times_ascend from (select ts, lag(ts) over (order by event_id) as p from events)")(lambda s, d: series.monotone(_series(s, d)))

# several sources, parts, limits


@query("merge_round_robin", "select event_id, event_type as source, row_number() over (order by rn, event_type) - 1 as packet_id from (select *, row_number() over (partition by event_type order by event_id) as rn from events)")
def merge_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"))
    return merge.round_robin(e, "source", "event_id")


query("split_by_count", "select event_id as packet_id, (event_id // 300 + 1)::int as part from events")(lambda s, d: merge.parts(views.events(s, d), 300).select("packet_id", "part"))
query("limit_matches", "select event_id as packet_id from events where event_type = 'click' order by 1 limit 25")(lambda s, d: merge.limit_matches(apply_filter(views.events(s, d), "click", views.events_layout()), 25).select("packet_id"))
query("read_by_ids", "select r.i as packet_id, e.event_type as type from (select (select max(event_id) from events) - 5 + range as i from range(10)) r left join events e on e.event_id = r.i")(
    lambda s, d: merge.by_ids(views.events(s, d).select("packet_id", projection.first(views.events_layout(), "event.type").alias("type")), views.read(s, d, "events").agg(F.max("event_id")).first()[0] - 5, 10)
)

# joins of the exported tables


@query("field_join", "select a.event_id as packet_id, a.event_type as type, a.value from events a where a.value > 150")
def field_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, lay = views.events(spark, sf_dir), views.events_layout()
    tables = projection.selected(df, lay, ["event.type", "event.value"])
    t = tables["event.type"].select("packet_id", F.col("value").alias("type"))
    return t.join(tables["event.value"].filter("value > 150").select("packet_id", "value"), "packet_id")


@query("catalog_join", "select 'event.type' as name, 'STRING' as field_type, 'Event' as protocol, count(*) as n from events union all select 'event.user_id', 'U64', 'Event', count(*) from events")
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = views.events_layout()
    rows = projection.long_rows(views.events(spark, sf_dir), lay, ["event.type", "event.user_id"]).groupBy("field").agg(F.count("*").alias("n"))
    c, p = lay.catalog.frame(spark), lay.catalog.protocol_frame(spark)
    return rows.join(F.broadcast(c), F.col("field") == c["name"]).join(F.broadcast(p), "protocol_id").select(c["name"], "field_type", p["ui_name"].alias("protocol"), "n")


# wire: what was synthesised is what is dissected


def _wire(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    return wire.dissect(views.frames(spark, sf_dir, every))


_PORT = "case event_type when 'click' then 53 when 'view' then 80 when 'purchase' then 443 when 'signup' then 5000 when 'error' then 5353 else 0 end"


def _firsts(df: DataFrame, **columns: str) -> DataFrame:
    return df.select("packet_id", *[F.try_element_at(F.col(f"`{field}`"), F.lit(1)).alias(name) for name, field in columns.items()])


query("wire_eth", "select event_id as packet_id, 2199023255553 as dst, 2199023255552 + user_id as src, 2048::bigint as type from events")(lambda s, d: _firsts(_wire(s, d), dst="eth.dst", src="eth.src", type="eth.type"))
query("wire_ip", f"select event_id as packet_id, 167772160 + user_id as src, 3232235521 as dst, 64 - event_id % 8 as ttl, (case event_type when 'purchase' then 6 else 17 end)::bigint as proto, event_id % 65536 as ident, 'Good' as checksum, ((case event_type when 'purchase' then 40 else 28 end) + octet_length(props::blob))::bigint as len from events")(
    lambda s, d: _firsts(_wire(s, d), src="ip.src", dst="ip.dst", ttl="ip.ttl", proto="ip.proto", ident="ip.id", checksum="ip.checksum.status", len="ip.len")
)
query("wire_udp", f"select event_id as packet_id, 1024 + user_id % 50000 as srcport, ({_PORT})::bigint as dstport, (8 + octet_length(props::blob))::bigint as length, props as payload from events where event_type <> 'purchase'")(
    lambda s, d: _firsts(_wire(s, d), srcport="udp.srcport", dstport="udp.dstport", length="udp.length", payload="udp.payload").filter("srcport is not null").withColumn("payload", F.col("payload").cast("string"))
)
query("wire_tcp", f"select event_id as packet_id, 1024 + user_id % 50000 as srcport, 443::bigint as dstport, event_id * 100 as seq, true as psh, false as syn, props as payload from events where event_type = 'purchase'")(
    lambda s, d: _firsts(_wire(s, d), srcport="tcp.srcport", dstport="tcp.dstport", seq="tcp.seq", psh="tcp.flags.push", syn="tcp.flags.syn", payload="tcp.payload").filter("srcport is not null").withColumn("payload", F.col("payload").cast("string"))
)
query("wire_vlan_qinq", "select event_id as packet_id, 0 as occurrence, user_id % 4095 as value from events where event_id % 10 = 0 union all select event_id, 1, event_id % 4095 from events where event_id % 30 = 0")(lambda s, d: projection.field_table(_wire(s, d), wire.layout(), "vlan.id"))
query("wire_dispatch", "select event_id as packet_id, list_aggregate(list_concat(['frame', 'eth'], case when event_id % 30 = 0 then ['vlan', 'vlan'] when event_id % 10 = 0 then ['vlan'] else [] end, ['ip', case event_type when 'purchase' then 'tcp' else 'udp' end, case event_type when 'click' then 'dns' when 'purchase' then 'tls' else 'data' end]), 'string_agg', '/') as stack from events where octet_length(props::blob) > 0")(
    lambda s, d: _wire(s, d, every=True).filter(F.octet_length("payload") > 0).select("packet_id", F.array_join("protocols", "/").alias("stack"))
)
query("wire_checksum", "select event_id as packet_id, 'Good' as status from events")(lambda s, d: _firsts(_wire(s, d), status="ip.checksum.status"))
query("wire_filter", f"select event_id as packet_id from events where event_type <> 'purchase' and ({_PORT}) in (53, 5353) and 64 - event_id % 8 < 62")(lambda s, d: apply_filter(_wire(s, d), "udp.dstport in {53, 5353} && ip.ttl < 62", wire.layout()).select("packet_id"))
query("flt_slice", "select event_id as packet_id from events where user_id % 256 = 7")(lambda s, d: apply_filter(_wire(s, d), f"eth.src[0:3] == 02:00:00 && eth.src[4:6] in {{{', '.join(f'{i:02X}:07' for i in range(256))}}} && len(eth.src) == 6", wire.layout()).select("packet_id"))
query("flt_mac_slice_never_equal", "select event_id as packet_id from events where false")(lambda s, d: apply_filter(_wire(s, d), "eth.dst[0:6] == 02:00:00:00:00:01", wire.layout()).select("packet_id"))
query("flt_mac", "select event_id as packet_id from events")(lambda s, d: apply_filter(_wire(s, d), "eth.dst == 02:00:00:00:00:01", wire.layout()).select("packet_id"))
query("flt_address_range", "select event_id as packet_id from events where user_id between 1 and 9")(lambda s, d: apply_filter(_wire(s, d), "ip.src in 10.0.0.1..10.0.0.9", wire.layout()).select("packet_id"))
query("flt_alias_presence", "select event_id as packet_id from events where event_type <> 'purchase'")(lambda s, d: apply_filter(_wire(s, d), "udp.port && ip.addr && !tcp.port", wire.layout()).select("packet_id"))
query("flt_address_families", "select event_id as packet_id from events")(lambda s, d: apply_filter(_wire(s, d), "ip.src < ::1 && !(ip.src == ::1) && ip.src != ::1", wire.layout()).select("packet_id"))
query("frame_hex", "select event_id as packet_id, hex(props) as hex, octet_length(props::blob)::bigint as n from events where event_type = 'error'")(lambda s, d: apply_filter(_wire(s, d), "udp.dstport == 5353", wire.layout()).transform(lambda df: projection.byte_columns(df, "payload")).select("packet_id", F.col("payload_hex").alias("hex"), F.octet_length("payload").cast("bigint").alias("n")))
query("frame_base64", "select event_id as packet_id, base64(props::blob) as b from events where event_type = 'error'")(lambda s, d: apply_filter(_wire(s, d), "udp.dstport == 5353", wire.layout()).transform(lambda df: projection.byte_columns(df, "payload")).select("packet_id", F.col("payload_base64").alias("b")))
query("text_addresses", "select event_id as packet_id, (10 + user_id // 16777216) || '.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) as src, '02:00:' || lpad(upper(to_hex(user_id // 16777216)), 2, '0') || ':' || lpad(upper(to_hex(user_id // 65536 % 256)), 2, '0') || ':' || lpad(upper(to_hex(user_id // 256 % 256)), 2, '0') || ':' || lpad(upper(to_hex(user_id % 256)), 2, '0') as mac, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' as time from events")(
    lambda s, d: _firsts(_wire(s, d), src="ip.src", mac="eth.src", time="frame.time").select("packet_id", T.ipv4(F.col("src")).alias("src"), T.mac(F.col("mac")).alias("mac"), T.iso_ns(F.col("time")).alias("time"))
)

# signals in a payload of eight bytes


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id") * 1000003 + F.col("user_id") * 77
    return views.read(spark, sf_dir, "events").select(F.col("event_id").alias("packet_id"), W.be_bytes(number, 8).alias("p"))


_N = "(event_id * 1000003 + user_id * 77)"
query("signal_be", f"select event_id as packet_id, ({_N} >> 4) & 4095 as v from events")(lambda s, d: _signal(s, d).select("packet_id", W.signal_raw(F.col("p"), 8 * 6 + 7, 12, True).alias("v")))
query("signal_le", f"select event_id as packet_id, ((({_N} & 255) << 8) | (({_N} >> 8) & 255)) & 1023 as v from events")(lambda s, d: _signal(s, d).select("packet_id", W.signal_raw(F.col("p"), 48, 10).alias("v")))
query("signal_physical", f"select event_id as packet_id, (({_N} & 255) * 0.5 - 40)::double as v from events")(lambda s, d: _signal(s, d).select("packet_id", W.signal_physical(W.signal_raw(F.col("p"), 56, 8), 0.5, -40).alias("v")))
query("signal_enum", f"select event_id as packet_id, case {_N} & 3 when 0 then 'off' when 1 then 'on' when 2 then 'error' end as v from events")(
    lambda s, d: signals.decode(_signal(s, d).withColumn("id", F.lit(1)), [signals.Message(1, "m", (signals.Signal("v", 56, 2, names={0: "off", 1: "on", 2: "error"}),))], payload="p").select("packet_id", F.try_element_at("shown", F.lit("v")).alias("v"))
)

# streams


@query("stream_index", "select event_id as packet_id, dense_rank() over (order by f) - 1 as stream from (select event_id, min(event_id) over (partition by user_id) as f from events)")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = views.read(spark, sf_dir, "events").select(F.col("event_id").alias("packet_id"), *[F.when(F.col("event_id") % 2 == 0, a).otherwise(b).alias(n) for n, a, b in (("src", F.col("user_id"), F.lit(-1).cast("bigint")), ("dst", F.lit(-1).cast("bigint"), F.col("user_id")))])
    return reassembly.stream_index(ends, ["src"], ["dst"]).select("packet_id", "stream")


@query("time_delta", "select event_id as packet_id, epoch_us(ts) * 1000 - lag(epoch_us(ts) * 1000) over (partition by user_id order by event_id) as delta_ns from events")
def time_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events").select(F.col("event_id").alias("packet_id"), "user_id", views.nanos("ts").alias("t"))
    return reassembly.time_deltas(e, ["user_id"], "packet_id", "t").select("packet_id", "delta_ns")


query("reassemble_concat", "select conv_id as conn_id, string_agg(text, '' order by turn) as data, count(*) as segments, 'complete' as state from conversations group by 1 having max(turn) = count(*) - 1 and min(turn) = 0")(
    lambda s, d: reassembly.concat_stream(views.turns(s, d)).filter("state = 'complete'").select("conn_id", F.col("data").cast("string").alias("data"), "segments", "state")
)
query("reassemble_gap", "select conv_id as conn_id, string_agg(text, '' order by turn) filter (turn < 1) as data, count(*) filter (turn < 1) as segments, case when count(*) filter (turn > 1) > 0 then 'pending' else 'complete' end as state from conversations where turn <> 1 group by 1")(
    lambda s, d: reassembly.concat_stream(views.turns(s, d).filter("seq <> 1")).select("conn_id", F.col("data").cast("string").alias("data"), "segments", "state")
)
query("pair_lifo", "select conv_id as conn_id, turn as request, case when next_role = 'assistant' then next_turn end as response from (select *, lead(turn) over w as next_turn, lead(role) over w as next_role from conversations where role in ('user', 'assistant') window w as (partition by conv_id order by turn)) where role = 'user'")(
    lambda s, d: reassembly.pair_latest(views.turns(s, d), ["conn_id"], "seq", F.col("role") == "user", F.col("role") == "assistant")
)
query("json_members", f"select event_id as packet_id, {K} as k from events")(
    lambda s, d: app.dissect(views.spread(views.read(s, d, "events")).select(F.col("event_id").alias("packet_id"), F.lit("json").alias("app"), F.coalesce("props", F.lit("{}")).cast("binary").alias("payload")), ["json", "json.key", "json.value.number"])
    .groupBy("packet_id").agg(F.max(F.when(F.col("name") == "json.value.number", F.col("i64"))).alias("k"))
)
query("http_url", r"select page_id as packet_id, regexp_extract(url, '^[a-z]+://([^/?#]*)([^#]*)', 1) as host, regexp_extract(url, '^[a-z]+://([^/?#]*)([^#]*)', 2) as uri from pages")(lambda s, d: _firsts(views.pages(s, d), host="http.host", uri="http.uri"))


# application layers: written from columns, read back


def _written(spark: SparkSession, sf_dir: str, layer: str, *parts: Column) -> DataFrame:
    return views.read(spark, sf_dir, "events").select(F.col("event_id").alias("packet_id"), F.lit(layer).alias("app"), F.concat(*parts).alias("payload"))


def _sized(name: str, width: int) -> Column:
    value = F.col(name).cast("binary")
    return F.concat(W.be_bytes(F.octet_length(value), width), value)


@query("app_dns", "select event_id as packet_id, event_type || '.example' as name from events")
def app_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _written(spark, sf_dir, "dns", W.be_bytes(F.col("event_id") % 65536, 2), wire.hexed("01000001000000000000"), _sized("event_type", 1), wire.hexed("076578616d706c65" + "0000010001"))
    return app.dissect(df, ["dns.qry.name"]).select("packet_id", F.col("str").alias("name"))


@query("app_can", "select event_id as packet_id, user_id % 2048 as id, lower(printf('%08x', event_id)) as data from events")
def app_can(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _written(spark, sf_dir, "can", W.be_bytes(F.col("user_id") % 2048, 4), wire.hexed("04000000"), W.be_bytes(F.col("event_id"), 4))
    nodes = app.dissect(df, ["can.id", "can.data"])
    return nodes.groupBy("packet_id").agg(F.max(F.when(F.col("name") == "can.id", F.col("i64"))).alias("id"), F.max(F.when(F.col("name") == "can.data", F.lower(F.hex("bin")))).alias("data"))


@query("app_someip_payload", "select event_id as packet_id, event_id::varchar as id, event_type as type, case user_id % 3 when 0 then 'off' when 1 then 'on' else 'unknown' end as state from events")
def app_someip_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"type": "struct", "members": [{"name": "id", "type": "uint32"}, {"name": "type", "type": "string", "length_bytes": 4}, {"name": "state", "type": "enum", "base": "uint8", "names": {"0": "off", "1": "on"}}]}
    df = _written(spark, sf_dir, "someip", W.be_bytes(F.col("event_id"), 4), _sized("event_type", 4), W.be_bytes(F.col("user_id") % 3, 1))
    read = someip.decode(df.withColumns({"serviceid": F.lit(1), "methodid": F.lit(2)}), {(1, 2): spec})
    value = lambda name: F.filter("values", lambda v: v["name"] == name)[0]["text"]
    return read.select("packet_id", value("value.id").alias("id"), value("value.type").alias("type"), value("value.state.name").alias("state"))


@query("app_someip_sd", "select event_id as packet_id, user_id % 65536 as service, case when event_id % 2 = 0 then 'stop_offer' else 'offer' end as kind from events")
def app_someip_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(wire.hexed("01000000"), W.be_bytes(F.col("user_id") % 65536, 2), wire.hexed("000101"), W.be_bytes(F.col("event_id") % 2 * 3, 3), wire.hexed("00000000"))
    body = F.concat(wire.hexed("c0000000" + "00000010"), entry, wire.hexed("00000000"))
    df = _written(spark, sf_dir, "someip", wire.hexed("ffff8100"), W.be_bytes(F.octet_length(body) + 8, 4), wire.hexed("0000000101010200"), body)
    nodes = app.dissect(df, ["someip_sd.entry.serviceid", "someip_sd.entry.kind"])
    return nodes.groupBy("packet_id").agg(F.max("i64").alias("service"), F.max("str").alias("kind"))


@query("wire_tcp_options", "select event_id as packet_id, 500 + event_id % 900 as mss, event_id % 15 as shift from events")
def wire_tcp_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events").select("event_id")
    listed = F.concat(wire.hexed("0204"), W.be_bytes(500 + F.col("event_id") % 900, 2), wire.hexed("0303"), W.be_bytes(F.col("event_id") % 15, 1), wire.hexed("01"))
    segment = F.concat(wire.hexed("04d20050" + "00000000" * 2 + "7002ffff00000000"), listed)
    address = F.lit(0x0A000001).cast("bigint")
    packet = wire.ipv4(address, address, F.lit(6), segment)
    frames = e.select(F.col("event_id").alias("frame_id"), F.lit(0).cast("bigint").alias("timestamp_ns"), wire.ethernet(F.lit(1), F.lit(2), F.lit(0x800), packet).alias("data"))
    nodes = options.layers(frames, ["tcp.options.mss_val", "tcp.options.wscale.shift"])
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("i64")))
    return nodes.groupBy("packet_id").agg(of("tcp.options.mss_val").alias("mss"), of("tcp.options.wscale.shift").alias("shift"))


@query(
    "http2_headers",
    """with e as (select event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before from events)
    select event_id as packet_id, 0 as position, 'x-type' as name, before as value from e where before is not null
    union all select event_id, case when before is null then 0 else 1 end, 'x-type', event_type from e""",
)
def http2_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block names its connection's last entry by its place in the table, and adds one."""
    from pyspark.sql import Window

    e = views.read(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    added = F.concat(wire.hexed("4006782d74797065"), _sized("event_type", 1))
    body = F.when(F.col("n") > 1, F.concat(wire.hexed("be"), added)).otherwise(added)
    frames = e.select("user_id", F.col("event_id").alias("packet_id"), F.col("event_id").alias("stream_id"), F.lit(1).alias("kind"), F.lit(4).alias("flags"), body.alias("body"))
    return hpack.headers(frames, "user_id").filter("error is null").select("packet_id", "position", "name", "value")


@query("http1_messages", "select conv_id as conn_id, row_number() over (partition by conv_id order by turn) - 1 as n, text as body from conversations")
def http1_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a request in two segments, cut inside its head."""
    t = views.turns(spark, sf_dir)
    head = F.concat(F.lit("POST / HTTP/1.1\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n")).cast("binary")
    whole = F.concat(head, F.col("payload"))
    cut = F.array(F.struct((F.col("seq") * 2).alias("seq"), W.raw(whole, 0, 20).alias("payload")), F.struct((F.col("seq") * 2 + 1).alias("seq"), W.raw(whole, 20).alias("payload")))
    read = reassembly.messages(t.select("conn_id", F.explode(cut).alias("s")).select("conn_id", "s.*"), "conn_id", boundaries.http1)
    return read.select("conn_id", "n", F.expr(r"substring(cast(data as string), instr(cast(data as string), '\r\n\r\n') + 4)").alias("body"))


from framelake import packet_queries as _packet_queries  # noqa: E402, F401  it registers its queries here


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flt_and_or"](spark, sf_dir)
