"""The derived views of ``rivulet.sources.tables`` as DuckDB common table expressions."""


def seg(per_word: float = 0.4) -> str:
    return rf"""seg as (select job_id, seq, speaker, text, n_words, round(u, 3) as t0, round(u + dur, 3) as t1 from (
  select *, coalesce(sum(dur + gap) over (partition by job_id order by seq rows between unbounded preceding and 1 preceding), 0e0) + gap as u from (
    select *, n_words * {per_word}e0 as dur, case when (seq * 7 + job_id * 3) % 5 = 0 then 2e0 when (seq + job_id) % 3 = 0 then 0.3e0 else 0e0 end as gap from (
      select conv_id as job_id, turn as seq, role as speaker, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::bigint as n_words from conversations))))"""


EV = """ev as (select job_id, event_id, event_type, value, round((s - min(s) over (partition by job_id)) / 3600e0, 3) as t from (
  select user_id as job_id, event_id, event_type, value, epoch_us(ts) / 1e6 as s from events))"""
SCENES = EV + ", scenes as (select job_id, event_id, t, 1 + event_id % 10 as importance, (event_id * 37 % 101)::double as subject_x from ev)"
SPK = (
    EV
    + """, spk as (select job_id, event_id, t as t0, t1, case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end as slot, round((event_id % 20) / 20e0, 2) as confidence from (
  select *, lead(t) over (partition by job_id order by t, event_id) as t1 from ev) where t1 is not null)"""
)
CUTS = EV + ", cuts as (select distinct job_id, t from ev where event_type = 'error')"
JOBS = "jobs as (select o_orderkey as job_id, o_orderstatus as status, o_orderdate as created_at, o_totalprice as cost, o_orderpriority as provider from orders)"
CLIPS = """clips as (select l_orderkey as job_id, l_linenumber as clip_id, (l_partkey % 600)::double as t0, (l_partkey % 600 + l_quantity)::double as t1,
  1 + l_suppkey * 7 % 100 as score, l_returnflag as platform, l_linestatus as kind from lineitem)"""


def fold(rows: str, order: str, start: dict[str, str], step: dict[str, str], key: str = "job_id", tag: str = "") -> str:
    """CTEs ``n`` and ``f`` (with ``tag``): the rows numbered per job, and a left fold over them with a state in every row.
    In ``start`` and ``step``, n names the row and f the row before with its state. Needs ``with recursive``."""
    first = ", ".join(f"{v} as {k}" for k, v in start.items())
    later = ", ".join(f"{step[k]} as new_{k}" for k in start)
    return f"""n{tag} as (select *, row_number() over (partition by {key} order by {order}) as rn from {rows}),
    f{tag} as (select n.*, {first} from n{tag} n where rn = 1 union all select n.*, {later} from f{tag} f join n{tag} n on n.{key} = f.{key} and n.rn = f.rn + 1)"""


def last_of(idx: str, key: str = "job_id", tag: str = "") -> str:
    """The last row of every number ``idx`` of a fold's rows."""
    return f"(select *, max(rn) over (partition by {key}, {idx}) as last_rn from f{tag}) where rn = last_rn"


FACES = EV + """, faces as (select job_id, event_id, t, k, case when (event_id + k) % 19 = 0 then -1 else (event_id % 3 + k) % 4 end::int as slot, ((event_id * 37 + k * 29) % 101)::double as x, ((event_id * 53 + k * 17) % 101)::double as y, (4 + event_id % 20)::double as w, (6 + event_id % 15)::double as h
  from (select *, unnest(range(0, event_id % 4)) as k from ev where event_id % 4 > 0))"""
SPANS = "spans as (select job_id, k::bigint as seq, k * 60e0 as t0, k * 60e0 + 60 as t1 from (select job_id, unnest(range(0, floor(max(t) / 60)::bigint + 1)) as k from ev group by job_id))"
