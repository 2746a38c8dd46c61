"""Queries: corrected words on their times, and filters of made-up segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.operators import alignment as A
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables


@register("sf04_realigned_words")
def realigned_words(spark, d):
    """Words spread evenly over their segment, and a corrected text: every seventh word is dropped, every eleventh is
    another, after every thirteenth comes a new one."""
    segs = tables.segments(spark, d).withColumn("w", tables.words(F.col("text"))).filter("size(w) > 0")
    each = (F.col("t1") - F.col("t0")) / F.size("w")
    words = F.transform("w", lambda w, i: F.struct(w.alias("word"), F.round(F.col("t0") + i * each, 3).alias("w0"), F.round(F.col("t0") + (i + 1) * each, 3).alias("w1")))
    n = lambda i, a: (i * a + F.col("seq")).cast("int")
    changed = F.flatten(F.transform("w", lambda w, i: F.when(n(i, 1) % 7 == 0, F.array().cast("array<string>")).when(n(i, 3) % 11 == 0, F.array(F.concat(F.lit("x"), w))).when(n(i, 1) % 13 == 0, F.array(F.concat(w, F.lit(",")), F.lit("indeed"))).otherwise(F.array(w))))
    rows = segs.select("job_id", "seq", F.array_join(changed, " ").alias("text"), words.alias("words"))
    return A.realigned_words(rows)


# Segments as a recogniser might give them: repeats of the one before, loops, boilerplate, echoes, ghosts and jumps by rule.
_RAW = rf"""{duck.seg()}, raw0 as (select *, lag(text) over (partition by job_id order by seq) as prev, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from seg),
raw as (select job_id, seq, case when seq % 6 = 1 and prev is not null then prev when seq % 11 = 3 then 'Thanks for watching!' when seq % 13 = 4 then 'Please use complete sentences now' when seq % 17 = 5 then repeat(coalesce(w[1], 'a') || ' b c ', 5) else text end as text,
  seq * 1.5e0 - case when seq % 10 = 9 then 4e0 else 0e0 end as t0, seq * 1.5e0 + case when seq % 19 = 7 then 40e0 when seq % 23 = 8 then 140e0 else 1e0 + seq % 3 end as t1, (seq * 7 % 20) / 20e0 as confidence, (seq * 3 % 40) / 40e0 as no_speech from raw0)"""


def raw_segments(spark, d):
    seq = F.col("seq")
    rows = tables.segments(spark, d).withColumns({"prev": F.lag("text").over(Window.partitionBy("job_id").orderBy("seq")), "first": F.coalesce(F.get(tables.words(F.col("text")), F.lit(0)), F.lit("a"))})
    text = F.when((seq % 6 == 1) & F.col("prev").isNotNull(), F.col("prev")).when(seq % 11 == 3, "Thanks for watching!").when(seq % 13 == 4, "Please use complete sentences now").when(seq % 17 == 5, F.repeat(F.concat("first", F.lit(" b c ")), 5)).otherwise(F.col("text"))
    start = seq * 1.5 - F.when(seq % 10 == 9, 4.0).otherwise(0.0)
    end = seq * 1.5 + F.when(seq % 19 == 7, 40.0).when(seq % 23 == 8, 140.0).otherwise(1.0 + seq % 3)
    return rows.select("job_id", "seq", text.alias("text"), start.alias("t0"), end.alias("t1"), (seq * 7 % 20 / 20.0).alias("confidence"), (seq * 3 % 40 / 40.0).alias("no_speech"))


@register("st06_filtered_segments")
def filtered_segments(spark, d):
    return A.filtered(raw_segments(spark, d))


_WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"
_LOOPS = f"(select coalesce(max(c) >= 3 and max(c) > 0.4e0 * sum(c), false) from (select count(*) as c from (select unnest(list_transform(range(1, len(w3) - 1), lambda i: w3[i] || ' ' || w3[i + 1] || ' ' || w3[i + 2])) as g) group by g) where len(w3) >= 9)"
_THIN = "t1 - t0 > 15 and length(text) / (t1 - t0) < 1"
_GHOST = "t1 - t0 > 120 and length(text) < 200"


@register(
    "st06_made_up",
    f"""with {_RAW}, x as (select job_id, seq, t0, t1, trim(text) as text, confidence, no_speech from raw where trim(text) <> ''), y as (select *, {_WORDS} as w3 from x)
    select job_id, seq, case when no_speech > 0.9e0 and confidence < 0.1e0 then 'silence' when lower(text) like '%use complete sentences%' or lower(text) like '%translate names as-is%' or lower(text) like '%translated to natural english%' or lower(text) like '%this is a japanese conversation%' or lower(text) like '%this is a conversation translated%' then 'echo' when ({_THIN}) or ({_GHOST}) then 'ghost' when length(text) > 1500 then 'runaway' when {_LOOPS} then 'loop' end as reason from y""",
)
def made_up(spark, d):
    """What segments tell about themselves."""
    return A.made_up(raw_segments(spark, d)).select("job_id", "seq", "reason")


_PROMPT = "This is a talk about bridges. Use complete sentences."
_LOW = r"regexp_replace(lower(text), '\.+$', '')"


@register(
    "st07_worker_filter",
    f"""with recursive {_RAW}, x as (select job_id, seq, t0, t1, trim(text) as text, no_speech from raw where trim(text) <> ''), y as (select *, {_WORDS} as w3, {_LOW} as low from x),
    z as (select job_id, seq, t0, t1, text from y where not (contains(low, 'this is a talk about bridges') or contains('this is a talk about bridges', low) or contains(low, 'use complete sentences') or contains('use complete sentences', low))
      and length(text) <= 1500 and not (t1 - t0 > 30 and length(text) < 30 and no_speech > 0.5e0) and not (t1 - t0 > 15 and length(text) / greatest(t1 - t0, 0.1e0) < 1) and not ({_GHOST}) and not {_LOOPS}),
    {duck.fold("z", "seq", {"last0": "n.t0", "prev": "n.text", "recent": "[lower(n.text)]", "stays": "true"}, {k: v.format(ok="not (n.t0 < f.last0 or (n.text = f.prev and n.t1 - n.t0 < 5) or (len(f.recent) >= 2 and list_contains(f.recent[-5:], lower(n.text))))") for k, v in {"last0": "case when {ok} then n.t0 else f.last0 end", "prev": "case when {ok} then n.text else f.prev end", "recent": "case when {ok} then list_append(f.recent, lower(n.text)) else f.recent end", "stays": "{ok}"}.items()})}
    select job_id, seq from f where stays""",
)
def worker_filter(spark, d):
    return A.worker_filtered(raw_segments(spark, d), _PROMPT)


_HALF = "list_concat(list_concat({v}[:pos - 1], [{{'s': {v}[pos].s, 'e': ({v}[pos].s + {v}[pos].e) / 2}}, {{'s': ({v}[pos].s + {v}[pos].e) / 2, 'e': {v}[pos].e}}]), {v}[pos + 1:])"
_AT = "list_position(list_transform({v}, lambda x: x.e - x.s), list_max(list_transform({v}, lambda x: x.e - x.s)))"


@register(
    "sf10_reconciled_times",
    f"""with recursive {duck.seg()}, w as (select job_id, seq, n_words::int as k, greatest(n_words + (seq * 5 + job_id) % 9 - 4, 0)::int as n, t0 from seg where n_words > 0),
    a as (select job_id, seq, k, n, list_transform(range(0, k), lambda i: {{'s': t0 + i * 0.5e0, 'e': t0 + i * 0.5e0 + 0.125e0 * (1 + (i * 5 + seq) % 3)}}) as v from w),
    g as (select job_id, seq, k, n, v, {_AT.format(v="v")} as pos from a where n > k and n - k <= 3 union all select job_id, seq, k + 1, n, nv, {_AT.format(v="nv")} from (select job_id, seq, k, n, {_HALF.format(v="v")} as nv from g where k < n)),
    r as (select job_id, seq, v from a where k = n union all select job_id, seq, list_transform(range(0, n), lambda i: v[least(floor(i * (k / n::double))::int, k - 1) + 1]) from a where k > n and k - n <= 3 and n > 0 union all select job_id, seq, v from g where k = n)
    select a.job_id, a.seq, r.v is not null as fits, len(r.v)::int as n, round(list_sum(list_transform(range(1, len(r.v) + 1), lambda i: i * r.v[i].s)), 6) as starts, round(list_sum(list_transform(range(1, len(r.v) + 1), lambda i: i * r.v[i].e)), 6) as ends from a left join r using (job_id, seq)""",
)
def reconciled_times(spark, d):
    """Word times by rule for edited texts of up to four words more or fewer; sums weighted by place stand for the times."""
    rows = tables.segments(spark, d).filter("n_words > 0").withColumn("k", F.col("n_words").cast("int"))
    rows = rows.withColumn("n", F.greatest(F.col("k") + ((F.col("seq") * 5 + F.col("job_id")) % 9 - 4).cast("int"), F.lit(0)))
    times = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct((F.col("t0") + i * 0.5).alias("s"), (F.col("t0") + i * 0.5 + 0.125 * (1 + (i * 5 + F.col("seq")) % 3)).alias("e")))
    found = rows.withColumn("times", times).withColumn("v", X.reconciled_times(F.col("times"), F.col("n")))
    total = lambda c: F.round(F.aggregate(F.transform("v", lambda t, i: (i + 1) * t[c]), F.lit(0.0), lambda a, x: a + x), 6)
    return found.select("job_id", "seq", F.col("v").isNotNull().alias("fits"), F.when(F.col("v").isNotNull(), F.size("v")).alias("n"), total("s").alias("starts"), total("e").alias("ends"))


_PAUSE = "coalesce(map {" + ", ".join(f"'{k}': {v}e0" for k, v in X.PAUSES.items()) + "}[x[-1]], 0e0)"
_FAST = "case when regexp_replace(lower(w[i]), '[.,!?;:—–]+$', '') in (" + ", ".join(repr(w) for w in X.FAST_WORDS) + ") then 0.75e0 else 1e0 end"


@register(
    "sf49_active_words",
    rf"""with {duck.seg()}, p as (select job_id, seq, unnest(range(0, 6)) as q, t0, t1, list_filter(string_split_regex(case when (seq + job_id) % 3 = 0 then replace(text, ' ', ', ') else text end, '\s+'), lambda x: x <> '') as w, case seq % 4 when 0 then null when 1 then 2e0 when 2 then 8e0 else 3.5e0 end as rate, (seq + job_id) % 2 = 0 as timed from seg),
    a as (select *, len(w) as n, t0 - 0.1e0 + (t1 - t0 + 0.3e0) * q / 5 as at_, t1 - t0 as length, greatest(0.6e0, least(1.6e0, 3e0 / coalesce(rate, 3e0))) as sc, list_sum(list_transform(w, lambda x: length(x))) as total from p),
    b as (select *, list_transform(w, lambda x: 0.04e0 * sc + {_PAUSE} * sc) as rests from a), c as (select *, list_sum(rests) as resting, greatest(length - list_sum(rests), length * 0.45e0) as letters from b),
    d as (select *, list_transform(range(1, n + 1), lambda i: (letters * (length(w[i]) / total::double) + rests[i] * ((length - letters) / greatest(resting, 0.01e0))) * {_FAST} * case when i = 1 then 1.15e0 when i = n then 1.1e0 else 1e0 end) as dur, at_ - t0 + 0.1e0 * sc - 0.12e0 as elapsed, at_ + 0.1e0 - 0.12e0 as now_ from c),
    e as (select *, list_filter(range(1, n + 1), lambda i: now_ < t0 + length * i / n) as later, list_filter(range(1, n + 1), lambda i: elapsed < list_sum(dur[:i])) as ahead from d)
    select job_id, seq, q::int as q, (case when n <= 1 then n - 1 when timed then case when now_ < t0 then -1 when len(later) > 0 then later[1] - 1 else n - 1 end when elapsed < 0 then -1 when len(ahead) > 0 then ahead[1] - 1 else n - 1 end)::int as word from e""",
)
def active_words(spark, d):
    """Six moments of every segment, from a little before it to a little after; every second one has word times."""
    seq, length = F.col("seq"), F.col("t1") - F.col("t0")
    rows = tables.segments(spark, d).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("text", F.when((seq + F.col("job_id")) % 3 == 0, F.replace("text", F.lit(" "), F.lit(", "))).otherwise(F.col("text")))
    rows = rows.withColumn("n", F.size(X.words(F.col("text"))))
    times = F.when(((seq + F.col("job_id")) % 2 == 0) & (F.col("n") > 0), F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct((F.col("t0") + length * (i - 1) / F.col("n")).alias("s"), (F.col("t0") + length * i / F.col("n")).alias("e"))))
    rate = F.when(seq % 4 == 1, 2.0).when(seq % 4 == 2, 8.0).when(seq % 4 == 3, 3.5)
    rows = rows.withColumns({"times": times, "rate": rate, "at": F.col("t0") - 0.1 + (length + 0.3) * F.col("q") / 5})
    return rows.select("job_id", "seq", "q", X.active_word(F.col("text"), F.col("at"), F.col("t0"), F.col("t1"), F.col("times"), F.col("rate")).alias("word"))
