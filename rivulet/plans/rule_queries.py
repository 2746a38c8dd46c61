"""Queries: output sizes, crops, priorities, prices, tiers, agents, limits and measured speeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import rules as R
from rivulet.operators import folds as D
from rivulet.operators import uploads as U
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables

_RATIOS, _QUALITIES = ["16:9", "9:16", "1:1", "4:5", "2:1"], ["720p", "1080p", "4k", "8k"]
_KNOWN = " ".join(f"when r = '{r}' and case when q in ('720p', '1080p', '4k') then q else '1080p' end = '{q}' then [{w}, {h}]" for q, dims in R.DIMS.items() for r, (w, h) in dims.items())


@register(
    "sf17_output_sizes",
    f"""with s as (select p_partkey, (320 + p_partkey * 2 % 3600)::int as w, (240 + p_partkey * 6 % 2000)::int as h, {_RATIOS}[p_partkey % 5 + 1] as r, {_QUALITIES}[p_partkey % 4 + 1] as q from part),
    t as (select *, case q when '720p' then 720 when '4k' then 2160 else 1080 end as target from s), d as (select p_partkey, case {_KNOWN} when h <> target then [(round_even(w * target / h::double / 2, 0) * 2)::int, target] else [w, h] end as dims from t) select p_partkey, dims[1]::int as w, dims[2]::int as h from d""",
)
def output_sizes(spark, d):
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    rows = tables.load(spark, d, "part").select("p_partkey", R.out_dims((320 + k * 2 % 3600).cast("int"), (240 + k * 6 % 2000).cast("int"), pick(_RATIOS, k % 5), pick(_QUALITIES, k % 4)).alias("d"))
    return rows.select("p_partkey", F.col("d.w").alias("w"), F.col("d.h").alias("h"))


@register("sf21_face_offsets", f"with {duck.FACES} select job_id, event_id, k, case when 400 + event_id % 900 >= 1080 then 0 else greatest(0, least(1080 - (400 + event_id % 900), trunc(1080 * y / 100 - (400 + event_id % 900) * 0.38e0)::int)) end::int as y_offset from faces")
def face_offsets(spark, d):
    crop = (400 + F.col("event_id") % 900).cast("int")
    return tables.dense_faces(spark, d).select("job_id", "event_id", "k", R.face_offset(F.col("y"), F.lit(1080), crop).cast("int").alias("y_offset"))


_CW = 9 / 16 * 1080 / 1920


@register("sf23_crop_rects", f"with {duck.FACES}, c as (select job_id, event_id, k, case when k = 0 then x * 19.2e0 else x / 100 end as px, x from faces), n as (select *, case when px > 1 then px / 1920 else px / 100 end as cx from c) select job_id, event_id, k, round(greatest(0, least(cx - {_CW}e0 / 2, 1 - {_CW}e0)), 6) as x, round({_CW}e0, 6) as w from n")
def crop_rects(spark, d):
    """The first face of a frame in pixels, others as shares."""
    x = F.when(F.col("k") == 0, F.col("x") * 19.2).otherwise(F.col("x") / 100)
    rect = R.crop_rect(x, F.lit(50.0), 1920, 1080, 9 / 16)
    return tables.dense_faces(spark, d).select("job_id", "event_id", "k", rect.alias("r")).select("job_id", "event_id", "k", F.round("r.x", 6).alias("x"), F.round("r.w", 6).alias("w"))


@register("sf25_gaze", f"with {duck.FACES}, g as (select job_id, event_id, k, case when w - 6 > 0 then ((x + (event_id * 7 % 11 - 5)) - x) / (w - 6) end as off from faces) select job_id, event_id, k, case when off > 0.15e0 then 'right' when off < -0.15e0 then 'left' else 'center' end as gaze from g")
def gaze(spark, d):
    nose = F.col("x") + (F.col("event_id") * 7 % 11 - 5)
    return tables.dense_faces(spark, d).select("job_id", "event_id", "k", R.gaze(nose, F.col("x"), F.col("w") - 6).alias("gaze"))


@register("sf39_model_costs", "with p as (select p_partkey, p_retailprice / 1e7 as price, p_partkey % 3 = 0 as vision, p_partkey % 7 = 0 as bad from part) select p_partkey, round(case when bad then 0 when vision then price * 100000 + price * 2 * 15000 else price * 15000 + price * 2 * 8000 end, 6) as usd from p")
def model_costs(spark, d):
    price = F.col("p_retailprice").cast("double") / 1e7
    prompt = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(price.cast("string"))
    role = F.when(F.col("p_partkey") % 3 == 0, "vision").otherwise("text")
    return tables.load(spark, d, "part").select("p_partkey", F.round(R.model_cost(prompt, (price * 2).cast("string"), role), 6).alias("usd"))


def _tier_case(table: dict, key: str, i: int) -> str:
    return "case " + key + " " + " ".join(f"when '{t}' then {v[i]!r}" for t, v in table.items()) + " end"


_NAMES = ["short", "medium", "long", "marathon"]


@register(
    "sf42_tiers",
    f"""with t as (select o_orderkey as job_id, {_NAMES}[o_orderkey % 4 + 1] as tier, o_orderkey % 3 = 0 as local_ from orders)
    select job_id, tier, case when local_ then {_tier_case(R.LOCAL_TIERS, 'tier', 0)} else {_tier_case(R.TIERS, 'tier', 0)} end::int as window, case when local_ then {_tier_case(R.LOCAL_TIERS, 'tier', 3)} else {_tier_case(R.TIERS, 'tier', 3)} end as strategy,
    case when local_ and {_tier_case(R.LOCAL_TIERS, 'tier', 4)} > 0 then {_tier_case(R.LOCAL_TIERS, 'tier', 4)} else {_tier_case(R.TIERS, 'tier', 4)} end::int as chunk from t""",
)
def tiers(spark, d):
    k = F.col("o_orderkey")
    tier = F.element_at(F.array(*map(F.lit, _NAMES)), (k % 4 + 1).cast("int"))
    rows = tables.load(spark, d, "orders").select(k.alias("job_id"), tier.alias("tier"), R.tier_fields(tier, k % 3 == 0).alias("f"))
    return rows.select("job_id", "tier", F.col("f.window").alias("window"), F.col("f.strategy").alias("strategy"), F.col("f.chunk").alias("chunk"))


_CLASSES = ["person", "car", "dog", "chair", "sports ball", "train", "boat", "cup"]
_WEIGHT = "case c " + " ".join(f"when '{k}' then {v}e0" for k, v in (R.ALWAYS | R.IF_MOVING).items()) + " else 0.3e0 end"


@register("sf43_class_priorities", f"with {duck.EV}, o as (select event_id, {_CLASSES}[event_id % 8 + 1] as c, event_id % 3 = 0 as moving from ev) select event_id, c as class, c in ({', '.join(repr(x) for x in R.ALWAYS)}) or (moving and c in ({', '.join(repr(x) for x in R.IF_MOVING)})) as must, {_WEIGHT} as weight from o")
def class_priorities(spark, d):
    name = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("event_id") % 8 + 1).cast("int"))
    rows = tables.timed_events(spark, d).select("event_id", name.alias("class"), R.class_priority(name, F.col("event_id") % 3 == 0).alias("p"))
    return rows.select("event_id", "class", F.col("p.must").alias("must"), F.col("p.weight").alias("weight"))


_AGENTS = ["Mozilla/5.0 (X11)", "Twitterbot/1.0", "", "WhatsApp/2.19", "Mozilla Googlebot/2.1", "curl/8", "Slackbot-LinkExpanding 1.0", "facebook/9", "Embedly/0.2", "Pinterestbot", "a bot", "W3C_Validator/1.3"]


@register("sf44_crawlers", f"with a as (select event_id, [{', '.join(repr(x) for x in _AGENTS)}][event_id % {len(_AGENTS)} + 1] as agent from events) select event_id, len(list_filter([{', '.join(repr(x) for x in R.CRAWLERS)}], lambda c: contains(lower(agent), c))) > 0 as crawler from a")
def crawlers(spark, d):
    agent = F.element_at(F.array(*map(F.lit, _AGENTS)), (F.col("event_id") % len(_AGENTS) + 1).cast("int"))
    return tables.load(spark, d, "events").select("event_id", R.is_crawler(agent).alias("crawler"))


@register("sf48_whole_numbers", "select l_orderkey as job_id, l_linenumber as clip_id, trunc(l_extendedprice)::bigint as a, trunc(-l_discount * 100)::bigint as b from lineitem")
def whole_numbers(spark, d):
    found = R.whole_numbers(F.array(F.col("l_extendedprice").cast("double"), -F.col("l_discount").cast("double") * 100))
    return tables.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("clip_id"), F.get(found, F.lit(0)).alias("a"), F.get(found, F.lit(1)).alias("b"))


@register("jn47_free_tier", f"with {duck.JOBS}, u as (select job_id, [case when provider like '1%' then 'x:free' when provider like '5%' then 'ollama' else provider end, 'paid'] as models from jobs) select job_id, len(list_filter(models, lambda m: contains(m, 'free') or m = 'ollama')) > 0 as free from u")
def free_tier(spark, d):
    p = F.col("provider")
    used = F.create_map(F.lit("text"), F.when(p.startswith("1"), "x:free").when(p.startswith("5"), "ollama").otherwise(p), F.lit("vision"), F.lit("paid"))
    return tables.jobs(spark, d).select("job_id", R.free_tier(used).alias("free"))


@register("pf08_active_exports", f"with {duck.CLIPS} select job_id, clip_id, platform from clips where kind <> 'F'")
def active_exports(spark, d):
    return tables.clips(spark, d).filter("kind <> 'F'").select("job_id", "clip_id", "platform")


@register("pf16_updated_scenes", f"with {duck.SCENES} select job_id, event_id, case when event_id % 2 = 0 then greatest(1, least(10, importance + (event_id % 7 - 3) * 3)) else importance end as importance, case when event_id % 3 = 0 then greatest(0, least(100, subject_x + event_id % 41 - 20)) else subject_x end as subject_x from scenes")
def updated_scenes(spark, d):
    """Patches of scenes, clamped to 1..10 and 0..100; what a patch doesn't name stays."""
    new_importance = F.when(F.col("event_id") % 2 == 0, F.col("importance") + (F.col("event_id") % 7 - 3) * 3)
    new_x = F.when(F.col("event_id") % 3 == 0, F.col("subject_x") + F.col("event_id") % 41 - 20)
    clamp = lambda v, low, high: F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))
    return tables.scenes(spark, d).select("job_id", "event_id", F.coalesce(clamp(new_importance, 1, 10), "importance").alias("importance"), F.coalesce(clamp(new_x, 0, 100), "subject_x").cast("double").alias("subject_x"))


@register("pf17_scene_deleted", f"with {duck.SCENES}, r as (select job_id, event_id, t, row_number() over (partition by job_id order by t, event_id) - 1 as i from scenes), n as (select job_id, count(*) as n from r group by 1) select job_id, event_id, (row_number() over (partition by job_id order by t, event_id) - 1)::int as i from r join n using (job_id) where i <> job_id % n")
def scene_deleted(spark, d):
    """Each job's scenes as an array, less the one at a place; the others close up."""
    rows = tables.scenes(spark, d).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("s"))
    left = F.filter("s", lambda _, i: i != F.col("job_id") % F.size("s"))
    return rows.select("job_id", F.posexplode(left).alias("i", "x")).select("job_id", F.col("x.event_id").alias("event_id"), "i")


@register("pf24_log_search", "select event_id, event_type from events where event_type = 'click' and contains(lower(coalesce(props, '')), 'k')")
def log_search(spark, d):
    return tables.load(spark, d, "events").filter((F.col("event_type") == "click") & F.contains(F.lower(F.coalesce("props", F.lit(""))), F.lit("k"))).select("event_id", "event_type")


@register(
    "pf26_merged_detections",
    f"""with recursive {duck.FACES}, own as (select job_id, event_id, list(x order by k) filter (where k = 0) as xs, list(x order by k) filter (where k > 0) as more from faces group by all),
    step(job_id, event_id, xs, more) as (select job_id, event_id, coalesce(xs, []), coalesce(more, []) from own union all select job_id, event_id, case when len(list_filter(xs, lambda p: abs(more[1] - p) < 10)) > 0 then xs else list_append(xs, more[1]) end, more[2:] from step where len(more) > 0)
    select job_id, event_id, len(xs)::int as n, round(list_sum(xs), 3) as total from step where len(more) = 0""",
)
def merged_detections(spark, d):
    """The first face of a frame from one detector, the others from a second: those are kept that stand ten and more from
    every face kept before."""
    frames = tables.dense_faces(spark, d).groupBy("job_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("f"))
    first = F.transform(F.filter("f", lambda s: s["k"] == 0), lambda s: s["x"])
    kept = F.aggregate(F.filter("f", lambda s: s["k"] > 0), first, lambda xs, s: F.when(F.exists(xs, lambda p: F.abs(p - s["x"]) < 10), xs).otherwise(F.concat(xs, F.array(s["x"]))))
    return frames.select("job_id", "event_id", F.size(kept).alias("n"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


_CALLS = "calls as (select user_id as job_id, event_id, epoch_us(ts) / 1e6 / 3600e0 as s from events)"
_KEPT = "list_filter(f.stamps, lambda x: n.s - x < 60e0)"
_SPACED = f"greatest(n.s, case when len({_KEPT}) > 0 then list_last({_KEPT}) + 3e0 else n.s end)"
_ADMITTED = f"case when len({_KEPT}) >= 18 then greatest({_SPACED}, {_SPACED} + 60e0 - (n.s - ({_KEPT})[1])) else {_SPACED} end"


@register("rt07_admitted", f"with recursive {_CALLS}, {duck.fold('calls', 's, event_id', {'at_': 'n.s', 'stamps': '[n.s]'}, {'at_': _ADMITTED, 'stamps': f'list_append({_KEPT}, {_ADMITTED})'})} select job_id, event_id, round(at_ - s, 3) as waited from f")
def admitted(spark, d):
    """How long each call waits: calls let through stay in a list for a minute; the next keeps 3 s from the last of them,
    and waits for the oldest to leave where there are 18. An hour of the data counts as a second."""
    calls = tables.load(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0).alias("s"))
    return D.fold(calls, "job_id", ["s", "event_id"], D.admitted, "job_id long, event_id long, waited double")


_ALPHA = "least(0.3e0, 1e0 / (f.samples + 1))"


@register(
    "rt08_speeds",
    f"""with recursive {duck.EV}, m as (select job_id, event_id, t, 100 + event_id % 900 as prompt, 1 + event_id % 300 as eval_tokens, 0.5e0 + event_id % 17 as elapsed from ev),
    {duck.fold("m", "t, event_id", {"gen": "n.eval_tokens / n.elapsed", "samples": "1"}, {"gen": f"f.gen * (1 - {_ALPHA}) + n.eval_tokens / n.elapsed * {_ALPHA}", "samples": "f.samples + 1"})}
    select job_id, samples, round(gen, 6) as gen from (select *, max(rn) over (partition by job_id) as l from f) where rn = l""",
)
def speeds(spark, d):
    """Measured speed per job, each sample weighted by 1 / (n + 1), at most .3."""
    rows = tables.timed_events(spark, d).select("job_id", "t", "event_id", ((1 + F.col("event_id") % 300) / (0.5 + F.col("event_id") % 17)).alias("v"))
    held = rows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "v"))).alias("a"))
    start = F.struct(F.lit(0.0).alias("gen"), F.lit(0).alias("samples"))
    alpha = lambda s: F.least(F.lit(0.3), 1.0 / (s["samples"] + 1))
    new = F.aggregate("a", start, lambda s, x: F.struct(F.when(s["samples"] == 0, x["v"]).otherwise(s["gen"] * (1 - alpha(s)) + x["v"] * alpha(s)).alias("gen"), (s["samples"] + 1).alias("samples")))
    return held.select("job_id", new.alias("s")).select("job_id", F.col("s.samples").alias("samples"), F.round("s.gen", 6).alias("gen"))


@register("rt06_still_degraded", "with recursive bad as (select user_id as job_id, event_id, epoch_us(ts) / 1e6 as s from events where event_type = 'error'), " + duck.fold("bad", "s, event_id", {"recent": "[n.s]", "until": "null::double"}, {"recent": "list_append(list_filter(f.recent, lambda s: n.s - s <= 86400e0), n.s)", "until": "case when len(list_append(list_filter(f.recent, lambda s: n.s - s <= 86400e0), n.s)) >= 3 then n.s + 3600e0 else f.until end"}) + ", e as (select max(epoch_us(ts) / 1e6) as now from events) select job_id, coalesce(arg_max(until, rn) filter (where until is not null) > (select now - 432000 from e), false) as degraded from f group by job_id")
def still_degraded(spark, d):
    """Whether a provider's last degradation reaches beyond five days before the end of the data."""
    events = tables.load(spark, d, "events").select("event_type", F.col("user_id").alias("job_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    rows = D.fold(events.filter("event_type = 'error'").drop("event_type"), "job_id", ["s", "event_id"], lambda r: D.breaker(r, 3, 86_400.0, 3600.0), "job_id long, event_id long, s double, n int, until double")
    last = rows.groupBy("job_id").agg(F.max("until").alias("until"))
    now = events.agg((F.max("s") - 432_000).alias("now"))  # one row
    return last.crossJoin(F.broadcast(now)).select("job_id", F.coalesce(F.col("until") > F.col("now"), F.lit(False)).alias("degraded"))


@register(
    "sc18_received_chunks",
    """with c as (select doc_id % 40 as upload_id, doc_id // 40 as chunk, coalesce(text, '') as data, case when doc_id % 2 = 1 then sha256(coalesce(text, '')) || case when doc_id % 11 = 0 then 'x' else '' end end as sha, doc_id % 2 = 0 as by_crc, doc_id % 11 = 0 as crc_off from documents), g as (select upload_id, chunk, octet_length(encode(data)) as size from c where case when by_crc then not crc_off else sha = sha256(data) end),
    t as (select upload_id, count(*) as total from c group by 1), n as (select upload_id, count(*) as n, sum(size)::bigint as bytes from g group by 1)
    select upload_id, coalesce(n, 0) as n, coalesce(bytes, 0) as bytes, round(coalesce(n, 0) / total * 100, 1) as percent, coalesce(n, 0) = total as complete from t left join n using (upload_id)""",
)
def received_chunks(spark, d):
    """Documents as chunks of forty uploads: half come with a CRC and half with a digest, every eleventh with a wrong one,
    and every third comes twice."""
    docs = tables.load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("data"))
    bad, even = F.col("doc_id") % 11 == 0, F.col("doc_id") % 2 == 0
    crc = F.when(even, (F.crc32(F.col("data").cast("binary")) + bad.cast("long")).cast("string"))
    sha = F.when(~even, F.concat(F.sha2("data", 256), F.when(bad, "x").otherwise("")))
    chunks = docs.select((F.col("doc_id") % 40).alias("upload_id"), F.floor(F.col("doc_id") / 40).alias("chunk"), "data", crc.alias("crc"), sha.alias("sha"), F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("seq"))
    totals = chunks.groupBy("upload_id").agg(F.countDistinct("chunk").alias("total"))
    return U.received(chunks, totals)
