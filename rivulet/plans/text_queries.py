"""Queries: text rules, lexicons, n-grams, time codes, parsing and formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rivulet.functions import text as X
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.plans.zones import _REACTS, SHOUTS
from rivulet.sources import tables


def docs(spark, d):
    return tables.load(spark, d, "documents").select("doc_id", "text")


_WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
_SRT = "printf('%02d:%02d:%02d,%03d', (floor({0}) // 3600)::bigint, (floor({0})::bigint % 3600) // 60, floor({0})::bigint % 60, floor(({0} - floor({0})) * 1000)::bigint)"


@register("sk04_srt", f"with {duck.seg()} select job_id, seq, (seq + 1)::varchar || chr(10) || {_SRT.format('t0')} || ' --> ' || {_SRT.format('t1')} || chr(10) || '[' || speaker || '] ' || trim(replace(text, chr(10), ' ')) as block from seg where trim(text) <> ''")
def srt(spark, d):
    rows = tables.segments(spark, d).filter(F.trim("text") != "")
    head = F.concat((F.col("seq") + 1).cast("string"), F.lit("\n"), X.srt_time(F.col("t0")), F.lit(" --> "), X.srt_time(F.col("t1")), F.lit("\n"))
    return rows.select("job_id", "seq", F.concat(head, F.lit("["), F.col("speaker"), F.lit("] "), F.trim(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("block"))


@register("sk05_srt_time", f"with {duck.seg()} select job_id, seq, {_SRT.format('t0')} as code from seg")
def srt_time(spark, d):
    return tables.segments(spark, d).select("job_id", "seq", X.srt_time(F.col("t0")).alias("code"))


@register("sk07_vtt_time", f"with {duck.seg()} select job_id, seq, printf('%02d:%02d:', (floor(t0) // 3600)::bigint, (floor(t0)::bigint % 3600) // 60) || lpad(printf('%.3f', t0 - floor(t0 / 60) * 60), 6, '0') as code from seg")
def vtt_time(spark, d):
    return tables.segments(spark, d).select("job_id", "seq", X.vtt_time(F.col("t0")).alias("code"))


@register("sk10_ass_time", f"with {duck.seg()}, c as (select *, floor(greatest(0, t0 - 3) * 100 + 1e-6)::bigint as c from seg) select job_id, seq, printf('%d:%02d:%02d.%02d', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100) as code, round(c / 100, 2) as back from c")
def ass_time(spark, d):
    code = X.ass_time(F.col("t0") - 3)
    return tables.segments(spark, d).select("job_id", "seq", code.alias("code"), X.seconds_of_ass(code).alias("back"))


@register("sf11_ass_color", "select p_partkey, '&H00' || upper(substr(h, 5, 2)) || upper(substr(h, 3, 2)) || upper(substr(h, 1, 2)) as color from (select p_partkey, printf('%06x', p_partkey * 7919 % 16777216) as h from part)")
def ass_color(spark, d):
    h = F.format_string("#%06x", F.col("p_partkey") * 7919 % 16777216)
    return tables.load(spark, d, "part").select("p_partkey", X.ass_color(h).alias("color"))


@register("sf45_masked_key", "select p_partkey, case when length(p_name) > 12 then left(p_name, 10) || '...' || right(p_name, 4) else left(p_name, 4) || '...' end as masked from part")
def masked_key(spark, d):
    return tables.load(spark, d, "part").select("p_partkey", X.mask_key(F.col("p_name")).alias("masked"))


@register("sf46_content_hash", "select doc_id, sha256(text) as h from documents")
def content_hash(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("h"))


@register("ts06_transcript_energy", rf"select doc_id, contains(text, '!') as loud, contains(text, '?') as asks, {SHOUTS} as shouts, ({_REACTS}) as reacts, len({_WORDS.format('text')})::int as n_words from documents")
def transcript_energy(spark, d):
    return docs(spark, d).select("doc_id", X.has("!").alias("loud"), X.has("?").alias("asks"), X.shouts(F.col("text")).alias("shouts"), X.reacts(F.col("text")).alias("reacts"), F.size(X.words(F.col("text"))).alias("n_words"))


@register(
    "st06_loop_texts",
    f"""with w as (select doc_id, {_WORDS.format("lower(text)")} as w from documents), g as (select doc_id, len(w) as n, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 9),
    c as (select doc_id, n, g, count(*) as c from g group by all), m as (select doc_id, n, max(c) as m from c group by all) select doc_id, m::int as most from m where m >= 3 and m > 0.4e0 * (n - 2)""",
)
def loop_texts(spark, d):
    """A text loops if one three-word run makes over 40 % of all."""
    size = F.size(X.words(F.lower("text")))
    grams = X.bound(X.words(F.lower("text")), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " ")))
    rows = docs(spark, d).select("doc_id", size.alias("size"), F.when(size >= 9, grams).alias("grams"))
    most = rows.select("doc_id", (F.col("size") - 2).alias("n"), F.explode("grams").alias("g")).groupBy("doc_id", "n", "g").count().groupBy("doc_id", "n").agg(F.max("count").alias("m"))
    return most.filter((F.col("m") >= 3) & (F.col("m") > 0.4 * F.col("n"))).select("doc_id", F.col("m").cast("int").alias("most"))


@register(
    "st06_near_repeats",
    f"""with {duck.seg()}, w as (select job_id, seq, t0, list_distinct({_WORDS.format("lower(text)")}) as w from seg)
    select a.job_id, a.seq, count(*) as n from w a join w b on a.job_id = b.job_id and b.seq < a.seq and b.seq >= a.seq - 10 and a.t0 - b.t0 between 2 and 30 and len(list_intersect(a.w, b.w)) > 0.7e0 * len(list_distinct(list_concat(a.w, b.w))) group by all""",
)
def near_repeats(spark, d):
    """Segments that share over 70 % of their words with one of the ten before, 2 to 30 seconds earlier."""
    w = tables.segments(spark, d).select("job_id", "seq", "t0", F.array_distinct(X.words(F.lower("text"))).alias("w"))
    # a segment finds the ten before it by equality on their numbers
    b = w.select("job_id", F.explode(F.sequence(F.col("seq") + 1, F.col("seq") + 10)).alias("seq"), F.col("t0").alias("u0"), F.col("w").alias("v"))
    pairs = w.join(b, ["job_id", "seq"]).filter((F.col("t0") - F.col("u0")).between(2, 30) & (F.size(F.array_intersect("w", "v")) > 0.7 * F.size(F.array_union("w", "v"))))
    return pairs.groupBy("job_id", "seq").agg(F.count(F.lit(1)).alias("n"))


@register("sf02_content_guidance", "select doc_id, case when regexp_matches(lower(text), 'interview|podcast') then 'talk' when regexp_matches(lower(text), 'game|match|play') then 'play' when regexp_matches(lower(text), 'the|of') then 'english' else 'other' end as kind from documents")
def content_guidance(spark, d):
    low = F.lower("text")
    return docs(spark, d).select("doc_id", F.when(low.rlike("interview|podcast"), "talk").when(low.rlike("game|match|play"), "play").when(low.rlike("the|of"), "english").otherwise("other").alias("kind"))


@register("sf33_titles", "select page_id, regexp_extract(html, '<title>([^<]*)', 1) as title, len(regexp_extract_all(html, '<p>'))::int as n_p from pages")
def titles(spark, d):
    return tables.load(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("n_p"))


@register("sf30_json_field", "select event_id, (props::json ->> 'k')::int as k from events")
def json_field(spark, d):
    return tables.load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("sf34_placeholders", "select doc_id, text is null or trim(text) = '' or regexp_matches(lower(trim(text)), '^(n/?a|none|null|todo|tbd|unknown|\\.+|-+|<.*>|\\[.*\\])$') as empty_like from documents")
def placeholders(spark, d):
    return docs(spark, d).select("doc_id", X.placeholder(F.col("text")).alias("empty_like"))


@register("sf36_positions", r"select p_partkey, case when regexp_matches(lower(p_name), 'far left') then 15 when regexp_matches(lower(p_name), 'far right') then 85 when regexp_matches(lower(p_name), '\bleft\b') then 30 when regexp_matches(lower(p_name), '\bright\b') then 70 else 50 end as x from part")
def positions(spark, d):
    return tables.load(spark, d, "part").select("p_partkey", X.position_in_text(F.col("p_name")).alias("x"))


@register(
    "sf37_truncated",
    """with h as (select doc_id, text, left(text, 200) as h from documents), p as (select *, length(h) - strpos(reverse(h), chr(10)) + 1 as nl, length(h) - strpos(reverse(h), '.') + 1 as dot, contains(h, chr(10)) as has_nl, contains(h, '.') as has_dot from h)
    select doc_id, case when length(text) <= 200 then text when (has_nl or has_dot) and greatest(case when has_nl then nl else 0 end, case when has_dot then dot else 0 end) > 140 then left(h, greatest(case when has_nl then nl else 0 end, case when has_dot then dot else 0 end)) else h end as cut from p""",
)
def truncated(spark, d):
    return docs(spark, d).select("doc_id", X.truncate_at_boundary(F.col("text"), 200).alias("cut"))


@register("sf07_word_times", rf"with {duck.seg()}, w as (select job_id, seq, t0, t1, {_WORDS.format('text')} as w from seg where n_words > 0), e as (select job_id, seq, t0, t1, w, unnest(range(1, len(w) + 1)) as i from w), s as (select *, list_sum(list_transform(w[:i], lambda x: length(x))) as upto, list_sum(list_transform(w, lambda x: length(x))) as every from e) select job_id, seq, i::int as i, w[i] as word, round(t0 + (t1 - t0) * upto / every, 7) as t1 from s")
def word_times(spark, d):
    """Words laid out over a segment in proportion to their letters."""
    rows = tables.segments(spark, d).filter("n_words > 0").select("job_id", "seq", "t0", "t1", F.posexplode(X.words(F.col("text"))).alias("p", "word"))
    w = Window.partitionBy("job_id", "seq")
    upto = F.sum(F.length("word")).over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum(F.length("word")).over(w)
    return rows.select("job_id", "seq", (F.col("p") + 1).alias("i"), "word", F.round(F.col("t0") + (F.col("t1") - F.col("t0")) * upto / every, 7).alias("t1"))


@register(
    "sf09_split_by_words",
    rf"""with {duck.seg()}, w as (select job_id, seq, t0, t1, {_WORDS.format('text')} as w from seg where n_words > 0), c as (select *, unnest(range(0, len(w), 6)) as o from w),
    p as (select job_id, seq, (o // 6)::int as part, array_to_string(w[o + 1:o + 6], ' ') as text, t0 + (t1 - t0) * o / len(w) as p0, case when o + 6 >= len(w) then t1 else t0 + (t1 - t0) * (o + 6) / len(w) end as p1, len(w) as n from c)
    select job_id, seq, part, text, round(p0, 6) as t0, round(p1, 6) as t1 from p where n <= 6 or round(p1 - p0, 9) >= 0.1e0""",
)
def split_by_words(spark, d):
    """Parts of six words with even shares of the segment's time, the last to its end; parts under a tenth of a second go."""
    rows = tables.segments(spark, d).filter("n_words > 0").withColumn("w", X.words(F.col("text")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(6))))
    n, length = F.size("w"), F.col("t1") - F.col("t0")
    start = F.col("t0") + length * F.col("o") / n
    end = F.when(F.col("o") + 6 >= n, F.col("t1")).otherwise(F.col("t0") + length * (F.col("o") + 6) / n)
    rows = rows.filter((n <= 6) | (F.round(end - start, 9) >= 0.1))
    return rows.select("job_id", "seq", F.floor(F.col("o") / 6).cast("int").alias("part"), F.array_join(F.slice("w", F.col("o") + 1, F.lit(6)), " ").alias("text"), F.round(start, 6).alias("t0"), F.round(end, 6).alias("t1"))


@register("st22_emphasis_words", rf"with w as (select doc_id, unnest(list_distinct({_WORDS.format('text')})) as w from documents), k as (select doc_id, w, row_number() over (partition by doc_id order by w) as r from w where regexp_matches(w, '^[A-Z]{{3,}}[!.]*$')) select doc_id, w from k where r <= 20")
def emphasis_words(spark, d):
    w = docs(spark, d).select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("w")).filter(F.col("w").rlike("^[A-Z]{3,}[!.]*$"))
    return w.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("w"))).filter("r <= 20").select("doc_id", "w")


@register("st23_normalised_tags", "select o_orderkey, array_to_string(list_sort(list_distinct(['#' || lower(replace(o_orderpriority, ' ', '')), '#' || lower(o_orderstatus), '#o'])), ' ') as tags from orders")
def normalised_tags(spark, d):
    tag = lambda c: F.concat(F.lit("#"), F.lower(F.replace(c, F.lit(" "), F.lit(""))))
    tags = F.array_sort(F.array_distinct(F.array(tag(F.col("o_orderpriority")), tag(F.col("o_orderstatus")), F.lit("#o"))))
    return tables.load(spark, d, "orders").select("o_orderkey", F.array_join(tags, " ").alias("tags"))


@register("ag30_summary_prefix", f"with {duck.seg()}, s as (select *, sum(length(text) + 1) over (partition by job_id order by seq) as upto from seg) select job_id, count(*) as n, sum(length(text)) as chars from s where upto <= 600 group by 1")
def summary_prefix(spark, d):
    """The leading segments whose texts fit 600 characters."""
    upto = F.sum(F.length("text") + 1).over(Window.partitionBy("job_id").orderBy("seq"))
    return tables.segments(spark, d).withColumn("upto", upto).filter("upto <= 600").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@register("sf24_even_pixels", f"with {duck.SPK}, p as (select event_id, round_even(confidence * 1081, 0) as px from spk) select event_id, least(greatest(px - px % 2, 0), 1081)::int as px from p")
def even_pixels(spark, d):
    return tables.speaker_events(spark, d).select("event_id", X.even_pixels(F.col("confidence"), 1081).alias("px"))


@register("sf19_safe_x", f"with {duck.SCENES} select event_id, greatest(15.8e0, least(84.2e0, subject_x)) as x, case when subject_x < 35 then 'left' when subject_x > 65 then 'right' else 'center' end as gaze from scenes")
def safe_x(spark, d):
    x = F.col("subject_x")
    return tables.scenes(spark, d).select("event_id", F.greatest(F.lit(15.8), F.least(F.lit(84.2), x)).alias("x"), F.when(x < 35, "left").when(x > 65, "right").otherwise("center").alias("gaze"))


@register("sf27_fallback_strategy", f"with {duck.SPK} select event_id, case when confidence >= 0.7e0 then 'track' when confidence >= 0.5e0 then 'hold' when confidence >= 0.3e0 then 'wide' else 'center' end as strategy from spk")
def fallback_strategy(spark, d):
    c = F.col("confidence")
    return tables.speaker_events(spark, d).select("event_id", F.when(c >= 0.7, "track").when(c >= 0.5, "hold").when(c >= 0.3, "wide").otherwise("center").alias("strategy"))
