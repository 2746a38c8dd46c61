"""Queries: reading models' answers and caption files, transcripts as text, speeds as filter chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import parse as P
from rivulet.functions import text as X
from rivulet.operators import scoring as S
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.plans.text_queries import _SRT
from rivulet.plans.zones import MOMENTS
from rivulet.sources import tables

_FENCE = "```"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# answers about the first words of every document: plain, fenced in three ways, cut off, of another length, and no array
ANSWERS = rf"""words as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[:3] as w from documents where text is not null),
arrays as (select doc_id, w, to_json(w)::varchar as a from words where len(w) = 3),
answers as (select doc_id, w, case doc_id % 7 when 0 then a when 1 then '{_FENCE}json' || chr(10) || a || chr(10) || '{_FENCE}' when 2 then '{_FENCE}' || a || '{_FENCE}' when 3 then '  ' || a || chr(10) when 4 then left(a, length(a) - 1) when 5 then '["x"]' else 'no answer' end as answer from arrays),
cleaned as (select doc_id, w, {_STRIP.format("regexp_replace(case when starts_with(s, '" + _FENCE + "') then case when contains(s, chr(10)) then regexp_replace(s, '^[^' || chr(10) || ']*' || chr(10), '') else substr(s, 4) end else s end, '" + _FENCE + "$', '')")} as c from (select *, {_STRIP.format("answer")} as s from answers))"""


def _answers(spark, d):
    w = F.slice(X.words(F.col("text")), 1, 3)
    rows = tables.load(spark, d, "documents").filter("text is not null").select("doc_id", w.alias("w")).filter(F.size("w") == 3)
    a = F.to_json("w")
    kinds = [a, F.concat(F.lit(_FENCE + "json\n"), a, F.lit("\n" + _FENCE)), F.concat(F.lit(_FENCE), a, F.lit(_FENCE)), F.concat(F.lit("  "), a, F.lit("\n")), F.left(a, F.length(a) - 1), F.lit('["x"]')]
    answer = F.lit("no answer")
    for i, kind in enumerate(kinds):
        answer = F.when(F.col("doc_id") % 7 == i, kind).otherwise(answer)
    return rows.withColumn("answer", answer)


@register("sf05_corrections", f"with {ANSWERS} select doc_id, case when json_valid(c) and json_type(try_cast(c as json)) = 'ARRAY' and json_array_length(try_cast(c as json)) = 3 then array_to_string(w, ' ') end as corrected from cleaned")
def corrections(spark, d):
    return _answers(spark, d).select("doc_id", F.array_join(P.corrections(F.col("answer"), F.lit(3)), " ").alias("corrected"))


@register("sf08_translations", f"with {ANSWERS} select doc_id, case when json_valid(c) and json_type(try_cast(c as json)) = 'ARRAY' then json_array_length(try_cast(c as json))::int end as n, case when json_valid(c) then json_extract_string(c::json, '$[0]') end as first from cleaned")
def translations(spark, d):
    found = P.translations(F.col("answer"))
    return _answers(spark, d).select("doc_id", F.when(found.isNotNull(), F.size(found)).alias("n"), F.get(found, F.lit(0)).alias("first"))


@register("sf30_json_object", "select doc_id, case when doc_id % 6 <> 5 then doc_id end as n from documents where text is not null")
def json_object(spark, d):
    """Answers with thoughts, fences, raw line breaks in strings and text around the object: the title in it."""
    a = F.to_json(F.struct(F.left("text", F.lit(40)).alias("title"), F.col("doc_id").alias("n")))
    raw = F.replace(a, F.lit("\\n"), F.lit("\n"))
    kinds = [a, F.concat(F.lit("<think>{no} \n</think>\n"), a), F.concat(F.lit("```json\n"), raw, F.lit("\n```")), F.concat(F.lit("Here it is: "), raw, F.lit(" - done.")), F.concat(F.lit("<reasoning>unfinished "), a)]
    answer = F.lit("none")
    for i, kind in enumerate(kinds):
        answer = F.when(F.col("doc_id") % 6 == i, kind).otherwise(answer)
    rows = tables.load(spark, d, "documents").filter("text is not null").select("doc_id", answer.alias("answer"))
    return rows.select("doc_id", F.get_json_object(P.json_text(F.col("answer")), "$.n").cast("long").alias("n"))


@register("sf31_escaped_breaks", "select doc_id, true as same from documents where text is not null")
def escaped_breaks(spark, d):
    """Texts with their raw line breaks as a JSON string; what is mended parses to the text."""
    quoted = F.concat(F.lit('{"t": "'), F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"}\n'))
    rows = tables.load(spark, d, "documents").filter("text is not null").select("doc_id", "text", P.escaped_breaks(quoted).alias("json"))
    return rows.select("doc_id", F.get_json_object("json", "$.t").eqNullSafe(F.col("text")).alias("same"))


@register("sf32_partial_clips", f"with {duck.CLIPS} select job_id, greatest(count(*) - 1, 0)::int as n, case when count(*) > 1 then min(clip_id) end as first from clips group by job_id")
def partial_clips(spark, d):
    """Each order's clips as an answer that breaks off within the last one: all but that are found."""
    clip = F.struct(F.col("clip_id"), F.struct("t0", "t1").alias("span"), F.lit("a } [ b\n").alias("note"))
    every = F.to_json(F.array_sort(F.collect_list(clip)))
    rows = tables.clips(spark, d).groupBy("job_id").agg(every.alias("a"))
    answer = F.concat(F.lit('<think>"clips": [{}]</think>{"clips" : '), F.replace(F.regexp_replace("a", r'"note":"[^"]*"\}\]$', ""), F.lit("} [ "), F.lit("")))
    found = P.partial_objects(answer)
    return rows.select("job_id", F.size(found).alias("n"), F.get_json_object(F.get(found, F.lit(0)), "$.clip_id").cast("int").alias("first"))


@register(
    "sf35_real_summaries",
    r"""select doc_id, text is not null and not regexp_matches(lower(trim(text)), '^(n/?a|none|null|todo|tbd|unknown|\.+|-+|<.*>|\[.*\])$') and trim(text) <> '' and length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20
    and doc_id % 4 <> 0 as real_ from documents""",
)
def real_summaries(spark, d):
    """Texts as overviews; every fourth has placeholders for topics only."""
    topics = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("n/a"), F.lit("..."))).otherwise(F.array(F.lit("TBD"), F.lit("bridges")))
    return tables.load(spark, d, "documents").select("doc_id", F.coalesce(P.real_summary(F.col("text"), topics, X.placeholder), F.lit(False)).alias("real_"))


_CODE = "printf('%d:%02d:%02d.%02d', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100)"


def _captions(spark, d):
    """A caption file per job: a full style line, a short one, and a dialogue line per segment."""
    line = F.concat(F.lit("Dialogue: 0,"), X.ass_time(F.col("t0")), F.lit(","), X.ass_time(F.col("t1")), F.lit(",Main, "), F.col("speaker"), F.lit(",0,0,0,,"), F.replace("text", F.lit("\n"), F.lit(" ")))
    styles = "Style: Main , Sans,48," + ",".join(str(i) for i in range(20)) + "\nStyle: short,1,2\n"
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return tables.segments(spark, d).groupBy("job_id").agg(F.concat(F.lit(styles), F.array_join(lines, "\n")).alias("content"))


@register("sf14_dialogue", f"with {duck.seg()}, a as (select job_id, seq, speaker, replace(text, chr(10), ' ') as line, floor(t0 * 100 + 1e-6)::bigint as c, floor(t1 * 100 + 1e-6)::bigint as e from seg) select job_id, {_CODE} as start, round(e / 100, 2) as end_s, speaker as name, length(regexp_replace(line, '\\s+$', '')) as n_chars from a")
def dialogue(spark, d):
    rows = _captions(spark, d).select("job_id", F.explode(P.dialogue_lines(F.col("content"))).alias("e"))
    return rows.select("job_id", F.col("e.Start").alias("start"), X.seconds_of_ass(F.col("e.End")).alias("end_s"), F.col("e.Name").alias("name"), F.length("e.Text").cast("long").alias("n_chars"))


@register("sf15_styles", "select distinct conv_id as job_id, 1 as n, 'Main' as name, 'Sans' as font, '19' as encoding from conversations")
def styles(spark, d):
    found = P.style_lines(F.col("content"))
    rows = _captions(spark, d).select("job_id", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("s"))
    return rows.select("job_id", "n", F.col("s")["Name"].alias("name"), F.col("s")["Fontname"].alias("font"), F.col("s")["Encoding"].alias("encoding"))


@register(
    "sf16_tempo_chain",
    """with s as (select l_orderkey as job_id, l_linenumber as clip_id, l_quantity / 7e0 as speed from lineitem), n as (select *, len(list_filter(range(1, 41), lambda i: speed > pow(2e0, i))) as up, len(list_filter(range(1, 41), lambda i: speed < pow(2e0, -i))) as down from s),
    r as (select *, speed * pow(2e0, down - up) as rest from n) select job_id, clip_id, array_to_string(list_concat(list_transform(range(0, up), lambda i: 'atempo=2.0'), list_concat(list_transform(range(0, down), lambda i: 'atempo=0.5'), case when abs(rest - 1) > 0.001e0 then [printf('atempo=%.4f', rest)] else [] end)), ',') as chain from r""",
)
def tempo_chain(spark, d):
    line = tables.load(spark, d, "lineitem")
    return line.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("clip_id"), P.tempo_chain(F.col("l_quantity").cast("double") / 7.0).alias("chain"))


_VTT = "printf('%02d:%02d:', (floor({0}) // 3600)::bigint, (floor({0})::bigint % 3600) // 60) || lpad(printf('%.3f', {0} - floor({0} / 60) * 60), 6, '0')"


@register(
    "sk06_transcripts",
    f"""with {duck.seg()} select job_id, sha256(string_agg(seq + 1 || chr(10) || {_SRT.format("t0")} || ' --> ' || {_SRT.format("t1")} || chr(10) || '[' || speaker || '] ' || trim(replace(text, chr(10), ' ')), chr(10) || chr(10) order by seq) filter (where trim(text) <> '')) as srt,
    sha256('WEBVTT' || chr(10) || chr(10) || string_agg({_VTT.format("t0")} || ' --> ' || {_VTT.format("t1")} || chr(10) || speaker || ': ' || text || chr(10), chr(10) order by seq)) as vtt, sha256(string_agg('[' || speaker || '] ' || text, chr(10) order by seq)) as txt from seg group by job_id""",
)
def transcripts(spark, d):
    """Each job's transcript as SRT, VTT and plain text (digests)."""
    return tables.segments(spark, d).groupBy("job_id").agg(*[F.sha2(v, 256).alias(k) for k, v in X.transcript_forms().items()])


@register("sk12_energy_map", f"with {duck.EV}, {MOMENTS} select job_id, string_agg(printf('[%.0fs] %s (+%.0fdB)', t, case kind when 'volume_spike' then 'LOUD' when 'extreme_spike' then 'VERY LOUD' when 'silence_to_loud' then 'SILENCE->LOUD' else 'SPIKE' end, delta), chr(10) order by t, event_id) as map from moments group by job_id")
def energy_map(spark, d):
    return X.energy_lines(S.audio_moments(tables.timed_events(spark, d)))


@register("sk13_plan_json", f"with {duck.CLIPS} select job_id, '[' || string_agg('{{\"clip_id\":' || clip_id || ',\"span\":{{\"t0\":' || t0::bigint || ',\"t1\":' || t1::bigint || '}},\"platform\":\"' || platform || '\"}}', ',' order by clip_id, t0, t1) || ']' as plan from clips group by job_id")
def plan_json(spark, d):
    """Each order's clips as one compact JSON text."""
    op = F.struct("clip_id", F.struct(F.col("t0").cast("long").alias("t0"), F.col("t1").cast("long").alias("t1")).alias("span"), "platform")
    return tables.clips(spark, d).groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_list(op))).alias("plan"))
