"""Queries: identities over embeddings, boxes and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import identity as Y
from rivulet.operators import intervals as I
from rivulet.plans.registry import register
from rivulet.sources import tables


def faces(spark, d):
    return tables.load(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding", F.floor(F.col("vec_id") / 4).alias("frame"))


_CENT = "c as (select label, list(e order by i) as v from (select label::bigint as label, i, avg(e::double) as e from (select label, unnest(embedding) as e, unnest(range(1, 65)) as i from embeddings) group by all) group by 1)"


@register("st12_identities", f"with {_CENT} select vec_id, case when s > 0.2e0 then label else -1 end as identity, round(s, 4) as cosine from (select vec_id, c.label, round(list_cosine_similarity(embedding::double[], v), 9) as s, row_number() over (partition by vec_id order by round(list_cosine_similarity(embedding::double[], v), 9) desc, c.label) as r from embeddings, c) where r = 1")
def identities(spark, d):
    rows = faces(spark, d)
    return Y.nearest_centroid(rows, Y.centroids(rows, "label", "embedding"), "vec_id", "label", "embedding", 0.2)


@register(
    "st12_identities_or_slots",
    f"""with {_CENT}, n as (select vec_id, c.label, round(list_cosine_similarity(embedding::double[], v), 9) as s, abs(vec_id * 13 % 101 - c.label * 17 % 101) as far from embeddings, c)
    select vec_id, case when max(s) > 0.2e0 then arg_max(label, (s, -label)) else arg_min(label, (far, label)) end as identity from n group by vec_id""",
)
def identities_or_slots(spark, d):
    """The identity of nearest centroid, or, where none is near enough, the slot whose place is nearest to the face's."""
    rows = faces(spark, d)
    found = Y.nearest_centroid(rows, Y.centroids(rows, "label", "embedding"), "vec_id", "label", "embedding", 0.2)
    slots = rows.select(F.col("label").cast("long").alias("slot")).distinct().withColumn("x", F.col("slot") * 17 % 101)
    return Y.or_nearest_slot(found.withColumn("x", F.col("vec_id") * 13 % 101), slots, "vec_id")


@register("st11_frame_pairs", "select a.vec_id // 4 as frame, a.vec_id, b.vec_id as other, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as cosine from embeddings a join embeddings b on a.vec_id // 4 = b.vec_id // 4 and a.vec_id < b.vec_id where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) >= 0.1e0")
def frame_pairs(spark, d):
    return Y.pairs_within(faces(spark, d), "frame", "vec_id", "embedding", 0.1)


@register("st17_histogram_distance", "select vec_id, round(sqrt(greatest(0, 1 - list_sum(list_transform(range(1, 33), lambda i: sqrt(abs(embedding[i]::double) * abs(embedding[i + 32]::double)))) / sqrt(list_sum(list_transform(embedding[1:32], lambda x: abs(x::double))) * list_sum(list_transform(embedding[33:64], lambda x: abs(x::double)))))), 5) as distance from embeddings")
def histogram_distance(spark, d):
    half = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: F.abs(x.cast("double")))
    return faces(spark, d).select("vec_id", F.round(Y.bhattacharyya(half(1), half(33)), 5).alias("distance"))


@register("st18_merged_signature", "select vec_id, i::int as i, round(0.7e0 * embedding[i]::double + 0.3e0 * embedding[i + 32]::double, 6) as value from (select vec_id, embedding, unnest(range(1, 33)) as i from embeddings)")
def merged_signature(spark, d):
    """The halves of every vector, weighted .7 and .3, value by value."""
    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    merged = F.zip_with(a, b, lambda x, y: 0.7 * x.cast("double") + 0.3 * y.cast("double"))
    return faces(spark, d).select("vec_id", F.posexplode(merged).alias("p", "v")).select("vec_id", (F.col("p") + 1).alias("i"), F.round("v", 6).alias("value"))


_BOX = "b as (select event_id, (event_id * 37 % 101)::double as x, (event_id * 17 % 101)::double as y, (10 + event_id % 30)::double as w, (10 + event_id % 20)::double as h from events)"


@register("jn38_box_overlap", f"with {_BOX}, p as (select *, greatest(0, least(x + w / 2, 50 + 30) - greatest(x - w / 2, 50 - 30)) as ix, greatest(0, least(y + h / 2, 50 + 20) - greatest(y - h / 2, 50 - 20)) as iy from b) select event_id, round(ix * iy / (w * h + 60 * 40 - ix * iy), 6) as iou from p")
def box_overlap(spark, d):
    e = F.col("event_id")
    box = [(e * 37 % 101).cast("double"), (e * 17 % 101).cast("double"), (10 + e % 30).cast("double"), (10 + e % 20).cast("double")]
    other = [F.lit(50.0), F.lit(50.0), F.lit(60.0), F.lit(40.0)]
    return tables.load(spark, d, "events").select("event_id", F.round(I.iou(box, other), 6).alias("iou"))


@register("pf28_box_edges", f"with {_BOX} select event_id, x - w / 2 as l, x + w / 2 as r, y - h / 2 as t, y + h / 2 as b from b")
def box_edges(spark, d):
    e = F.col("event_id")
    x, y, w, h = (e * 37 % 101).cast("double"), (e * 17 % 101).cast("double"), (10 + e % 30).cast("double"), (10 + e % 20).cast("double")
    return tables.load(spark, d, "events").select("event_id", (x - w / 2).alias("l"), (x + w / 2).alias("r"), (y - h / 2).alias("t"), (y + h / 2).alias("b"))


@register("sm10_nearest_slot", f"with {_BOX} select event_id, case when abs(x - 25) <= abs(x - 50) and abs(x - 25) <= abs(x - 75) then 0 when abs(x - 50) <= abs(x - 75) then 1 else 2 end as slot from b")
def nearest_slot(spark, d):
    x = (F.col("event_id") * 37 % 101).cast("double")
    best = F.array_min(F.array(*[F.struct(F.abs(x - c).alias("d"), F.lit(i).alias("s")) for i, c in enumerate((25.0, 50.0, 75.0))]))
    return tables.load(spark, d, "events").select("event_id", best["s"].alias("slot"))


@register("sm09_dominant_face", "select frame, vec_id from (select vec_id // 4 as frame, vec_id, row_number() over (partition by vec_id // 4 order by round(0.35e0 * (label % 7) + 0.25e0 * (vec_id % 5) + 0.15e0 * (vec_id % 3) + 0.25e0 * (vec_id % 2), 6) desc, vec_id) as r from embeddings) where r = 1")
def dominant_face(spark, d):
    v = F.col("vec_id")
    score = F.round(0.35 * (F.col("label") % 7) + 0.25 * (v % 5) + 0.15 * (v % 3) + 0.25 * (v % 2), 6)
    return faces(spark, d).groupBy("frame").agg(F.max_by("vec_id", F.struct(score, -v)).alias("vec_id"))
