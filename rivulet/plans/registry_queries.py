"""Queries: registries of faces and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import face_registry as R
from rivulet.plans import duck
from rivulet.plans.registry import register
from rivulet.sources import tables


@register("st10_face_registry")
def place_registry(spark, d):
    """The stable places of every job's faces; every seventh face isn't human."""
    faces = tables.dense_faces(spark, d)
    return R.place_registry(faces.select("job_id", F.col("event_id").alias("frame"), "k", "x", "w", "h", ((F.col("event_id") + F.col("k")) % 7 > 0).alias("human")))


def embedded_faces(spark, d):
    """The embedding table as faces: twelve jobs, three faces a frame, each vector pulled towards one of six people by its
    label, each person walking; every twentieth face has no embedding."""
    v, label = F.col("vec_id"), F.col("label").cast("int")
    rows = tables.load(spark, d, "embeddings").select("vec_id", "label", "embedding")
    person = label % 6
    pulled = F.transform(F.slice("embedding", 1, 16), lambda e, i: e.cast("double") * 0.2 + F.when(i == person, 1.0).otherwise(0.0))
    n = F.floor(v / 12)
    x = 8.0 + person * 15 + (n % 9) * 1.5
    return rows.select((v % 12).alias("job_id"), F.floor(n / 3).alias("frame"), (n % 3).alias("k"), x.alias("x"), (6.0 + v % 5).alias("w"), (8.0 + v % 4).alias("h"), F.lit(True).alias("human"), F.when(v % 20 > 0, pulled).alias("embedding"))


@register("st11_identity_registry")
def identity_registry(spark, d):
    return R.identity_registry(embedded_faces(spark, d))


_ROOT = "list_transform(v, lambda x: sqrt(x / greatest(list_sum(v), 1e-300)))"
_FAR = "list_transform(range(1, len(f.roots) + 1), lambda i: sqrt(greatest(0, 1 - list_inner_product(f.roots[i], n.root))))"
_NEAR = f"(n.root is not null and len(f.roots) > 0 and list_min({_FAR}) < 0.25e0)"


@register(
    "st15_persistent_identities",
    f"""with recursive tracks as (select vec_id % 20 as job_id, vec_id as track, case when vec_id % 17 > 0 then list_transform(embedding[1:8], lambda e: abs(e::double)) end as v from embeddings),
    r as (select job_id, track, {_ROOT} as root from tracks),
    {duck.fold("r", "track", {"roots": "case when n.root is null then [] else [n.root] end", "ids": "case when n.root is null then []::int[] else [0] end", "fresh": "1", "identity": "0"}, {"roots": "case when n.root is null then f.roots else list_append(f.roots, n.root) end", "ids": f"case when n.root is null then f.ids else list_append(f.ids, case when {_NEAR} then f.ids[list_position({_FAR}, list_min({_FAR}))] else f.fresh end) end", "fresh": f"case when {_NEAR} then f.fresh else f.fresh + 1 end", "identity": f"case when {_NEAR} then f.ids[list_position({_FAR}, list_min({_FAR}))] else f.fresh end"})}
    select job_id, track, identity from f""",
)
def persistent_identities(spark, d):
    """Eight entries of every vector as a track's signature; every seventeenth track has none."""
    v = F.col("vec_id")
    signature = F.when(v % 17 > 0, F.transform(F.slice("embedding", 1, 8), lambda e: F.abs(e.cast("double"))))
    return R.persistent_identities(tables.load(spark, d, "embeddings").select((v % 20).alias("job_id"), v.alias("track"), signature.alias("signature")), 0.25)
