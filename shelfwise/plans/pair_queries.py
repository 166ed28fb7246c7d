"""Duplicate and similar pictures and videos: pairs, components, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import constants as K
from shelfwise.operators import groups, pairs, scans
from shelfwise.operators.components import connected_components
from shelfwise.plans.registry import query
from shelfwise.plans.tables_sql import components
from shelfwise.session import settle
from shelfwise.sources.adapters import Tables

_EXACT = "select library_id, group_id, reason, similarity, members, newest from exact_groups"


@query(_EXACT)
def exact_duplicates(t: Tables) -> DataFrame:
    return groups.exact_duplicates(scans.images(t.assets), t.dhashes).orderBy(F.desc("newest"), "group_id")


@query("select library_id, group_id, unnest(members) as asset_id, len(members) as n from exact_groups")
def exact_members(t: Tables) -> DataFrame:
    return groups.exact_members(scans.images(t.assets), t.dhashes)


@query("select library_id, group_id, newest from exact_groups")
def newest_groups_first(t: Tables) -> DataFrame:
    return groups.exact_duplicates(scans.images(t.assets), t.dhashes).select("library_id", "group_id", "newest").orderBy(F.desc("newest"), "group_id")


@query("select library_id, group_id, members from exact_groups where len(members) >= 2")
def group_min_size(t: Tables) -> DataFrame:
    return groups.exact_duplicates(scans.images(t.assets), t.dhashes).where("size(members) >= 2").select("library_id", "group_id", "members")


_BURST = "select library_id, min(asset_id) as group_id, 'burstShot' as reason, list(asset_id order by creation_date, asset_id) as members from assets where media_type = 'image' and media_subtypes & 4 = 0 and burst_identifier is not null group by library_id, burst_identifier having count(*) >= 2"


@query(_BURST)
def burst_groups(t: Tables) -> DataFrame:
    return groups.burst_groups(scans.images(t.assets)).select("library_id", "group_id", "reason", "members")


@query(f"select library_id, a, b, round(d, 6) as distance from dist_pairs where same_bucket and d < {K.SIMILAR}")
def similar_pairs(t: Tables) -> DataFrame:
    return pairs.bucket_pairs(t.feature_prints).withColumn("distance", F.round("distance", 6))


@query(f"select library_id, a, b, round(d, 6) as distance from dist_pairs where d < {K.NEAR}")
def near_pairs(t: Tables) -> DataFrame:
    return pairs.pivot_pairs(t.feature_prints, K.NEAR).withColumn("distance", F.round("distance", 6))


@query()
def near_pairs_lsh(t: Tables) -> DataFrame:
    return pairs.lsh_pairs(t.feature_prints, K.NEAR).withColumn("distance", F.round("distance", 6))


_HASH = "select h.library_id, h.asset_id as a, g.asset_id as b from dhashes h join dhashes g on h.library_id = g.library_id and h.asset_id < g.asset_id join assets x on x.asset_id = h.asset_id and x.media_type = 'video' join assets y on y.asset_id = g.asset_id and y.media_type = 'video' where bit_count(xor(h.dhash, g.dhash)) <= 3"


def _video_hashes(t: Tables) -> DataFrame:
    return t.dhashes.join(t.assets.where("media_type = 'video'").select("asset_id"), "asset_id")


@query(_HASH)
def hash_pairs(t: Tables) -> DataFrame:
    return pairs.all_hash_pairs(_video_hashes(t))


_FRAMES = f"select a.library_id, a.asset_id as a, b.asset_id as b, avg(sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) as distance from video_prints a join video_prints b on a.library_id = b.library_id and a.frame_idx = b.frame_idx and a.asset_id < b.asset_id group by 1, 2, 3 having distance < {K.KEYFRAME}"


@query(f"select library_id, a, b, round(distance, 6) as distance from ({_FRAMES})")
def keyframe_pairs(t: Tables) -> DataFrame:
    return pairs.keyframe_pairs(t.video_prints).withColumn("distance", F.round("distance", 6))


_COMP = f"with p as (select library_id, a, b from dist_pairs where d < {K.SIMILAR} and same_bucket), " + components("p")


@query(_COMP + " select id, component from comp", "connected_components")
def components_of_similar(t: Tables) -> DataFrame:
    return connected_components(pairs.bucket_pairs(t.feature_prints))


def _items(t: Tables) -> DataFrame:
    return t.feature_prints.selectExpr("library_id", "asset_id", "creation_date", "cast(100 * (1 + asset_id % 7) as int) as pixel_width", "100 as pixel_height")


_SIMILAR = _COMP + " select f.library_id, component as group_id, 'visuallySimilar' as reason, list(f.asset_id order by 1 + f.asset_id % 7 desc, creation_date desc, f.asset_id) as members from comp join feature_prints f on f.asset_id = comp.id group by 1, 2"


@query(_SIMILAR)
def similar_groups(t: Tables) -> DataFrame:
    return groups.similar_groups(_items(t), pairs.bucket_pairs(t.feature_prints)).select("library_id", "group_id", "reason", "members")


_NEAR = f"with p as (select library_id, a, b from dist_pairs where d < {K.NEAR}), " + components("p") + """,
g as (select f.library_id, component as group_id, list(f.asset_id order by creation_date, f.asset_id) as members from comp join feature_prints f on f.asset_id = comp.id group by 1, 2)
select g.library_id, group_id, case when d < 0.01 then 'exactDuplicate' when d < 0.05 then 'nearDuplicate' else 'visuallySimilar' end as reason, round(d, 6) as similarity, members
from g join dist_pairs q on q.a = least(members[1], members[2]) and q.b = greatest(members[1], members[2])"""  # fmt: skip


@query(_NEAR)
def near_groups(t: Tables) -> DataFrame:
    return groups.near_groups(_items(t), pairs.pivot_pairs(t.feature_prints, K.NEAR), t.feature_prints.select("asset_id", "vec")).select("library_id", "group_id", "reason", "similarity", "members")


_VIDEO_FRAMES = _FRAMES.replace("video_prints", "video_frames")
_VIDEO = f"""with ex as ({_HASH}), vp as (select library_id, a, b from ({_VIDEO_FRAMES})),
pp as (select * from ex union select * from vp), {components('pp')},
sz as (select asset_id, coalesce(file_size, 0) as bytes from primary_res)
select c.library_id, component as group_id, case when bool_or(e.a is not null) then 'exactDuplicate' else 'nearDuplicate' end as reason, sum(coalesce(bytes, 0))::bigint as total_bytes, list(x.asset_id order by coalesce(bytes, 0) desc, creation_date desc, x.asset_id) as members
from comp c join assets x on x.asset_id = c.id left join sz using (asset_id) left join (select distinct a from ex) e on e.a = c.id group by 1, 2"""


@query(_VIDEO)
def video_groups(t: Tables) -> DataFrame:
    """Components of equal first-frame hashes and of close key frames."""
    videos = t.assets.where("media_type = 'video'").select("library_id", "asset_id", "creation_date")
    sizes = scans.primary_resource(t.assets, t.asset_resources).select("asset_id", F.col("file_size").alias("bytes"))
    exact = settle(pairs.hash_pairs(_video_hashes(t)), "exact")
    near = pairs.keyframe_links(t.video_frames, lambda stars: connected_components(exact.union(stars)))
    return groups.video_groups(videos, sizes, exact, settle(near, "near"))


def _arrivals(t: Tables) -> DataFrame:
    """Groups as several engines would report them: every third twice with another reason and order."""
    g = t.groups.select("library_id", "group_id", "reason", "members", F.lit(0).alias("arrival"))
    again = t.groups.where("group_id % 3 = 0").selectExpr("library_id", "group_id + 1000000 as group_id", "case when group_id % 2 = 0 then 'exactDuplicate' else 'unknown' end as reason", "reverse(members) as members", "1 as arrival")
    return g.union(again)


_ARR = "arr as (select *, array_to_string(list_sort(list_transform(members, lambda x: cast(x as varchar))), ',') as key, case reason when 'exactDuplicate' then 3 when 'nearDuplicate' then 2 when 'burstShot' then 1 when 'visuallySimilar' then 0 else -1 end as p from (select library_id, group_id, reason, members, 0 as arrival from groups union all select library_id, group_id + 1000000, case when group_id % 2 = 0 then 'exactDuplicate' else 'unknown' end, list_reverse(members), 1 from groups where group_id % 3 = 0))"


@query(f"with {_ARR} select library_id, key, group_id, reason, members from (select *, row_number() over (partition by library_id, key order by arrival, group_id) as k from arr) where k = 1")
def dedupe_group_sets(t: Tables) -> DataFrame:
    return groups.dedupe_sets(_arrivals(t))


@query(f"with {_ARR} select library_id, key, arg_max(reason, p * 10 - arrival) as reason, arg_min(group_id, arrival) as group_id, arg_min(members, arrival) as members from arr group by 1, 2")
def merge_groups_priority(t: Tables) -> DataFrame:
    return groups.merge_priority(_arrivals(t))


@query(f"with {_ARR} select library_id, key, reason, group_id, members from (select *, row_number() over (partition by library_id, key order by p desc, arrival, group_id) as k from arr) where k = 1")
def merge_groups_replace(t: Tables) -> DataFrame:
    return groups.merge_replace(_arrivals(t))


def _overlapping(t: Tables) -> DataFrame:
    """Similar groups that share members with exact ones."""
    exact = t.groups.where("reason = 'exactDuplicate'").select("library_id", "group_id", "reason", "members")
    similar = t.groups.where("reason = 'visuallySimilar'").select("library_id", "group_id", "reason", "members")
    mixed = exact.selectExpr("library_id", "group_id + 2000000 as group_id", "'visuallySimilar' as reason", "concat(slice(members, 1, 1), transform(members, x -> x + 500000)) as members")
    return exact.union(similar).union(mixed)


_OVER = "ov as (select library_id, group_id, reason, members from groups where reason in ('exactDuplicate', 'visuallySimilar') union all select library_id, group_id + 2000000, 'visuallySimilar', list_concat(members[1:1], list_transform(members, lambda x: x + 500000)) from groups where reason = 'exactDuplicate')"


@query(f"with {_OVER}, ex as (select library_id, unnest(members) as id from ov where reason = 'exactDuplicate'), s as (select library_id, group_id, reason, unnest(members) as id, generate_subscripts(members, 1) as pos from ov where reason = 'visuallySimilar') select library_id, group_id, reason, members from ov where reason <> 'visuallySimilar' union all select library_id, group_id, reason, list(id order by pos) from s where (library_id, id) not in (select library_id, id from ex) group by 1, 2, 3 having count(*) >= 2")
def strip_exact_from_similar(t: Tables) -> DataFrame:
    return groups.strip_exact(_overlapping(t))


def _photo_sources(t: Tables) -> DataFrame:
    """All branches of a photo scan with their order of arrival."""
    cols = ["library_id", "group_id", "reason", "members"]
    near = groups.near_groups(_items(t), pairs.pivot_pairs(t.feature_prints, K.NEAR), t.feature_prints.select("asset_id", "vec")).select(*cols)
    burst = groups.burst_groups(scans.images(t.assets)).select(*cols)
    exact = groups.exact_duplicates(scans.images(t.assets), t.dhashes).select(*cols)
    similar = groups.similar_groups(_items(t), pairs.bucket_pairs(t.feature_prints)).select(*cols)
    first = near.union(burst).where(F.col("reason").isin("nearDuplicate", "burstShot"))
    return first.withColumn("arrival", F.lit(0)).union(exact.withColumn("arrival", F.lit(1))).union(similar.withColumn("arrival", F.lit(2)))


_PHOTO = f"""with pn as (select library_id, a, b from dist_pairs where d < {K.NEAR}), {components('pn', 'cn')},
ng as (select f.library_id, component as group_id, list(f.asset_id order by creation_date, f.asset_id) as members from cn join feature_prints f on f.asset_id = cn.id group by 1, 2),
nr as (select g.library_id, group_id, case when d < 0.01 then 'exactDuplicate' when d < 0.05 then 'nearDuplicate' else 'visuallySimilar' end as reason, members from ng g join dist_pairs q on q.a = least(members[1], members[2]) and q.b = greatest(members[1], members[2])),
ps as (select library_id, a, b from dist_pairs where d < {K.SIMILAR} and same_bucket), {components('ps', 'cs')},
sg as (select f.library_id, component as group_id, 'visuallySimilar' as reason, list(f.asset_id order by 1 + f.asset_id % 7 desc, creation_date desc, f.asset_id) as members from cs join feature_prints f on f.asset_id = cs.id group by 1, 2),
bg as ({_BURST}),
src as (select *, 0 as arrival from nr where reason = 'nearDuplicate' union all select *, 0 from bg union all select library_id, group_id, reason, members, 1 from exact_groups union all select *, 2 from sg)"""


@query(_PHOTO + " select library_id, group_id, reason from src where arrival = 0")
def near_and_burst_only(t: Tables) -> DataFrame:
    return _photo_sources(t).where("arrival = 0").select("library_id", "group_id", "reason")


@query(_PHOTO + """, k as (select *, array_to_string(list_sort(list_transform(members, lambda x: cast(x as varchar))), ',') as key, case reason when 'exactDuplicate' then 3 when 'nearDuplicate' then 2 when 'burstShot' then 1 else 0 end as p from src),
m as (select library_id, key, arg_max(reason, p * 10 - arrival) as reason, arg_min(group_id, arrival * 100000000 + group_id) as group_id, arg_min(members, arrival * 100000000 + group_id) as members from k group by 1, 2),
ex as (select library_id, unnest(members) as id from m where reason = 'exactDuplicate'), s as (select library_id, group_id, reason, unnest(members) as id, generate_subscripts(members, 1) as pos from m where reason = 'visuallySimilar')
select library_id, group_id, reason, members from m where reason <> 'visuallySimilar' union all select library_id, group_id, reason, list(id order by pos) from s where (library_id, id) not in (select library_id, id from ex) group by 1, 2, 3 having count(*) >= 2""")
def photo_groups(t: Tables) -> DataFrame:
    return groups.strip_exact(groups.merge_priority(_photo_sources(t)).select("library_id", "group_id", "reason", "members"))
