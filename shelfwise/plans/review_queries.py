"""Ranking in groups, review state, snapshots, decisions, dashboards and training."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import constants as K
from shelfwise.operators import groups, review, scans
from shelfwise.plans import signal_queries as S
from shelfwise.plans.registry import query
from shelfwise.session import settle, shared_dir
from shelfwise.sources.adapters import Tables

_REASON = "case when reason <> 'visuallySimilar' then 'duplicates' else 'similar' end"


@query(f"select library_id, {_REASON} as kind, count(*) as n, list_sort(list(distinct reason)) as reasons from groups group by 1, 2")
def groups_by_reason(t: Tables) -> DataFrame:
    kind = F.when(F.col("reason") != "visuallySimilar", "duplicates").otherwise("similar")
    return t.groups.groupBy("library_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("reason")).alias("reasons"))


_KEYED = "kg as (select *, array_to_string(list_sort(list_transform(members, lambda x: cast(x as varchar))), ',') as key from groups), st as (select k.*, s.kind from kg k left join (select library_id, key, min(kind) as kind from review_state where kind in ('completed', 'skipped') group by 1, 2) s using (library_id, key)), mk as (select distinct library_id, cast(key as bigint) as id from review_state where kind = 'marked'), ri as (select library_id, id from mk union select library_id, unnest(members) from st where kind is not null)"


@query(f"with {_KEYED} select library_id, id as asset_id from ri")
def reviewed_ids(t: Tables) -> DataFrame:
    return review.reviewed_ids(t.groups, t.review_state)


@query(f"with {_KEYED} select library_id, group_id from groups g where not exists (select 1 from ri where ri.library_id = g.library_id and list_contains(g.members, ri.id))")
def unreviewed_groups(t: Tables) -> DataFrame:
    return review.unreviewed(t.groups, review.reviewed_ids(t.groups, t.review_state)).select("library_id", "group_id")


@query("select library_id, asset_id from assets where media_type = 'image' and asset_id not in (select cast(key as bigint) from review_state where kind = 'marked')")
def exclude_deleted(t: Tables) -> DataFrame:
    return scans.images(t.assets, True).join(review.marked(t.review_state).select("asset_id"), "asset_id", "left_anti").select("library_id", "asset_id")


@query(f"with {_KEYED} select library_id, group_id, kind is null as fresh, kind is null or kind = 'completed' as restart from st where kind is null or kind = 'completed'")
def review_queue(t: Tables) -> DataFrame:
    rows = review.states(t.groups, t.review_state).where("kind is null or kind = 'completed'")
    return rows.select("library_id", "group_id", F.col("kind").isNull().alias("fresh"), F.lit(True).alias("restart"))


_MARKS = f"{_KEYED}, gm as (select g.library_id, group_id, id, pos, exists (select 1 from mk where mk.library_id = g.library_id and mk.id = g.id) as m from (select library_id, group_id, unnest(members) as id, generate_subscripts(members, 1) as pos from groups) g)"


@query(f"with {_MARKS} select library_id, group_id, list(id order by pos) as ids from gm where m group by 1, 2")
def marked_in_group(t: Tables) -> DataFrame:
    return _sides(t, True)


@query(f"with {_MARKS} select library_id, group_id, list(id order by pos) as ids from gm where not m and (library_id, group_id) in (select library_id, group_id from gm where m) group by 1, 2")
def kept_in_group(t: Tables) -> DataFrame:
    return _sides(t, False)


def _sides(t: Tables, side: bool) -> DataFrame:
    """Intersection or difference of members and marks, for groups that have marks."""
    rows = review.members_marked(t.groups, t.review_state)
    pair = F.collect_list(F.when(F.col("marked") == side, F.struct("pos", "asset_id")))
    out = rows.groupBy("library_id", "group_id").agg(F.bool_or("marked").alias("any"), F.transform(F.array_sort(pair), lambda x: x["asset_id"]).alias("ids"))
    return out.where("any and size(ids) > 0").select("library_id", "group_id", "ids")


@query(f"with {_MARKS} select library_id, count(distinct group_id) as n_groups, count(distinct id) as n_items from gm where m group by 1")
def marked_groups(t: Tables) -> DataFrame:
    return review.members_marked(t.groups, t.review_state).where("marked").groupBy("library_id").agg(F.count_distinct("group_id").alias("n_groups"), F.count_distinct("asset_id").alias("n_items"))


_RANK = "rk as (select library_id, group_id, g.id as asset_id, row_number() over (partition by library_id, group_id order by coalesce(quality_score, 0.5) desc, pos) as rank from (select library_id, group_id, unnest(members) as id, generate_subscripts(members, 1) as pos from groups) g left join (select asset_id, quality_score from asset_analysis) q on q.asset_id = g.id)"


@query(f"with {_RANK} select * from rk")
def rank_in_group(t: Tables) -> DataFrame:
    return groups.ranked(t.groups, t.asset_analysis)


@query(f"with {_RANK} select library_id, group_id, max(asset_id) filter (rank = 1) as kept, list_sort(list(asset_id) filter (rank > 1)) as queued from rk group by 1, 2")
def keep_and_queue(t: Tables) -> DataFrame:
    rows = groups.ranked(t.groups, t.asset_analysis)
    return rows.groupBy("library_id", "group_id").agg(F.max(F.when(F.col("rank") == 1, F.col("asset_id"))).alias("kept"), F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.col("asset_id")))).alias("queued"))


@query("select library_id, group_id, unnest(members[2:]) as asset_id from groups")
def queue_all(t: Tables) -> DataFrame:
    return t.groups.select("library_id", "group_id", F.posexplode("members").alias("pos", "asset_id")).where("pos > 0").drop("pos")


@query("select library_id, group_id, members[1] as first_id, members[2] as second_id from groups")
def adjacent_first_two(t: Tables) -> DataFrame:
    return t.groups.select("library_id", "group_id", F.element_at("members", 1).alias("first_id"), F.element_at("members", 2).alias("second_id"))


@query("select library_id, decision_id from (select *, row_number() over (partition by library_id order by recorded_at desc, decision_id) as k from user_decisions) where k <= 500")
def last_n_decisions(t: Tables) -> DataFrame:
    return review.last_decisions(t.user_decisions).select("library_id", "decision_id")


@query("with ex as (select library_id, asset_id from asset_analysis where is_blurry), nw as (select library_id, asset_id from assets where asset_id % 9 = 2) select * from ex union all select * from nw where asset_id not in (select asset_id from ex)")
def append_new_only(t: Tables) -> DataFrame:
    old = t.asset_analysis.where("is_blurry").select("library_id", "asset_id")
    return review.append_new(old, t.assets.where("asset_id % 9 = 2").select("library_id", "asset_id"), ["library_id", "asset_id"])


@query("with now as (select library_id, count(*) as n from groups where group_id % 4 = 3 group by 1), b as (select library_id, count(*) filter (asset_id % 9 = 2 and is_blurry is not true) as n from asset_analysis group by 1) select l.library_id, coalesce(now.n, 0) + coalesce(b.n, 0) as n from (select distinct library_id from assets) l left join now using (library_id) left join b using (library_id)")
def new_results_count(t: Tables) -> DataFrame:
    """Groups and blurry pictures that a refresh adds to the previous snapshot, per library."""
    before, after = t.groups.where("group_id % 4 <> 3"), t.groups
    fresh = groups.dedupe_sets(after.withColumn("arrival", F.lit(0))).join(groups.dedupe_sets(before.withColumn("arrival", F.lit(0))).select("library_id", "key"), ["library_id", "key"], "left_anti").groupBy("library_id").agg(F.count("*").alias("g"))
    old = t.asset_analysis.where("is_blurry").select("library_id", "asset_id")
    now = review.append_new(old, t.asset_analysis.where("asset_id % 9 = 2").select("library_id", "asset_id"), ["library_id", "asset_id"])
    delta = now.groupBy("library_id").agg(F.count("*").alias("now")).join(old.groupBy("library_id").agg(F.count("*").alias("old")), "library_id", "left").select("library_id", F.greatest(F.col("now") - F.coalesce("old", F.lit(0)), F.lit(0)).alias("b"))
    return t.assets.select("library_id").distinct().join(fresh, "library_id", "left").join(delta, "library_id", "left").select("library_id", (F.coalesce("g", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))


_REBUILT = "rb as (select library_id, group_id, reason, list(id order by pos) as members from (select library_id, group_id, reason, unnest(members) as id, generate_subscripts(members, 1) as pos from groups) where id in (select asset_id from assets where not in_trash) group by 1, 2, 3 having count(*) >= 2)"


@query(f"with {_REBUILT} select * from rb")
def rebuild_groups(t: Tables) -> DataFrame:
    return review.rebuild(t.groups, t.assets.where("not in_trash"))


_LARGE = "lg as (select library_id, list(asset_id order by asset_id) as ids, list(file_size order by asset_id) as sizes from first_res where file_size >= 900000000 group by 1), lz as (select library_id, unnest(ids) as id, unnest(sizes) as size from lg where length(library_id) % 2 = 0)"


def _large(t: Tables) -> DataFrame:
    """Two parallel lists a library; every second one, by the length of its name, has lost a size."""
    rows = scans.first_resource_bytes(t.asset_resources).where("bytes >= 900000000")
    pairs = rows.groupBy("library_id").agg(F.array_sort(F.collect_list(F.struct("asset_id", "bytes"))).alias("x"))
    cut = F.when(F.length("library_id") % 2 == 0, F.size("x")).otherwise(F.size("x") - 1)
    return pairs.select("library_id", F.col("x.asset_id").alias("ids"), F.slice(F.col("x.bytes"), F.lit(1), cut).alias("sizes"))


def _paths(t: Tables) -> DataFrame:
    return t.files.where("not is_dir").select(F.lit("files").alias("library_id"), "path")


@query(f"with {_REBUILT}, {_LARGE} select library_id, 'group' as kind, array_to_string(members, ',') as key, cast(len(members) as bigint) as size from rb union all select library_id, 'large', cast(id as varchar), size from lz union all select library_id, 'blurry', cast(asset_id as varchar), null from asset_analysis where is_blurry")
def snapshot_read(t: Tables) -> DataFrame:
    """A snapshot read back: groups over what is left, lists of equal length zipped, tables that it lacks empty."""
    path = f"{shared_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    review.write_snapshot({"groups": t.groups, "blurry": t.asset_analysis.where("is_blurry"), "large": _large(t)}, path, 3)
    found = review.read_snapshot(t.spark, path)
    rebuilt = review.rebuild(found["groups"], t.assets.where("not in_trash")).select("library_id", F.lit("group").alias("kind"), F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("key"), F.size("members").cast("long").alias("size"))
    large = review.zip_parallel(found["large"], "ids", "sizes").select("library_id", F.lit("large"), F.col("id").cast("string"), "size")
    flat = [found[n].select("library_id", F.lit(n), F.col("asset_id").cast("string"), F.lit(None).cast("long")) for n in ("blurry", "screenshots", "picks")]
    return rebuilt.union(large).union(flat[0]).union(flat[1]).union(flat[2])


@query("select library_id, 'groups' as kind, count(*) as n from groups group by 1 union all select library_id, 'blurry', count(*) from asset_analysis where is_blurry group by 1 union all select library_id, 'screenshots', count(*) from assets where media_type = 'image' and media_subtypes & 4 <> 0 group by 1 union all select 'files', 'files', count(*) from files where not is_dir and path in (select path from files where length % 3000000 <> 0)")
def snapshot_write(t: Tables) -> DataFrame:
    """Two versions written; the newer one is read, without the files that are gone."""
    path = f"{shared_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    blurry, shots = t.asset_analysis.where("is_blurry"), scans.images(t.assets, True).where(scans.has_bit(K.SCREENSHOT))
    review.write_snapshot({"groups": t.groups.limit(0), "blurry": blurry}, path, 3)
    review.write_snapshot({"groups": t.groups, "blurry": blurry, "screenshots": shots, "files": _paths(t)}, path, 4, t.files.where("length % 3000000 <> 0"))
    found = review.read_snapshot(t.spark, path)
    counts = [found[n].groupBy("library_id").agg(F.count("*").alias("n")).select("library_id", F.lit(n).alias("kind"), "n") for n in ("groups", "blurry", "screenshots", "files")]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("select library_id, group_id, group_id % 3 + 1 as version, case when group_id % 3 = 1 then 1 else 0 end as n_groups, case when group_id % 3 = 0 then len(members) else 0 end as n_blurry, case when group_id % 3 = 1 then members[1] end as first_id from groups")
def decode_with_defaults(t: Tables) -> DataFrame:
    """Snapshot documents of three versions, of which each lacks some lists."""
    ids = F.concat_ws(", ", F.transform("members", lambda x: x.cast("string")))
    document = F.when(F.col("group_id") % 3 == 0, F.format_string('{"version": 1, "blurry": [%s]}', ids)).when(F.col("group_id") % 3 == 1, F.format_string('{"version": 2, "blurry": null, "groups": [{"ids": [%s], "reason": "burstShot"}]}', ids)).otherwise('{"version": 3}')
    rows = t.groups.select("library_id", "group_id", document.alias("document")).withColumn("s", review.decode_snapshot())
    first = F.get(F.get("s.groups", F.lit(0))["ids"], F.lit(0))
    return rows.select("library_id", "group_id", F.col("s.version").alias("version"), F.size("s.groups").alias("n_groups"), F.size("s.blurry").alias("n_blurry"), first.alias("first_id"))


@query("select library_id, asset_id from asset_analysis where is_blurry")
def snapshot_recover(t: Tables) -> DataFrame:
    """Blurry pictures of a snapshot; libraries whose list is empty take them from the cache."""
    known = t.asset_analysis.where("is_blurry").select("library_id", "asset_id")
    stored = known.where(F.crc32(F.col("library_id").cast("binary")) % 2 == 0)
    return stored.union(known.join(stored.select("library_id").distinct(), "library_id", "left_anti"))


@query("select library_id, reason, count(*) as n from deletions group by 1, 2")
def affinity_counts(t: Tables) -> DataFrame:
    return t.deletions.groupBy("library_id", "reason").agg(F.count("*").alias("n"))


@query("select library_id, max(deleted) >= 5 as high from affinity group by 1")
def high_affinity(t: Tables) -> DataFrame:
    return t.affinity.groupBy("library_id").agg(F.bool_or(F.col("deleted") >= 5).alias("high"))


@query(f"with {S._PICKS}, x as (select library_id, case when reason = 'visuallySimilar' then 'similar' else 'duplicates' end as what from groups union all select library_id, 'blurry' from asset_analysis where is_blurry union all select library_id, 'screenshots' from assets where media_type = 'image' and media_subtypes & 4 <> 0 union all select library_id, 'panoramas' from assets where media_type = 'image' and media_subtypes & 1 <> 0 union all select library_id, 'portrait' from assets where media_type = 'image' and media_subtypes & 16 <> 0 union all select library_id, 'live' from assets where media_type = 'image' and media_subtypes & 8 <> 0 union all select library_id, 'picks' from pk) select library_id, count(*) filter (what = 'duplicates') as duplicates, count(*) filter (what = 'similar') as similar, count(*) filter (what = 'blurry') as blurry, count(*) filter (what = 'screenshots') as screenshots, count(*) filter (what = 'panoramas') as panoramas, count(*) filter (what = 'portrait') as portrait, count(*) filter (what = 'live') as live, count(*) filter (what = 'picks') as picks from x group by 1")
def dashboard_counts(t: Tables) -> DataFrame:
    img = scans.images(t.assets, True)
    parts = [
        t.groups.select("library_id", F.when(F.col("reason") == "visuallySimilar", "similar").otherwise("duplicates").alias("what")),
        t.asset_analysis.where("is_blurry").select("library_id", F.lit("blurry").alias("what")), S.smart_picks(t).select("library_id", F.lit("picks").alias("what")),
        *(img.where(scans.has_bit(b)).select("library_id", F.lit(n).alias("what")) for n, b in (("screenshots", K.SCREENSHOT), ("panoramas", K.PANORAMA), ("portrait", K.DEPTH), ("live", K.LIVE))),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = ["duplicates", "similar", "blurry", "screenshots", "panoramas", "portrait", "live", "picks"]
    return rows.groupBy("library_id").agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])


@query(f"with {_MARKS}, fz as (select mk.library_id, count(*) as n, sum(coalesce(file_size, 0))::bigint as bytes from mk join first_res r on r.library_id = mk.library_id and r.asset_id = mk.id group by 1), tc as (select library_id, count(distinct group_id) as completed from gm where m group by 1) select library_id, n, bytes, coalesce(completed, 0) as completed from fz left join tc using (library_id)")
def deletion_plan(t: Tables) -> DataFrame:
    return review.deletion_plan(t.groups, t.review_state, scans.first_resource_bytes(t.asset_resources))


@query(f"with {_MARKS}, {S._SCORE} select gm.library_id, group_id, min(id) filter (not m) as kept_id, list_sort(list(id) filter (m)) as deleted_ids, round(sum(coalesce(score, 0.5)) filter (m), 4) as score_sum, sum(len(coalesce(labels, cast([] as varchar[])))) filter (m) as n_labels, round(coalesce(sum(list_sum(av.vec)) filter (m), 0), 6) as vec_sum, count(av.vec) filter (m) as n_vecs, list_sum(arg_min(coalesce(av.vec, [0e0]), id) filter (not m)) as kept_sum from gm left join qs on qs.asset_id = gm.id left join sg on sg.asset_id = gm.id left join asset_vectors av on av.asset_id = gm.id group by 1, 2 having min(id) filter (not m) is not null and count(*) filter (m) > 0")
def build_decisions(t: Tables) -> DataFrame:
    """Decisions with labels, scores and vectors of the deleted side, and the kept side's vector; vectors by their sums."""
    out = review.build_decisions(t.groups, t.review_state, S._signals(t), S._scores(t), t.asset_vectors)
    total_of = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate("deleted", F.lit(0.0), lambda s, d: s + d["score"])
    labels = F.aggregate("deleted", F.lit(0).cast("long"), lambda s, d: s + F.size(d["labels"]))
    return out.select("library_id", "group_id", "kept_id", F.transform("deleted", lambda d: d["asset_id"]).alias("deleted_ids"), F.round(total, 4).alias("score_sum"), labels.alias("n_labels"),
        F.round(F.aggregate("deleted", F.lit(0.0), lambda s, d: s + F.coalesce(total_of(d["vec"]), F.lit(0.0))), 6).alias("vec_sum"), F.size(F.filter("deleted", lambda d: d["vec"].isNotNull())).cast("long").alias("n_vecs"), F.coalesce(total_of(F.col("kept_vec")), F.lit(0.0)).alias("kept_sum"))


@query("select library_id, count(kept_vec_id) as n, count(kept_vec_id) >= 50 as ready from user_decisions group by 1")
def training_readiness(t: Tables) -> DataFrame:
    return t.user_decisions.groupBy("library_id").agg(F.count("kept_vec_id").alias("n"), (F.count("kept_vec_id") >= 50).alias("ready"))


@query("select library_id, decision_id, kept_id as asset_id, kept_vec_id as vec_id, 'kept' as label from user_decisions where kept_vec_id is not null union all select library_id, decision_id, d.asset_id, d.vec_id, 'deleted' from (select library_id, decision_id, unnest(deleted) as d from user_decisions)")
def training_rows(t: Tables) -> DataFrame:
    return review.training_rows(t.user_decisions)


@query("with l as (select doc_id, case when mean_luma > 220 then 'overexposed' when mean_luma < 30 then 'underexposed' when mos >= 70 then 'sharp' when mos <= 30 then 'blurry' end as label from training_files) select doc_id, label from (select *, row_number() over (partition by label order by doc_id) as k from l where label is not null) where k <= 40")
def curate_training_labels(t: Tables) -> DataFrame:
    return review.curate(t.training_files, 40, order="doc_id")


@query()
def train_quality_model(t: Tables) -> DataFrame:
    """Four classes of pictures over their vectors; held-out predictions."""
    kind = F.element_at(F.array(*map(F.lit, ("sharp", "blurry", "overexposed", "underexposed"))), (F.col("label") % 4).cast("int") + 1)
    rows = t.read("embeddings").select(F.col("vec_id").alias("id"), kind.alias("kind"), F.col("embedding").cast("array<double>").alias("vec"))
    out, accuracy = review.fit_classifier(settle(rows, "rows"), "kind", "vec", True)
    return out.withColumn("accuracy", F.lit(round(accuracy, 6))).withColumn("low", F.lit(accuracy < 0.75))


@query()
def personalize_model(t: Tables) -> DataFrame:
    """Kept against deleted over the decisions' vectors."""
    vecs = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    rows = review.training_rows(t.user_decisions).join(vecs, "vec_id").select(F.col("asset_id").alias("id"), F.col("label").alias("side"), "vec")
    out, accuracy = review.fit_classifier(settle(rows, "rows"), "side", "vec", False)
    return out.withColumn("accuracy", F.lit(round(accuracy, 6)))


@query(f"""{S._LAP}, {S._FRESH}, bs as (select a.asset_id, a.library_id from assets a left join fr using (asset_id) left join bl using (asset_id) where a.media_type = 'image' and a.media_subtypes & 4 = 0 and coalesce(fr.is_blurry, bl.is_blurry)),
cur as (select library_id, group_id, reason, members from exact_groups), prev as (select library_id, group_id, reason, members from groups),
k as (select *, array_to_string(list_sort(list_transform(members, lambda x: cast(x as varchar))), ',') as key from (select *, 1 as arrival from cur union all select *, 0 from prev)),
m as (select library_id, key, reason, row_number() over (partition by library_id, key order by case reason when 'exactDuplicate' then 3 when 'nearDuplicate' then 2 when 'burstShot' then 1 else 0 end desc, arrival, group_id) as n, count(*) filter (arrival = 0) over (partition by library_id, key) as was from k),
old as (select library_id, asset_id from asset_analysis where asset_id % 6 = 0 and is_blurry),
nb as (select library_id, asset_id from bs where (library_id, asset_id) not in (select library_id, asset_id from old))
select library_id, 'group' as kind, key, reason from m where n = 1 union all select library_id, 'blurry', cast(asset_id as varchar), null from (select * from old union all select * from nb)
union all select library_id, 'screenshots', cast(asset_id as varchar), null from assets where media_type = 'image' and media_subtypes & 4 <> 0
union all select library_id, 'new', cast(sum(c) as varchar), null from (select library_id, count(*) as c from m where n = 1 and was = 0 group by 1 union all select library_id, count(*) from nb group by 1) group by 1""")
def background_refresh(t: Tables) -> DataFrame:
    """Exact duplicates and blur, merged into the previous snapshot and written as the next; the rest stays."""
    path = f"{shared_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    shots = scans.images(t.assets, True).where(scans.has_bit(K.SCREENSHOT))
    review.write_snapshot({"groups": t.groups, "blurry": t.asset_analysis.where("asset_id % 6 = 0 and is_blurry"), "screenshots": shots}, path, 3)
    now = groups.exact_duplicates(scans.images(t.assets), t.dhashes)
    blur = S.blur_scan(t).where("is_blurry").join(t.assets.select("asset_id", "library_id"), "asset_id")
    tables, new = review.refresh_snapshot(review.read_snapshot(t.spark, path), now, blur)
    review.write_snapshot(tables, path, 4)
    found = review.read_snapshot(t.spark, path)
    out = review.keyed(found["groups"]).select("library_id", F.lit("group").alias("kind"), "key", "reason")
    for n in ("blurry", "screenshots"):
        out = out.union(found[n].select("library_id", F.lit(n), F.col("asset_id").cast("string"), F.lit(None).cast("string")))
    return out.union(new.select("library_id", F.lit("new"), F.col("n").cast("string"), F.lit(None).cast("string")))
