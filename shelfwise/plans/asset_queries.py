"""Scans, resources, filters, storage accounting and sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions import constants as K
from shelfwise.functions.vectors import epoch_us
from shelfwise.operators import scans, sessions, storage
from shelfwise.plans.registry import query
from shelfwise.sources.adapters import Tables

LAST_SCAN = dt.datetime(2024, 1, 15)
_IMG = "media_type = 'image'"
_COLS = "asset_id, library_id, creation_date"


@query(f"select {_COLS} from assets where {_IMG} and media_subtypes & 4 = 0")
def scan_images(t: Tables) -> DataFrame:
    return scans.images(t.assets).select("asset_id", "library_id", "creation_date").orderBy("creation_date", "asset_id")


@query(f"select {_COLS} from assets where {_IMG} and media_subtypes & 4 = 0")
def scan_images_desc(t: Tables) -> DataFrame:
    return scans.images(t.assets).select("asset_id", "library_id", "creation_date").orderBy(F.desc("creation_date"), "asset_id")


@query(f"select {_COLS} from assets where {_IMG}")
def scan_all_images(t: Tables) -> DataFrame:
    return scans.images(t.assets, screenshots=True).select("asset_id", "library_id", "creation_date").orderBy("creation_date", "asset_id")


@query(f"select {_COLS} from assets where media_type = 'video'")
def scan_videos(t: Tables) -> DataFrame:
    return t.assets.where("media_type = 'video'").select("asset_id", "library_id", "creation_date").orderBy("creation_date", "asset_id")


@query(f"select {_COLS} from assets where {_IMG} and media_subtypes & 4 = 0 and creation_date > timestamp '2024-01-15'")
def scan_incremental(t: Tables) -> DataFrame:
    return scans.added_after(scans.images(t.assets), LAST_SCAN).select("asset_id", "library_id", "creation_date")


@query(f"select {_COLS} from assets where {_IMG} and media_subtypes & 4 <> 0")
def scan_screenshots(t: Tables) -> DataFrame:
    return scans.with_bit(t.assets, K.SCREENSHOT).select("asset_id", "library_id", "creation_date").orderBy(F.desc("creation_date"), "asset_id")


@query(f"select {_COLS} from assets where {_IMG} and media_subtypes & 1 <> 0")
def scan_panoramas(t: Tables) -> DataFrame:
    return scans.with_bit(t.assets, K.PANORAMA).select("asset_id", "library_id", "creation_date")


@query(f"select {_COLS} from assets where {_IMG} and media_subtypes & 16 <> 0")
def scan_portrait(t: Tables) -> DataFrame:
    return scans.with_bit(t.assets, K.DEPTH).select("asset_id", "library_id", "creation_date")


@query(f"select {_COLS} from assets where {_IMG} and media_subtypes & 8 <> 0")
def scan_live(t: Tables) -> DataFrame:
    return scans.with_bit(t.assets, K.LIVE).select("asset_id", "library_id", "creation_date")


@query(f"select library_id, count(*) filter (media_subtypes & 1 <> 0) as panoramas, count(*) filter (media_subtypes & 16 <> 0) as portraits, count(*) filter (media_subtypes & 8 <> 0) as live from assets where {_IMG} group by 1")
def metadata_counts(t: Tables) -> DataFrame:
    return scans.images(t.assets, True).groupBy("library_id").agg(F.count_if(scans.has_bit(K.PANORAMA)).alias("panoramas"), F.count_if(scans.has_bit(K.DEPTH)).alias("portraits"), F.count_if(scans.has_bit(K.LIVE)).alias("live"))


_LARGE_VIDEO = f"select p.asset_id, p.library_id, p.file_size from primary_res p join assets a using (asset_id) where (a.media_type = 'video' or a.media_subtypes & 8 <> 0) and p.file_size >= {K.LARGE_FILE}"
_FILES = f"select path, page_id, length from files where not is_dir and length >= {K.LARGE_FILE} and not regexp_matches(path, '(^|/)[.]')"


@query(_LARGE_VIDEO)
def scan_large_videos(t: Tables) -> DataFrame:
    return scans.large_videos(t.assets, t.asset_resources).select("asset_id", "library_id", "file_size")


@query(_FILES)
def scan_files(t: Tables) -> DataFrame:
    return scans.large_files(t.files).select("path", "page_id", "length")


@query(f"with v as ({_LARGE_VIDEO}), f as ({_FILES}) select 'asset' as source_type, cast(asset_id as varchar) as key, file_size as bytes from v union all select 'file', path, length from f")
def largest_files(t: Tables) -> DataFrame:
    return scans.largest_files(scans.large_videos(t.assets, t.asset_resources), scans.large_files(t.files)).orderBy(F.desc("bytes"), "key")


@query("select a.library_id, count(*) as n, coalesce(sum(file_size) filter (file_size > 0), 0)::bigint as bytes from assets a left join first_res r using (asset_id) where in_trash group by 1")
def scan_recently_deleted(t: Tables) -> DataFrame:
    first = scans.first_resource_bytes(t.asset_resources).select("asset_id", "bytes")
    return t.assets.where("in_trash").join(first, "asset_id", "left").groupBy("library_id").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest("bytes", F.lit(0))), F.lit(0)).alias("bytes"))


@query("select contact_id, given_name, family_name, organization_name, phone_numbers, emails, birthday, image_available from contacts")
def scan_contacts(t: Tables) -> DataFrame:
    return t.contacts.drop("library_id")


@query("select asset_id, library_id, media_type from assets where asset_id in (select unnest(members) from groups where group_id % 3 = 0)")
def lookup_by_ids(t: Tables) -> DataFrame:
    ids = t.groups.where("group_id % 3 = 0").select(F.explode("members").alias("asset_id"))
    return scans.lookup_by_ids(t.assets, ids).select("asset_id", "library_id", "media_type")


@query("with need(label, least) as (values ('sharp', 500), ('blurry', 500), ('overexposed', 200), ('underexposed', 200)), f as (select regexp_extract(path, '^([^/]+)/', 1) as label, lower(regexp_extract(path, '\\.([^.]+)$', 1)) as ext from training_files), c as (select label, count(*) as n from f where ext in ('jpg', 'jpeg', 'png', 'heic', 'tiff') group by 1) select label, coalesce(n, 0) as n, coalesce(n, 0) >= least as enough, n is null as missing from need left join c using (label)")
def labelled_dirs(t: Tables) -> DataFrame:
    return scans.labelled_dirs(t.training_files, {"sharp": 500, "blurry": 500, "overexposed": 200, "underexposed": 200})


@query("select asset_id, library_id, file_size, locally_available from primary_res")
def primary_resource(t: Tables) -> DataFrame:
    return scans.primary_resource(t.assets, t.asset_resources).select("asset_id", "library_id", "file_size", "locally_available")


_SIZED = "select asset_id, library_id, media_type, bytes from (select r.asset_id, r.library_id, media_type, file_size as bytes, row_number() over (partition by r.asset_id order by ord) as k from asset_resources r join assets a using (asset_id) where file_size is not null and ((media_type = 'image' and resource_type in ('photo', 'fullSizePhoto')) or (media_type = 'video' and resource_type in ('video', 'fullSizeVideo')))) where k = 1"


@query(_SIZED)
def first_sized_resource(t: Tables) -> DataFrame:
    return scans.first_sized_resource(t.assets, t.asset_resources)


@query("select asset_id, library_id, coalesce(file_size, 0) as bytes from first_res")
def first_resource_bytes(t: Tables) -> DataFrame:
    return scans.first_resource_bytes(t.asset_resources)


@query("select asset_id, library_id, case when coalesce(locally_available, false) then coalesce(file_size, 0) else 0 end as local_bytes from primary_res")
def local_bytes(t: Tables) -> DataFrame:
    return scans.primary_resource(t.assets, t.asset_resources).select("asset_id", "library_id", F.when(F.coalesce("locally_available", F.lit(False)), F.coalesce("file_size", F.lit(0))).otherwise(0).alias("local_bytes"))


@query("select asset_id, library_id, coalesce(locally_available, true) as is_local from primary_res")
def is_stored_locally(t: Tables) -> DataFrame:
    return scans.primary_resource(t.assets, t.asset_resources).select("asset_id", "library_id", F.coalesce("locally_available", F.lit(True)).alias("is_local"))


@query("select contact_id, concat_ws(' ', nullif(given_name, ''), nullif(family_name, '')) as full_name from contacts")
def full_name(t: Tables) -> DataFrame:
    return t.contacts.select("contact_id", scans.full_name().alias("full_name"))


@query("select contact_id, coalesce(nullif(concat_ws(' ', nullif(given_name, ''), nullif(family_name, '')), ''), organization_name) as display_name from contacts")
def display_name(t: Tables) -> DataFrame:
    return t.contacts.select("contact_id", F.coalesce(F.nullif(scans.full_name(), F.lit("")), F.col("organization_name")).alias("display_name"))


@query("select contact_id, filled from names")
def filled_field_count(t: Tables) -> DataFrame:
    return t.contacts.select("contact_id", scans.filled_fields().alias("filled"))


@query("select group_id, library_id, array_to_string(list_sort(list_transform(members, lambda x: cast(x as varchar))), ',') as group_key from groups")
def group_key(t: Tables) -> DataFrame:
    return t.groups.select("group_id", "library_id", F.concat_ws(",", F.array_sort(F.transform("members", lambda x: x.cast("string")))).alias("group_key"))


_PRIMARY = "primary_res p join assets a using (asset_id)"


@query(f"select p.asset_id, preset, cast(floor(p.file_size * factor) as bigint) as estimated from {_PRIMARY}, (values {', '.join(f'({chr(39)}{n}{chr(39)}, {f}::double)' for n, f in K.PRESETS)}) s(preset, factor) where a.media_type = 'video' and p.file_size is not null")
def compression_estimate(t: Tables) -> DataFrame:
    presets = F.array(*[F.struct(F.lit(n).alias("preset"), F.lit(f).alias("factor")) for n, f in K.PRESETS])
    sizes = scans.primary_resource(t.assets.where("media_type = 'video'"), t.asset_resources).where("file_size is not null")
    return sizes.select("asset_id", "file_size", F.inline(presets)).select("asset_id", "preset", F.floor(F.col("file_size") * F.col("factor")).cast("long").alias("estimated"))


@query(f"select asset_id, library_id from assets where {_IMG} and media_subtypes & 4 = 0 and media_subtypes & 8 <> 0")
def bitmask_filter(t: Tables) -> DataFrame:
    return scans.images(t.assets).where(scans.has_bit(K.LIVE)).select("asset_id", "library_id")


_LARGE_PHOTO = f"select p.asset_id, p.library_id, p.file_size from {_PRIMARY} where a.media_type = 'image' and a.media_subtypes & 4 = 0 and p.file_size >= {K.LARGE_PHOTO}"


@query(_LARGE_PHOTO)
def large_photos(t: Tables) -> DataFrame:
    return scans.large_photos(t.assets, t.asset_resources).select("asset_id", "library_id", "file_size").orderBy(F.desc("file_size"), "asset_id")


@query("select asset_id, library_id, creation_date is null or creation_date < timestamp '2024-02-01' - interval 30 day as is_old from assets where media_type = 'image' and media_subtypes & 4 <> 0")
def split_old_recent(t: Tables) -> DataFrame:
    now = F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")
    old = F.col("creation_date").isNull() | (F.col("creation_date") < now - F.expr("interval 30 days"))
    return scans.with_bit(t.assets, K.SCREENSHOT).select("asset_id", "library_id", old.alias("is_old"))


@query("select g.group_id, bool_or(not coalesce(p.locally_available, true)) as has_cold from (select group_id, unnest(members) as asset_id from groups) g join primary_res p using (asset_id) group by 1")
def cold_members_check(t: Tables) -> DataFrame:
    local = scans.primary_resource(t.assets, t.asset_resources).select("asset_id", F.coalesce("locally_available", F.lit(True)).alias("here"))
    return t.groups.select("group_id", F.explode("members").alias("asset_id")).join(local, "asset_id").groupBy("group_id").agg(F.bool_or(~F.col("here")).alias("has_cold"))


@query(f"with s as ({_SIZED}) select a.library_id, coalesce(sum(bytes) filter (a.media_type = 'image'), 0)::bigint as photo_bytes, coalesce(sum(bytes) filter (a.media_type = 'video'), 0)::bigint as video_bytes, count(*) as items from assets a left join s using (asset_id) group by 1")
def storage_breakdown(t: Tables) -> DataFrame:
    return storage.breakdown(t.assets, t.asset_resources)


@query(f"with s as ({_SIZED}), b as (select library_id, coalesce(sum(bytes) filter (media_type = 'image'), 0)::double as p, coalesce(sum(bytes) filter (media_type = 'video'), 0)::double as v from s group by 1), u as (select library_id, p, v, greatest(total_bytes - available_bytes, 1)::double as used, total_bytes::double as total from storage join b using (library_id)) select library_id, round(p / used, 6) as photo_share, round(v / used, 6) as video_share, round(greatest(used - p - v, 0) / used, 6) as other_share, round(used / greatest(total, 1), 6) as used_fraction from u")
def storage_fractions(t: Tables) -> DataFrame:
    return storage.fractions(storage.breakdown(t.assets, t.asset_resources), t.storage)


@query(f"with v as ({_LARGE_VIDEO}), l as (select library_id, sum(case when coalesce(locally_available, false) then coalesce(p.file_size, 0) else 0 end) as x from primary_res p where asset_id in (select asset_id from v) group by 1), b as (select library_id, count(*) * {K.BLURRY_BYTES} as x from asset_analysis where is_blurry group by 1), s as (select library_id, count(*) * {K.SCREENSHOT_BYTES} as x from assets where media_type = 'image' and media_subtypes & 4 <> 0 group by 1), p as (select library_id, sum(file_size) as x from ({_LARGE_PHOTO}) group by 1) select u.library_id, least(coalesce(l.x, 0) + coalesce(b.x, 0) + coalesce(s.x, 0) + coalesce(p.x, 0), greatest(total_bytes - available_bytes, 0))::bigint as reclaimable from storage u left join l using (library_id) left join b using (library_id) left join s using (library_id) left join p using (library_id)")
def reclaimable_bytes(t: Tables) -> DataFrame:
    return storage.reclaimable(t.assets, t.asset_resources, t.asset_analysis, t.storage)


@query("select g.group_id, coalesce(sum(r.file_size), 0)::bigint as bytes from (select group_id, unnest(members[2:]) as asset_id from groups) g left join (select asset_id, file_size from asset_resources where resource_type = 'video') r using (asset_id) group by 1")
def video_reclaimable(t: Tables) -> DataFrame:
    rest = t.groups.select("group_id", F.explode(F.slice("members", 2, 1 << 30)).alias("asset_id"))
    return rest.join(t.asset_resources.where("resource_type = 'video'").select("asset_id", "file_size"), "asset_id", "left").groupBy("group_id").agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


@query("select library_id, count(*) as n, sum(coalesce(file_size, 0))::bigint as bytes from first_res where asset_id in (select unnest(members[2:]) from groups) group by 1")
def deletion_totals(t: Tables) -> DataFrame:
    ids = t.groups.select(F.explode(F.slice("members", 2, 1 << 30)).alias("asset_id"))
    return scans.first_resource_bytes(t.asset_resources).join(ids, "asset_id", "left_semi").groupBy("library_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(f"with v as ({_LARGE_VIDEO}), p as ({_LARGE_PHOTO}) select 'files' as list, count(*) as n, sum(file_size)::bigint as bytes from v union all select 'photos', count(*), sum(file_size)::bigint from p")
def visible_totals(t: Tables) -> DataFrame:
    v, p = scans.large_videos(t.assets, t.asset_resources), scans.large_photos(t.assets, t.asset_resources)
    both = v.select(F.lit("files").alias("list"), "file_size").union(p.select(F.lit("photos"), "file_size"))
    return both.groupBy("list").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


@query("with s as (select *, case when epoch_us(creation_date) - lag(epoch_us(creation_date)) over w <= 1800000000 then 0 else 1 end as f from assets where media_type = 'image' window w as (partition by library_id order by creation_date, asset_id)), x as (select *, sum(f) over (partition by library_id order by creation_date, asset_id rows unbounded preceding) as session from s) select library_id, cast(session as bigint) as session, min(creation_date) as start_at, max(creation_date) as end_at, count(*) as n from x group by 1, 2")
def sessionize_time(t: Tables) -> DataFrame:
    rows = sessions.by_gap(scans.images(t.assets, True), K.ROLL_GAP_S)
    return rows.groupBy("library_id", "session").agg(F.min("creation_date").alias("start_at"), F.max("creation_date").alias("end_at"), F.count("*").alias("n"))


# a roll is folded over its assets in order: the state is the roll's number, its last time, and its mean place
_ROLLS = """with o as (select *, row_number() over (partition by library_id order by creation_date, asset_id) as k, epoch_us(creation_date) as us from assets where media_type = 'image'),
f as (select library_id, k, asset_id, us, latitude as slat, longitude as slon, case when latitude is null then 0 else 1 end as c, 1 as roll, creation_date from o where k = 1
  union all
  select o.library_id, o.k, o.asset_id, o.us,
    case when x.same then case when o.latitude is null then f.slat else coalesce(f.slat, 0) + o.latitude end else o.latitude end,
    case when x.same then case when o.latitude is null then f.slon else coalesce(f.slon, 0) + o.longitude end else o.longitude end,
    case when x.same then f.c else 0 end + case when o.latitude is null then 0 else 1 end, f.roll + case when x.same then 0 else 1 end, o.creation_date
  from f join o on o.library_id = f.library_id and o.k = f.k + 1, lateral (select o.us - f.us <= 1800000000 and (o.latitude is null or f.c = 0 or
    12742.0 * atan2(sqrt(pow(sin(radians(o.latitude - f.slat / f.c) / 2), 2) + cos(radians(f.slat / f.c)) * cos(radians(o.latitude)) * pow(sin(radians(o.longitude - f.slon / f.c) / 2), 2)),
      sqrt(1 - (pow(sin(radians(o.latitude - f.slat / f.c) / 2), 2) + cos(radians(f.slat / f.c)) * cos(radians(o.latitude)) * pow(sin(radians(o.longitude - f.slon / f.c) / 2), 2)))) <= 1.0) as same) x),
rolls as (select library_id, roll, min(asset_id) as group_id, list(asset_id order by k) as members, min(creation_date) as start_at, max(creation_date) as end_at, count(*) as n, round(arg_max(slat, k) / nullif(max(c), 0), 6) as lat, round(arg_max(slon, k) / nullif(max(c), 0), 6) as lon
  from f group by 1, 2 having count(*) >= 5 and max(us) - min(us) >= 300000000)
"""


@query(_ROLLS + "select library_id, members, start_at, end_at, n, lat, lon from rolls")
def event_rolls(t: Tables) -> DataFrame:
    return sessions.event_rolls(scans.images(t.assets, True)).select("library_id", "members", "start_at", "end_at", "n", "lat", "lon")


@query(_ROLLS + "select library_id, start_at from rolls")
def rolls_newest_first(t: Tables) -> DataFrame:
    return sessions.event_rolls(scans.images(t.assets, True)).select("library_id", "start_at").orderBy(F.desc("start_at"), "library_id")


@query(_ROLLS + "select library_id, members[1] as first_id, (epoch_us(end_at) - epoch_us(start_at)) / 1e6 as duration_s, n, case when cast(start_at as date) = cast(end_at as date) then strftime(start_at, '%Y-%m-%d') else strftime(start_at, '%Y-%m-%d') || ' - ' || strftime(end_at, '%Y-%m-%d') end as date_range from rolls")
def roll_metrics(t: Tables) -> DataFrame:
    r = sessions.event_rolls(scans.images(t.assets, True))
    a, b = F.date_format("start_at", "yyyy-MM-dd"), F.date_format("end_at", "yyyy-MM-dd")
    return r.select("library_id", F.col("members")[0].alias("first_id"), ((epoch_us(F.col("end_at")) - epoch_us(F.col("start_at"))) / 1e6).alias("duration_s"), "n", F.when(a == b, a).otherwise(F.concat(a, F.lit(" - "), b)).alias("date_range"))


@query(_ROLLS + """, d as (select r.library_id, r.members[1] as first_id, p.place_id, p.locality, p.country, 12742.0 * asin(least(1, sqrt(pow(sin(radians(p.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - r.lon) / 2), 2)))) as km from rolls r join places p on abs(floor(p.lat) - floor(r.lat)) <= 1 and abs(floor(p.lon) - floor(r.lon)) <= 1)
select library_id, first_id, nullif(concat_ws(', ', locality, country), '') as place from (select *, row_number() over (partition by library_id, first_id order by round(km, 6), place_id) as k from d) where k = 1""")  # fmt: skip
def nearest_place(t: Tables) -> DataFrame:
    rolls = sessions.event_rolls(scans.images(t.assets, True)).select("library_id", F.col("members")[0].alias("first_id"), "lat", "lon")
    return sessions.nearest_place(rolls, t.places, ["library_id", "first_id"])


@query("select library_id, asset_id, creation_date from (select *, row_number() over (partition by library_id order by creation_date desc, asset_id) as k from assets where media_type = 'image' and media_subtypes & 4 = 0 and asset_id not in (select unnest(members) from groups where group_id % 4 = 1)) where k <= 800")
def recent_capped(t: Tables) -> DataFrame:
    gone = t.groups.where("group_id % 4 = 1").select(F.explode("members").alias("asset_id"))
    rows = scans.images(t.assets).join(gone, "asset_id", "left_anti")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("library_id").orderBy(F.desc("creation_date"), "asset_id"))).where("k <= 800").select("library_id", "asset_id", "creation_date")
