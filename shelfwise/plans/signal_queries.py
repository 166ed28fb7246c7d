"""Pixel and vision signals, the analysis cache, categories, tags and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.functions import constants as K
from shelfwise.functions import image
from shelfwise.functions.text import tag_screenshot
from shelfwise.operators import cache, picks, scans, signals
from shelfwise.plans.registry import query
from shelfwise.plans.tables_sql import strings
from shelfwise.sources.adapters import Tables


def _any(x: str, words: object) -> str:
    return f"len(list_filter({strings(words)}, lambda k: contains({x}, k))) > 0"


@query("select asset_id, cast(list_sum(list_transform(range(0, 63), lambda i: case when px[(i // 8) * 9 + i % 8 + 1] < px[(i // 8) * 9 + i % 8 + 2] then cast(1 as bigint) << i else 0 end)) as bigint) + case when px[70 + 1] < px[71 + 1] then -9223372036854775807 - 1 else 0 end as dhash from luma")
def dhash_from_grid(t: Tables) -> DataFrame:
    return t.luma.select("asset_id", image.dhash(F.col("px")).alias("dhash"))


_LAP = """with lp as (select asset_id, x, y, cast(4 * px[y * 16 + x + 1] - px[(y - 1) * 16 + x + 1] - px[(y + 1) * 16 + x + 1] - px[y * 16 + x] - px[y * 16 + x + 2] as double) as v from luma, range(1, 15) a(x), range(1, 15) b(y)),
gv as (select asset_id, var_pop(v) as variance, avg(v * v) as mean_square from lp group by 1),
tl as (select asset_id, list(v order by v) as tiles from (select asset_id, var_pop(v) as v from lp where x // 4 < 3 and y // 4 < 3 group by asset_id, x // 4, y // 4) group by 1),
fv as (select asset_id, var_pop(v) as face_variance from lp where x between 4 and 11 and y between 4 and 11 and asset_id % 5 = 0 group by 1),
mn as (select asset_id, list_avg(px) as mean from luma),
ft as (select * from mn join gv using (asset_id) join tl using (asset_id) left join fv using (asset_id)),
bl as (select asset_id, case when variance <= 8.0 * s then false when face_variance is not null then face_variance < 55.0 * s when p90 > 420.0 then false when p10 > 1.0 and p90 / p10 >= 4.0 then false when p90 < 260.0 * s then true else p50 < 120.0 * s end as is_blurry
  from (select *, 0.33 + 0.67 * mean / 255.0 as s, tiles[2] as p10, tiles[5] as p50, tiles[8] as p90 from ft))"""


def _luma(t: Tables) -> DataFrame:
    """Pictures with the faces that are known of them."""
    faces = t.vision_signals.where("size(faces) > 0").select("asset_id", "faces")
    return t.luma.join(faces, "asset_id", "left")


@query(f"{_LAP} select asset_id, round(variance, 6) as variance from gv")
def laplacian_variance(t: Tables) -> DataFrame:
    return image.pixel_features(t.luma).select("asset_id", F.round("variance", 6).alias("variance"))


@query(f"{_LAP} select asset_id, list_transform(tiles, lambda x: round(x, 6)) as tiles from tl")
def tile_variances(t: Tables) -> DataFrame:
    return image.pixel_features(t.luma).select("asset_id", F.transform("tiles", lambda x: F.round(x, 6)).alias("tiles"))


@query("select asset_id, round(list_avg(px), 6) as mean from luma")
def mean_luminance(t: Tables) -> DataFrame:
    return t.luma.select("asset_id", F.round(image.mean(F.col("px")), 6).alias("mean"))


@query(f"{_LAP} select asset_id, is_blurry from bl")
def is_blurry(t: Tables) -> DataFrame:
    return image.pixel_features(_luma(t)).select("asset_id", image.is_blurry().alias("is_blurry"))


@query(f"{_LAP} select asset_id, mean_square < 80.0 * (0.33 + 0.67 * mean / 255.0) as is_blurry from ft")
def is_blurry_simple(t: Tables) -> DataFrame:
    return image.pixel_features(t.luma).select("asset_id", image.is_blurry_simple().alias("is_blurry"))


_FRESH = "fr as (select c.* from asset_analysis c join assets a using (asset_id) where abs(c.modification_date - coalesce(epoch_us(a.modification_date) / 1e6, 0)) <= 1.0)"


@query(f"{_LAP}, {_FRESH} select a.asset_id, coalesce(fr.is_blurry, bl.is_blurry) as is_blurry, fr.is_blurry is not null as cached from assets a left join fr using (asset_id) left join bl using (asset_id) where a.media_type = 'image' and a.media_subtypes & 4 = 0 and coalesce(fr.is_blurry, bl.is_blurry) is not null")
def blur_scan(t: Tables) -> DataFrame:
    """Cached results where fresh, else computed from pixels; pictures with neither are left out."""
    known = cache.split(scans.images(t.assets), t.asset_analysis, "is_blurry").select("asset_id", "is_blurry", "cached")
    todo = _luma(t).join(known.where("not cached").select("asset_id"), "asset_id", "left_semi")
    made = image.pixel_features(todo).select("asset_id", image.is_blurry().alias("is_blurry"), F.lit(False).alias("cached"))
    return known.where("cached").unionByName(made)


_CACHE = "asset_id, library_id, round(modification_date, 3) as modification_date, dhash, is_blurry, quality_score, semantic_category"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("modification_date", F.round("modification_date", 3)).select("asset_id", "library_id", "modification_date", *cache.SIGNALS)


@query(f"with {_FRESH} select {_CACHE} from fr")
def cache_fresh(t: Tables) -> DataFrame:
    return _rounded(cache.fresh(t.assets, t.asset_analysis))


@query(f"with {_FRESH} select a.asset_id, fr.dhash, fr.dhash is not null as cached from assets a left join fr using (asset_id) where a.media_type = 'image' and a.media_subtypes & 4 = 0")
def cache_split(t: Tables) -> DataFrame:
    return cache.split(scans.images(t.assets), t.asset_analysis, "dhash").select("asset_id", "dhash", "cached")


def _new_signals(t: Tables) -> DataFrame:
    return t.assets.where("asset_id % 3 = 0").select("asset_id", "library_id", cache.epoch_s().alias("modification_date"), (F.col("asset_id") % 2 == 1).alias("is_blurry"), F.when(F.col("asset_id") % 2 == 0, F.lit(0.25)).alias("quality_score"))


_NEW = "nw as (select asset_id, library_id, epoch_us(modification_date) / 1e6 as modification_date, asset_id % 2 = 1 as is_blurry, case when asset_id % 2 = 0 then 0.25 end as quality_score from assets where asset_id % 3 = 0)"
_UPSERT = """select asset_id, library_id, round(modification_date, 3) as modification_date, case when stale then null else dhash end as dhash, coalesce(nb, case when stale then null else is_blurry end) as is_blurry,
coalesce(nq, case when stale then null else quality_score end) as quality_score, case when stale then null else semantic_category end as semantic_category
from (select coalesce(n.asset_id, c.asset_id) as asset_id, coalesce(n.library_id, c.library_id) as library_id, coalesce(n.modification_date, c.modification_date) as modification_date, c.dhash, c.is_blurry, c.quality_score, c.semantic_category, n.is_blurry as nb, cast(n.quality_score as double) as nq,
  coalesce(abs(c.modification_date - n.modification_date) > 1.0, false) as stale from asset_analysis c full join nw n on n.asset_id = c.asset_id) q"""


@query(f"with {_NEW} {_UPSERT}")
def cache_upsert(t: Tables) -> DataFrame:
    return _rounded(cache.upsert(t.asset_analysis, _new_signals(t)))


@query(f"select {_CACHE} from asset_analysis where asset_id not in (select asset_id from assets where in_trash)")
def cache_delete(t: Tables) -> DataFrame:
    return _rounded(cache.delete(t.asset_analysis, t.assets.where("in_trash").select("asset_id")))


@query("select asset_id from asset_analysis where is_blurry")
def cache_bulk_blurry(t: Tables) -> DataFrame:
    return t.asset_analysis.where("is_blurry").select("asset_id")


@query("select asset_id, dhash from asset_analysis where dhash is not null")
def cache_bulk_dhash(t: Tables) -> DataFrame:
    return t.asset_analysis.where("dhash is not null").select("asset_id", "dhash")


@query("select asset_id, semantic_category from asset_analysis where semantic_category is not null")
def cache_bulk_semantic(t: Tables) -> DataFrame:
    return t.asset_analysis.where("semantic_category is not null").select("asset_id", "semantic_category")


@query("select asset_id, quality_score from asset_analysis where quality_score is not null")
def cache_bulk_quality(t: Tables) -> DataFrame:
    return t.asset_analysis.where("quality_score is not null").select("asset_id", "quality_score")


# ---- labels and scores

_EXPOSURE = "case when luma < 0.12 then 'Too Dark' when luma > 0.93 then 'Overexposed' end"
_EYES = "len(list_filter(faces, lambda f: f.left_ear < 0.15 and f.right_ear < 0.15)) > 0"
_FACE = f"case when {_EYES} then 'Eyes Closed' when len(list_filter(faces, lambda f: f.capture_quality < 0.25)) > 0 then 'Low Quality' end"
_BLUR = "coalesce(c.is_blurry, false)"
_SIG = f"sg as (select v.*, {_BLUR} as is_blurry, list_filter([case when {_BLUR} then 'Blurry' end, {_EXPOSURE}, {_FACE}, case when salient_count = 0 then 'No Subject' end], lambda x: x is not null) as labels from vision_signals v join assets a using (asset_id) left join asset_analysis c on c.asset_id = v.asset_id where a.media_type = 'image')"
_HEUR = "hq as (select asset_id, greatest(0, least(1, 0.5e0 - case when list_contains(labels, 'Blurry') then 0.3e0 else 0 end - case when list_contains(labels, 'Eyes Closed') then 0.2e0 else 0 end - case when list_contains(labels, 'Too Dark') then 0.15e0 else 0 end - case when list_contains(labels, 'Overexposed') then 0.15e0 else 0 end - case when list_contains(labels, 'Low Quality') then 0.2e0 else 0 end - case when list_contains(labels, 'No Subject') then 0.15e0 else 0 end)) as score from sg)"
_MODEL = "mq as (select asset_id, greatest(0, least(1, sum(confidence * case label when 'sharp' then 1e0 when 'blurry' then -0.7e0 else -0.5e0 end) + 0.5e0)) as score from class_probs group by 1)"


def _signals(t: Tables) -> DataFrame:
    """Vision columns of images with the blur result of the cache."""
    known = t.asset_analysis.select("asset_id", "is_blurry")
    rows = t.vision_signals.join(t.assets.where("media_type = 'image'").select("asset_id"), "asset_id", "left_semi").join(known, "asset_id", "left")
    return rows.withColumn("is_blurry", F.coalesce("is_blurry", F.lit(False))).withColumn("labels", signals.quality_labels())


@query(f"select asset_id, {_EXPOSURE} as label from vision_signals")
def exposure_label(t: Tables) -> DataFrame:
    return t.vision_signals.select("asset_id", signals.exposure_label().alias("label"))


@query(f"select asset_id, {_FACE} as label from vision_signals")
def face_labels(t: Tables) -> DataFrame:
    return t.vision_signals.select("asset_id", signals.face_label().alias("label"))


@query(f"with {_SIG} select asset_id, labels from sg")
def quality_labels(t: Tables) -> DataFrame:
    return _signals(t).select("asset_id", "labels")


@query(f"with {_SIG}, {_HEUR} select asset_id, round(score, 6) as score from hq")
def heuristic_quality(t: Tables) -> DataFrame:
    return _signals(t).select("asset_id", F.round(signals.heuristic_quality(), 6).alias("score"))


@query(f"with {_MODEL} select asset_id, round(score, 6) as score from mq")
def model_quality(t: Tables) -> DataFrame:
    return signals.model_quality(t.class_probs).select("asset_id", F.round("score", 6).alias("score"))


_SCORE = f"{_SIG}, {_HEUR}, {_MODEL}, {_FRESH}, qs as (select h.asset_id, coalesce(fr.quality_score, mq.score, h.score) as score from hq h left join mq using (asset_id) left join fr on fr.asset_id = h.asset_id)"


def _scores(t: Tables) -> DataFrame:
    known = cache.fresh(t.assets, t.asset_analysis).select("asset_id", "quality_score")
    rows = _signals(t).select("library_id", "asset_id", signals.heuristic_quality().alias("heuristic"))
    return rows.join(signals.model_quality(t.class_probs).select("asset_id", "score"), "asset_id", "left").join(known, "asset_id", "left").select("library_id", "asset_id", F.coalesce("quality_score", "score", "heuristic").alias("score"))


@query(f"with {_SCORE} select asset_id, round(score, 6) as score from qs")
def quality_score(t: Tables) -> DataFrame:
    return _scores(t).select("asset_id", F.round("score", 6).alias("score"))


_PRE = ", ".join(f"({i}, '{n}', '{p}', {j})" for i, (n, ps) in enumerate(K.CATEGORY_PREFIXES.items()) for j, p in enumerate(ps))
_SEM = f"""ob as (select asset_id, unnest(observations) as o, generate_subscripts(observations, 1) as pos from vision_signals), px(no, name, prefix, j) as (values {_PRE}),
ht as (select asset_id, o.confidence as confidence, pos, name, row_number() over (partition by asset_id order by o.confidence desc, pos, no, j) as k from ob join px on contains(lower(o.identifier), prefix) where o.confidence >= 0.4),
sc as (select asset_id, name as semantic_category from ht where k = 1 and confidence > 0.4)"""


@query(f"with {_SEM} select asset_id, semantic_category from sc")
def semantic_category(t: Tables) -> DataFrame:
    return signals.semantic_category(t.vision_signals)


_SCAN = f"{_SEM}, {_FRESH}, ss as (select a.library_id, a.asset_id, coalesce(fr.semantic_category, sc.semantic_category) as category from assets a left join fr using (asset_id) left join sc using (asset_id) where a.media_type = 'image')"


def _semantic(t: Tables) -> DataFrame:
    known = cache.split(scans.images(t.assets, True), t.asset_analysis, "semantic_category").select("library_id", "asset_id", "semantic_category", "cached")
    made = signals.semantic_category(t.vision_signals.join(known.where("not cached").select("asset_id"), "asset_id", "left_semi")).withColumnRenamed("semantic_category", "made")
    return known.join(made, "asset_id", "left").select("library_id", "asset_id", F.coalesce("semantic_category", "made").alias("category"))


@query(f"with {_SCAN} select library_id, asset_id, category from ss where category is not null")
def semantic_scan(t: Tables) -> DataFrame:
    return _semantic(t).where("category is not null")


@query(f"with {_SCAN} select library_id, category, count(*) as n from ss where category is not null group by 1, 2")
def semantic_groups(t: Tables) -> DataFrame:
    return _semantic(t).where("category is not null").groupBy("library_id", "category").agg(F.count("*").alias("n")).orderBy("library_id", F.desc("n"), "category")


_TAG = f"""case when {_any('j', K.RECEIPT)} then 'Receipt' when {_any('j', K.BOARDING)} then 'Boarding Pass' when {_any('j', K.COUPON)} then 'Coupon / Code'
when length(replace(j, ' ', '')) < 15 and len(ocr_lines) > 0 then 'Meme' when {_any('j', K.MEME)} then 'Meme' when len(list_filter(ocr_lines, lambda s: length(s) < 50)) > 5 and {_any('j', K.MESSAGING)} then 'Conversation' else 'Other' end"""
_TAGS = f"tg as (select asset_id, library_id, {_TAG} as tag from (select v.*, lower(array_to_string(ocr_lines, ' ')) as j from vision_signals v join assets a using (asset_id) where a.media_type = 'image' and a.media_subtypes & 4 <> 0))"


def _tags(t: Tables) -> DataFrame:
    shots = scans.with_bit(t.assets, K.SCREENSHOT).select("asset_id", "library_id")
    return shots.join(t.vision_signals.select("asset_id", "ocr_lines"), "asset_id", "left").select("asset_id", "library_id", tag_screenshot(F.coalesce("ocr_lines", F.array().cast("array<string>"))).alias("tag"))


@query(f"with {_TAGS} select * from tg")
def screenshot_tags(t: Tables) -> DataFrame:
    return _tags(t)


@query(f"with {_TAGS} select asset_id from tg where tag = 'Receipt'")
def tag_filter(t: Tables) -> DataFrame:
    return _tags(t).where("tag = 'Receipt'").select("asset_id")


@query(f"with {_TAGS} select distinct tag, list_position({strings(K.SCREENSHOT_TAGS)}, tag) as place from tg")
def present_tags(t: Tables) -> DataFrame:
    order = F.array(*[F.lit(x) for x in K.SCREENSHOT_TAGS])
    return _tags(t).select("tag").distinct().withColumn("place", F.array_position(order, F.col("tag"))).orderBy("place")


# ---- wasted shots and picks

_WASTED = f"""{_SIG}, wr as (select asset_id, library_id, case when luma < 0.08 then 'darkShot' when barcode_count > 0 then 'qrCode' when len(list_filter(observations, lambda o: o.confidence > 0.35 and {_any('o.identifier', K.SCREENS)})) > 0 then 'screenPhoto'
when luma > 0.55 and len(ocr_lines) >= 6 and len(faces) = 0 then 'whiteboard' when len(ocr_lines) > 0 and ({_any("lower(array_to_string(ocr_lines, ' '))", K.WATERMARKS)} or len(ocr_lines) >= 14) then 'memeForwarded'
when luma >= 0.08 and luma < 0.15 then 'lowLight' when {_EYES} then 'eyesClosed' when salient_count = 0 then 'noSubject' when is_blurry then 'blurryPhoto' end as reason from sg)"""


def _wasted(t: Tables) -> DataFrame:
    return _signals(t).select("asset_id", "library_id", signals.wasted_reason().alias("reason"))


@query(f"with {_WASTED} select * from wr")
def wasted_reason(t: Tables) -> DataFrame:
    return _wasted(t)


@query(f"with {_WASTED} select asset_id from wr where reason = 'qrCode'")
def reason_filter(t: Tables) -> DataFrame:
    return _wasted(t).where("reason = 'qrCode'").select("asset_id")


@query(f"with {_WASTED} select reason, min(asset_id) as first_at from wr where reason is not null group by 1")
def present_reasons(t: Tables) -> DataFrame:
    return _wasted(t).where("reason is not null").groupBy("reason").agg(F.min("asset_id").alias("first_at")).orderBy("first_at")


@query(f"with {_WASTED} select asset_id, wr.reason, coalesce(deleted, 0) as deleted from wr left join affinity f on f.library_id = wr.library_id and f.reason = wr.reason where wr.reason is not null")
def affinity_join(t: Tables) -> DataFrame:
    return picks.with_affinity(_wasted(t).where("reason is not null"), t.affinity).select("asset_id", "reason", "deleted")


_SHARED = "sh as (select a.library_id, a.asset_id, a.creation_date, cast(latitude is null as int) + cast(lower(original_filename) like 'image%' or (contains(original_filename, '-') and length(original_filename) > 30) as int) + cast(coalesce(file_size > 0 and file_size < 500000, false) as int) + cast(abs(epoch_us(creation_date) - epoch_us(modification_date)) > 60000000 as int) + cast(burst_identifier is null and media_subtypes & 24 = 0 as int) as signals from assets a join first_res r using (asset_id) where media_type = 'image')"


def _shared(t: Tables) -> DataFrame:
    return signals.shared_photos(scans.images(t.assets, True), t.asset_resources.where("ord = 0"))


@query(f"with {_SHARED} select asset_id, library_id, signals from sh where signals >= 3")
def shared_photo(t: Tables) -> DataFrame:
    return _shared(t).select("asset_id", "library_id", "signals")


@query(f"with {_SHARED} select library_id, asset_id from (select *, row_number() over (partition by library_id order by creation_date, asset_id) as k from sh where signals >= 3) where k <= 200")
def shared_capped(t: Tables) -> DataFrame:
    w = Window.partitionBy("library_id").orderBy("creation_date", "asset_id")
    return _shared(t).withColumn("k", F.row_number().over(w)).where("k <= 200").select("library_id", "asset_id")


_CAND = "ca as (select library_id, asset_id, 0 as source, asset_id as pos from asset_analysis where is_blurry union all select library_id, unnest(members[2:]), 1, group_id from groups), cd as (select library_id, asset_id, source, pos from (select *, row_number() over (partition by library_id, asset_id order by source, pos) as k from ca) where k = 1)"


def _candidates(t: Tables) -> DataFrame:
    blur = t.asset_analysis.where("is_blurry").select("library_id", "asset_id", F.lit(0).alias("source"), F.col("asset_id").alias("pos"))
    rest = t.groups.select("library_id", F.explode(F.slice("members", 2, 1 << 30)).alias("asset_id"), F.lit(1).alias("source"), F.col("group_id").alias("pos"))
    return picks.keep_first(blur.unionByName(rest))


@query(f"with {_CAND} select * from cd")
def dedupe_keep_first(t: Tables) -> DataFrame:
    return _candidates(t)


_WORST = f"{_CAND}, {_SCORE}, lw as (select library_id, asset_id, score, k from (select c.library_id, c.asset_id, round(coalesce(score, 0.5), 6) as score, row_number() over (partition by c.library_id order by round(coalesce(score, 0.5), 6), c.asset_id) as k from cd c left join qs using (asset_id)) where k <= 300)"


def _lowest(t: Tables) -> DataFrame:
    return picks.lowest(_candidates(t), _scores(t), 300)


@query(f"with {_WORST} select library_id, asset_id, score from lw")
def lowest_quality_300(t: Tables) -> DataFrame:
    return _lowest(t).select("library_id", "asset_id", "score")


_WR2 = _WASTED.removeprefix(_SIG + ", ")
_PICKS = f"""{_WORST}, {_WR2},
cap as (select a.library_id, case when max(coalesce(f.m, 0)) >= 5 then 1500 else 800 end as cap from (select distinct library_id from assets) a left join (select library_id, max(deleted) as m from affinity group by 1) f using (library_id) group by 1),
rc as (select library_id, asset_id, row_number() over (partition by library_id order by creation_date desc, asset_id) as k from assets a where media_type = 'image' and media_subtypes & 4 = 0 and not exists (select 1 from cd where cd.library_id = a.library_id and cd.asset_id = a.asset_id)),
ws as (select rc.library_id, rc.asset_id, wr.reason, coalesce(f.deleted, 0) as deleted, k from rc join cap using (library_id) join wr using (asset_id) left join affinity f on f.library_id = rc.library_id and f.reason = wr.reason where k <= cap and wr.reason is not null),
pk as (select library_id, asset_id, reason, case when deleted >= 3 then 1 else 3 end as tier, row_number() over (partition by library_id, case when deleted >= 3 then 1 else 3 end order by deleted desc, k) as rank from ws union all select library_id, asset_id, null, 2, k from lw)"""


@query(f"with {_PICKS} select * from pk")
def smart_picks(t: Tables) -> DataFrame:
    return picks.smart_picks(_candidates(t), _lowest(t), scans.images(t.assets), _wasted(t), t.affinity)


@query("select asset_id, round(list_avg(list_transform(range(0, 85), lambda k: 0.2126e0 * (px[3 * k + 1] / 255e0) + 0.7152e0 * (px[3 * k + 2] / 255e0) + 0.0722e0 * (px[3 * k + 3] / 255e0))), 6) as brightness from luma")
def luma_bt709(t: Tables) -> DataFrame:
    """Mean brightness of pixels read as red, green and blue."""
    part = lambda k, c: F.get("px", (3 * k + c).cast("int")) / F.lit(255.0)
    each = F.transform(F.sequence(F.lit(0), F.lit(84)), lambda k: image.luma_bt709(part(k, 0), part(k, 1), part(k, 2)))
    return t.luma.select("asset_id", F.round(image.mean(each), 6).alias("brightness"))


_POINTS = "p as (select vec_id as asset_id, case when vec_id % 7 = 0 then 3 else 6 end as n, list_transform(embedding[1:12], lambda v: cast(v as double)) as e from embeddings), xy as (select asset_id, n, list_max(e[1:n]) - list_min(e[1:n]) as sx, list_max(e[7:6 + n]) - list_min(e[7:6 + n]) as sy from p)"


@query(f"with {_POINTS} select asset_id, round(case when n >= 4 and sx > 0.01 then sy / sx else 1e0 end, 6) as aspect from xy")
def eye_aspect(t: Tables) -> DataFrame:
    """Height to width of landmarks taken from vectors; every seventh has too few of them."""
    last = F.when(F.col("vec_id") % 7 == 0, 2).otherwise(5)
    points = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get("embedding", i).cast("double").alias("x"), F.get("embedding", i + 6).cast("double").alias("y")))
    return t.read("embeddings").select(F.col("vec_id").alias("asset_id"), points.alias("points")).select("asset_id", F.round(image.eye_aspect(F.col("points")), 6).alias("aspect"))


@query("select asset_id, 0.25e0 * pixel_width as x, 0.25e0 * pixel_height as y, 0.5e0 * pixel_width as w, 0.5e0 * pixel_height as h from assets where asset_id % 5 = 0")
def face_pixel_rect(t: Tables) -> DataFrame:
    """Faces of all pictures in pixels, counted from the top left."""
    faces = t.vision_signals.select("asset_id", F.explode("faces").alias("f")).join(t.assets.select("asset_id", "pixel_width", "pixel_height"), "asset_id")
    return faces.select("asset_id", image.face_rect(F.col("f"), F.col("pixel_width"), F.col("pixel_height")).alias("r")).select("asset_id", "r.*")
