"""The same tables as in ``sources/adapters``, as DuckDB common table expressions for the oracle."""

from __future__ import annotations

import re

from shelfwise.functions.constants import CATEGORY_PREFIXES, NICKNAMES, SCREENSHOT_WORDS


def strings(values: object) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_SHIFT = "case vec_id % 4 when 0 then 995e-3 when 1 then 96e-2 when 2 then 9e-1 else 6e-1 end"
_PX = "list_transform(range(0, 256), lambda i: cast(floor((cast(embedding[i % 64 + 1] as double) + 1e0) * 127.5e0) as int))"
_PREFIXES = strings(p for c in CATEGORY_PREFIXES.values() for p in c)

CTE = {
    "assets": """
select event_id as asset_id, event_type as library_id, case when event_id % 10 < 8 then 'image' else 'video' end as media_type,
  cast((case when event_id % 7 = 0 then 1 else 0 end) + (case when event_id % 5 = 0 then 4 else 0 end) + (case when event_id % 4 = 0 then 8 else 0 end) + (case when event_id % 6 = 0 then 16 else 0 end) as int) as media_subtypes,
  ts as creation_date, case event_id % 3 when 0 then ts when 1 then ts + interval '45' second else ts + interval '90' second end as modification_date,
  cast(100 * (1 + event_id % 40) as int) as pixel_width, 3000 as pixel_height,
  case when event_id % 8 <> 0 then 37e0 + (event_id % 20) * 8e-4 end as latitude, case when event_id % 8 <> 0 then -122e0 end as longitude,
  case when event_id % 9 = 0 then cast(user_id as varchar) end as burst_identifier, event_id % 50 = 0 as in_trash, cast(event_id % 21 as double) + 1 as duration
from events""",
    "asset_resources": """
select event_id as asset_id, event_type as library_id, 0 as ord,
  case when event_id % 11 = 0 then 'other' when event_id % 10 < 8 then 'photo' else 'video' end as resource_type,
  case event_id % 6 when 0 then 'image_1.jpg' when 1 then '3f2b9c1e-77aa-4c0d-9d11-aabbccddeeff.jpg' else 'IMG_0001.HEIC' end as original_filename,
  case when event_id % 13 = 0 then null else cast(round(value * 100) as bigint) * 10000 end as file_size,
  case when event_id % 17 = 0 then null else event_id % 4 <> 0 end as locally_available
from events
union all
select event_id, event_type, 1, case when event_id % 10 < 8 then 'fullSizePhoto' else 'fullSizeVideo' end, 'full.bin', cast(round(value * 50) as bigint) * 10000, true
from events where event_id % 3 = 0""",
    "dhashes": """
select event_id as asset_id, event_type as library_id,
  xor(cast(floor(event_id / 8) as bigint) * 3141592653589, cast(case event_id % 4 when 0 then 0 when 1 then 1 when 2 then 6 else 240 end as bigint)) as dhash
from events""",
    "feature_prints": f"""
select vec_id as asset_id, concat('L', label % 3) as library_id, 0 as frame_idx, timestamp '2024-01-01 00:00:00' + cast(vec_id as int) * interval '1' minute as creation_date,
  list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings
union all
select vec_id + 1000000, concat('L', label % 3), 0, timestamp '2024-01-01 00:05:00' + cast(vec_id as int) * interval '1' minute,
  list_transform(embedding, lambda x: cast(x as double) * ({_SHIFT})) from embeddings""",
    "video_prints": """
select asset_id, library_id, frame_idx, vec from feature_prints
union all
select asset_id, library_id, 1, list_concat(vec[2:], vec[1:1]) from feature_prints where asset_id % 3 <> 0""",
    "asset_vectors": """
select asset_id, list_transform(embedding, lambda x: cast(x as double)) as vec from (select asset_id, asset_id % (select count(*) from embeddings) as vec_id from assets where asset_id % 3 <> 1) join embeddings using (vec_id)""",
    "video_frames": """
with v as (select asset_id, library_id, asset_id % (select count(*) from embeddings) as vec_id, case asset_id % 5 when 1 then 9e-1 when 2 then 75e-2 when 3 then 6e-1 else 1e0 end as f from assets where media_type = 'video'),
p as (select asset_id, library_id, list_transform(embedding, lambda x: cast(x as double) * f) as vec from v join embeddings using (vec_id))
select asset_id, library_id, 0 as frame_idx, vec from p union all select asset_id, library_id, 1, list_concat(vec[2:], vec[1:1]) from p where asset_id % 3 <> 0""",
    "contacts": """
select p_partkey as contact_id, concat('C', p_partkey % 5) as library_id,
  case p_partkey % 6 when 0 then 'Bob' when 1 then 'Robert' when 2 then 'Róbert' else split_part(p_name, ' ', 1) end as given_name,
  case when p_partkey % 23 = 0 then '' else split_part(p_name, ' ', 2) end as family_name, case when p_partkey % 4 = 0 then '' else p_type end as organization_name,
  case when p_partkey % 3 = 0 then cast([] as varchar[]) when p_partkey % 19 = 0 then ['12-34']
    when p_partkey % 2 = 0 then [concat('+1 (555) ', lpad(cast(p_partkey % 400 as varchar), 3, '0'), '-0199')]
    else [concat('555-', lpad(cast((p_partkey - 1) % 400 as varchar), 3, '0'), '-0199')] end as phone_numbers,
  [concat(lower(p_brand), '@example.com')] as emails, case when p_partkey % 7 = 0 then date '1990-01-01' end as birthday, p_partkey % 2 = 0 as image_available
from part""",
    "asset_analysis": """
select a.asset_id, a.library_id, epoch_us(modification_date) / 1e6 + case when a.asset_id % 10 = 0 then 5e0 when a.asset_id % 14 = 0 then 1e0 else 0e0 end as modification_date,
  case when a.asset_id % 3 <> 0 then dhash end as dhash, case when a.asset_id % 4 <> 0 then a.asset_id % 6 = 2 end as is_blurry,
  case when a.asset_id % 5 <> 0 then (a.asset_id % 100) / 1e2 end as quality_score,
  case when a.asset_id % 3 <> 1 then (['Food & Drink', 'Pets & Animals', 'Nature & Outdoors', 'Documents & Receipts', 'Architecture', 'Vehicles'])[a.asset_id % 6 + 1] end as semantic_category
from assets a join dhashes d using (asset_id) where a.asset_id % 2 = 0""",
    "luma": f"""
select vec_id as asset_id, 16 as w, 16 as h,
  case vec_id % 4 when 0 then list_transform(range(0, 256), lambda i: 128) when 1 then list_transform({_PX}, lambda x: cast(floor(x / 8) as int))
    when 2 then list_transform(range(0, 256), lambda i: case when (i + i // 16) % 2 = 0 then 255 else 0 end) else {_PX} end as px
from embeddings""",
    "vision_signals": f"""
select a.asset_id, a.library_id, (a.asset_id % 100) / 1e2 as luma, case when a.asset_id % 31 = 0 then 1 else 0 end as barcode_count, case when a.asset_id % 29 = 0 then 0 else 1 end as salient_count,
  case when a.asset_id % 7 = 0 then cast([] as varchar[]) else list_concat([({strings(SCREENSHOT_WORDS)})[a.asset_id % 12 + 1]], coalesce(string_split(d.text, chr(10)), cast([] as varchar[]))) end as ocr_lines,
  [{{'identifier': ({_PREFIXES})[a.asset_id % 45 + 1], 'confidence': (a.asset_id % 20) / 2e1}}, {{'identifier': ({_PREFIXES})[a.asset_id * 7 % 45 + 1], 'confidence': (a.asset_id % 10) / 2e1}},
   {{'identifier': case when a.asset_id % 41 = 0 then 'laptop_computer' else 'education' end, 'confidence': (a.asset_id % 9) / 2e1}}] as observations,
  case when a.asset_id % 5 = 0 then [{{'left_ear': (a.asset_id % 30) / 1e2, 'right_ear': (a.asset_id % 20) / 1e2, 'capture_quality': (a.asset_id % 50) / 1e2}}] else [] end as faces
from assets a left join documents d on d.doc_id = a.asset_id % (select count(*) from documents)""",
    "class_probs": """
select asset_id, library_id, label, (asset_id * k % 7) / 7e0 as confidence
from assets, (values ('sharp', 1), ('blurry', 2), ('overexposed', 3), ('underexposed', 4)) t(label, k)
where media_type = 'image' and asset_id % 3 <> 0 and not (asset_id % 9 = 1 and k = 2)""",
    "token_vectors": """
select token, list_transform(embedding, lambda x: cast(x as double)) as vec
from (select distinct token from (select unnest(string_split(lower(p_type), ' ')) as token from part union all select unnest(string_split(lower(replace(p_brand, '#', ' ')), ' ')) from part) where token <> '') t
join embeddings e on e.vec_id = (ascii(token) * 31 + length(token) * 7 + ascii(substr(token, 2, 1))) % (select count(*) from embeddings)""",
    "places": """
select n_nationkey as place_id, 37e0 + n_nationkey * 1e-3 as lat, -122e0 as lon, case when n_nationkey % 7 <> 0 then n_name end as locality, r_name as country
from nation join region on n_regionkey = r_regionkey""",
    "storage": "select event_type as library_id, count(*) * 100000000 as total_bytes, count(*) * 30000000 as available_bytes from events group by 1",
    "files": """
select case when page_id % 10 = 0 then concat('/docs/.cache/', page_id) else concat('/docs', regexp_replace(url, '^[a-z]+://[^/]*', '')) end as path, page_id, page_id * 1000000 as length, page_id % 17 = 0 as is_dir
from pages""",
    "training_files": """
select l.doc_id, concat(case when toxic = 1 then 'overexposed' when quality = 1 then 'sharp' else 'blurry' end, '/', l.doc_id, (['.jpg', '.JPEG', '.png', '.txt'])[l.doc_id % 4 + 1]) as path,
  cast(n_chars % 101 as double) as mos, cast(l.doc_id % 256 as double) as mean_luma
from labels l join documents d using (doc_id)""",
    "deletions": """
select event_type as library_id, event_id, ts, cast(round(value * 100) as bigint) * 10000 as bytes, cast(1 + event_id % 3 as int) as n,
  (['darkShot', 'qrCode', 'screenPhoto', 'whiteboard', 'memeForwarded', 'eyesClosed', 'blurryPhoto', 'noSubject', 'lowLight', 'sharedPhoto'])[event_id % 10 + 1] as reason
from events""",
    "affinity": "select library_id, reason, count(*) % 7 as deleted from deletions group by 1, 2",
    "groups": """
select library_id, members[1] as group_id, reason, members from (
  select event_type as library_id, event_id // 24 as g, (['exactDuplicate', 'nearDuplicate', 'visuallySimilar', 'burstShot'])[(event_id // 24) % 4 + 1] as reason, list(event_id order by event_id) as members
  from events group by all) where len(members) >= 2""",
    "review_state": """
select library_id, case when group_id % 3 = 1 then 'completed' else 'skipped' end as kind, array_to_string(members, ',') as key from groups where group_id % 3 in (1, 2)
union all select library_id, 'marked', cast(members[2] as varchar) from groups where group_id % 5 = 0
union all select library_id, 'skipped', array_to_string(members, ',') from groups where group_id % 15 = 1""",
    "user_decisions": """
select decision_id, o_orderstatus as library_id, o_orderdate as recorded_at, kept_id, kept_vec_id, deleted
from orders join (
  select l_orderkey as decision_id, l_orderkey * 10 + l_linenumber as kept_id, case when l_orderkey % 4 <> 0 then l_partkey % (select count(*) from embeddings) end as kept_vec_id from lineitem where l_linenumber = 1) k on k.decision_id = o_orderkey
left join (
  select l_orderkey as did, list({'asset_id': l_orderkey * 10 + l_linenumber, 'label': l_returnflag, 'score': cast(l_quantity as double) / 5e1, 'vec_id': l_partkey % (select count(*) from embeddings)} order by l_linenumber) as deleted
  from lineitem where l_linenumber > 1 group by 1) g on g.did = o_orderkey""",
}

_FOLDED = "trim(regexp_replace(lower(strip_accents({})), '\\s+', ' ', 'g'))"
_MAP = "map(" + strings(NICKNAMES) + ", " + strings(NICKNAMES.values()) + ")"


def folded(x: str) -> str:
    return _FOLDED.format(x)


def expanded(x: str) -> str:
    """Of an already folded name."""
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda t: coalesce({_MAP}[t], t)), ' ')"


def turned(x: str) -> str:
    return f"array_to_string(list_reverse(string_split({x}, ' ')), ' ')"


CTE["names"] = f"""
select contact_id, library_id, full_name, n, {turned('n')} as rn, e, {turned('e')} as re, org, filled from (
  select *, {expanded('n')} as e from (
    select contact_id, library_id, full_name, {folded('full_name')} as n, organization_name as org, filled from (
      select *, concat_ws(' ', nullif(given_name, ''), nullif(family_name, '')) as full_name,
        cast(given_name <> '' as int) + cast(family_name <> '' as int) + cast(organization_name <> '' as int) + cast(len(phone_numbers) > 0 as int) + cast(len(emails) > 0 as int) + cast(birthday is not null as int) + cast(image_available as int) as filled
      from contacts)))"""
CTE["phones"] = """
select distinct library_id, contact_id, case when length(d) = 10 then '1' || d else d end as phone from (
  select library_id, contact_id, regexp_replace(unnest(phone_numbers), '[^\\p{Nd}]', '', 'g') as d from contacts) where length(d) >= 7"""
CTE["phone_pair"] = "select distinct a.library_id, a.contact_id as a, b.contact_id as b from phones a join phones b on a.library_id = b.library_id and a.phone = b.phone and a.contact_id < b.contact_id"


def distance(a: str, b: str) -> str:
    return f"least(levenshtein({a}.n, {b}.n), levenshtein({a}.rn, {b}.n), levenshtein({a}.e, {b}.e), levenshtein({a}.re, {b}.e))"


CTE["primary_res"] = """
select asset_id, library_id, media_type, file_size, locally_available from (
  select r.asset_id, r.library_id, a.media_type, r.file_size, r.locally_available,
    row_number() over (partition by r.asset_id order by case when r.resource_type = case when a.media_type = 'video' then 'video' else 'photo' end then 0 else 1 end, r.ord) as k
  from asset_resources r join assets a using (asset_id)) where k = 1"""
CTE["first_res"] = "select asset_id, library_id, file_size, original_filename from asset_resources where ord = 0"
CTE["exact_groups"] = """
select library_id, dhash, min(asset_id) as group_id, list(asset_id order by pixel_width * pixel_height desc, creation_date desc, asset_id) as members, max(creation_date) as newest, 'exactDuplicate' as reason, 0e0 as similarity
from assets join dhashes using (asset_id, library_id) where media_type = 'image' and media_subtypes & 4 = 0 group by 1, 2 having count(*) >= 2"""
CTE["dist_pairs"] = """
select a.library_id, a.asset_id as a, b.asset_id as b, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d,
  epoch_us(a.creation_date) // 900000000 = epoch_us(b.creation_date) // 900000000 as same_bucket
from feature_prints a join feature_prints b on a.library_id = b.library_id and a.asset_id < b.asset_id"""

DEPENDS = {k: [t for t in CTE if t != k and re.search(rf"\b{t}\b", v)] for k, v in CTE.items()}


def components(pairs: str, names: str = "comp") -> str:
    """CTEs ``names(library_id, id, component)`` of pairs (library_id, a, b); needs ``with recursive``."""
    return f"""{names}_e as (select library_id, a, b from {pairs} union select library_id, b, a from {pairs}),
{names}_r as (select library_id, a as id, a as component from {names}_e union select e.library_id, e.b, r.component from {names}_r r join {names}_e e on e.library_id = r.library_id and e.a = r.id where r.component < e.b),
{names} as (select library_id, id, min(component) as component from {names}_r group by 1, 2)"""


def oracle(body: str) -> str:
    """``body`` with the tables that it mentions; it may start with its own ``with`` list."""
    need: list[str] = []

    def add(name: str) -> None:
        for d in DEPENDS[name]:
            if d not in need:
                add(d)
        if name not in need:
            need.append(name)

    own = body.strip()
    for t in CTE:
        if re.search(rf"\b{t}\b", own):
            add(t)
    head = ", ".join(f"{t} as ({CTE[t]})" for t in need)
    if own.lower().startswith("with "):
        rest = own[5:].removeprefix("recursive ")
        return f"with recursive {head}, {rest}" if head else f"with recursive {rest}"
    return f"with recursive {head} {own}" if head else own
