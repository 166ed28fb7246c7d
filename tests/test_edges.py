"""Hand-made edge tables: one for each limit and quirk."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import image, text, vectors
from shelfwise.operators import cache, contacts, groups, pairs, picks, review, scans, sessions, signals
from shelfwise.operators.components import connected_components

T0 = dt.datetime(2024, 1, 1)


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


def test_phones(spark):
    got = column(spark, ["+1 (555) 867-5309", "555-867-5309", "123456", "1234567", "١٢٣٤٥٦٧", None], "string", text.normalize_phone)
    assert got == ["15558675309", "15558675309", None, "1234567", "١٢٣٤٥٦٧", None]


@pytest.mark.parametrize(("a", "b", "d"), [("Bob Smith", "Robert Smith", 0), ("John Smith", "Smith John", 0), ("José", "Jose", 0), ("", "Al", 2), ("Anna Lee", "Hanna Leer", 2), ("Abcd", "Axyz", 3), ("  A   b ", "a B", 0)])
def test_name_distance(spark, a, b, d):
    rows = [(1, "L", a, "", "", [], [], None, False), (2, "L", b, "", "", [], [], None, False)]
    keys = contacts.contact_keys(spark.createDataFrame(rows, "contact_id long, library_id string, given_name string, family_name string, organization_name string, phone_numbers array<string>, emails array<string>, birthday date, image_available boolean"))
    f = keys.select("contact_id", F.struct("n", "rn", "e", "re").alias("f"))
    both = f.where("contact_id = 1").select(F.col("f").alias("x")).crossJoin(f.where("contact_id = 2").select(F.col("f").alias("y")))
    assert both.select(text.name_distance("x", "y")).first()[0] == d
    assert (contacts.name_pairs(keys, 2).count() == 1) == (d <= 2 and a.strip() != "" and b != "")


def test_name_join_equals_nested_loop(spark):
    rng = random.Random(4)
    names = ["".join(rng.choices("ab ", k=rng.randint(1, 9))).strip() or "a" for _ in range(150)]
    rows = [(i, "L", n, "", "", [], [], None, False) for i, n in enumerate(names)]
    keys = contacts.contact_keys(spark.createDataFrame(rows, "contact_id long, library_id string, given_name string, family_name string, organization_name string, phone_numbers array<string>, emails array<string>, birthday date, image_available boolean"))
    keys.createOrReplaceTempView("names_")
    want = spark.sql("select a.contact_id, b.contact_id from names_ a join names_ b on a.contact_id < b.contact_id where least(levenshtein(a.n, b.n), levenshtein(a.rn, b.n), levenshtein(a.e, b.e), levenshtein(a.re, b.e)) <= 2").collect()
    assert {tuple(r)[1:3] for r in contacts.name_pairs(keys, 2).collect()} == {tuple(r) for r in want}


def test_similar_organisations_match(spark):
    rows = [(1, "L", "Anna", "Leeee", "Red Shop", [], [], None, False), (2, "L", "Hanna", "Lee", "Scarlet Shop", [], [], None, False), (3, "L", "", "", "Red Shop", [], [], None, False), (4, "L", "", "", "Scarlet Store", [], [], None, False), (5, "L", "Quite", "Different", "Red Shop", [], [], None, False)]
    keys = contacts.contact_keys(spark.createDataFrame(rows, "contact_id long, library_id string, given_name string, family_name string, organization_name string, phone_numbers array<string>, emails array<string>, birthday date, image_available boolean"))
    tokens = spark.createDataFrame([("red", [1.0, 0.1]), ("scarlet", [1.0, 0.2]), ("shop", [0.0, 1.0]), ("store", [0.1, 1.0])], "token string, vec array<double>")
    got = {(r.primary_id, r.duplicate_id, r.confidence, r.reasons[0].kind) for r in contacts.contact_matches(keys, tokens).collect()}
    assert got == {(1, 2, "possible", "semanticOrganization"), (3, 4, "possible", "semanticOrganization")}


def assets(spark, rows):
    return spark.createDataFrame(rows, "library_id string, asset_id long, creation_date timestamp_ntz, latitude double, longitude double")


@pytest.mark.parametrize(("gap", "n"), [(1800, 1), (1801, 2)])
def test_session_gap(spark, gap, n):
    rows = assets(spark, [("L", 1, T0, None, None), ("L", 2, T0 + dt.timedelta(seconds=gap), None, None)])
    assert sessions.by_gap(rows).select("session").distinct().count() == n


@pytest.mark.parametrize(("count", "span", "kept"), [(5, 299, 0), (5, 300, 1), (4, 900, 0)])
def test_roll_size(spark, count, span, kept):
    rows = [("L", i, T0 + dt.timedelta(seconds=span * i / (count - 1)), None, None) for i in range(count)]
    assert sessions.event_rolls(assets(spark, rows)).count() == kept


def test_roll_distance():
    km = 1 / (6371.0 * 3.141592653589793 / 180)
    near = [(1, 0.0, 0.0, 0.0), (2, 60.0, km * 0.999, 0.0), (3, 120.0, None, None)]
    assert len(list(sessions.split_rolls(near))) == 1
    assert len(list(sessions.split_rolls([near[0], (2, 60.0, km * 1.001, 0.0)]))) == 2
    assert len(list(sessions.split_rolls([(1, 0.0, None, None), (2, 1.0, 50.0, 8.0)]))) == 1


@pytest.mark.parametrize("limit", [0.5, 0.12, 0.35])
def test_distance_limits(spark, limit):
    rows = [("L", 1, 0, T0, [0.0, 0.0]), ("L", 2, 0, T0, [limit - 1e-4, 0.0]), ("L", 3, 0, T0, [0.0, limit]), ("L", 4, 0, T0, [1.0])]
    p = spark.createDataFrame(rows, "library_id string, asset_id long, frame_idx int, creation_date timestamp_ntz, vec array<double>")
    for got in (pairs.pivot_pairs(p, limit), pairs.bucket_pairs(p, limit), pairs.keyframe_pairs(p, limit)):
        assert {(r.a, r.b) for r in got.collect()} == {(1, 2)}


def test_pivot_join_equals_all_pairs(spark):
    rng = random.Random(2)
    rows = [(f"L{i % 2}", i, [rng.random() for _ in range(3)]) for i in range(200)]
    got = pairs.pivot_pairs(spark.createDataFrame(rows, "library_id string, asset_id long, vec array<double>"), 0.3)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and sum((x - y) ** 2 for x, y in zip(a[2], b[2], strict=True)) ** 0.5 < 0.3}
    assert {(r.a, r.b) for r in got.collect()} == want


def test_buckets_do_not_overlap(spark):
    rows = [("L", 1, T0 + dt.timedelta(seconds=899), [0.0]), ("L", 2, T0 + dt.timedelta(seconds=901), [0.0])]
    assert pairs.bucket_pairs(spark.createDataFrame(rows, "library_id string, asset_id long, creation_date timestamp_ntz, vec array<double>")).count() == 0


def test_hash_bits(spark):
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = []
    for _ in range(40):
        base = rng.getrandbits(64)
        values.append(base)
        for k in (0, 3, 4):
            x = base
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            values.append(x)
    rows = [("L", i, signed(v)) for i, v in enumerate(values)]
    got = pairs.all_hash_pairs(spark.createDataFrame(rows, "library_id string, asset_id long, dhash long")).collect()
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 3}
    assert {(r.a, r.b) for r in got} == want
    star = pairs.hash_pairs(spark.createDataFrame(rows, "library_id string, asset_id long, dhash long"))
    one, two = ({r.id: r.component for r in connected_components(x).collect()} for x in (star, spark.createDataFrame(sorted(want), "a long, b long")))
    assert one == two


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(5)] + [(10, 11), (11, 12), (12, 10), (20, 21), (21, 22), (12, 20), (30, 30), (40, 41), (41, 40), (40, 41)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    rng.shuffle(edges)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert {tuple(r) for r in connected_components(spark.createDataFrame([("b", "a"), (None, "c")], "a string, b string")).collect()} == {("a", "a"), ("b", "a")}


def test_merge_priority(spark):
    rows = [("L", 1, "visuallySimilar", [1, 2], 0), ("L", 9, "exactDuplicate", [2, 1], 1), ("L", 3, "burstShot", [3, 4], 0), ("L", 8, "nearDuplicate", [4, 3], 1), ("L", 5, "burstShot", [5, 6], 0), ("L", 7, "unknown", [5, 6], 1)]
    g = spark.createDataFrame(rows, "library_id string, group_id long, reason string, members array<long>, arrival int")
    assert {(r.group_id, r.reason, tuple(r.members)) for r in groups.merge_priority(g).collect()} == {(1, "exactDuplicate", (1, 2)), (3, "nearDuplicate", (3, 4)), (5, "burstShot", (5, 6))}
    assert {(r.group_id, r.reason) for r in groups.merge_replace(g).collect()} == {(9, "exactDuplicate"), (8, "nearDuplicate"), (5, "burstShot")}


@pytest.mark.parametrize(("n", "want"), [(16, (2, 8, 14)), (4, (0, 2, 3)), (1, (0, 0, 0))])
def test_percentiles(spark, n, want):
    row = spark.createDataFrame([([float(i) for i in range(n)],)], "x array<double>").select(*[image.percentile_nearest(F.col("x"), p) for p in (10, 50, 90)]).first()
    assert tuple(row) == want


def test_pixels(spark):
    flat, sharp = [128] * 256, [255 if (i + i // 16) % 2 else 0 for i in range(256)]
    soft = [min(255, (i % 16) * (i % 16)) for i in range(256)]
    rows = [(1, 16, 16, flat), (2, 16, 16, sharp), (3, 16, 16, soft), (4, 2, 2, [1, 2, 3, 4])]
    got = {r.asset_id: r for r in image.pixel_features(spark.createDataFrame(rows, "asset_id long, w int, h int, px array<int>")).select("*", image.is_blurry().alias("b")).collect()}
    assert got[1].variance == 0 and not got[1].b and not got[2].b and got[4].tiles == [] and got[4].variance == 0
    assert len(got[2].tiles) == 9


@pytest.mark.parametrize(("delta", "hit"), [(1.0, True), (1.01, False), (-1.0, True)])
def test_freshness(spark, delta, hit):
    a = spark.createDataFrame([(1, T0)], "asset_id long, modification_date timestamp_ntz")
    c = spark.createDataFrame([(1, "L", T0.replace(tzinfo=dt.UTC).timestamp() + delta, 5, None, None, None)], CACHE)
    assert cache.fresh(a, c).count() == int(hit)


CACHE = "asset_id long, library_id string, modification_date double, dhash long, is_blurry boolean, quality_score double, semantic_category string"


def test_missing_date_counts_as_zero(spark):
    a = spark.createDataFrame([(1, None)], "asset_id long, modification_date timestamp_ntz")
    assert cache.fresh(a, spark.createDataFrame([(1, "L", 0.5, 5, None, None, None)], CACHE)).count() == 1


def test_upsert_drops_stale_signals(spark):
    old = spark.createDataFrame([(1, "L", 10.0, 5, True, 0.5, "Vehicles")], CACHE)
    new = spark.createDataFrame([(1, "L", 20.0, False), (2, "L", 1.0, None)], "asset_id long, library_id string, modification_date double, is_blurry boolean")
    got = {r.asset_id: tuple(r)[2:] for r in cache.upsert(old, new).collect()}
    assert got == {1: (20.0, None, False, None, None), 2: (1.0, None, None, None, None)}
    assert cache.upsert(old, new, compat=True).where("asset_id = 1").first()[3:] == (5, False, 0.5, "Vehicles")


@pytest.mark.parametrize(("seen", "want"), [([("food", 0.4)], None), ([("Food", 0.41)], "Food & Drink"), ([("education", 0.9)], "Pets & Animals"), ([("sky", 0.5), ("car", 0.9)], "Vehicles"), ([("xyz", 0.9), ("bridge", 0.5)], "Architecture"), ([], None)])
def test_category(spark, seen, want):
    df = spark.createDataFrame([(1, seen)], "asset_id long, observations array<struct<identifier string, confidence double>>")
    got = signals.semantic_category(df).first()
    assert (got.semantic_category if got else None) == want


def test_tags(spark):
    lines = [["Total 5"], ["ok"], [], ["gate 4"], ["plain words that say nothing much at all"], ["a"] * 5 + ["read it all the way through"]]
    assert column(spark, lines, "array<string>", text.tag_screenshot) == ["Receipt", "Meme", "Other", "Boarding Pass", "Other", "Conversation"]


@pytest.mark.parametrize(("deleted", "tier"), [(2, 3), (3, 1)])
def test_pick_tiers(spark, deleted, tier):
    cand = spark.createDataFrame([("L", 1)], "library_id string, asset_id long")
    worst = spark.createDataFrame([("L", 1, 0.1, 1)], "library_id string, asset_id long, score double, rank int")
    img = spark.createDataFrame([("L", i, T0 + dt.timedelta(minutes=i)) for i in range(1, 4)], "library_id string, asset_id long, creation_date timestamp_ntz")
    shots = spark.createDataFrame([("L", 2, "qrCode"), ("L", 3, None), ("L", 1, "qrCode")], "library_id string, asset_id long, reason string")
    got = {(r.asset_id, r.tier) for r in picks.smart_picks(cand, worst, img, shots, spark.createDataFrame([("L", "qrCode", deleted)], "library_id string, reason string, deleted long")).collect()}
    assert got == {(1, 2), (2, tier)}


@pytest.mark.parametrize(("most", "n"), [(4, 800), (5, 1500)])
def test_pick_cap(spark, most, n):
    img = spark.range(1, 2001).selectExpr("'L' as library_id", "id as asset_id", "timestamp_ntz'2024-01-01' + cast(id as int) * interval '1' minute as creation_date")
    none = spark.createDataFrame([], "library_id string, asset_id long, score double, rank int")
    got = picks.smart_picks(none.select("library_id", "asset_id"), none, img, img.selectExpr("library_id", "asset_id", "'darkShot' as reason"), spark.createDataFrame([("L", "qrCode", most)], "library_id string, reason string, deleted long"))
    assert got.count() == n


@pytest.mark.parametrize(("size", "kept"), [(52_428_799, 0), (52_428_800, 1)])
def test_large_files(spark, size, kept):
    f = spark.createDataFrame([("/a/b", size, False), ("/a/.c/d", size, False), ("/a/e", size, True)], "path string, length long, is_dir boolean")
    assert scans.large_files(f).count() == kept


def test_folder(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"\xab" * 1024)
    row = scans.read_folder(spark, str(tmp_path)).first()
    assert row.length == 1024 and row.path.endswith("x.bin")


def test_zip_parallel(spark):
    rows = [("L", [1, 2], [3, 4]), ("L", [5], [6, 7])]
    got = review.zip_parallel(spark.createDataFrame(rows, "library_id string, ids array<long>, sizes array<long>"), "ids", "sizes").collect()
    assert {(r.id, r.size) for r in got} == {(1, 3), (2, 4)}


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [-1.0, 0.0], [1.0])], "a array<double>, z array<double>, n array<double>, s array<double>").select(*[vectors.cosine01(F.col("a"), F.col(x)) for x in "azns"]).first()
    assert tuple(row) == (1.0, 0.0, 0.0, 0.0)


def test_rebuild_drops_unknown_and_small(spark):
    g = spark.createDataFrame([("L", 1, "exactDuplicate", [3, 1, 2]), ("L", 4, "other", [1, 2]), ("L", 5, "burstShot", [1, 9])], "library_id string, group_id long, reason string, members array<long>")
    got = review.rebuild(g, spark.createDataFrame([(1,), (3,)], "asset_id long")).collect()
    assert [(r.group_id, r.members) for r in got] == [(1, [3, 1])]


def test_snapshot_defaults(spark):
    row = spark.createDataFrame([('{"version": 2, "blurry": [4], "groups": [{"ids": [1, 2], "reason": "burstShot"}]}',)], "document string").select(review.decode_snapshot().alias("s")).first().s
    assert (row.version, row.blurry, row.screenshots, row.large_sizes, row.groups[0].ids) == (2, [4], [], [], [1, 2])


def test_eyes_and_boxes(spark):
    p = "array<struct<x double, y double>>"
    wide = [(0.0, 0.0), (1.0, 0.0), (0.5, 0.1), (0.5, 0.0)]
    assert column(spark, [wide, wide[:3], [(0.0, 0.0)] * 4, None], p, image.eye_aspect) == [0.1, 1.0, 1.0, 1.0]
    row = spark.createDataFrame([((0.25, 0.25, 0.5, 0.5),)], "b struct<x double, y double, w double, h double>").select(image.face_rect(F.col("b"), F.lit(16), F.lit(8)).alias("r"), image.luma_bt709(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("l")).first()
    assert tuple(row.r) == (4.0, 2.0, 8.0, 4.0) and row.l == 1.0


def test_pivot_join_over_cells_and_blocks(spark, monkeypatch):
    """Small blocks: many cells, guests of later cells, and cells of several blocks."""
    rng = random.Random(9)
    centres = [[rng.random() * 4 for _ in range(4)] for _ in range(6)]
    rows = [(f"L{i % 2}", i, [c + rng.gauss(0, 0.15) for c in centres[0 if i % 3 else rng.randrange(6)]]) for i in range(400)]
    rows += [("L0", 1000, None), ("L0", 1001, []), ("L0", 1002, [1.0, None, 1.0, 1.0]), ("L1", 1003, [1.0])]
    monkeypatch.setattr(pairs, "BLOCK", 24)
    got = [(r.library_id, r.a, r.b) for r in pairs.pivot_pairs(spark.createDataFrame(rows, "library_id string, asset_id long, vec array<double>"), 0.3).collect()]
    whole = [r for r in rows if r[2] and len(r[2]) == 4 and None not in r[2]]
    want = {(a[0], a[1], b[1]) for a in whole for b in whole if a[0] == b[0] and a[1] < b[1] and math.dist(a[2], b[2]) < 0.3}
    assert set(got) == want and len(got) == len(want) > 500


def test_lsh_recall(spark):
    rng = random.Random(10)
    rows = [(f"L{i % 3}", i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "library_id string, asset_id long, vec array<double>")
    key = lambda d: {(r.library_id, r.a, r.b) for r in d.collect()}
    want, got = key(pairs.pivot_pairs(df, 0.2)), key(pairs.lsh_pairs(df, 0.2))
    assert got <= want and len(got) > 0.6 * len(want)


@pytest.mark.parametrize("edits", [2, 4])
def test_names_within_edits_are_all_found(spark, edits):
    rng = random.Random(edits)
    names = set()
    while len(names) < 90:
        base = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        names.add(base)
        x = list(base)
        for _ in range(rng.randint(1, edits + 1)):
            k, at = rng.randrange(3), rng.randrange(len(x) + 1)
            x = x[:at] + [rng.choice("abc")] + x[at:] if k == 0 else x[:at] + x[at + 1 :] if k == 1 else x[:at] + [rng.choice("abc")] + x[at + 1 :]
        names.add("".join(x) or "a")
    names = sorted(names)
    keys = spark.createDataFrame([("L", i, n, n, n, n, n) for i, n in enumerate(names)], "library_id string, contact_id long, full_name string, n string, rn string, e string, re string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, cb in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (ca != cb))
        return row[-1]

    want = {(a, b) for a in names for b in names if distance(a, b) <= edits}
    got = {(r.na, r.nb) for r in contacts.name_candidates(keys, edits).collect()}
    assert want <= got


def test_pairs_of_one_component_are_left_out(spark):
    found = spark.createDataFrame([("L", 1, 2), ("L", 1, 3), ("L", 3, 4), ("L", 5, 6)], "library_id string, a long, b long")
    joined = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "id long, component long")
    assert sorted(tuple(r) for r in pairs.apart(found, joined).collect()) == [("L", 1, 3), ("L", 3, 4)]
