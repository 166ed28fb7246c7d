"""The library's tables, derived from the generic test tables (see FIXTURES.md).

Each adapter is a plain projection of one or two tables, so filters and column pruning reach the Parquet scan.
A deployment replaces this module by readers of its own exports; operators only know the columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.constants import CATEGORY_PREFIXES, SCREENSHOT_WORDS


class Tables:
    """Lazy tables under one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def assets(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id as asset_id", "event_type as library_id",
            "case when event_id % 10 < 8 then 'image' else 'video' end as media_type",
            "cast(if(event_id % 7 = 0, 1, 0) + if(event_id % 5 = 0, 4, 0) + if(event_id % 4 = 0, 8, 0) + if(event_id % 6 = 0, 16, 0) as int) as media_subtypes",
            "ts as creation_date",
            "case event_id % 3 when 0 then ts when 1 then ts + interval '45' second else ts + interval '90' second end as modification_date",
            "cast(100 * (1 + event_id % 40) as int) as pixel_width", "3000 as pixel_height",
            "case when event_id % 8 <> 0 then 37e0 + (event_id % 20) * 8e-4 end as latitude", "case when event_id % 8 <> 0 then -122e0 end as longitude",
            "case when event_id % 9 = 0 then cast(user_id as string) end as burst_identifier", "event_id % 50 = 0 as in_trash",
            "cast(event_id % 21 as double) + 1 as duration",
        )

    @cached_property
    def asset_resources(self) -> DataFrame:
        events = self.read("events")
        first = events.selectExpr(
            "event_id as asset_id", "event_type as library_id", "0 as ord",
            "case when event_id % 11 = 0 then 'other' when event_id % 10 < 8 then 'photo' else 'video' end as resource_type",
            "case event_id % 6 when 0 then 'image_1.jpg' when 1 then '3f2b9c1e-77aa-4c0d-9d11-aabbccddeeff.jpg' else 'IMG_0001.HEIC' end as original_filename",
            "case when event_id % 13 = 0 then null else cast(round(value * 100) as bigint) * 10000 end as file_size",
            "case when event_id % 17 = 0 then null else event_id % 4 <> 0 end as locally_available",
        )
        second = events.where("event_id % 3 = 0").selectExpr(
            "event_id", "event_type", "1", "case when event_id % 10 < 8 then 'fullSizePhoto' else 'fullSizeVideo' end", "'full.bin'",
            "cast(round(value * 50) as bigint) * 10000", "true",
        )
        return first.union(second)

    @cached_property
    def dhashes(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id as asset_id", "event_type as library_id",
            "((cast(floor(event_id / 8) as bigint) * 3141592653589) ^ cast(case event_id % 4 when 0 then 0 when 1 then 1 when 2 then 6 else 240 end as bigint)) as dhash",
        )

    @cached_property
    def feature_prints(self) -> DataFrame:
        e = self.read("embeddings")
        shift = "case vec_id % 4 when 0 then 995e-3 when 1 then 96e-2 when 2 then 9e-1 else 6e-1 end"
        at = "timestamp_ntz'2024-01-01 {}' + cast(vec_id as int) * interval '1' minute as creation_date"
        one = e.selectExpr("vec_id as asset_id", "concat('L', label % 3) as library_id", "0 as frame_idx", at.format("00:00:00"), "transform(embedding, x -> cast(x as double)) as vec")
        two = e.selectExpr("vec_id + 1000000", "concat('L', label % 3)", "0", at.format("00:05:00"), f"transform(embedding, x -> cast(x as double) * ({shift}))")
        return one.union(two)

    @cached_property
    def video_prints(self) -> DataFrame:
        """Key frames of videos: the picture's own print and, for two in three, a rotated one."""
        p = self.feature_prints.select("asset_id", "library_id", "frame_idx", "vec")
        turned = p.where("asset_id % 3 <> 0").selectExpr("asset_id", "library_id", "1 as frame_idx", "concat(slice(vec, 2, size(vec) - 1), slice(vec, 1, 1)) as vec")
        return p.union(turned)

    @cached_property
    def asset_vectors(self) -> DataFrame:
        """One vector an asset, for two assets in three."""
        e = self.read("embeddings")
        a = self.assets.where("asset_id % 3 <> 1").selectExpr("asset_id", f"asset_id % {max(1, e.count())} as vec_id")
        return a.join(e.select("vec_id", "embedding"), "vec_id").selectExpr("asset_id", "transform(embedding, x -> cast(x as double)) as vec")

    @cached_property
    def video_frames(self) -> DataFrame:
        """Key frames of the test videos: one print or two, of vectors that a few videos share, at several scales."""
        e = self.read("embeddings")
        v = self.assets.where("media_type = 'video'").selectExpr("asset_id", "library_id", f"asset_id % {max(1, e.count())} as vec_id", "case asset_id % 5 when 1 then 9e-1 when 2 then 75e-2 when 3 then 6e-1 else 1e0 end as f")
        p = v.join(e.select("vec_id", "embedding"), "vec_id").selectExpr("asset_id", "library_id", "0 as frame_idx", "transform(embedding, x -> cast(x as double) * f) as vec")
        return p.union(p.where("asset_id % 3 <> 0").selectExpr("asset_id", "library_id", "1", "concat(slice(vec, 2, size(vec) - 1), slice(vec, 1, 1))"))

    @cached_property
    def contacts(self) -> DataFrame:
        return self.read("part").selectExpr(
            "p_partkey as contact_id", "concat('C', p_partkey % 5) as library_id",
            "case p_partkey % 6 when 0 then 'Bob' when 1 then 'Robert' when 2 then 'Róbert' else split_part(p_name, ' ', 1) end as given_name",
            "case when p_partkey % 23 = 0 then '' else split_part(p_name, ' ', 2) end as family_name",
            "case when p_partkey % 4 = 0 then '' else p_type end as organization_name",
            "case when p_partkey % 3 = 0 then cast(array() as array<string>) when p_partkey % 19 = 0 then array('12-34') "
            "when p_partkey % 2 = 0 then array(concat('+1 (555) ', lpad(cast(p_partkey % 400 as string), 3, '0'), '-0199')) "
            "else array(concat('555-', lpad(cast((p_partkey - 1) % 400 as string), 3, '0'), '-0199')) end as phone_numbers",
            "array(concat(lower(p_brand), '@example.com')) as emails", "case when p_partkey % 7 = 0 then date '1990-01-01' end as birthday", "p_partkey % 2 = 0 as image_available",
        )

    @cached_property
    def asset_analysis(self) -> DataFrame:
        epoch = "unix_micros(cast(modification_date as timestamp)) / 1e6"
        a = self.assets.where("asset_id % 2 = 0").join(self.dhashes.select("asset_id", "dhash"), "asset_id")
        return a.selectExpr(
            "asset_id", "library_id", f"{epoch} + case when asset_id % 10 = 0 then 5e0 when asset_id % 14 = 0 then 1e0 else 0e0 end as modification_date",
            "case when asset_id % 3 <> 0 then dhash end as dhash", "case when asset_id % 4 <> 0 then asset_id % 6 = 2 end as is_blurry",
            "case when asset_id % 5 <> 0 then (asset_id % 100) / 1e2 end as quality_score",
            "case when asset_id % 3 <> 1 then element_at(array('Food & Drink', 'Pets & Animals', 'Nature & Outdoors', 'Documents & Receipts', 'Architecture', 'Vehicles'), cast(asset_id % 6 as int) + 1) end as semantic_category",
        )

    @cached_property
    def luma(self) -> DataFrame:
        px = "transform(sequence(0, 255), i -> cast(floor((cast(embedding[i % 64] as double) + 1e0) * 127.5e0) as int))"
        return self.read("embeddings").selectExpr(
            "vec_id as asset_id", "16 as w", "16 as h",
            f"case vec_id % 4 when 0 then transform(sequence(0, 255), i -> 128) when 1 then transform({px}, x -> cast(floor(x / 8) as int)) "
            f"when 2 then transform(sequence(0, 255), i -> if((i + cast(floor(i / 16) as int)) % 2 = 0, 255, 0)) else {px} end as px",
        )

    @cached_property
    def vision_signals(self) -> DataFrame:
        words = F.array(*[F.lit(w) for w in SCREENSHOT_WORDS])
        prefixes = F.array(*[F.lit(p) for c in CATEGORY_PREFIXES.values() for p in c])
        documents = self.read("documents")
        texts = documents.select(F.col("doc_id").alias("d"), F.split("text", "\n").alias("lines"))
        a = self.assets.selectExpr("asset_id", "library_id", f"asset_id % {max(1, documents.count())} as d").join(texts, "d", "left")
        i = F.col("asset_id")
        face = F.expr("named_struct('x', 0.25D, 'y', 0.25D, 'w', 0.5D, 'h', 0.5D, 'left_ear', (asset_id % 30) / 1e2, 'right_ear', (asset_id % 20) / 1e2, 'capture_quality', (asset_id % 50) / 1e2)")
        faces = F.when(i % 5 == 0, F.array(face))
        return a.select(
            "asset_id", "library_id", ((i % 100) / 1e2).alias("luma"), F.when(i % 31 == 0, 1).otherwise(0).alias("barcode_count"), F.when(i % 29 == 0, 0).otherwise(1).alias("salient_count"),
            F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.element_at(words, (i % 12).cast("int") + 1)), F.coalesce("lines", F.array().cast("array<string>")))).alias("ocr_lines"),
            F.array(
                F.struct(F.element_at(prefixes, (i % 45).cast("int") + 1).alias("identifier"), ((i % 20) / 2e1).alias("confidence")),
                F.struct(F.element_at(prefixes, (i * 7 % 45).cast("int") + 1).alias("identifier"), ((i % 10) / 2e1).alias("confidence")),
                F.struct(F.when(i % 41 == 0, "laptop_computer").otherwise("education").alias("identifier"), ((i % 9) / 2e1).alias("confidence")),
            ).alias("observations"),
            F.coalesce(faces, F.array().cast(faces_type)).alias("faces"),
        )

    @cached_property
    def class_probs(self) -> DataFrame:
        a = self.assets.where("media_type = 'image'").select("asset_id", "library_id")
        return a.selectExpr("asset_id", "library_id", "stack(4, 'sharp', 1, 'blurry', 2, 'overexposed', 3, 'underexposed', 4) as (label, k)").where("asset_id % 3 <> 0 and not (asset_id % 9 = 1 and k = 2)").selectExpr("asset_id", "library_id", "label", "(asset_id * k % 7) / 7e0 as confidence")

    @cached_property
    def token_vectors(self) -> DataFrame:
        types = self.read("part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("token"))
        brands = self.read("part").select(F.explode(F.split(F.lower(F.regexp_replace("p_brand", "#", " ")), " ")).alias("token"))
        tokens = types.union(brands).where("token <> ''").distinct()
        # the vector of a token is that of a row given by its letters
        e = self.read("embeddings")
        n = F.expr(f"pmod(ascii(token) * 31 + length(token) * 7 + ascii(substring(token, 2)), {max(1, e.count())})")
        return tokens.withColumn("vec_id", n.cast("long")).join(e.selectExpr("vec_id", "transform(embedding, x -> cast(x as double)) as vec"), "vec_id").select("token", "vec")

    @cached_property
    def places(self) -> DataFrame:
        n, r = self.read("nation"), self.read("region")
        return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).selectExpr(  # region has five rows
            "n_nationkey as place_id", "37e0 + n_nationkey * 1e-3 as lat", "-122e0 as lon", "case when n_nationkey % 7 <> 0 then n_name end as locality", "r_name as country"
        )

    @cached_property
    def storage(self) -> DataFrame:
        return self.read("events").groupBy(F.col("event_type").alias("library_id")).agg((F.count("*") * 100_000_000).alias("total_bytes"), (F.count("*") * 30_000_000).alias("available_bytes"))

    @cached_property
    def files(self) -> DataFrame:
        return self.read("pages").selectExpr(
            "case when page_id % 10 = 0 then concat('/docs/.cache/', page_id) else concat('/docs', regexp_replace(url, '^[a-z]+://[^/]*', '')) end as path", "page_id",
            "page_id * 1000000 as length", "page_id % 17 = 0 as is_dir",
        )

    @cached_property
    def training_files(self) -> DataFrame:
        d, l = self.read("documents"), self.read("labels")
        return l.join(d.select("doc_id", "n_chars"), "doc_id").selectExpr(
            "doc_id", "concat(case when toxic = 1 then 'overexposed' when quality = 1 then 'sharp' else 'blurry' end, '/', doc_id, element_at(array('.jpg', '.JPEG', '.png', '.txt'), cast(doc_id % 4 as int) + 1)) as path",
            "cast(n_chars % 101 as double) as mos", "cast(doc_id % 256 as double) as mean_luma",
        )

    @cached_property
    def deletions(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_type as library_id", "event_id", "ts", "cast(round(value * 100) as bigint) * 10000 as bytes", "cast(1 + event_id % 3 as int) as n",
            "element_at(array('darkShot', 'qrCode', 'screenPhoto', 'whiteboard', 'memeForwarded', 'eyesClosed', 'blurryPhoto', 'noSubject', 'lowLight', 'sharedPhoto'), cast(event_id % 10 as int) + 1) as reason",
        )

    @cached_property
    def affinity(self) -> DataFrame:
        """Deletions so far: what is left of their counts beyond multiples of seven, so that few and many occur."""
        return self.deletions.groupBy("library_id", "reason").agg((F.count("*") % 7).alias("deleted"))

    @cached_property
    def groups(self) -> DataFrame:
        """Member lists as a previous scan left them."""
        a = self.read("events").selectExpr("event_id as asset_id", "event_type as library_id", "cast(floor(event_id / 24) as bigint) as g", "element_at(array('exactDuplicate', 'nearDuplicate', 'visuallySimilar', 'burstShot'), cast(floor(event_id / 24) % 4 as int) + 1) as reason")
        rows = a.groupBy("library_id", "g", "reason").agg(F.array_sort(F.collect_list("asset_id")).alias("members"))
        return rows.where("size(members) >= 2").selectExpr("library_id", "members[0] as group_id", "reason", "members")

    @cached_property
    def review_state(self) -> DataFrame:
        key = F.concat_ws(",", F.transform("members", lambda x: x.cast("string")))
        kinds = self.groups.select("library_id", F.when(F.col("group_id") % 3 == 1, "completed").when(F.col("group_id") % 3 == 2, "skipped").alias("kind"), key.alias("key")).where("kind is not null")
        marked = self.groups.where("group_id % 5 = 0").selectExpr("library_id", "'marked' as kind", "cast(members[1] as string) as key")
        both = self.groups.where("group_id % 15 = 1").select("library_id", F.lit("skipped").alias("kind"), key.alias("key"))
        return kinds.union(marked).union(both)

    @cached_property
    def user_decisions(self) -> DataFrame:
        """An order is a decision: its first line is kept, the others are deleted."""
        o, l = self.read("orders"), self.read("lineitem")
        vectors = max(1, self.read("embeddings").count())
        line = l.selectExpr("l_orderkey as decision_id", "l_linenumber as no", f"l_partkey % {vectors} as vec_id", "l_orderkey * 10 + l_linenumber as asset_id", "cast(l_quantity as double) / 5e1 as score", "l_returnflag as label")
        kept = line.where("no = 1").selectExpr("decision_id", "asset_id as kept_id", "case when decision_id % 4 <> 0 then vec_id end as kept_vec_id")
        gone = line.where("no > 1").groupBy("decision_id").agg(F.array_sort(F.collect_list(F.struct("asset_id", "label", "score", "vec_id"))).alias("deleted"))
        head = o.selectExpr("o_orderkey as decision_id", "o_orderstatus as library_id", "o_orderdate as recorded_at")
        return head.join(kept, "decision_id").join(gone, "decision_id", "left")


faces_type = "array<struct<x:double,y:double,w:double,h:double,left_ear:double,right_ear:double,capture_quality:double>>"
