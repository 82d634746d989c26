"""Further queries: grids, catalogues, palettes, permutations and composed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.functions import geo
from fieldlens.operators import aggregate as A
from fieldlens.operators import evaluation as E
from fieldlens.operators import joins as J
from fieldlens.operators import learn as L
from fieldlens.operators import select as S
from fieldlens.plans.tables import table
from fieldlens.queries.joins import LINKS, SUPPLIERS, h_sql, links, suppliers
from fieldlens.queries.learning import DRAW
from fieldlens.registry import query
from fieldlens.sources import standins as T


@query("q_best_per_period", """
    WITH g AS (SELECT * FROM (SELECT unnest([1996, 1997, 1998, 1999]) AS y), (SELECT unnest([3, 6, 9]) AS m)), s AS (SELECT year(day) AS y, month(day) AS m, scene_id, cloud FROM scenes WHERE cloud <= 0.05 QUALIFY row_number() OVER (PARTITION BY year(day), month(day) ORDER BY cloud, scene_id) = 1)
    SELECT CAST(g.y AS INTEGER) AS y, CAST(g.m AS INTEGER) AS m, scene_id, cloud FROM g LEFT JOIN s ON s.y = g.y AND s.m = g.m""")  # fmt: skip
def best_per_period(spark: SparkSession, d: str) -> DataFrame:
    """The clearest scene of each period of a grid; empty periods stay."""
    grid = spark.createDataFrame([(y, m) for y in range(1996, 2000) for m in (3, 6, 9)], "y int, m int")
    s = T.scenes(spark, d).filter("cloud <= 0.05").groupBy(F.year("day").alias("y"), F.month("day").alias("m")).agg(F.min(F.struct("cloud", "scene_id")).alias("b"))
    return grid.join(s, ["y", "m"], "left").select("y", "m", "b.scene_id", "b.cloud")


@query("q_analyses_latest_count", "SELECT subject, kind, n, value FROM (SELECT *, count(*) OVER (PARTITION BY subject, kind) AS n FROM status_log) QUALIFY row_number() OVER (PARTITION BY subject, kind ORDER BY logged_at DESC, record_id DESC) = 1")
def analyses_latest_count(spark: SparkSession, d: str) -> DataFrame:
    """Latest record and number of records of each key in one aggregation."""
    return T.status_log(spark, d).groupBy("subject", "kind").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("logged_at", "record_id")).alias("value"))


@query("q_images_for_training", f"SELECT l.scene_id, l.period, s.driver, substr(s.source_id, 10, 4) AS part FROM ({LINKS}) l JOIN samples s USING (sample_id) WHERE NOT l.excluded AND (l.cloud <= 0.05 OR l.shadow IS NULL) AND l.period IN ('PRE', 'POST') AND s.driver IN ('BUILDING', 'FURNITURE')")
def images_for_training(spark: SparkSession, d: str) -> DataFrame:
    s = T.samples(spark, d).filter(F.col("driver").isin("BUILDING", "FURNITURE")).select("sample_id", "driver", F.substring("source_id", 10, 4).alias("part"))
    fine = ~F.col("excluded") & ((F.col("cloud") <= 0.05) | F.col("shadow").isNull()) & F.col("period").isin("PRE", "POST")
    return links(spark, d).filter(fine).join(s, "sample_id").select("scene_id", "period", "driver", "part")


@query("q_scene_rank", "SELECT sample_id, scene_id, round(100 * cloud + abs(dayofyear(day) - 135), 4) AS score FROM scenes QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(100 * cloud + abs(dayofyear(day) - 135), 4), scene_id) <= 2")
def scene_rank(spark: SparkSession, d: str) -> DataFrame:
    """Two best scenes of a sample by cloud and distance from the target day; unknowns score 1000."""
    score = F.round(F.coalesce(100 * F.col("cloud"), F.lit(1000.0)) + F.coalesce(F.abs(F.dayofyear("day") - 135), F.lit(1000)), 4)
    return S.top_per_group(T.scenes(spark, d).withColumn("score", score), ["sample_id"], [F.col("score"), F.col("scene_id")], 2).select("sample_id", "scene_id", "score")


@query("q_palette", """
    WITH c AS (SELECT p_partkey AS k, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part), p AS (SELECT * FROM (VALUES ('forest', 0, 120, 0), ('fire', 220, 40, 20), ('water', 20, 60, 200), ('bare', 190, 170, 130)) AS p(name, r, g, b))
    SELECT k, arg_min(name, (c.r - p.r) ** 2 + (c.g - p.g) ** 2 + (c.b - p.b) ** 2) AS class FROM c, p GROUP BY k""")  # fmt: skip
def palette(spark: SparkSession, d: str) -> DataFrame:
    """Nearest colour of a short palette, as one expression a row."""
    colours = (("forest", 0, 120, 0), ("fire", 220, 40, 20), ("water", 20, 60, 200), ("bare", 190, 170, 130))
    k = F.col("p_partkey")
    rgb = (k * 7 % 256, k * 13 % 256, k * 29 % 256)
    far = lambda c: sum(((x - v) * (x - v) for x, v in zip(rgb, c[1:], strict=True)), F.lit(0))
    best = F.array_min(F.array(*(F.struct(far(c).alias("d"), F.lit(i).alias("i"), F.lit(c[0]).alias("name")) for i, c in enumerate(colours))))
    return table(spark, d, "part").select(k.alias("k"), best["name"].alias("class"))


@query("q_union_last_wins", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def union_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of one kind, where the later entry of a key wins."""
    e = table(spark, d, "events")
    both = e.filter("event_id % 2 = 0").unionByName(e.filter("event_id % 2 = 1"))
    return both.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("q_nearest_candidate", f"""
    SELECT id, arg_min(sample_id, (round(h, 12), sample_id)) AS sample_id FROM (SELECT b.id, a.sample_id, {h_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS h FROM samples a, {SUPPLIERS} b WHERE abs(a.lat - b.lat) < 7 AND 2.0 * 6371000.0 * asin(sqrt({h_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')})) <= 600000) GROUP BY id""")  # fmt: skip
def nearest_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The nearest sample within 600 km of each supplier."""
    near = J.nearest_within(suppliers(spark, d), T.samples(spark, d).select(F.col("sample_id").alias("id"), "lat", "lon"), 600_000)
    return near.select(F.col("a_id").alias("id"), F.col("b_id").alias("sample_id"))


@query("q_legend", "SELECT CAST(p_size AS INTEGER) AS size, min(p_name) AS name FROM part GROUP BY p_size")
def legend(spark: SparkSession, d: str) -> DataFrame:
    """Legend items without repetition, one name a key."""
    return table(spark, d, "part").groupBy(F.col("p_size").alias("size")).agg(F.min("p_name").alias("name"))


@query("q_flag_counts", "SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN cloud > 0.08 THEN 'cloud' END, CASE WHEN shadow > 0.06 THEN 'shadow' END, CASE WHEN brightness < 2000 THEN 'dark' END], lambda x: x IS NOT NULL)) AS flag FROM scenes) GROUP BY flag")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    flags = S.reasons(cloud=F.col("cloud") > 0.08, shadow=F.col("shadow") > 0.06, dark=F.col("brightness") < 2000)
    return T.scenes(spark, d).select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("q_inside_outside", """
    SELECT flag, round(avg(brightness) FILTER (quantity > 25), 4) AS inside, round(avg(brightness) FILTER (quantity <= 25), 4) AS outside, CASE WHEN avg(brightness) FILTER (quantity > 25) / avg(brightness) FILTER (quantity <= 25) >= 2.0 THEN 'strong' WHEN avg(brightness) FILTER (quantity > 25) / avg(brightness) FILTER (quantity <= 25) >= 1.4 THEN 'weak' ELSE 'none' END AS verdict FROM scenes GROUP BY flag""")  # fmt: skip
def inside_outside(spark: SparkSession, d: str) -> DataFrame:
    i, o = (F.avg(F.when(c, F.col("brightness"))) for c in (F.col("quantity") > 25, F.col("quantity") <= 25))
    g = T.scenes(spark, d).groupBy("flag").agg(i.alias("i"), o.alias("o"))
    ratio = F.col("i") / F.col("o")
    return g.select("flag", F.round("i", 4).alias("inside"), F.round("o", 4).alias("outside"), F.when(ratio >= 2.0, "strong").when(ratio >= 1.4, "weak").otherwise("none").alias("verdict"))


@query("q_quantile_rows", "SELECT review_class, CAST(q AS DOUBLE) AS q, round(v, 6) AS v FROM (SELECT review_class, unnest([0.0, 0.1, 0.5, 0.9, 1.0]) AS q, unnest(quantile_cont(p_b, [0.0, 0.1, 0.5, 0.9, 1.0])) AS v FROM obs GROUP BY review_class)")
def quantile_rows(spark: SparkSession, d: str) -> DataFrame:
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    g = T.events(spark, d).groupBy("review_class").agg(F.percentile("p_b", qs).alias("v"))
    return g.select("review_class", F.posexplode("v").alias("i", "v")).select("review_class", F.element_at(F.array(*(F.lit(q) for q in qs)), F.col("i") + 1).alias("q"), F.round("v", 6).alias("v"))


@query("q_bottom_overlap", """
    WITH t AS (SELECT quantile_cont(p_a, 0.1) AS a, quantile_cont(p_b, 0.1) AS b FROM obs) SELECT count(*) FILTER (p_a <= a AND p_b <= b) AS both, round(count(*) FILTER (p_a <= a AND p_b <= b) / CAST(count(*) FILTER (p_a <= a OR p_b <= b) AS DOUBLE), 6) AS jaccard FROM obs, t""")  # fmt: skip
def bottom_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the lowest tenths of two scores."""
    e = T.events(spark, d)
    t = e.agg(F.percentile("p_a", 0.1).alias("a"), F.percentile("p_b", 0.1).alias("b"))
    x, y = F.col("p_a") <= F.col("a"), F.col("p_b") <= F.col("b")
    return e.join(F.broadcast(t)).agg(A.count_if(x & y).alias("both"), F.round(A.ratio(A.count_if(x & y).cast("double"), A.count_if(x | y)), 6).alias("jaccard"))


@query("q_bundle_summary", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, list_sort(list(DISTINCT lang)) = ['de', 'en', 'es', 'fr'] AS complete FROM documents GROUP BY source")
def bundle_summary(spark: SparkSession, d: str) -> DataFrame:
    need = F.array(*(F.lit(x) for x in ("de", "en", "es", "fr")))
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"), (F.sort_array(F.collect_set("lang")) == need).alias("complete"))


@query("q_bundle_files", "SELECT doc_id, kind, CAST(CASE kind WHEN 'tif' THEN n_chars WHEN 'png' THEN n_chars // 10 ELSE 200 END AS BIGINT) AS bytes FROM documents, (SELECT unnest(['tif', 'png', 'json']) AS kind) WHERE NOT (kind = 'png' AND lang = 'de')")
def bundle_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of each item by profile."""
    kinds = F.explode(F.array(*(F.lit(k) for k in ("tif", "png", "json")))).alias("kind")
    x = table(spark, d, "documents").select("doc_id", "n_chars", "lang", kinds).filter("not (kind = 'png' and coalesce(lang, '') = 'de')")
    return x.select("doc_id", "kind", F.when(F.col("kind") == "tif", F.col("n_chars")).when(F.col("kind") == "png", F.floor(F.col("n_chars") / 10)).otherwise(200).cast("long").alias("bytes"))


@query("q_missing_tiles", """
    WITH p AS (SELECT sample_id, lat + dy * 0.4 AS lat, lon + dx * 0.4 AS lon FROM samples, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx))
    SELECT sample_id, count(DISTINCT (CAST(floor(lat / 10) AS BIGINT), CAST(floor(lon / 10) AS BIGINT))) AS tiles FROM p GROUP BY sample_id""")  # fmt: skip
def missing_tiles(spark: SparkSession, d: str) -> DataFrame:
    """How many tiles the box around each sample touches, by nine probe points."""
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("s")
    p = T.samples(spark, d).select("sample_id", "lat", "lon", steps)
    cell = F.struct(F.floor((F.col("lat") + F.col("s.dy") * 0.4) / 10).alias("r"), F.floor((F.col("lon") + F.col("s.dx") * 0.4) / 10).alias("c"))
    return p.groupBy("sample_id").agg(F.count_distinct(cell).alias("tiles"))


@query("q_required_tiles", """
    WITH p AS (SELECT sample_id, lat + dy AS lat, lon + dx AS lon FROM samples, (SELECT unnest([-0.4 + 1e-9, 0, 0.4 - 1e-9]) AS dy), (SELECT unnest([-0.4 + 1e-9, 0, 0.4 - 1e-9]) AS dx)),
    c AS (SELECT DISTINCT sample_id, CAST(floor(lat / 10) * 10 + 10 AS BIGINT) AS n, CAST(floor(lon / 10) * 10 AS BIGINT) AS w FROM p)
    SELECT sample_id, lpad(CAST(abs(n) AS VARCHAR), 2, '0') || CASE WHEN n >= 0 THEN 'N' ELSE 'S' END || '_' || lpad(CAST(abs(w) AS VARCHAR), 3, '0') || CASE WHEN w >= 0 THEN 'E' ELSE 'W' END AS tile FROM c""")  # fmt: skip
def required_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The tiles that the box around each sample touches, by name."""
    lat, lon = F.col("lat"), F.col("lon")
    return T.samples(spark, d).select("sample_id", F.explode(geo.required_tiles(lon - 0.4, lat - 0.4, lon + 0.4, lat + 0.4)).alias("tile"))


@query("q_overlaps", f"""
    SELECT sample_id, count(*) AS occupied FROM samples a, {SUPPLIERS} b WHERE abs(a.lat - b.lat) <= 200000 / 110574.0 AND abs(a.lon - b.lon) <= 200000 / (111320.0 * cos(radians(a.lat))) GROUP BY sample_id""")  # fmt: skip
def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Squares of 200 km half side around samples that hold occupied points: an equi-join on cells, then the exact box."""
    a = T.samples(spark, d).select("sample_id", "lat", "lon")
    step, half = 2.0, 200_000.0
    dy, dx = F.lit(half / 110_574.0), half / (111_320.0 * F.cos(F.radians("lat")))
    cells = a.withColumns({"dy": dy, "dx": dx}).withColumn("r", F.explode(F.sequence(F.floor((F.col("lat") - F.col("dy")) / step), F.floor((F.col("lat") + F.col("dy")) / step))))
    cells = cells.withColumn("c", F.explode(F.sequence(F.floor((F.col("lon") - F.col("dx")) / step), F.floor((F.col("lon") + F.col("dx")) / step))))
    b = suppliers(spark, d).select(F.col("lat").alias("y"), F.col("lon").alias("x"), F.floor(F.col("lat") / step).alias("r"), F.floor(F.col("lon") / step).alias("c"))
    hit = (F.abs(F.col("lat") - F.col("y")) <= F.col("dy")) & (F.abs(F.col("lon") - F.col("x")) <= F.col("dx"))
    return cells.join(b, ["r", "c"]).filter(hit).groupBy("sample_id").agg(F.count(F.lit(1)).alias("occupied"))


@query("q_review_queue", "SELECT event_id, label_a, round(CASE WHEN label_a = 'Wildfire' THEN 1 - p_b ELSE p_b END, 6) AS conflict FROM obs WHERE human_label IS NULL AND CASE WHEN label_a = 'Wildfire' THEN 1 - p_b ELSE p_b END > 0.5")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Unreviewed events whose second model speaks against the first one's label."""
    conflict = F.when(F.col("label_a") == "Wildfire", 1 - F.col("p_b")).otherwise(F.col("p_b"))
    return T.events(spark, d).filter(F.col("human_label").isNull() & (conflict > 0.5)).select("event_id", "label_a", F.round(conflict, 6).alias("conflict"))


@query("q_permutation_test", f"""
    WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, label < 5 AS y FROM embeddings), o AS (SELECT abs(avg(x) FILTER (y) - avg(x) FILTER (NOT y)) AS obs, count(*) FILTER (y) AS n FROM v),
    r AS (SELECT run, vec_id, x, row_number() OVER (PARTITION BY run ORDER BY {DRAW.format("run || '-' || vec_id")}, vec_id) AS k FROM v, (SELECT unnest(range(100)) AS run)),
    p AS (SELECT run, abs(avg(x) FILTER (k <= n) - avg(x) FILTER (k > n)) AS gap FROM r, o GROUP BY run) SELECT round(any_value(obs), 6) AS observed, round((count(*) FILTER (gap >= obs) + 1) / CAST(count(*) + 1 AS DOUBLE), 6) AS p_value FROM p, o""")  # fmt: skip
def permutation_test(spark: SparkSession, d: str) -> DataFrame:
    """Permutation test of a difference of means; the shuffles are hash orders."""
    v = table(spark, d, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"), (F.col("label") < 5).alias("y"))
    gap = lambda c: F.abs(F.avg(F.when(c, F.col("x"))) - F.avg(F.when(~c, F.col("x"))))
    o = v.agg(gap(F.col("y")).alias("obs"), A.count_if(F.col("y")).alias("n"))
    each = v.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("run")).withColumn("u", L.draw(F.col("run"), F.col("vec_id")))
    runs = L.mark_lowest(each, "run", "u", "vec_id", o).join(F.broadcast(o)).groupBy("run", "obs").agg(gap(F.col("taken")).alias("gap"))
    return runs.groupBy("obs").agg((A.count_if(F.col("gap") >= F.col("obs")) + 1).alias("a"), (F.count(F.lit(1)) + 1).alias("b")).select(F.round("obs", 6).alias("observed"), F.round(F.col("a") / F.col("b"), 6).alias("p_value"))


@query("q_similarity_gap", f"""
    WITH u AS (SELECT vec_id, label < 5 AS y, list_transform(embedding, lambda x: x / nullif(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 0)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL), c AS (SELECT count(*) FILTER (y) AS n FROM u),
    r AS (SELECT -1 AS run, v, y AS taken FROM u UNION ALL SELECT run, v, row_number() OVER (PARTITION BY run ORDER BY {DRAW.format("run || '-' || vec_id")}, vec_id) <= n FROM u, c, (SELECT unnest(range(100)) AS run)),
    m AS (SELECT run, i, coalesce(sum(x) FILTER (taken), 0) AS a, coalesce(sum(x) FILTER (NOT taken), 0) AS b, sum(x * x) AS q FROM (SELECT run, taken, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM r) GROUP BY ALL),
    k AS (SELECT run, CAST(count(*) FILTER (taken) AS DOUBLE) AS na, CAST(count(*) FILTER (NOT taken) AS DOUBLE) AS nb FROM r GROUP BY run),
    g AS (SELECT run, (sum(a * a + b * b) - sum(q)) / any_value(na * (na - 1) + nb * (nb - 1)) - sum(a * b) / any_value(na * nb) AS gap FROM m JOIN k USING (run) GROUP BY run)
    SELECT round(any_value(o.gap), 6) AS observed, round((count(*) FILTER (g.gap >= o.gap) + 1) / CAST(count(*) + 1 AS DOUBLE), 6) AS p_value FROM g, (SELECT gap FROM g WHERE run = -1) o WHERE run >= 0""")  # fmt: skip
def similarity_gap(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of pairs of one class less that of pairs of two, with a permutation p-value, over all components.

    Sums of pairs come from the sums of a class: the square of its sum less its vectors' own terms.
    """
    v = table(spark, d, "embeddings").filter("label is not null and embedding is not null").select("vec_id", (F.col("label") < 5).alias("taken"), geo.unit(F.col("embedding")).alias("v"))
    dim = v.agg(F.max(F.size("v"))).first()[0] or 1
    each = v.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("run")).withColumn("u", L.draw(F.col("run"), F.col("vec_id")))
    runs = L.mark_lowest(each, "run", "u", "vec_id", v.agg(A.count_if(F.col("taken")).alias("n"))).select("run", "v", "taken")
    runs = runs.unionByName(v.select(F.lit(-1).alias("run"), "v", "taken"))
    part = lambda c, i: F.coalesce(F.sum(F.when(c, F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)))), F.lit(0.0))
    a, b = (F.array(*(part(c, i) for i in range(dim))) for c in (F.col("taken"), ~F.col("taken")))
    own = F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sums = runs.groupBy("run").agg(a.alias("a"), b.alias("b"), own.alias("q"), A.count_if(F.col("taken")).cast("double").alias("na"), A.count_if(~F.col("taken")).cast("double").alias("nb"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    same = F.try_divide(dot("a", "a") + dot("b", "b") - F.col("q"), F.col("na") * (F.col("na") - 1) + F.col("nb") * (F.col("nb") - 1))
    gaps = sums.select("run", (same - F.try_divide(dot("a", "b"), F.col("na") * F.col("nb"))).alias("gap"))
    both = gaps.agg(F.max(F.when(F.col("run") < 0, F.col("gap"))).alias("obs"), F.collect_list(F.when(F.col("run") >= 0, F.col("gap"))).alias("g"))
    return both.select(F.round("obs", 6).alias("observed"), F.round((F.size(F.filter("g", lambda x: x >= F.col("obs"))) + 1) / (F.size("g") + 1), 6).alias("p_value"))


@query("q_paired_bootstrap", f"""
    WITH c AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS i, count(*) FILTER (t AND a) AS a_tp, count(*) FILTER (NOT t AND NOT a) AS a_tn, count(*) FILTER (NOT t AND a) AS a_fp, count(*) FILTER (t AND NOT a) AS a_fn,
                      count(*) FILTER (t AND b) AS b_tp, count(*) FILTER (NOT t AND NOT b) AS b_tn, count(*) FILTER (NOT t AND b) AS b_fp, count(*) FILTER (t AND NOT b) AS b_fn
               FROM (SELECT sample_id, human_label = 'Wildfire' AS t, label_a = 'Wildfire' AS a, label_b = 'Wildfire' AS b FROM obs WHERE human_label IS NOT NULL) GROUP BY sample_id),
    k AS (SELECT count(*) AS k FROM c), draws AS (SELECT run, {DRAW.format("run || '-' || t")} % k AS i FROM k, (SELECT unnest(range(100)) AS run), (SELECT unnest(range((SELECT k FROM k))) AS t)),
    cells AS (SELECT run, {", ".join(f"CAST(sum({m}_{x}) AS DOUBLE) AS {m}_{x}" for m in "ab" for x in ("tp", "tn", "fp", "fn"))} FROM (SELECT run, c.* FROM draws JOIN c USING (i) UNION ALL SELECT -1, c.* FROM c) GROUP BY run),
    v AS (SELECT run, {", ".join(f"coalesce(({m}_tp + {m}_tn) / nullif({m}_tp + {m}_tn + {m}_fp + {m}_fn, 0), 0) AS {m}_accuracy, (coalesce({m}_tp / nullif({m}_tp + {m}_fn, 0), 0) + coalesce({m}_tn / nullif({m}_tn + {m}_fp, 0), 0)) / 2 AS {m}_balanced_accuracy, (coalesce(2 * {m}_tp / nullif(2 * {m}_tp + {m}_fp + {m}_fn, 0), 0) + coalesce(2 * {m}_tn / nullif(2 * {m}_tn + {m}_fp + {m}_fn, 0), 0)) / 2 AS {m}_macro_f1" for m in "ab")} FROM cells),
    u AS ({" UNION ALL ".join(f"SELECT run, '{x}' AS metric, a_{x} AS x, b_{x} AS y FROM v" for x in ("accuracy", "balanced_accuracy", "macro_f1"))})
    SELECT metric, round(max(x) FILTER (run < 0), 6) AS first, round(max(y) FILTER (run < 0), 6) AS second, round(max(x - y) FILTER (run < 0), 6) AS point_delta, count(*) FILTER (run >= 0) AS bootstrap_runs, round(avg(x - y) FILTER (run >= 0), 6) AS mean_delta,
           round(quantile_cont(x - y, 0.5) FILTER (run >= 0), 6) AS median_delta, round(quantile_cont(x - y, 0.025) FILTER (run >= 0), 6) AS ci_low, round(quantile_cont(x - y, 0.975) FILTER (run >= 0), 6) AS ci_high, round(avg(CAST(x > y AS INTEGER)) FILTER (run >= 0), 6) AS probability_delta_gt_zero FROM u GROUP BY metric""")  # fmt: skip
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Two models against the reviewers: each measure's difference with its interval over resampled points, the same draws for both."""
    e = T.events(spark, d).filter("human_label is not null")
    is_fire = lambda c: F.col(c) == "Wildfire"
    return E.paired_bootstrap(e, "sample_id", is_fire("human_label"), is_fire("label_a"), is_fire("label_b"), 100)


@query("q_mining_funnel", """
    SELECT decision, count(*) AS n FROM (SELECT CASE WHEN area_ha < 5 THEN 'below_area' WHEN share < 0.1 THEN 'below_share' WHEN sample_id % 10 = 0 THEN 'excluded' WHEN nth <= 1 THEN 'selected' ELSE 'eligible' END AS decision FROM (
        SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN area_ha >= 5 AND share >= 0.1 THEN 0 ELSE 1 END, area_ha DESC, event_year) AS nth FROM obs)) GROUP BY decision""")  # fmt: skip
def mining_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the first rule they fail, the best passing one of a point selected."""
    e = T.events(spark, d)
    passing = (F.col("area_ha") >= 5) & (F.col("share") >= 0.1)
    nth = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.when(passing, 0).otherwise(1), F.desc("area_ha"), "event_year"))
    decision = F.when(F.col("area_ha") < 5, "below_area").when(F.col("share") < 0.1, "below_share").when(F.col("sample_id") % 10 == 0, "excluded").when(F.col("nth") <= 1, "selected").otherwise("eligible")
    return e.withColumn("nth", nth).groupBy(decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("q_grid_alignment", """
    WITH g AS (SELECT l_suppkey % 50 AS tile, CAST(floor((l_partkey % 20) * 30 / 45.0) AS INTEGER) AS row, CAST(floor((l_orderkey % 20) * 30 / 45.0) AS INTEGER) AS col, l_quantity AS q FROM lineitem) SELECT tile, row, col, max(q) AS q FROM g GROUP BY ALL""")  # fmt: skip
def grid_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of 30 m put into the 45 m grid that holds their corners."""
    at = lambda c: F.floor(F.col(c) % 20 * 30 / 45.0).cast("int")
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("tile"), at("l_partkey").alias("row"), at("l_orderkey").alias("col")).agg(F.max("l_quantity").alias("q"))


@query("q_event_vectors", """
    WITH u AS (SELECT label, vec_id % 2 AS side, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings), m AS (SELECT label, side, i, avg(x) AS x FROM (SELECT label, side, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY ALL),
    n AS (SELECT label, side, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL) SELECT a.label, round(sum(a.x / na.n * b.x / nb.n), 6) AS similarity FROM m a JOIN m b ON a.label = b.label AND a.i = b.i AND a.side = 0 AND b.side = 1 JOIN n na ON na.label = a.label AND na.side = 0 JOIN n nb ON nb.label = b.label AND nb.side = 1 GROUP BY a.label""")  # fmt: skip
def event_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Mean unit vectors of two sides of a class, made unit again, and their cosine."""
    x = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("side"), F.posexplode(geo.unit(F.col("embedding"))).alias("i", "x"))
    m = x.groupBy("label", "i").agg(F.avg(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.avg(F.when(F.col("side") == 1, F.col("x"))).alias("b"))
    s = lambda p, q: F.sum(F.col(p) * F.col(q))
    return m.groupBy("label").agg(F.round(s("a", "b") / F.sqrt(s("a", "a") * s("b", "b")), 6).alias("similarity"))


@query("q_inherited_review", """
    SELECT e.event_id, CASE WHEN e.review_class IN ('VALID_LOGGING', 'VALID_WILDFIRE') THEN e.review_status WHEN l.q = 1 THEN 'VALID' WHEN l.q = 0 THEN 'REJECTED' ELSE 'DRAFT' END AS effective, CASE WHEN e.review_class IN ('VALID_LOGGING', 'VALID_WILDFIRE') THEN 'event' WHEN l.q IS NOT NULL THEN 'sample' ELSE 'none' END AS source
    FROM obs e LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = e.sample_id""")  # fmt: skip
def inherited_review(spark: SparkSession, d: str) -> DataFrame:
    """An event's own review, else its sample's, else a draft."""
    l = table(spark, d, "labels").groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("quality").alias("q"))  # noqa: E741
    own = F.col("review_class").isin("VALID_LOGGING", "VALID_WILDFIRE")
    effective = F.when(own, F.col("review_status")).when(F.col("q") == 1, "VALID").when(F.col("q") == 0, "REJECTED").otherwise("DRAFT")
    return T.events(spark, d).join(l, "sample_id", "left").select("event_id", effective.alias("effective"), F.when(own, "event").when(F.col("q").isNotNull(), "sample").otherwise("none").alias("source"))


@query("q_run_progress", "SELECT region, count(*) AS items, count(*) FILTER (e.sample_id IS NOT NULL) AS ready, count(*) FILTER (e.sample_id IS NULL) AS pending FROM samples s LEFT JOIN (SELECT DISTINCT sample_id FROM obs WHERE event_year >= 2000) e USING (sample_id) GROUP BY region")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    have = T.events(spark, d).filter("event_year >= 2000").select("sample_id").distinct().withColumn("here", F.lit(True))
    return T.samples(spark, d).join(have, "sample_id", "left").groupBy("region").agg(F.count(F.lit(1)).alias("items"), A.count_if(F.col("here").isNotNull()).alias("ready"), A.count_if(F.col("here").isNull()).alias("pending"))


@query("q_conversation_turns", "SELECT conv_id, count(*) AS turns, bool_and(turn = nth - 1) OR bool_and(turn = nth) AS gapless, max(role) FILTER (nth = 1) AS opens FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) GROUP BY conv_id")
def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    """Ordered histories checked for gaps."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    g = table(spark, d, "conversations").withColumn("nth", nth).groupBy("conv_id")
    return g.agg(F.count(F.lit(1)).alias("turns"), (F.bool_and(F.col("turn") == F.col("nth") - 1) | F.bool_and(F.col("turn") == F.col("nth"))).alias("gapless"), F.max(F.when(F.col("nth") == 1, F.col("role"))).alias("opens"))
