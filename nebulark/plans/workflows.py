"""Registered queries of file lists, headers and channel assignment, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.functions import channels, headers
from nebulark.operators import frames
from nebulark.plans import views
from nebulark.plans.queries import query

NAMES = ("F200W", "f444w ", "Ha", "H-alpha", "[OIII]", "SII", "Luminance", "Red", "V", "Clear", "F090W", "O III 5007", "Sloan_r", "F470N", "unknown", "Sloan-g", "F150W2", "NII", "")
FILES = ("m42_HA_001.fits", "m42-OIII-2.fits", "ngc_sii_1.fits", "x_RED_1.fits", "y_L.fits", "a_G.fits", "b_B.fits", "jwst_nircam_flat_0001.asdf", "jwst_miri_photom_12.asdf", "jwst_nircam_i2d.asdf", "lum.fits", "f200w_x.fits", "plain.fits", "tile_blue_3.fits", "q_r_1.fits", "f115w.fits", "o3_green.fits")


def cycled(values, key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def cases(text: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '" + p.replace("'", "''") + f"') THEN '{n}'" for n, p in patterns) + " END"


def table_sql(values: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in values.items()) + "}"


FILES_SQL = f"f AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, {quoted(NAMES)}[l_partkey % {len(NAMES)} + 1] AS filter, {quoted(FILES)}[l_suppkey % {len(FILES)} + 1] AS name FROM lineitem)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "lineitem")
    return rows.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), cycled(NAMES, "l_partkey").alias("filter"), cycled(FILES, "l_suppkey").alias("name"))


@query(f"WITH {FILES_SQL} SELECT o, n, p, filter, {table_sql(channels.FILTER_NM)}[upper(trim(filter))]::DOUBLE AS nm FROM f")
def filter_wavelength(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("o", "n", "p", "filter", channels.filter_wavelength("filter").cast("double").alias("nm"))


@query(f"""WITH {FILES_SQL}, w AS (SELECT *, trim(filter) AS t, {table_sql(channels.FILTER_NM)}[upper(trim(filter))] AS nm FROM f)
SELECT o, n, p, filter, name, coalesce({table_sql(channels.CHANNEL_OF)}[t], {cases('t', channels.FILTER_PATTERNS)}, CASE WHEN nm <= 1200 THEN 'b' WHEN nm <= 2500 THEN 'g' WHEN nm IS NOT NULL THEN 'r' END, {cases('name', channels.NAME_PATTERNS)}) AS channel FROM w""")
def channel_detection(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("o", "n", "p", "filter", "name", channels.channel("filter", "name").alias("channel"))


def slot_sql(name: str, before: tuple[str, ...]) -> str:
    suits = " OR ".join(f"regexp_matches(name, '{p}')" for p in channels.SLOT_PATTERNS[name])
    free = "".join(f" AND f.id IS DISTINCT FROM s{x}.id" for x in before)
    joins = "".join(f" LEFT JOIN s{x} ON s{x}.o = f.o" for x in before)
    return f"s{name} AS (SELECT f.o, min(f.id) AS id FROM g f{joins} WHERE ({suits}){free} GROUP BY f.o)"


@query(f"""WITH {FILES_SQL}, g AS (SELECT o, p * 10 + n AS id, name FROM f), {slot_sql('L', ())}, {slot_sql('R', ('L',))}, {slot_sql('G', ('L', 'R'))}, {slot_sql('B', ('L', 'R', 'G'))}
SELECT o, sL.id::VARCHAR AS "L", sR.id::VARCHAR AS "R", sG.id::VARCHAR AS "G", sB.id::VARCHAR AS "B" FROM (SELECT DISTINCT o FROM g) LEFT JOIN sL USING (o) LEFT JOIN sR USING (o) LEFT JOIN sG USING (o) LEFT JOIN sB USING (o)""")
def slots_by_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = files(spark, sf).withColumn("id", F.col("p") * 10 + F.col("n"))
    return frames.mapped_by_name(rows, ["o"], "name", "id").select("o", *(F.col(s).cast("string").alias(s) for s in "LRGB"))


BINS_SQL = "bins AS (SELECT o_custkey AS k, ['r', 'g', 'b', 'ha', 'oiii', 'sii', 'l'][o_orderkey % 7 + 1] AS bin, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END AS file FROM orders)"


def bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders")
    return rows.select(F.col("o_custkey").alias("k"), cycled(("r", "g", "b", "ha", "oiii", "sii", "l"), "o_orderkey").alias("bin"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey")).alias("file"))


@query(f"""WITH {BINS_SQL}, p AS (SELECT c_custkey AS k, ['rgb', 'sho', 'none'][c_custkey % 3 + 1] AS preset FROM customer), d AS (SELECT l_orderkey AS file, ['Hα (656nm)', 'Red', '[SII] (673nm)', 'Clear'][l_linenumber % 4 + 1] AS filter FROM lineitem),
a AS (SELECT k, bool_or(file IS NOT NULL AND (bin IN ('ha', 'sii', 'nii', 'oiii', 'hb') OR file IN (SELECT file FROM d WHERE filter IN ('Hα (656nm)', '[OIII] (502nm)', '[SII] (673nm)')))) AS n FROM bins GROUP BY k)
SELECT k, n OR coalesce(preset = 'sho', false) AS narrowband FROM a LEFT JOIN p USING (k)""")
def narrowband_workflow(spark: SparkSession, sf: str) -> DataFrame:
    presets = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), cycled(("rgb", "sho", "none"), "c_custkey").alias("preset"))
    found = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), cycled(("Hα (656nm)", "Red", "[SII] (673nm)", "Clear"), "l_linenumber").alias("filter"))
    return frames.is_narrowband(bins(spark, sf), found, presets, "k")


PRESET = (("sii", 673.0, 0.7, 0.3, 0.0), ("ha", 656.0, 0.3, 0.8, 0.2), ("oiii", 502.0, 0.0, 0.15, 0.85))


@query(f"""WITH {BINS_SQL}, w(channel, nm, r, g, b) AS (VALUES {', '.join(f"('{c}', {n}, CAST({r} AS DOUBLE), CAST({g} AS DOUBLE), CAST({b} AS DOUBLE))" for c, n, r, g, b in PRESET)}),
d AS (SELECT DISTINCT k, bin, CASE bin WHEN 'r' THEN 640 WHEN 'g' THEN 530 WHEN 'b' THEN 460 WHEN 'l' THEN 550 WHEN 'ha' THEN 656 WHEN 'oiii' THEN 502 ELSE 673 END AS nm FROM bins WHERE file IS NOT NULL),
e AS (SELECT k, bin, r, g, b FROM d JOIN w ON bin = channel), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY nm DESC, bin) AS rank FROM d WHERE k NOT IN (SELECT k FROM e)),
z AS (SELECT k, bin, r, g, b, count(*) OVER (PARTITION BY k) AS n FROM l JOIN (SELECT r, g, b, row_number() OVER (ORDER BY nm DESC, channel) AS rank FROM w) USING (rank))
SELECT * FROM e UNION ALL SELECT k, bin, r, g, b FROM z WHERE n >= 2""")
def preset_weights(spark: SparkSession, sf: str) -> DataFrame:
    nm = channels.looked_up({"r": 640, "g": 530, "b": 460, "l": 550, "ha": 656, "oiii": 502, "sii": 673}, F.col("bin"))
    filled = bins(spark, sf).where("file IS NOT NULL").select("k", "bin", nm.alias("nm")).distinct()
    weights = spark.createDataFrame(PRESET, "channel string, nm double, r double, g double, b double")
    return frames.resolved_weights(weights, filled, "k")


@query(f"""WITH {BINS_SQL}, f AS (SELECT k, bin, CAST(min(file) AS VARCHAR) AS file FROM bins WHERE file IS NOT NULL GROUP BY k, bin), s AS (SELECT k, bin, 'back' || k AS path FROM f WHERE k % 3 = 0), c AS (SELECT k, bin, CASE WHEN k % 4 = 0 THEN '' ELSE 'crop' || k END AS path FROM f WHERE k % 2 = 0)
SELECT k, bin, coalesce(s.path, nullif(c.path, ''), file) AS path FROM f LEFT JOIN s USING (k, bin) LEFT JOIN c USING (k, bin)""")
def channel_paths(spark: SparkSession, sf: str) -> DataFrame:
    first = bins(spark, sf).where("file IS NOT NULL").groupBy("k", "bin").agg(F.min("file").cast("string").alias("file"))
    back = first.where("k % 3 = 0").select("k", "bin", F.concat(F.lit("back"), "k").alias("path"))
    cropped = first.where("k % 2 = 0").select("k", "bin", F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("crop"), "k")).alias("path"))
    return frames.channel_paths(first, [back, cropped], ["k", "bin"])


@query(f"""WITH {BINS_SQL}, h AS (SELECT k, list(DISTINCT bin) AS h FROM bins WHERE file IS NOT NULL GROUP BY k), r AS (SELECT *, list_filter(['r', 'sii', 'ha'], lambda x: list_contains(h, x))[1] AS r FROM h),
g AS (SELECT *, list_filter(['g', 'ha', 'oiii'], lambda x: list_contains(h, x) AND x IS DISTINCT FROM r)[1] AS g FROM r), b AS (SELECT *, list_filter(['b', 'oiii', 'sii'], lambda x: list_contains(h, x)) AS c FROM g)
SELECT k, r, g, coalesce(list_filter(c, lambda x: x IS DISTINCT FROM r AND x IS DISTINCT FROM g)[1], c[1]) AS b FROM b""")
def rgb_bins(spark: SparkSession, sf: str) -> DataFrame:
    return frames.rgb_bins(bins(spark, sf).where("file IS NOT NULL"), "k")


@query("""WITH RECURSIVE s AS (SELECT l_suppkey % 50 AS k, 1000 + l_partkey * 7 % 60 AS width, 800 + l_partkey * 3 % 40 AS height, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, width, height) AS i FROM s),
g AS (SELECT k, i, [{'w': width, 'h': height}] AS gs FROM t WHERE i = 1 UNION ALL
SELECT t.k, t.i, CASE WHEN len(list_filter(gs, lambda x: abs(x.w - t.width) < 10 AND abs(x.h - t.height) < 10)) > 0 THEN gs ELSE list_append(gs, {'w': width, 'h': height}) END FROM g JOIN t ON t.k = g.k AND t.i = g.i + 1),
e AS (SELECT k, arg_max(gs, i) AS gs FROM g GROUP BY k)
SELECT k, width, height, o, x.w AS group_w, x.h AS group_h FROM (SELECT t.k, width, height, o, list_filter(gs, lambda x: abs(x.w - width) < 10 AND abs(x.h - height) < 10)[1] AS x FROM t JOIN e ON t.k = e.k)""")
def resolution_groups(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_partkey")
    rows = views.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), (1000 + p * 7 % 60).alias("width"), (800 + p * 3 % 40).alias("height"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return frames.resolution_groups(rows.groupBy("k", "width", "height").agg(F.min("o").alias("o")), "k", "o")


@query("""WITH s AS (SELECT s_nationkey AS k, 1000 * (s_suppkey % 3 + 1) AS width, 800 * (s_suppkey % 3 + 1) AS height FROM supplier), a AS (SELECT k, min(width * height) AS least, max(width * height) AS most, min(width) AS w, min(height) AS h FROM s GROUP BY k)
SELECT k, most >= 1.5 * least AS needed, CASE WHEN most >= 1.5 * least THEN w END AS target_w, CASE WHEN most >= 1.5 * least THEN h END AS target_h FROM a""")
def resample_targets(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    rows = views.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), s.alias("o"), (1000 * (s % 3 + 1)).alias("width"), (800 * (s % 3 + 1)).alias("height"))
    return frames.resample_targets(frames.resolution_groups(rows, "k", "o"), "k")


@query(f"WITH {FILES_SQL} SELECT filter AS instrument, count(*) AS files, min(name) AS first FROM f GROUP BY filter")
def files_by_instrument(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).groupBy(F.col("filter").alias("instrument")).agg(F.count("*").alias("files"), F.min("name").alias("first"))


@query("SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) AS position FROM pages")
def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    return frames.numbered(views.table(spark, sf, "pages").select("page_id", "url"), ["url", "page_id"], "position")


@query("SELECT id, metric, row_number() OVER (PARTITION BY metric ORDER BY x DESC, id) AS position FROM (SELECT event_id AS id, event_type AS metric, value AS x FROM events)")
def subframe_sort(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("metric"), F.col("value").alias("x"))
    return frames.sorted_by(rows, "metric", "x", False, "id")


#: Ends of file names, of which three name a product.
ENDS = ("_i2d.fits", "-CAL.fit", "_x1d.asdf", "_other.fits", "_cal.txt", "plain.fits")


@query(f"SELECT k, array_to_string(list_sort(list(DISTINCT kind) FILTER (kind <> '')), ' ') AS kinds FROM (SELECT l_orderkey % 100 AS k, CASE l_partkey % 6 WHEN 0 THEN 'i2d' WHEN 1 THEN 'cal' WHEN 2 THEN 'x1d' ELSE '' END AS kind FROM lineitem) GROUP BY k HAVING count(*) FILTER (kind <> '') > 0")
def sorted_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct products of file names, in order."""
    name = F.concat(F.lit("shot"), F.col("l_suppkey").cast("string"), F.element_at(F.array(*map(F.lit, ENDS)), (F.col("l_partkey") % len(ENDS) + 1).cast("int")))
    rows = views.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("k"), headers.product_type(name).alias("kind")).where("kind IS NOT NULL")
    return rows.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("kind")), " ").alias("kinds"))  # kinds are few


@query(rf"""WITH {FILES_SQL} SELECT o, n, p, name, regexp_matches(name, '{channels.REFERENCE_FILE}') AS reference, starts_with(name, 'jwst_') AND ends_with(name, '.asdf') AND regexp_matches(name, '{'|'.join(channels.REFERENCE_KINDS)}') AS held,
ends_with(lower(name), '.asdf') AS asdf, CASE upper(trim(filter)) WHEN 'HA' THEN 'HOO' ELSE 'SHO' END AS palette FROM f""")
def reference_files(spark: SparkSession, sf: str) -> DataFrame:
    palette = channels.palette(F.when(F.upper(F.trim("filter")) == "HA", "hoo").otherwise(F.col("filter")))
    asdf = F.lower("name").endswith(".asdf")
    return files(spark, sf).select("o", "n", "p", "name", channels.is_reference_file("name").alias("reference"), channels.holds_reference("name").alias("held"), asdf.alias("asdf"), palette.alias("palette"))


KEYS = ("CRPIX1", "A_2_0", "DATE-OBS", "FILTER", "PV1_3", "HISTORY", "AP_1_", "CD1_2", "IMAGEW", "B_x", "EPOCH", "WCSNAME", "A_")


@query(rf"""WITH k AS (SELECT event_id AS id, {quoted(KEYS)}[event_id % {len(KEYS)} + 1] AS key FROM events)
SELECT id, key, regexp_matches(key, '^({'|'.join(headers.WCS_STARTS)})') AS wcs, key IN ({', '.join(f"'{x}'" for x in headers.SOLVER_KEYS)}) OR regexp_matches(key, '^(A|B|AP|BP)_[0-9_]+$') AS solver FROM k""")
def wcs_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "events").select(F.col("event_id").alias("id"), cycled(KEYS, "event_id").alias("key"))
    return rows.select("id", "key", headers.is_wcs_card("key").alias("wcs"), headers.is_solver_key("key").alias("solver"))


CARD_ROWS = f"c AS (SELECT user_id AS k, event_id AS pos, {quoted(KEYS)}[event_id % {len(KEYS)} + 1] AS key, CAST(event_id AS VARCHAR) AS value FROM events)"


def card_arrays(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("pos"), cycled(KEYS, "event_id").alias("key"), F.col("event_id").cast("string").alias("value"))
    cards = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "value"))), lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value")))
    return rows.groupBy("k").agg(cards.alias("cards"))


def joined(cards: Column) -> Column:
    return F.array_join(F.transform(cards, lambda c: F.concat(c["key"], F.lit("="), c["value"])), ";")


WCS_CASE = f"regexp_matches(key, '^({'|'.join(headers.WCS_STARTS)})')"


@query(f"""WITH {CARD_ROWS} SELECT k, string_agg(key || '=' || value, ';' ORDER BY pos) AS all_cards, string_agg(key || '=' || value, ';' ORDER BY pos) FILTER ({WCS_CASE}) AS wcs, string_agg(key || '=' || value, ';' ORDER BY pos) FILTER (NOT {WCS_CASE}) AS others, CAST(NULL AS VARCHAR) AS none FROM c GROUP BY k""")
def exported_cards(spark: SparkSession, sf: str) -> DataFrame:
    rows = card_arrays(spark, sf)
    one = lambda wcs, rest: joined(headers.exported_cards(F.col("cards"), wcs, rest))
    return rows.select("k", one(True, True).alias("all_cards"), one(True, False).alias("wcs"), one(False, True).alias("others"), one(False, False).alias("none"))


@query(f"""WITH {CARD_ROWS}, f AS (SELECT k, min(pos) AS first FROM c WHERE key = 'EPOCH' GROUP BY k), r AS (SELECT c.k, pos, key, CASE WHEN pos = first THEN '2.00050000000000E3' ELSE value END AS value, first FROM c LEFT JOIN f USING (k))
SELECT k, string_agg(key || '=' || value, ';' ORDER BY pos) || CASE WHEN any_value(first) IS NULL THEN ';EPOCH=2.00050000000000E3' ELSE '' END AS cards,
       CAST(arg_max(value, pos) FILTER (key = 'FILTER') AS DOUBLE) AS number FROM r GROUP BY k""")
def header_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = card_arrays(spark, sf)
    return rows.select("k", joined(headers.with_card(F.col("cards"), "EPOCH", headers.number_card(F.lit(2000.5)))).alias("cards"), headers.card_number(F.col("cards"), "FILTER").alias("number"))


ESCAPES = ("a%20b", "plus+sign", "100%", "%C3%A9t%C3%A9", "x%2Fy%zz", "%41%4a", "")


@query("WITH u AS (SELECT page_id, " + quoted(ESCAPES) + "[page_id % 7 + 1] AS e FROM pages) SELECT page_id, e, CASE page_id % 7 WHEN 0 THEN 'a b' WHEN 1 THEN 'plus+sign' WHEN 2 THEN '100%' WHEN 3 THEN 'été' WHEN 4 THEN 'x/y%zz' WHEN 5 THEN 'AJ' ELSE '' END AS decoded FROM u")
def url_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "pages").select("page_id", cycled(ESCAPES, "page_id").alias("e"))
    return rows.withColumn("decoded", channels.url_decoded("e"))


@query("""SELECT event_id AS id, greatest(0, least(9, event_id - 25)) AS clamped, ((event_id - 25) % 10 + 10) % 10 AS wrapped FROM events""")
def boundary_index(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id") - 25
    return views.table(spark, sf, "events").select(F.col("event_id").alias("id"), frames.bounded(i, 10, "clamp").alias("clamped"), frames.bounded(i, 10, "wrap").alias("wrapped"))
