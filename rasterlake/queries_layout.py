"""Queries over names, tokens, file layouts, budgets, geometry and composition."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterlake.functions import geometry as G
from rasterlake.functions import tokens as K
from rasterlake.operators import layout as Y
from rasterlake.operators import timeline as L
from rasterlake.plans import graph
from rasterlake.plans import views as V
from rasterlake.queries import FRAMES_SQL, TIMELINE_SQL, query

# --- names and tokens --------------------------------------------------------


@query("SELECT n_nationkey AS k, 'frame_' || CASE WHEN len(CAST(i AS VARCHAR)) >= 2 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 2, '0') END || '.tif' AS name FROM (SELECT n_nationkey, unnest(range(n_nationkey * 9, n_nationkey * 10 + 1)) AS i FROM nation)")
def expand_token(spark, d):
    """Numbers wider than the pad stay whole."""
    k = F.col("n_nationkey")
    token = K.token(F.lit("frame_"), F.lit(2), F.lit(".tif"), k * 9, k * 10)
    return V.table(spark, d, "nation").select(k.alias("k"), F.explode(K.expand(token)).alias("name"))


@query(r"SELECT page_id, regexp_extract(url, '^(.*[^0-9]|)([0-9]+)([^0-9]*)$', 1) AS prefix, CAST(regexp_extract(url, '^(.*[^0-9]|)([0-9]+)([^0-9]*)$', 2) AS BIGINT) AS number, CAST(len(regexp_extract(url, '^(.*[^0-9]|)([0-9]+)([^0-9]*)$', 2)) AS INTEGER) AS width, regexp_extract(url, '^(.*[^0-9]|)([0-9]+)([^0-9]*)$', 3) AS suffix FROM pages")
def split_index(spark, d):
    """T03."""
    parts = K.split_name(F.col("url"))
    return V.table(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in parts.items()))


RUNS_SQL = "n AS (SELECT DISTINCT o_orderpriority || '_' || o_orderstatus || '_' AS prefix, o_orderkey AS number FROM orders), g AS (SELECT *, number - row_number() OVER (PARTITION BY prefix ORDER BY number) AS island FROM n), r AS (SELECT prefix, min(number) AS start, max(number) AS stop, count(*) AS n FROM g GROUP BY prefix, island)"


@query(f"WITH {RUNS_SQL} SELECT CASE WHEN n = 1 THEN prefix || CASE WHEN len(CAST(start AS VARCHAR)) >= 5 THEN CAST(start AS VARCHAR) ELSE lpad(CAST(start AS VARCHAR), 5, '0') END || '.tif' ELSE prefix || '%05u.tif,' || start || ',' || stop END AS token, n FROM r")
def group_runs(spark, d):
    """Consecutive numbers as one token, single files by name."""
    names = V.table(spark, d, "orders").select(F.concat("o_orderpriority", F.lit("_"), "o_orderstatus", F.lit("_")).alias("prefix"), F.col("o_orderkey").alias("number"))
    runs = L.runs(names, ["prefix"], "number")
    single = F.concat("prefix", K.padded(F.col("start"), F.lit(5)), F.lit(".tif"))
    return runs.select(F.when(F.col("n") == 1, single).otherwise(K.token(F.col("prefix"), F.lit(5), F.lit(".tif"), F.col("start"), F.col("stop"))).alias("token"), "n")


NAMES_SQL = "names AS (SELECT p_partkey, 'clip_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || '.' || CASE p_size % 5 WHEN 0 THEN 'TIF' WHEN 1 THEN 'png' WHEN 2 THEN 'mp4' WHEN 3 THEN 'txt' ELSE 'AVI' END AS name, p_brand AS dir FROM part)"


def _names(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("TIF", "png", "mp4", "txt", "AVI"))), F.col("p_size") % 5 + 1)
    return V.table(spark, d, "part").select("p_partkey", F.concat(F.lit("clip_"), K.padded(F.col("p_partkey"), F.lit(7)), F.lit("."), ext).alias("name"), F.col("p_brand").alias("dir"))


@query(f"WITH {NAMES_SQL} SELECT p_partkey, name, lower(string_split(name, '.')[-1]) IN ('mp4', 'avi') AS video FROM names WHERE lower(string_split(name, '.')[-1]) <> 'txt'")
def list_folder(spark, d):
    """S28, O01, T06, T07, X02."""
    return _names(spark, d).filter(K.is_loadable(F.col("name"))).select("p_partkey", "name", K.is_video(F.col("name")).alias("video"))


@query(f"WITH {NAMES_SQL}, f AS (SELECT *, lower(string_split(name, '.')[-1]) AS ext FROM names) SELECT dir, count(*) FILTER (WHERE ext IN ('tif', 'png')) AS images, count(*) FILTER (WHERE ext IN ('mp4', 'avi')) AS videos, CASE WHEN count(*) FILTER (WHERE ext IN ('tif', 'png')) >= 2 THEN min(name) FILTER (WHERE ext IN ('tif', 'png')) END AS first FROM f GROUP BY dir")
def folder_inputs(spark, d):
    """S29, S30, M28, as counts and the name of the first: one sequence of a folder's images, each video its own media."""
    image = K.is_loadable(F.col("name")) & ~K.is_video(F.col("name"))
    video = K.is_video(F.col("name"))
    n = F.count(F.when(image, 1))
    return _names(spark, d).groupBy("dir").agg(n.alias("images"), F.count(F.when(video, 1)).alias("videos"), F.when(n >= 2, F.min(F.when(image, F.col("name")))).alias("first"))


@query(f"WITH {NAMES_SQL} SELECT name FROM names WHERE lower(name) LIKE 'clip_000001%' ORDER BY name")
def complete_name(spark, d):
    """T05, T08, O03."""
    return _names(spark, d).filter(F.startswith(F.lower("name"), F.lower(F.lit("CLIP_000001")))).select("name").orderBy("name")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE ['sub', 'mean', 'add'][n_nationkey % 4 + 1] END AS kind, CASE WHEN n_nationkey % 4 = 3 THEN -1 ELSE n_nationkey END AS a, CASE WHEN n_nationkey % 4 IN (0, 2) THEN n_regionkey ELSE -1 END AS b FROM nation")
def parse_compute_tokens(spark, d):
    """T10, T11, T19, H22's old name."""
    k = F.col("n_nationkey")
    kind = F.element_at(F.array(*map(F.lit, ("diff", "mean", "add", "bogus"))), k % 4 + 1)
    token = F.concat(F.lit("compute:"), kind, F.lit(":"), k.cast("string"), F.lit(","), F.col("n_regionkey").cast("string"), F.lit(":auto"))
    parsed = K.compute_token(token)
    return V.table(spark, d, "nation").select(k.alias("k"), parsed["kind"].alias("kind"), *(F.coalesce(parsed[n], F.lit(-1)).alias(n) for n in "ab"))


@query("SELECT p_partkey, CASE WHEN len(p_name) <= 12 THEN p_name ELSE p_name[:11] || '…' END AS short, CASE WHEN p_name LIKE '% %' THEN '\"' || p_name || '\"' ELSE p_name END AS quoted, p_size * 1000 / 1001.0::DOUBLE AS fps FROM part")
def name_display(spark, d):
    """Shortened, quoted, and a rational rate."""
    fps = K.rate(F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/1001")))
    return V.table(spark, d, "part").select("p_partkey", K.ellipsize(F.col("p_name"), 12).alias("short"), K.quoted(F.col("p_name")).alias("quoted"), fps.alias("fps"))


@query(r"SELECT event_id, try_cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) AS k, greatest(event_id % 30 - 0.5::DOUBLE, 0) / 25 AS seek FROM events")
def probe_fields(spark, d):
    """Key and value text, and the seek time of a frame."""
    text = F.regexp_replace(F.regexp_replace("props", '[{}" ]', ""), ":", "=")
    k = F.nullif(F.element_at(F.str_to_map(text, F.lit(","), F.lit("=")), "k"), F.lit("N/A")).cast("int")
    return V.table(spark, d, "events").select("event_id", k.alias("k"), (F.greatest(F.col("event_id") % 30 - F.lit(0.5), F.lit(0.0)) / 25).alias("seek"))


# --- file layouts ------------------------------------------------------------

FILES_SQL = "files AS (SELECT n_regionkey AS media_id, n_nationkey AS file_idx, CAST(1 + n_nationkey * 7 % 5 AS INTEGER) AS pages FROM nation), map AS (SELECT media_id, file_idx, CAST(unnest(range(0, pages)) AS INTEGER) AS page FROM files), frame_map AS (SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY file_idx, page) - 1 AS BIGINT) AS frame_idx FROM map)"


def _frame_map(spark, d):
    files = V.table(spark, d, "nation").select(F.col("n_regionkey").alias("media_id"), F.col("n_nationkey").alias("file_idx"), (1 + F.col("n_nationkey") * 7 % 5).cast("int").alias("pages"))
    return Y.frame_map(files, "media_id", "file_idx", "pages")


@query(f"WITH {FILES_SQL} SELECT media_id, file_idx, page, frame_idx FROM frame_map")
def concat_map(spark, d):
    """S08, I21, I26, W05, W06, X01, M16."""
    return _frame_map(spark, d)


@query(f"WITH {FILES_SQL} SELECT media_id, frame_idx FROM frame_map WHERE page = 1")
def locate_file(spark, d):
    """(file, page) to the global frame."""
    return _frame_map(spark, d).filter("page = 1").select("media_id", "frame_idx")


@query(f"WITH {FILES_SQL} SELECT media_id, file_idx, page FROM frame_map WHERE frame_idx = 9")
def fast_jump(spark, d):
    """One global frame's place."""
    return _frame_map(spark, d).filter("frame_idx = 9").select("media_id", "file_idx", "page")


#: A page header a line: where it stands, where its strips do, its shape and the next page. Files
#: are regular (a third), drift, break their chain, change shape or move a strip, as their numbers say.
HEADERS_SQL = """k AS (SELECT l_orderkey AS file, l_linenumber AS line, min(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY ALL),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY line) - 1 AS BIGINT) AS page FROM k),
    o AS (SELECT file, page, q, 16 + page * 1000 + CASE WHEN file % 3 = 0 THEN 0 ELSE q % 2 * page END AS off FROM n),
    h AS (SELECT file, page, off, CASE WHEN file % 7 = 0 AND page % 4 = 3 THEN 0 ELSE coalesce(lead(off) OVER (PARTITION BY file ORDER BY page), 0) END AS next, CAST(4 + CASE WHEN q % 13 = 0 THEN 1 ELSE 0 END AS INTEGER) AS w, 3 AS h, [off + 100, off + 200 + CASE WHEN q % 11 = 0 THEN 4 ELSE 0 END] AS strips FROM o)"""


def _headers(spark, d):
    q = F.min(F.col("l_quantity").cast("int"))
    lines = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).agg(q.alias("q"))
    w = Window.partitionBy("file").orderBy("line")
    page = (F.row_number().over(w) - 1).cast("long")
    rows = lines.withColumn("page", page).withColumn("off", 16 + F.col("page") * 1000 + F.when(F.col("file") % 3 == 0, 0).otherwise(F.col("q") % 2 * F.col("page")))
    following = F.when((F.col("file") % 7 == 0) & (F.col("page") % 4 == 3), 0).otherwise(F.coalesce(F.lead("off").over(w), F.lit(0)))
    strips = F.array(F.col("off") + 100, F.col("off") + 200 + F.when(F.col("q") % 11 == 0, 4).otherwise(0))
    return rows.select("file", "page", "off", following.alias("next"), (4 + F.when(F.col("q") % 13 == 0, 1).otherwise(0)).cast("int").alias("w"), F.lit(3).alias("h"), strips.alias("strips"))


@query(f"WITH {HEADERS_SQL}, s AS (SELECT *, lead(off) OVER (PARTITION BY file ORDER BY page) - off AS step FROM h) SELECT file, count(*) AS pages, min(step) AS stride, coalesce(min(step) = max(step) AND min(step) > 0, false) AS regular FROM s GROUP BY file")
def page_stride_check(spark, d):
    """Whether a file's pages stand one stride apart."""
    return Y.strides(_headers(spark, d), "file", "page", "off")


CHECKED_SQL = f"""{HEADERS_SQL}, t AS (SELECT file, max(off) FILTER (WHERE page = 0) AS off0, max(off) FILTER (WHERE page = 1) AS off1, max(w) FILTER (WHERE page = 0) AS w0, max(h) FILTER (WHERE page = 0) AS h0, max(strips) FILTER (WHERE page = 0) AS s0 FROM h WHERE page <= 1 GROUP BY file),
    c AS (SELECT h.*, lag(next) OVER (PARTITION BY file ORDER BY page) AS pre, coalesce(off1 - off0, 0) AS stride, off0 + page * coalesce(off1 - off0, 0) AS predicted, w = w0 AND h.h = h0 AS same_shape, list_transform(strips, lambda x: x - off) = list_transform(s0, lambda x: x - off0) AS same_strips FROM h JOIN t USING (file))"""


@query(f"WITH {CHECKED_SQL} SELECT file, page, predicted, same_shape, same_strips, page = 0 OR (off = predicted AND same_shape AND same_strips AND (next = 0 OR next = off + stride) AND coalesce(pre = off, false)) AS valid FROM c")
def validated_pages(spark, d):
    """A predicted place holds a page of the first one's shape and strips, one stride on from the page that points to it."""
    return Y.validated(_headers(spark, d)).select("file", "page", "predicted", "same_shape", "same_strips", "valid")


STRIPS_SQL = "s AS (SELECT l_orderkey AS file, l_linenumber AS strip, CAST(l_quantity AS BIGINT) AS len, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1), o AS (SELECT *, coalesce(sum(len + CASE WHEN l_partkey % 4 = 0 THEN 100 ELSE 0 END) OVER (PARTITION BY file ORDER BY strip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)"


@query(f"WITH {STRIPS_SQL}, g AS (SELECT *, CASE WHEN lag(off + len) OVER (PARTITION BY file ORDER BY strip) = off THEN 0 ELSE 1 END AS starts FROM o), r AS (SELECT *, sum(starts) OVER (PARTITION BY file ORDER BY strip ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT file, CAST(min(off) AS BIGINT) AS \"offset\", CAST(sum(len) AS BIGINT) AS bytes, count(*) AS strips FROM r GROUP BY file, run")
def strip_runs(spark, d):
    """Contiguous strips are one read."""
    rows = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("strip")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("s"))
    gap = F.when(F.col("s.l_partkey") % 4 == 0, 100).otherwise(0)
    before = Window.partitionBy("file").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    length = F.col("s.l_quantity").cast("long")
    strips = rows.select("file", "strip", length.alias("len"), F.coalesce(F.sum(length + gap).over(before), F.lit(0)).alias("off"))
    return Y.strip_runs(strips, "file", "strip", "off", "len")


@query(f"""WITH {CHECKED_SQL}, v AS (SELECT *, page = 0 OR (off = predicted AND same_shape AND same_strips AND (next = 0 OR next = off + stride) AND coalesce(pre = off, false)) AS valid, page > 0 AND pre <> off AS broken FROM c)
        SELECT file, count(*) AS stored, coalesce(min(page) FILTER (WHERE broken), count(*)) AS walked, coalesce(min(page) FILTER (WHERE NOT valid), count(*)) AS predicted FROM v GROUP BY file""")
def page_counts(spark, d):
    """Pages that the chain of pointers reaches, and those that stand where prediction puts them."""
    return Y.page_counts(_headers(spark, d))


PAGES_SQL = """p AS (SELECT p_partkey, p_size AS w, 1 + p_partkey % 9 AS h, [8, 16, 32, 1, 16][p_partkey % 5 + 1] AS bits, [1, 3, 4, 2, 1, 1][p_partkey % 6 + 1] AS spp, CASE WHEN p_partkey % 5 = 2 THEN 3 WHEN p_partkey % 11 = 0 THEN 2 ELSE 1 END AS kind,
    p_partkey % 19 = 0 AS mixed, CASE WHEN p_partkey % 13 = 0 THEN 5 ELSE 1 END AS compression, CASE WHEN p_partkey % 23 = 0 THEN 2 ELSE 1 END AS predictor, CASE WHEN p_partkey % 17 = 0 THEN 2 ELSE 1 END AS planar, p_partkey % 4 AS photometric, p_partkey % 29 = 0 AS tiled, CASE WHEN p_partkey % 31 = 0 THEN 7 ELSE 0 END AS padding FROM part)"""


@query(f"""WITH {PAGES_SQL} SELECT p_partkey, CASE WHEN tiled THEN 'stored in tiles' WHEN compression <> 1 THEN 'compressed' WHEN predictor <> 1 THEN 'differenced by a predictor' WHEN planar <> 1 THEN 'channels stored apart' WHEN mixed THEN 'channels of several depths'
        WHEN photometric NOT IN (1, 2) THEN 'colours of another kind' WHEN spp NOT IN (1, 3, 4) THEN 'no such number of channels' WHEN NOT (bits IN (8, 16, 32) AND kind = 1 OR bits = 32 AND kind = 3) THEN 'no such sample type' WHEN padding > 0 THEN 'strips hold other than the pixels' END AS reason FROM p""")
def raw_decodable(spark, d):
    """Why a page's strips aren't its pixels, or null if they are."""
    k, pick = F.col("p_partkey"), lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    bits, spp = pick((8, 16, 32, 1, 16), k % 5), pick((1, 3, 4, 2, 1, 1), k % 6)
    mixed, h = k % 19 == 0, (1 + k % 9).cast("long")
    depths = F.when(mixed, F.array(bits, F.lit(99))).otherwise(F.array_repeat(bits, spp))
    row = F.col("p_size") * spp * (bits / 8).cast("long")
    page = {
        "tiled": k % 29 == 0,
        "compression": F.when(k % 13 == 0, 5).otherwise(1),
        "predictor": F.when(k % 23 == 0, 2).otherwise(1),
        "planar": F.when(k % 17 == 0, 2).otherwise(1),
        "depths": depths,
        "photometric": k % 4,
        "spp": spp,
        "sample_format": F.when(k % 5 == 2, 3).when(k % 11 == 0, 2).otherwise(1),
        "strip_counts": F.array(row * (h - 1), row + F.when(k % 31 == 0, 7).otherwise(0)),
        "w": F.col("p_size"),
        "h": h,
    }
    return V.table(spark, d, "part").select("p_partkey", Y.raw_reason(page).alias("reason"))


@query("WITH k AS (SELECT user_id AS media_id, CAST(event_id % 60 AS INTEGER) AS idx FROM events), u AS (SELECT DISTINCT * FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS rank FROM u) SELECT media_id, CAST(sum(CASE WHEN idx = rank THEN 1 ELSE 0 END) AS BIGINT) AS length FROM r GROUP BY media_id")
def frontier_prefix(spark, d):
    """ST06, ST07, M10, X04: only a gapless prefix is known."""
    k = V.table(spark, d, "events").select(F.col("user_id").alias("media_id"), (F.col("event_id") % 60).cast("int").alias("idx"))
    return L.contiguous_prefix(k, "media_id", "idx")


# --- dependencies ------------------------------------------------------------

EDGES_SQL = "edges AS (SELECT n_nationkey AS node, n_nationkey // 2 AS source FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, n_nationkey // 3 FROM nation WHERE n_nationkey > 2)"


def _edges(spark, d):
    """Each nation's node is computed from the nodes of half and a third of its number."""
    k = F.col("n_nationkey")
    n = V.table(spark, d, "nation")
    half = n.filter(k > 0).select(k.alias("node"), F.floor(k / 2).cast("int").alias("source"))
    return half.unionAll(n.filter(k > 2).select(k.alias("node"), F.floor(k / 3).cast("int").alias("source"))).distinct()


@query(f"WITH RECURSIVE {EDGES_SQL}, r(node, source) AS (SELECT node, source FROM edges UNION SELECT r.node, e.source FROM r JOIN edges e ON e.node = r.source) SELECT node, source FROM r")
def compute_closure(spark, d):
    """Everything that a node is computed from."""
    return graph.reachable(spark, _edges(spark, d))


@query(f"WITH RECURSIVE {EDGES_SQL}, r(node, source) AS (SELECT node, source FROM edges UNION SELECT r.node, e.source FROM r JOIN edges e ON e.node = r.source) SELECT n_nationkey AS candidate FROM nation WHERE n_nationkey <> 3 AND n_nationkey NOT IN (SELECT node FROM r WHERE source = 3)")
def compute_sources_eligible(spark, d):
    """What node 3 may depend on without a cycle."""
    below = graph.reachable(spark, _edges(spark, d)).filter("source = 3").select(F.col("node").alias("candidate"))
    return V.table(spark, d, "nation").filter("n_nationkey <> 3").select(F.col("n_nationkey").alias("candidate")).join(below, "candidate", "left_anti")


# --- budgets and rolling measures ---------------------------------------------


@query("WITH r AS (SELECT user_id, event_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE 1 END AS free, CAST(value * 100 AS BIGINT) AS bytes FROM events), s AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id ORDER BY free, event_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT event_id, run <= 200000 OR free = 0 AS kept FROM s")
def lru_evict(spark, d):
    """The most recent within a budget, protected ones first."""
    rows = V.table(spark, d, "events").select("user_id", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("bytes"))
    return L.keep_recent(rows, "user_id", "event_id", "bytes", 200_000, F.col("event_id") % 50 == 0).select("event_id", "kept")


@query(f"WITH {TIMELINE_SQL} SELECT event_id, c AS last, CAST(sum(c) OVER w AS DOUBLE) / count(*) OVER w AS avg, min(c) OVER w AS min, max(c) OVER w AS max FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM e) WINDOW w AS (PARTITION BY media_id ORDER BY ts, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)")
def rolling_metrics(spark, d):
    """W08, A29."""
    cents = V.event_timeline(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return L.rolling(cents, "media_id", ["ts", "event_id"], "cents").select("event_id", "last", "avg", "min", "max")


@query(f"WITH {TIMELINE_SQL} SELECT media_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a + (x - a) / 8), 6) AS ema, count(*) AS n FROM e GROUP BY media_id")
def latency_ema(spark, d):
    """The average after the last row, as a weighted sum."""
    return L.final_average(V.event_timeline(spark, d), "media_id", ["ts", "event_id"], "value").select("media_id", F.round("ema", 6).alias("ema"), "n")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, run")
def debounce_sessions(spark, d):
    """ST02 in batch: changes closer than the gap are one."""
    return V.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


@query("SELECT user_id, max_by(event_id, ts) AS event_id, count(*) AS scans FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY user_id")
def last_generation(spark, d):
    """ST03, ST05, M09: of several results, the latest generation's."""
    per = V.table(spark, d, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return per.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"), F.count("*").alias("scans"))


@query("SELECT user_id, (ts::DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 3")
def lock_step(spark, d):
    """ST11: a position is complete once every displayed kind has arrived."""
    return V.table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")).filter("kinds = 3").drop("kinds")


# --- geometry ---------------------------------------------------------------


@query("SELECT p_partkey, greatest(least(800.0::DOUBLE / p_size, 600.0::DOUBLE / (p_size % 7 + 1)), 0.0001) AS zoom, CASE WHEN p_size / 10.0::DOUBLE >= 1 THEN 1 ELSE CAST(floor(10.0::DOUBLE / p_size) AS INTEGER) END AS step FROM part")
def view_fit(spark, d):
    """F21, F34."""
    s = F.col("p_size")
    zoom = G.fit_zoom(F.lit(800.0), F.lit(600.0), s, s % 7 + 1)
    return V.table(spark, d, "part").select("p_partkey", zoom.alias("zoom"), G.decimation(s / 10.0).alias("step"))


@query("SELECT c_custkey, round(50 + (x - 50) * cos(a) - (y - 40) * sin(a), 6) AS rx, round(40 + (x - 50) * sin(a) + (y - 40) * cos(a), 6) AS ry FROM (SELECT c_custkey, c_nationkey * 4.0::DOUBLE AS x, c_custkey % 80 * 1.0::DOUBLE AS y, radians(c_nationkey * 15.0::DOUBLE) AS a FROM customer)")
def rotate_points(spark, d):
    """F24."""
    x, y = G.rotate(F.col("c_nationkey") * 4.0, F.col("c_custkey") % 80 * 1.0, F.lit(50.0), F.lit(40.0), F.col("c_nationkey") * 15.0)
    return V.table(spark, d, "customer").select("c_custkey", F.round(x, 6).alias("rx"), F.round(y, 6).alias("ry"))


@query("SELECT c_custkey, CASE WHEN m > 180 THEN m - 360 WHEN m <= -180 THEN m + 360 ELSE m END AS wrapped FROM (SELECT c_custkey, (c_custkey * 37 % 2000 - 1000) * 1.0::DOUBLE % 360 AS m FROM customer)")
def wrap_angles(spark, d):
    """F27."""
    return V.table(spark, d, "customer").select("c_custkey", G.wrap_angle((F.col("c_custkey") * 37 % 2000 - 1000) * 1.0).alias("wrapped"))


@query("WITH p AS (SELECT c_custkey, c_nationkey * 1.0::DOUBLE AS x, c_custkey % 30 * 1.0::DOUBLE AS y FROM customer), t AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((x - 2) * 10 + (y - 3) * 20) / 500.0::DOUBLE)) AS t FROM p) SELECT c_custkey, round(sqrt((x - (2 + t * 10)) * (x - (2 + t * 10)) + (y - (3 + t * 20)) * (y - (3 + t * 20))), 6) AS distance FROM t")
def segment_distance(spark, d):
    """F28."""
    distance = G.segment_distance(F.col("c_nationkey") * 1.0, F.col("c_custkey") % 30 * 1.0, 2.0, 3.0, 12.0, 23.0)
    return V.table(spark, d, "customer").select("c_custkey", F.round(distance, 6).alias("distance"))


@query("WITH p AS (SELECT p_partkey, p_size * 700 AS w, p_size * 500 AS h FROM part), l AS (SELECT *, unnest(range(0, 9)) AS k FROM p), s AS (SELECT *, CAST(greatest(1, ceil(w / (1 << k)::DOUBLE)) AS BIGINT) * CAST(greatest(1, ceil(h / (1 << k)::DOUBLE)) AS BIGINT) AS px FROM l) SELECT p_partkey, CAST(coalesce(min(k) FILTER (WHERE px <= 32000000), 8) AS INTEGER) AS level FROM s GROUP BY p_partkey")
def resolution_level(spark, d):
    """S15, S16."""
    s = F.col("p_size")
    return V.table(spark, d, "part").select("p_partkey", G.resolution_level(s * 700, s * 500, F.lit(32_000_000)).alias("level"))


@query("SELECT p_partkey, least(8, greatest(3, CAST(ceil(p_size * 0.001::DOUBLE * 4 / (2 / 30.0::DOUBLE)) AS INTEGER) + 1)) AS depth, least(2.0::DOUBLE, 0.2::DOUBLE * greatest(p_size / 4.0::DOUBLE, 1)) AS seconds, CAST(2 ** floor(log2(p_size)) AS INTEGER) AS pow2 FROM part")
def prefetch_and_watch(spark, d):
    """F35, F43, F45."""
    s = F.col("p_size")
    return V.table(spark, d, "part").select("p_partkey", G.prefetch_depth(s * 0.001, F.lit(4), F.lit(2), F.lit(30.0)).alias("depth"), G.watch_interval(s).alias("seconds"), G.power_of_two(s).alias("pow2"))


@query("WITH n AS (SELECT p_partkey, p_size * 1.0::DOUBLE AS hi FROM part WHERE p_size > 1), s AS (SELECT *, 10.0::DOUBLE ** floor(log10(hi - 1)) AS p FROM n), r AS (SELECT *, (CASE WHEN (hi - 1) / p <= 1 THEN 1 WHEN (hi - 1) / p <= 2 THEN 2 WHEN (hi - 1) / p <= 5 THEN 5 ELSE 10 END) * p / 4 AS raw FROM s), q AS (SELECT *, 10.0::DOUBLE ** floor(log10(raw)) AS rp FROM r), t AS (SELECT *, (CASE WHEN raw / rp < 1.5 THEN 1.0::DOUBLE WHEN raw / rp < 3 THEN 2 WHEN raw / rp < 7 THEN 5 ELSE 10 END) * rp AS step FROM q) SELECT p_partkey, round(step, 6) AS step, CAST(ceil(hi / step) - floor(1 / step) + 1 AS INTEGER) AS ticks FROM t")
def nice_ticks(spark, d):
    """F31, F32."""
    hi = F.col("p_size") * 1.0
    ticks = G.ticks(F.lit(1.0), hi, 5)
    return V.table(spark, d, "part").filter("p_size > 1").select("p_partkey", F.round(F.element_at(ticks, 2) - F.element_at(ticks, 1), 6).alias("step"), F.size(ticks).alias("ticks"))


@query("SELECT p_partkey, greatest(2, CAST(floor(h * 1.5::DOUBLE + 0.5) AS INTEGER)) - greatest(2, CAST(floor(h * 1.5::DOUBLE + 0.5) AS INTEGER)) % 2 AS w, h FROM (SELECT p_partkey, greatest(2, p_size * 13 - p_size * 13 % 2) AS h FROM part)")
def output_size(spark, d):
    """F29."""
    w, h = G.even_size(F.col("p_size") * 13, F.lit(1.5))
    return V.table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"))


# --- composition ------------------------------------------------------------

PANES_SQL = "panes AS (SELECT n_regionkey AS plan, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pane, CAST(40 + n_nationkey * 3 % 17 AS INTEGER) AS w, CAST(30 + n_nationkey * 5 % 13 AS INTEGER) AS h FROM nation), cells AS (SELECT *, pane % 3 AS col, pane // 3 AS row FROM panes)"


def _panes(spark, d):
    n = V.table(spark, d, "nation").select(F.col("n_regionkey").alias("plan"), "n_nationkey", (40 + F.col("n_nationkey") * 3 % 17).cast("int").alias("w"), (30 + F.col("n_nationkey") * 5 % 13).cast("int").alias("h"))
    return V.numbered(n, "plan", "n_nationkey", name="pane")


GRID_SQL = f"{PANES_SQL}, cw AS (SELECT plan, col, CAST(coalesce(sum(w) OVER (PARTITION BY plan ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM (SELECT plan, col, max(w) AS w FROM cells GROUP BY ALL)), rh AS (SELECT plan, row, CAST(coalesce(sum(h) OVER (PARTITION BY plan ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS y FROM (SELECT plan, row, max(h) AS h FROM cells GROUP BY ALL)), grid AS (SELECT plan, pane, x AS \"left\", y AS top, w, h FROM cells JOIN cw USING (plan, col) JOIN rh USING (plan, row))"


def _grid(spark, d):
    return Y.packed_grid(_panes(spark, d), "plan", "pane", "w", "h", 3).select("plan", "pane", "left", "top", "w", "h")


@query(f"WITH {GRID_SQL} SELECT * FROM grid")
def grid_layout(spark, d):
    """A23, F46, K10, W07."""
    return _grid(spark, d)


@query(f"WITH {GRID_SQL}, points AS (SELECT c_custkey, c_nationkey % 5 AS plan, c_custkey * 7 % 150 AS px, c_custkey * 11 % 80 AS py FROM customer) SELECT c_custkey, arg_min(pane, pane) AS pane FROM points p JOIN grid g ON g.plan = p.plan AND px >= g.\"left\" AND px < g.\"left\" + w AND py >= top AND py < top + h GROUP BY c_custkey")
def locate_pane(spark, d):
    """The first cell that holds a point; plans are an equal key, so no loop over all cells."""
    p = V.table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("plan"), (F.col("c_custkey") * 7 % 150).alias("px"), (F.col("c_custkey") * 11 % 80).alias("py"))
    inside = (F.col("px") >= F.col("left")) & (F.col("px") < F.col("left") + F.col("w")) & (F.col("py") >= F.col("top")) & (F.col("py") < F.col("top") + F.col("h"))
    return p.join(_grid(spark, d), "plan").filter(inside).groupBy("c_custkey").agg(F.min("pane").alias("pane"))


@query(f"WITH {FRAMES_SQL}, ab AS (SELECT a.media_id, a.frame_idx, a.samples AS a, b.samples AS b FROM f a JOIN f b ON a.media_id = b.media_id AND b.frame_idx = a.frame_idx + 1) SELECT media_id, frame_idx, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y, CASE WHEN pos % 8 < 8 * 0.4 THEN a[pos + 1] ELSE b[pos + 1] END AS v FROM (SELECT *, unnest(range(0, 64)) AS pos FROM ab)")
def ab_compose(spark, d):
    """a wipe between two panes."""
    frames = V.embedding_frames(spark, d)
    a = frames.select("media_id", "frame_idx", F.col("samples").alias("a"))
    b = frames.select("media_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("samples").alias("b"))
    split = min(0.98, max(0.02, 0.4))
    mixed = F.transform(F.arrays_zip("a", "b"), lambda z, i: F.when(i % 8 < 8 * split, z["a"]).otherwise(z["b"]))
    return V.pixels(a.join(b, ["media_id", "frame_idx"]).select("media_id", "frame_idx", mixed.alias("samples")), 8).drop("c")


@query(f"WITH {GRID_SQL} SELECT plan, CAST(max(\"left\" + w) AS BIGINT) AS width, CAST(max(top + h) AS BIGINT) AS height, count(*) AS panes FROM grid GROUP BY plan")
def canvas_size(spark, d):
    """K10, M62 for grids."""
    return _grid(spark, d).groupBy("plan").agg(F.max(F.col("left") + F.col("w")).alias("width"), F.max(F.col("top") + F.col("h")).alias("height"), F.count("*").alias("panes"))


@query(f"WITH {PANES_SQL}, corners AS (SELECT plan, pane, w, h, unnest([0, 20, 0, 20]) AS cx, unnest([0, 0, 12, 12]) AS cy FROM panes), mapped AS (SELECT plan, pane, w, h, w / 2.0::DOUBLE + (cx - 10) * 0.5::DOUBLE AS mx, h / 2.0::DOUBLE + (cy - 6) * 0.5::DOUBLE AS my FROM corners) SELECT plan, pane, CAST(greatest(0, floor(min(mx)) - 1) AS INTEGER) AS x0, CAST(greatest(0, floor(min(my)) - 1) AS INTEGER) AS y0, CAST(least(max(w), ceil(max(mx)) + 1) AS INTEGER) AS x1, CAST(least(max(h), ceil(max(my)) + 1) AS INTEGER) AS y1 FROM mapped GROUP BY plan, pane")
def pane_boxes(spark, d):
    """The source box of an output cell, a pixel wider, inside the frame."""
    corner = F.explode(F.array(*(F.struct(F.lit(x).alias("cx"), F.lit(y).alias("cy")) for x in (0, 20) for y in (0, 12))))
    m = _panes(spark, d).select("plan", "pane", "w", "h", corner.alias("c")).withColumns({"mx": F.col("w") / 2.0 + (F.col("c.cx") - 10) * 0.5, "my": F.col("h") / 2.0 + (F.col("c.cy") - 6) * 0.5})
    low = lambda c: F.greatest(F.lit(0), F.floor(F.min(c)) - 1).cast("int")
    high = lambda c, n: F.least(F.max(n), F.ceil(F.max(c)) + 1).cast("int")
    return m.groupBy("plan", "pane").agg(low("mx").alias("x0"), low("my").alias("y0"), high("mx", "w").alias("x1"), high("my", "h").alias("y1"))


