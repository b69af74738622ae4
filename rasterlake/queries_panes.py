"""Queries over panes: settings, views, labels, layouts that change, and composed output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlake.functions import geometry as G
from rasterlake.functions import tokens as K
from rasterlake.functions import tone as T
from rasterlake.operators import compose as C
from rasterlake.operators import layout as Y
from rasterlake.plans import views as V
from rasterlake.queries import FRAMES_SQL, linear_sql, query

#: Every nation is a pane of its region's plan; its frames are its customers.
PANES_SQL = """panes AS (SELECT n_nationkey AS pane, n_regionkey AS plan, n_name AS name, ['uint8', 'uint16', 'float32'][n_nationkey % 3 + 1] AS dtype, [1, 3, 4, 2][n_nationkey % 4 + 1] AS channels,
    n_nationkey % 5 = 0 AS mask, n_nationkey % 6 > 0 AS resident, 640 + n_nationkey * 97 AS w, 480 + n_nationkey * 61 AS h, coalesce(c.n, 0) AS customers, coalesce(c.n, 0) % 4 AS frames FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey)"""


def _pick(values, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def _panes(spark, d):
    n = F.col("n_nationkey")
    customers = V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    count = F.coalesce("customers", F.lit(0))
    return V.table(spark, d, "nation").join(customers, "n_nationkey", "left").select(
        n.alias("pane"), F.col("n_regionkey").alias("plan"), F.col("n_name").alias("name"), _pick(("uint8", "uint16", "float32"), n % 3).alias("dtype"), _pick((1, 3, 4, 2), n % 4).alias("channels"),
        (n % 5 == 0).alias("mask"), (n % 6 > 0).alias("resident"), (640 + n * 97).alias("w"), (480 + n * 61).alias("h"), count.alias("customers"), (count % 4).alias("frames"),
    )


# --- settings and predicates --------------------------------------------------


@query(f"WITH {PANES_SQL} SELECT pane, channels = 1 AND dtype = 'uint16' AS op_input, dtype <> 'uint8' AS deep, CASE dtype WHEN 'uint8' THEN 255.0::DOUBLE WHEN 'uint16' THEN 65535 ELSE 1 END AS top, resident AND channels IN (1, 3, 4) AS may_overlay, CASE WHEN dtype = 'uint16' THEN 65536 ELSE 256 END AS entries, pane % 7 = 0 AND w - pane % 2 = w AS covers FROM panes")
def pane_predicates(spark, d):
    """What a pane's samples allow, and whether a rectangle is its whole frame."""
    dtype, k = F.col("dtype"), F.col("pane")
    x0, x1 = F.when(k % 7 == 0, 0).otherwise(1), F.col("w") - k % 2
    covers = (x0 == 0) & (x1 == F.col("w"))
    return _panes(spark, d).select("pane", T.operator_input(dtype, F.col("channels")).alias("op_input"), T.deep(dtype).alias("deep"), T.nominal_max(dtype).alias("top"), (F.col("resident") & T.may_overlay(F.col("channels"))).alias("may_overlay"), T.table_entries(dtype).alias("entries"), covers.alias("covers"))


SETTINGS_SQL = f"""{PANES_SQL}, shared AS (SELECT r_regionkey AS plan, ['linear', 'colormap', 'lut_alpha'][r_regionkey % 3 + 1] AS s_tone, r_regionkey * 0.25::DOUBLE AS s_clip, r_regionkey % 2 = 0 AS s_on FROM region),
    picked AS (SELECT pane, dtype, channels, mask, CASE WHEN pane % 2 = 0 THEN s_tone ELSE ['colormap', 'linear', 'lut_alpha'][pane % 3 + 1] END AS tone, CASE WHEN pane % 2 = 0 THEN s_clip ELSE 0.01::DOUBLE END AS clip, CASE WHEN pane % 2 = 0 THEN s_on ELSE dtype <> 'uint8' END AS clip_on FROM panes JOIN shared USING (plan))"""


@query(f"WITH {SETTINGS_SQL} SELECT pane, tone, CASE WHEN clip_on AND tone <> 'lut_alpha' THEN clip END AS percent, tone = 'colormap' AND channels IN (1, 2) AND NOT mask AS palette FROM picked")
def effective_settings(spark, d):
    """Synced panes take their plan's settings, others their own, which clip deep samples."""
    k, plan = F.col("pane"), F.col("r_regionkey")
    shared = V.table(spark, d, "region").select(plan.alias("plan"), F.struct(_pick(("linear", "colormap", "lut_alpha"), plan % 3).alias("tone"), (plan * 0.25).alias("clip"), (plan % 2 == 0).alias("clip_on")).alias("shared"))
    own = F.struct(_pick(("colormap", "linear", "lut_alpha"), k % 3).alias("tone"), F.lit(0.01).alias("clip"), T.deep(F.col("dtype")).alias("clip_on"))
    s = _panes(spark, d).join(shared, "plan").withColumn("s", F.when(k % 2 == 0, F.col("shared")).otherwise(own))
    return s.select("pane", "s.tone", T.clip_percent(F.col("s.tone"), F.col("s.clip_on"), F.col("s.clip")).alias("percent"), T.uses_palette(F.col("s.tone"), F.col("channels"), F.col("mask")).alias("palette"))


@query(f"WITH {PANES_SQL}, c AS (SELECT plan, min(pane) AS control, max_by(frames, -pane) AS control_frames, min(pane) FILTER (WHERE frames > 1) AS sequence, count(*) FILTER (WHERE pane % 4 > 0) AS visible, max(frames) AS longest FROM panes GROUP BY plan) SELECT plan, control, CASE WHEN control_frames > 1 OR sequence IS NULL THEN control ELSE sequence END AS driver, visible, longest FROM c")
def loop_driver(spark, d):
    """The control drives if it is a sequence, else the first sequence does."""
    k = F.col("pane")
    c = _panes(spark, d).groupBy("plan").agg(F.min(k).alias("control"), F.min_by("frames", k).alias("control_frames"), F.min(F.when(F.col("frames") > 1, k)).alias("sequence"), F.count(F.when(k % 4 > 0, 1)).alias("visible"), F.max("frames").alias("longest"))
    return c.select("plan", "control", F.when((F.col("control_frames") > 1) | F.col("sequence").isNull(), F.col("control")).otherwise(F.col("sequence")).alias("driver"), "visible", "longest")


@query(f"WITH {PANES_SQL} SELECT plan, greatest(1, 100000000 // sum(w * h * channels * CASE dtype WHEN 'uint8' THEN 1 WHEN 'uint16' THEN 2 ELSE 4 END) FILTER (WHERE resident)) AS positions, max(pane % 4) AS level, max(pane) FILTER (WHERE pane % 4 = (SELECT max(q.pane % 4) FROM panes q WHERE q.plan = panes.plan)) AS of FROM panes GROUP BY plan")
def cache_positions(spark, d):
    """Timeline positions that a budget holds, and the coarsest level with the pane that has it, the last of several."""
    size = F.col("w") * F.col("h") * F.col("channels") * F.when(F.col("dtype") == "uint8", 1).when(F.col("dtype") == "uint16", 2).otherwise(4)
    held = F.sum(F.when(F.col("resident"), size))
    top = F.max(F.struct((F.col("pane") % 4).alias("level"), "pane"))
    found = _panes(spark, d).groupBy("plan").agg(held.alias("held"), top.alias("top"))
    return found.select("plan", F.when(F.col("held").isNotNull(), F.greatest(F.lit(1), F.floor(F.lit(100_000_000) / F.col("held")))).alias("positions"), "top.level", F.col("top.pane").alias("of"))


@query(f"WITH {PANES_SQL} SELECT pane, (pane % 3, pane % 4) <> (pane % 2, pane % 5) AS rerender, CASE WHEN pane % 2 = 0 THEN xor(CAST(customers + 1 AS BIGINT) << 32, CAST(frames + 1 AS BIGINT)) ELSE CAST(customers AS BIGINT) END AS inputs FROM panes")
def input_signatures(spark, d):
    """whether a look changed, and the signature of a computed pane's sources: shown frames of a pair, frames held of a stack."""
    k = F.col("pane")
    changed = F.xxhash64(k % 3, k % 4) != F.xxhash64(k % 2, k % 5)
    pair = F.shiftleft((F.col("customers") + 1).cast("long"), 32).bitwiseXOR((F.col("frames") + 1).cast("long"))
    return _panes(spark, d).select("pane", changed.alias("rerender"), F.when(k % 2 == 0, pair).otherwise(F.col("customers").cast("long")).alias("inputs"))


# --- names ----------------------------------------------------------------------


@query(f"""WITH {PANES_SQL}, v AS (SELECT *, CAST(pane * 7.3::DOUBLE - 40 AS DOUBLE) AS angle, pane * 0.3::DOUBLE AS tick, CASE pane % 3 WHEN 1 THEN '   ' WHEN 2 THEN ' Mine ' || pane || ' ' END AS custom FROM panes)
        SELECT pane, CASE WHEN pane % 4 = 0 THEN name ELSE name || ' (1/' || (1 << (pane % 4)) || ')' END AS title, coalesce(nullif(trim(custom), ''), name) AS label, CASE WHEN abs(angle - trunc(angle)) < 0.05 THEN CAST(CAST(round(angle) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', angle) END AS angle,
        CASE WHEN abs(tick - trunc(tick)) < 0.0001 THEN CAST(CAST(round(tick) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', tick) END AS tick, coalesce(nullif(trim(custom), ''), name) || ' · ' || pane || ' - ' || plan AS computed FROM v""")
def pane_labels(spark, d):
    """T24, T25, T26, K20."""
    k = F.col("pane")
    custom = F.when(k % 3 == 1, "   ").when(k % 3 == 2, F.concat(F.lit(" Mine "), k.cast("string"), F.lit(" ")))
    label = K.label(custom, F.col("name"))
    return _panes(spark, d).select("pane", K.reduced_name(F.col("name"), k % 4).alias("title"), label.alias("label"), K.short_number(k * F.lit(7.3) - 40, 1, 0.05).alias("angle"), K.short_number(k * F.lit(0.3), 2, 1e-4).alias("tick"), K.computed_name(label, k.cast("string"), "-", F.col("plan").cast("string")).alias("computed"))


@query("SELECT p_partkey, CASE WHEN lower(regexp_extract(name, '\\.([^.]*)$', 1)) IN ('png', 'jpg', 'jpeg') THEN 'image' ELSE 'video' END AS format FROM (SELECT p_partkey, trim(replace(p_name, ' ', '.') || ['.PNG', '', '.mp4', '.jpeg ', '.tif'][p_partkey % 5 + 1]) AS name FROM part)")
def export_formats(spark, d):
    """By extension; a bare name is a video."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), _pick((".PNG", "", ".mp4", ".jpeg ", ".tif"), F.col("p_partkey") % 5))
    return V.table(spark, d, "part").select("p_partkey", K.export_format(name).alias("format"))


@query(r"SELECT o_orderkey, array_to_string(list_reverse(lines)[1:3], ' | ') AS tail FROM (SELECT o_orderkey, CASE WHEN lines[-1] = '' THEN lines[:-2] ELSE lines END AS lines FROM (SELECT o_orderkey, string_split('start' || chr(10) || o_orderpriority || chr(10) || o_orderstatus || chr(10) || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) ELSE '' END, chr(10)) AS lines FROM orders))")
def log_tails(spark, d):
    """The last three lines of a log, the latest first."""
    log = F.concat_ws("\n", F.lit("start"), "o_orderpriority", "o_orderstatus", F.col("o_orderkey").cast("string"))
    log = F.concat(log, F.when(F.col("o_orderkey") % 2 == 0, "\n").otherwise(""))
    return V.table(spark, d, "orders").select("o_orderkey", K.log_tail(log, 3).alias("tail"))


# --- views ------------------------------------------------------------------------

VIEW_SQL = "v AS (SELECT c_custkey, 0.1::DOUBLE + c_custkey % 50 * 0.1::DOUBLE AS zoom, c_custkey % 31 * 1.0::DOUBLE AS cx, c_custkey % 17 * 1.0::DOUBLE AS cy, [0.5::DOUBLE, 2, 10000, 0.0000001][c_custkey % 4 + 1] AS factor, c_nationkey * 20.0::DOUBLE AS ax, c_custkey % 300 * 1.0::DOUBLE AS ay, radians(c_nationkey * 15.0::DOUBLE) AS a FROM customer)"


def _views(spark, d):
    k = F.col("c_custkey")
    return V.table(spark, d, "customer").select(k, (0.1 + k % 50 * F.lit(0.1)).alias("zoom"), (k % 31 * F.lit(1.0)).alias("cx"), (k % 17 * F.lit(1.0)).alias("cy"), _pick((0.5, 2.0, 10000.0, 0.0000001), k % 4).alias("factor"), (F.col("c_nationkey") * 20.0).alias("ax"), (k % 300 * F.lit(1.0)).alias("ay"), (F.col("c_nationkey") * 15.0).alias("degrees"))


@query(f"WITH {VIEW_SQL}, z AS (SELECT *, least(512.0::DOUBLE, greatest(0.0001::DOUBLE, zoom * factor)) AS new FROM v) SELECT c_custkey, round(new, 6) AS zoom, round(cx + (ax - 200) / zoom - (ax - 200) / new, 3) AS cx, round(cy + (ay - 150) / zoom - (ay - 150) / new, 3) AS cy, round(cx - ax / zoom, 6) AS panned FROM z")
def zoomed_views(spark, d):
    """zoom about a screen point, held within limits, and pan."""
    zoom, cx, cy = G.zoom_at(F.col("zoom"), F.col("cx"), F.col("cy"), F.col("factor"), F.col("ax"), F.col("ay"), F.lit(200.0), F.lit(150.0))
    return _views(spark, d).select("c_custkey", F.round(zoom, 6).alias("zoom"), F.round(cx, 3).alias("cx"), F.round(cy, 3).alias("cy"), F.round(F.col("cx") - F.col("ax") / F.col("zoom"), 6).alias("panned"))


@query(f"""WITH {VIEW_SQL}, p AS (SELECT *, 200 + (16 - cx) * zoom AS px, 150 + (12 - cy) * zoom AS py, 200 + (5 - cx) * zoom AS ux, 150 + (7 - cy) * zoom AS uy FROM v),
        r AS (SELECT *, px + (ux - px) * cos(a) - (uy - py) * sin(a) AS sx, py + (ux - px) * sin(a) + (uy - py) * cos(a) AS sy, px + (ax - px) * cos(-a) - (ay - py) * sin(-a) AS bx, py + (ax - px) * sin(-a) + (ay - py) * cos(-a) AS ny FROM p),
        i AS (SELECT *, cx + (bx - 200) / zoom AS ix, cy + (ny - 150) / zoom AS iy FROM r) SELECT c_custkey, round(sx, 6) AS sx, round(sy, 6) AS sy, CASE WHEN ix >= 0 AND iy >= 0 AND ix < 32 AND iy < 24 THEN CAST(floor(round(ix, 9)) AS BIGINT) END AS x, CASE WHEN ix >= 0 AND iy >= 0 AND ix < 32 AND iy < 24 THEN CAST(floor(round(iy, 9)) AS BIGINT) END AS y FROM i""")
def rotated_views(spark, d):
    """An image point on a turned view, and the pixel under a screen point, if there is one."""
    view = (F.col("zoom"), F.col("cx"), F.col("cy"), F.lit(200.0), F.lit(150.0))
    w, h = F.lit(32), F.lit(24)
    sx, sy = G.rotated_to_screen(F.lit(5.0), F.lit(7.0), w, h, F.col("degrees"), *view)
    ix, iy = G.rotated_to_image(F.col("ax"), F.col("ay"), w, h, F.col("degrees"), *view)
    on = (ix >= 0) & (iy >= 0) & (ix < w) & (iy < h)
    return _views(spark, d).select("c_custkey", F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"), F.when(on, F.floor(F.round(ix, 9))).alias("x"), F.when(on, F.floor(F.round(iy, 9))).alias("y"))


@query("SELECT p_partkey, CASE WHEN side = 0 THEN 1 ELSE CAST(greatest(1, ceil(greatest(w, h) / greatest(side, 1)::DOUBLE)) AS INTEGER) END AS fit, t AS step, CAST(greatest(1, ceil(w / t::DOUBLE)) AS INTEGER) AS thumb_w, CAST(greatest(1, ceil(h / t::DOUBLE)) AS INTEGER) AS thumb_h FROM (SELECT *, CAST(greatest(1, ceil(greatest(w, h) / 240.0::DOUBLE)) AS INTEGER) AS t FROM (SELECT p_partkey, p_size * 37 AS w, p_partkey % 900 + 1 AS h, p_partkey % 3 * 512 AS side FROM part))")
def fit_steps(spark, d):
    """the decimation that fits a texture, none without a limit, and a thumbnail's."""
    w, h, k = F.col("p_size") * 37, F.col("p_partkey") % 900 + 1, F.col("p_partkey")
    step = G.fit_step(w, h, G.THUMBNAIL)
    return V.table(spark, d, "part").select("p_partkey", G.fit_step(w, h, k % 3 * 512).alias("fit"), step.alias("step"), G.stepped(w, step).alias("thumb_w"), G.stepped(h, step).alias("thumb_h"))


RECT_SQL = "b AS (SELECT p_partkey, p_size AS ax0, p_partkey % 40 AS ay0, p_size + 30 AS ax1, p_partkey % 40 + 20 AS ay1, p_partkey % 60 AS bx0, p_size % 30 AS by0, p_partkey % 60 + 25 AS bx1, p_size % 30 + 25 AS by1 FROM part)"


@query(f"WITH {RECT_SQL} SELECT p_partkey, least(ax0, bx0) AS ux0, least(ay0, by0) AS uy0, greatest(ax1, bx1) AS ux1, greatest(ay1, by1) AS uy1, greatest(ax0, bx0) AS ix0, greatest(ay0, by0) AS iy0, least(ax1, bx1) AS ix1, least(ay1, by1) AS iy1, greatest(ax0, bx0) < least(ax1, bx1) AND greatest(ay0, by0) < least(ay1, by1) AS meet FROM b")
def rectangle_algebra(spark, d):
    """The box around two panes' contents, and what a view shows of one."""
    s, k = F.col("p_size"), F.col("p_partkey")
    a, b = {"x0": s, "y0": k % 40, "x1": s + 30, "y1": k % 40 + 20}, {"x0": k % 60, "y0": s % 30, "x1": k % 60 + 25, "y1": s % 30 + 25}
    u, i = G.union(a, b), G.intersection(a, b)
    return V.table(spark, d, "part").select("p_partkey", *(c.alias(f"u{n}") for n, c in u.items()), *(c.alias(f"i{n}") for n, c in i.items()), ((i["x0"] < i["x1"]) & (i["y0"] < i["y1"])).alias("meet"))


@query(f"WITH {PANES_SQL} SELECT pane, CAST(round((w - 100) * (pane % 9 % 3 / 2.0::DOUBLE), 3) AS DOUBLE) AS x, CAST(round((h - 20) * (pane % 9 // 3 / 2.0::DOUBLE), 3) AS DOUBLE) AS y, CAST(floor((CASE WHEN resident THEN pane * 9 ELSE 24 END) * (1 - (pane % 11) / 10.0::DOUBLE) + 255 * ((pane % 11) / 10.0::DOUBLE) + 0.5) AS INTEGER) AS r FROM panes")
def label_places(spark, d):
    """A label's corner by its anchor, and its colour over the image, or over the background where there is none."""
    k = F.col("pane")
    fx, fy = G.anchor_fractions(k % 9)
    r = T.label_blend(k * 9, F.col("resident"), F.lit(255), (k % 11) / 10.0)
    return _panes(spark, d).select("pane", F.round((F.col("w") - 100) * fx, 3).alias("x"), F.round((F.col("h") - 20) * fy, 3).alias("y"), r.alias("r"))


# --- order and layouts that change --------------------------------------------------


@query(f"WITH {PANES_SQL}, m AS (SELECT plan, pane AS v, plan * 3 AS src, plan * 5 AS dst FROM panes) SELECT v AS pane, plan, CASE WHEN v = src THEN dst WHEN v = dst THEN src ELSE v END AS swapped, CASE WHEN v = src THEN dst WHEN src < v AND v <= dst THEN v - 1 WHEN dst <= v AND v < src THEN v + 1 ELSE v END AS moved, CASE WHEN v = src THEN NULL WHEN v > src THEN v - 1 ELSE v END AS removed FROM m")
def reordered_panes(spark, d):
    """Indexes after two panes change places, one moves, or one goes."""
    v, src, dst = F.col("pane"), F.col("plan") * 3, F.col("plan") * 5
    return _panes(spark, d).select("pane", "plan", Y.after_swap(v, src, dst).alias("swapped"), Y.after_move(v, src, dst).alias("moved"), Y.after_removal(v, src).alias("removed"))


FILES_SQL = "f AS (SELECT n_regionkey AS media_id, n_nationkey AS file_idx, CAST(1 + n_nationkey * 7 % 5 AS INTEGER) AS pages, CAST(1 + (n_nationkey + CASE WHEN n_nationkey = 8 THEN 1 ELSE 0 END) * 7 % 5 AS INTEGER) AS measured, n_nationkey % 4 <> 1 AS stays FROM nation)"


def _map_sql(name: str, pages: str, where: str = "true") -> str:
    return f"{name} AS (SELECT media_id, file_idx, page, CAST(row_number() OVER (PARTITION BY media_id ORDER BY file_idx, page) - 1 AS BIGINT) AS frame_idx FROM (SELECT media_id, file_idx, CAST(unnest(range(0, {pages})) AS INTEGER) AS page FROM f WHERE {where}))"


def _files(spark, d):
    n = F.col("n_nationkey")
    pages = lambda k: (1 + k * 7 % 5).cast("int")
    return V.table(spark, d, "nation").select(F.col("n_regionkey").alias("media_id"), n.alias("file_idx"), pages(n).alias("pages"), pages(n + F.when(n == 8, 1).otherwise(0)).alias("measured"), (n % 4 != 1).alias("stays"))


@query(f"WITH {FILES_SQL}, {_map_sql('known', 'pages')}, {_map_sql('new', 'measured')}, k AS (SELECT * FROM known WHERE frame_idx < 9), c AS (SELECT media_id, count(k.frame_idx) AS known, count(n.frame_idx) AS measured, count(*) FILTER (WHERE k.file_idx <> n.file_idx OR k.page <> n.page) AS differ FROM k FULL JOIN new n USING (media_id, frame_idx) GROUP BY media_id) SELECT media_id, differ = 0 AS agrees, CASE WHEN differ = 0 THEN greatest(known, measured) ELSE known END AS length FROM c")
def extended_layout(spark, d):
    """Measured page counts lengthen a timeline only if they agree with what is known of it."""
    files = _files(spark, d)
    known = Y.frame_map(files, "media_id", "file_idx", "pages").filter("frame_idx < 9")
    return Y.extended(known, Y.frame_map(files, "media_id", "file_idx", "measured"), "media_id")


@query(f"WITH {FILES_SQL}, {_map_sql('old', 'pages')}, {_map_sql('new', 'pages + 1', 'stays')}, n AS (SELECT media_id, count(*) AS n FROM new GROUP BY media_id) SELECT o.media_id, o.frame_idx, coalesce(w.frame_idx, least(o.frame_idx, n - 1)) AS after FROM old o LEFT JOIN new w ON w.media_id = o.media_id AND w.file_idx = o.file_idx AND w.page = o.page JOIN n ON n.media_id = o.media_id")
def reloaded_frames(spark, d):
    """J11, ST18: after a folder changed, a frame is where its file and page are now, or as near its old place as there are frames."""
    files = _files(spark, d)
    new = Y.frame_map(files.filter("stays").withColumn("pages", F.col("pages") + 1), "media_id", "file_idx", "pages")
    return Y.reanchored(Y.frame_map(files, "media_id", "file_idx", "pages"), new, "media_id")


@query("SELECT e.event_id FROM events e JOIN (SELECT user_id, max(event_id) AS newest FROM events GROUP BY user_id) k USING (user_id) WHERE (e.event_id % 3, e.event_id % 2) <> (newest % 3, newest % 2) AND e.event_id % 10 > 0")
def retired_regions(spark, d):
    """Cached regions of a pane that show another frame or look than its newest one, and aren't on the screen."""
    e = V.table(spark, d, "events").select("user_id", "event_id")
    newest = e.groupBy("user_id").agg(F.max("event_id").alias("newest"))
    look = lambda c: F.struct(F.col(c) % 3, F.col(c) % 2)
    return e.join(newest, "user_id").filter((look("event_id") != look("newest")) & (F.col("event_id") % 10 > 0)).select("event_id")


@query("SELECT user_id, least(CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 80 - 0.1::DOUBLE)) * greatest(n - 1, 1) + 0.5) AS BIGINT), n - 1) AS frame, event_id FROM events JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) USING (user_id)")
def scrubbed_frames(spark, d):
    """The frame under a place on the timeline bar."""
    e = V.table(spark, d, "events").select("user_id", "event_id", "value")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 80 - F.lit(0.1)))
    frame = F.least(F.floor(part * F.greatest(F.col("n") - 1, F.lit(1)) + 0.5), F.col("n") - 1)
    return e.join(n, "user_id").select("user_id", frame.alias("frame"), "event_id")


@query(f"WITH {PANES_SQL}, m AS (SELECT plan, pane, frames, pane % 2 = 0 AS at_end, pane % 4 > 0 AS visible FROM panes), r AS (SELECT plan, max(frames) AS tl FROM m GROUP BY plan), c AS (SELECT plan, least(1, greatest(tl, 1) - 1) AS first, greatest(least(1, greatest(tl, 1) - 1), least(2, greatest(tl, 1) - 1)) AS last FROM r) SELECT plan, first, last, bool_or(visible AND frames > 1 AND NOT at_end AND frames <= last) AS incomplete, count(*) FILTER (WHERE visible) AS shown FROM m JOIN c USING (plan) GROUP BY plan, first, last")
def export_ranges(spark, d):
    """An export's range within the timeline, and whether a pane that takes part may still grow within it."""
    m = _panes(spark, d).select("plan", "pane", "frames", (F.col("pane") % 2 == 0).alias("at_end"), (F.col("pane") % 4 > 0).alias("visible"))
    most = F.greatest(F.max("frames"), F.lit(1)) - 1
    r = m.groupBy("plan").agg(F.least(F.lit(1), most).alias("first"), F.greatest(F.least(F.lit(1), most), F.least(F.lit(2), most)).alias("last"))
    open_ = F.col("visible") & (F.col("frames") > 1) & ~F.col("at_end") & (F.col("frames") <= F.col("last"))
    return m.join(r, "plan").groupBy("plan", "first", "last").agg(F.bool_or(open_).alias("incomplete"), F.count(F.when(F.col("visible"), 1)).alias("shown"))


# --- decoded planes and videos --------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN colour IS NULL OR comps < colour THEN NULL WHEN colour = 1 THEN 1 WHEN alpha AND comps > colour THEN 4 ELSE 3 END AS channels FROM (SELECT p_partkey, p_partkey % 2 = 0 AS alpha, p_size % 5 + 1 AS comps, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 4 THEN NULL ELSE CASE WHEN p_partkey % 7 IN (1, 3) THEN p_partkey % 7 END END AS colour FROM part)")
def plane_shapes(spark, d):
    """Channels of decoded planes by colour space; what can't be shown has none."""
    k = F.col("p_partkey")
    return V.table(spark, d, "part").select("p_partkey", T.plane_channels(_pick(("gray", "rgb", "icc", "unknown", "cmyk"), k % 5), k % 7, k % 2 == 0, F.col("p_size") % 5 + 1).alias("channels"))


@query("SELECT vec_id, list_transform(range(0, 64), lambda i: CAST(greatest(0, least((1 << (1 + vec_id % 8)) - 1, round(CAST(embedding[i % 4 * 16 + i // 4 + 1] AS DOUBLE) * 100 + 50))) AS INTEGER)) AS samples FROM embeddings")
def interleaved_planes(spark, d):
    """Planes, four of 16 samples, as pixels; rounded and held within the component's bits."""
    top = F.pow(F.lit(2), 1 + F.col("vec_id") % 8).cast("int") - 1
    planes = V.table(spark, d, "embeddings").select("vec_id", top.alias("top"), F.transform("embedding", lambda v: v.cast("double") * 100 + 50).alias("planes"))
    return planes.select("vec_id", T.interleave(F.col("planes"), 4, 16, F.col("top")).alias("samples"))


@query("SELECT p_partkey, coalesce(nb, CASE WHEN coalesce(packets, CAST(round(duration * fps) AS BIGINT)) > 0 THEN coalesce(packets, CAST(round(duration * fps) AS BIGINT)) END) AS frames FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END AS nb, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size % 4 AS BIGINT) END AS packets, CASE WHEN p_partkey % 5 > 0 THEN p_size * 0.31::DOUBLE END AS duration, 25.0::DOUBLE AS fps FROM part)")
def video_lengths(spark, d):
    """A stated number of frames, else counted packets, else duration times rate; none if that is none."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return V.table(spark, d, "part").select("p_partkey", K.video_frames(F.when(k % 3 == 0, s.cast("long")), F.when(k % 3 == 1, (s % 4).cast("long")), F.when(k % 5 > 0, s * F.lit(0.31)), F.lit(25.0)).alias("frames"))


@query("SELECT vec_id, CAST(pos AS INTEGER) AS pos, CASE WHEN png OR a > 0 THEN r ELSE 255 END AS r, CASE WHEN png THEN a ELSE 255 END AS a FROM (SELECT vec_id, vec_id % 2 = 0 AS png, unnest(range(0, 64)) AS pos, CAST(floor(greatest(0, unnest(embedding)) * 500) AS INTEGER) % 256 AS r, CASE WHEN unnest(embedding) > 0 THEN 200 ELSE 0 END AS a FROM embeddings)")
def saved_pixels(spark, d):
    """A still keeps its alpha in a format that has one; elsewhere what is clear turns white."""
    px = V.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    # both factors are floats, so the product is rounded to one before it is cut off
    r, a = (F.floor(F.greatest(F.col("v"), F.lit(0.0).cast("float")) * F.lit(500.0).cast("float")).cast("int") % 256), F.when(F.col("v") > 0, 200).otherwise(0)
    keeps = F.col("vec_id") % 2 == 0
    return px.select("vec_id", "pos", F.when(keeps, r).otherwise(T.on_white(r, a)).alias("r"), F.when(keeps, a).otherwise(255).alias("a"))


# --- composed output --------------------------------------------------------------------

CELL, CANVAS, OUTPUT = 16, (48.0, 32.0), (36, 24)
COMPOSED_SQL = f"""{FRAMES_SQL}, p AS (SELECT n_regionkey AS plan, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS pane, n_nationkey AS k FROM nation),
    c AS (SELECT *, pane % 3 * 16 AS "left", pane // 3 * 16 AS top, k % 10 AS media_id, 1.5::DOUBLE + k % 3 * 0.5::DOUBLE AS zoom, radians(k * 30.0::DOUBLE) AS a, k % 3 = 0 AS masked, k % 2 = 1 AS pinned FROM p),
    o AS (SELECT unnest(range(0, 36)) AS ox), q AS (SELECT unnest(range(0, 24)) AS oy),
    s AS (SELECT c.*, ox, oy, 4 + ((x - cx) * cos(-a) - (y - cy) * sin(-a)) / zoom AS ix, 4 + ((x - cx) * sin(-a) + (y - cy) * cos(-a)) / zoom AS iy FROM (SELECT c.*, ox, oy, (ox + 0.5::DOUBLE) * 48 / 36 AS x, (oy + 0.5::DOUBLE) * 32 / 24 AS y, "left" + 8 - 0.03::DOUBLE * zoom AS cx, top + 8 + 0.04::DOUBLE * zoom AS cy FROM c, o, q) c WHERE x >= "left" AND x < "left" + 16 AND y >= top AND y < top + 16),
    k AS (SELECT plan, pane, 4 + (dx * cos(-a) - dy * sin(-a)) / zoom AS mx, 4 + (dx * sin(-a) + dy * cos(-a)) / zoom AS my FROM (SELECT plan, pane, a, zoom, x + 0.03::DOUBLE * zoom AS dx, y - 0.04::DOUBLE * zoom AS dy FROM c, (VALUES (-8, -8), (-8, 8), (8, -8), (8, 8)) v(x, y))),
    box AS (SELECT plan, pane, greatest(0, floor(min(mx)) - 1) AS x0, greatest(0, floor(min(my)) - 1) AS y0, least(8, ceil(max(mx)) + 1) AS x1, least(8, ceil(max(my)) + 1) AS y1 FROM k GROUP BY ALL),
    z AS (SELECT c.plan, c.pane, f.media_id, f.frame_idx, min(v) AS lo, max(v) AS hi FROM c JOIN box USING (plan, pane) JOIN (SELECT media_id, frame_idx, unnest(samples) AS v, generate_subscripts(samples, 1) - 1 AS pos FROM f) f ON f.media_id = c.media_id WHERE pos % 8 >= CASE WHEN pinned THEN 2 ELSE x0 END AND pos % 8 < CASE WHEN pinned THEN 6 ELSE x1 END AND pos // 8 >= CASE WHEN pinned THEN 1 ELSE y0 END AND pos // 8 < CASE WHEN pinned THEN 5 ELSE y1 END GROUP BY ALL),
    m AS (SELECT s.plan, f.frame_idx, ox, oy, masked, lo, hi, CASE WHEN ix >= 0 AND iy >= 0 AND ix < 8 AND iy < 8 THEN samples[CAST(floor(iy) * 8 + floor(ix) + 1 AS INTEGER)] END AS v FROM s JOIN z USING (plan, pane) JOIN f ON f.media_id = z.media_id AND f.frame_idx = z.frame_idx),
    g AS (SELECT *, {linear_sql('v', 'lo', 'hi')} AS g FROM m)"""


@query(f"WITH {COMPOSED_SQL} SELECT plan, frame_idx, CAST(ox AS INTEGER) AS ox, CAST(oy AS INTEGER) AS oy, CASE WHEN v IS NULL THEN 24 WHEN masked AND v > 0.2::FLOAT THEN CAST(floor(g * (1 - 128 / 255.0::DOUBLE) + 10 * (128 / 255.0::DOUBLE) + 0.5) AS INTEGER) ELSE g END AS g, CASE WHEN v IS NULL THEN 0 ELSE 255 END AS a FROM g")
def composed_output(spark, d):
    """Turned and zoomed panes of every frame on one canvas, windowed by what a cell shows or by a pinned region."""
    n = V.table(spark, d, "nation").select(F.col("n_regionkey").alias("plan"), F.col("n_nationkey").alias("k"))
    p, k = V.numbered(n, "plan", "k", name="pane"), F.col("k")
    pin = lambda v: F.when(k % 2 == 1, v)
    panes = p.select(
        "plan", "pane", (k % 10).alias("media_id"), (F.col("pane") % 3 * CELL).alias("left"), (F.floor(F.col("pane") / 3) * CELL).alias("top"), F.lit(CELL).alias("cell_w"), F.lit(CELL).alias("cell_h"),
        (1.5 + k % 3 * F.lit(0.5)).alias("zoom"), F.lit(4.03).alias("cx"), F.lit(3.96).alias("cy"), (k * 30.0).alias("degrees"), (k % 3 == 0).alias("masked"), pin(2).alias("pin_x0"), pin(1).alias("pin_y0"), pin(6).alias("pin_x1"), pin(5).alias("pin_y1"),
    )
    frames = V.embedding_frames(spark, d).select("media_id", "frame_idx", "samples")
    return C.compose(frames, panes, CANVAS, OUTPUT, 8, 8, over=0.2)
