"""Queries over rates, operator chains, and files that have changed since they were read."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterlake.functions import tokens as K
from rasterlake.functions import tone as T
from rasterlake.operators import anchors as A
from rasterlake.operators import chain as C
from rasterlake.operators import layout as Y
from rasterlake.operators import packed, scan
from rasterlake.operators import timeline as L
from rasterlake.plans import views as V
from rasterlake.plans.graph import Node
from rasterlake.plans.stage import shared_dir
from rasterlake.queries import FRAMES_SQL, linear_sql, query
from rasterlake.queries_layout import HEADERS_SQL, _headers
from rasterlake.streaming import routing
from rasterlake.streaming.refresh import Refresh


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 3.6e9::DOUBLE AS t, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, event_id, i, t, x, 0.0::DOUBLE AS rate FROM e WHERE i = 1
          UNION ALL SELECT e.user_id, e.event_id, e.i, e.t, e.x, CASE WHEN e.t - r.t > 48 THEN 0 WHEN e.t - r.t > 0 THEN r.rate + ((e.x - r.x) / (e.t - r.t) - r.rate) * least((e.t - r.t) / 24, 1) ELSE r.rate END
          FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, round(rate, 6) AS rate FROM r""")
def smoothed_rates(spark, d):
    """How fast values change an hour, smoothed over a day and started again after two."""
    events = V.table(spark, d, "events").withColumn("hours", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9))
    return scan.smoothed_rate(events, "user_id", "hours", "event_id", "value", 24, 48).select("user_id", "event_id", F.round("rate", 6).alias("rate"))


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT media_id, frame_idx, list_transform(samples, lambda x: floor(32768 + CAST(x AS DOUBLE) * 32768)) AS s FROM f), b AS (SELECT *, list_min(s) AS lo, list_max(s) AS hi FROM s),
    t AS (SELECT media_id, frame_idx, CASE WHEN hi > lo THEN list_transform(s, lambda v: floor((v - lo) * 65535 / (hi - lo))) ELSE s END AS s FROM b),
    o AS (SELECT media_id, frame_idx, list_transform(s, lambda v, i: least(65535, v + floor(v / 256) * (abs(2 * ((i - 1) % 8) + 1 - 8) + abs(2 * ((i - 1) // 8) + 1 - 8)))) AS s FROM t)
    SELECT media_id, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(list_min(s) AS FLOAT) AS lo, CAST(list_max(s) AS FLOAT) AS hi, list_sum(list_transform(s, lambda v, i: v * i)) AS weighed, 'denoise' AS absent FROM o""")
def operator_chain(spark, d):
    """Stretched, passed by an operator that isn't there, then lifted with the 8-bit companion."""
    frames = V.embedding_frames(spark, d).withColumns({"samples": F.transform("samples", lambda x: F.floor(32768 + x.cast("double") * 32768).cast("float")), "dtype": F.lit("uint16")})
    made = C.apply_chain(frames, (C.Step("lut_alpha", C.LutAlpha), C.Step("denoise", None), C.Step("details", C.EdgeLift, companion=True)))
    weighed = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.select("media_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.array_min("samples").alias("lo"), F.array_max("samples").alias("hi"), weighed.alias("weighed"), F.array_join("absent", ",").alias("absent"))


#: By file: every sixth as it was (a third of those with one pointer changed), widened, grown, cut, moved, or (half) gone.
NEW_SQL = f"""{HEADERS_SQL}, m AS (SELECT *, max(page) OVER (PARTITION BY file) AS last_page FROM h),
    now AS (SELECT file, page, CASE WHEN file % 6 = 4 THEN off + 8 ELSE off END AS off, CASE WHEN file % 6 = 1 AND page = 2 THEN w + 1 ELSE w END AS w, h, strips,
                 CASE WHEN file % 18 = 0 AND page = 1 THEN next + 4 WHEN file % 6 = 2 AND page = last_page THEN off + 1000 WHEN file % 6 = 3 AND page = last_page - 1 THEN 0 WHEN file % 6 = 4 AND next <> 0 THEN next + 8 ELSE next END AS next
          FROM m WHERE NOT (file % 6 = 3 AND page = last_page AND page > 0) AND file % 12 <> 5
          UNION ALL SELECT file, page + 1, off + 1000, w, h, strips, 0 FROM m WHERE file % 6 = 2 AND page = last_page)"""


def _rewritten(spark, d):
    """The headers as they were, and as they are now."""
    old = _headers(spark, d)
    m = old.withColumn("last_page", F.max("page").over(Window.partitionBy("file")))
    kind, last = F.col("file") % 6, F.col("page") == F.col("last_page")
    following = (
        F.when((F.col("file") % 18 == 0) & (F.col("page") == 1), F.col("next") + 4)
        .when((kind == 2) & last, F.col("off") + 1000)
        .when((kind == 3) & (F.col("page") == F.col("last_page") - 1), 0)
        .when((kind == 4) & (F.col("next") != 0), F.col("next") + 8)
        .otherwise(F.col("next"))
    )
    kept = m.filter(~((kind == 3) & last & (F.col("page") > 0)) & (F.col("file") % 12 != 5))
    changed = kept.select("file", "page", (F.col("off") + F.when(kind == 4, 8).otherwise(0)).alias("off"), following.alias("next"), (F.col("w") + F.when((kind == 1) & (F.col("page") == 2), 1).otherwise(0)).alias("w"), "h", "strips")
    added = m.filter((kind == 2) & last).select("file", (F.col("page") + 1).alias("page"), (F.col("off") + 1000).alias("off"), F.lit(0).cast("long").alias("next"), "w", "h", "strips")
    return old, changed.unionByName(added)


def _facts(headers):
    return headers.groupBy("file").agg(F.min("off").alias("first"), (F.max("off") + 1000).alias("length"))


@query(f"""WITH {NEW_SQL}, f AS (SELECT file, min(off) AS first, max(off) + 1000 AS length FROM h GROUP BY file), g AS (SELECT file, min(off) AS first, max(off) + 1000 AS length FROM now GROUP BY file),
    a AS (SELECT *, lag(off) OVER (PARTITION BY file ORDER BY page) AS prev FROM h)
    SELECT a.file, a.page, a.off, CASE WHEN g.first IS NULL THEN 'gone' WHEN f.first <> g.first THEN 'first page moved' WHEN f.length <> g.length THEN 'length changed'
        WHEN n.off IS NULL OR (a.next, a.w, a.h, a.strips) IS DISTINCT FROM (n.next, n.w, n.h, n.strips) THEN 'header changed'
        WHEN CASE WHEN a.prev IS NULL THEN a.off <> g.first ELSE coalesce(p.next <> a.off, true) END THEN 'chain changed' END AS reason
    FROM a JOIN f USING (file) LEFT JOIN g USING (file) LEFT JOIN now n ON n.file = a.file AND n.off = a.off LEFT JOIN now p ON p.file = a.file AND p.off = a.prev""")
def anchors_held(spark, d):
    """Which pages of files read again are still where and what they were, and why not."""
    old, new = _rewritten(spark, d)
    return A.still_anchored(A.anchors(old), _facts(old), new, _facts(new))


@query(f"""WITH {NEW_SQL}, p AS (SELECT coalesce(h.file, n.file) AS file, coalesce(h.page, n.page) AS page, h.page IS NOT NULL AS was, n.page IS NOT NULL AS there,
        coalesce(h.off = n.off AND h.w = n.w AND h.h = n.h AND h.strips = n.strips AND (h.next = n.next OR h.next = 0 OR n.next = 0), false) AS stays FROM h FULL JOIN now n ON h.file = n.file AND h.page = n.page),
    c AS (SELECT file, count(*) FILTER (WHERE was) AS before, count(*) FILTER (WHERE there) AS pages, coalesce(min(page) FILTER (WHERE NOT stays), count(*)) AS kept FROM p GROUP BY file)
    SELECT file, CASE WHEN before = 0 THEN 'new' WHEN pages = 0 THEN 'gone' WHEN kept < least(before, pages) THEN 'rewritten' WHEN pages > before THEN 'grown' WHEN pages < before THEN 'cut' ELSE 'same' END AS change, pages, kept FROM c""")
def layout_changes(spark, d):
    """I13, ST18: what became of each file since its headers were kept."""
    return A.changes(*_rewritten(spark, d))


@query(f"""WITH {HEADERS_SQL}, s AS (SELECT *, lead(off) OVER (PARTITION BY file ORDER BY page) - off AS step FROM h), c AS (SELECT file, count(*) AS pages, count(*) = 1 OR coalesce(min(step) = max(step) AND min(step) > 0, false) AS regular FROM s GROUP BY file),
    g AS (SELECT file // 5 AS grp, file, pages, NOT regular AS failed, min(CASE WHEN NOT regular THEN file END) OVER (PARTITION BY file // 5) AS stop FROM c)
    SELECT grp AS "group", count(*) AS files, count(*) FILTER (WHERE failed) AS failed, CASE WHEN bool_or(failed) THEN -1 ELSE CAST(sum(pages) AS BIGINT) END AS pages, CAST(coalesce(sum(pages) FILTER (WHERE stop IS NULL OR file < stop), 0) AS BIGINT) AS usable FROM g GROUP BY grp""")
def group_page_counts(spark, d):
    """All or nothing for a run of files, failures on their own, and what is usable before the first."""
    counts = Y.strides(_headers(spark, d), "file", "page", "off")
    files = counts.select(F.floor(F.col("file") / 5).alias("group"), F.col("file").alias("place"), "file", "pages", F.when((F.col("pages") > 1) & ~F.col("regular"), "no stride").alias("error"))
    return A.group_counts(files).fillna(-1, ["pages"])


#: Nodes over the media 0, 1 and 2: a mean, what differs from it, and a sum with the third.
NODES = {10: Node("mean", 0), 11: Node("sub", 1, 10), 12: Node("add", 2, 11), 13: Node("mean", 12)}


@query(f"""WITH {FRAMES_SQL}, px AS (SELECT media_id, CAST(frame_idx AS INTEGER) AS frame_idx, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS v FROM (SELECT media_id, frame_idx, unnest(samples) AS v, generate_subscripts(samples, 1) AS i FROM f WHERE media_id < 3)),
    i AS (SELECT media_id, frame_idx, y, x, CAST(CASE WHEN media_id = 2 AND frame_idx % 10 = 0 THEN floor(v * 64) + 1 ELSE floor(v * 64) END AS FLOAT) AS v FROM px),
    mean AS (SELECT y, x, CAST(sum(CAST(v AS DOUBLE)) / count(*) AS FLOAT) AS v FROM i WHERE media_id = 0 GROUP BY y, x),
    sub AS (SELECT frame_idx, y, x, CAST(i.v - mean.v AS FLOAT) AS v FROM i JOIN mean USING (y, x) WHERE media_id = 1),
    total AS (SELECT frame_idx, y, x, CAST(i.v + sub.v AS FLOAT) AS v FROM i JOIN sub USING (frame_idx, y, x) WHERE media_id = 2),
    r AS (SELECT 10 AS node, false AS again, 0 AS frame_idx, y, x, v FROM mean UNION ALL SELECT 11, false, frame_idx, y, x, v FROM sub UNION ALL SELECT 12, true, frame_idx, y, x, v FROM total
          UNION ALL SELECT 13, true, 0, y, x, CAST(sum(CAST(v AS DOUBLE)) / count(*) AS FLOAT) FROM total GROUP BY y, x)
    SELECT node, again, frame_idx, y, x, round(CAST(v AS DOUBLE), 3) AS v FROM r""")
def refreshed_nodes(spark, d):
    """ST15, F50, K12, K22: after frames of one media change, only what depends on it is computed again."""
    px = V.embedding_px(spark, d).filter("media_id < 3").select(F.col("media_id").alias("input"), F.col("frame_idx").cast("int").alias("frame_idx"), "y", "x", F.floor(F.col("v").cast("double") * 64).cast("float").alias("v"))
    refresh = Refresh(NODES, f"{shared_dir(spark).rstrip('/')}/refresh/{uuid.uuid4().hex}")
    refresh(px, 0)
    refresh(px.filter("input = 2 AND frame_idx % 10 = 0").withColumn("v", (F.col("v") + 1).cast("float")), 1)
    return refresh.results(spark).select("node", F.col("recomputed").alias("again"), "frame_idx", "y", "x", F.round(F.col("v").cast("double"), 3).alias("v"))


@query("""WITH e AS (SELECT user_id AS media_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    broken AS (SELECT media_id, min(i) AS stop FROM e WHERE event_id % 101 = 0 GROUP BY media_id)
    SELECT media_id, min(least(coalesce(stop, n), n)) AS length, min(CASE WHEN stop IS NULL THEN (n + 24) // 25 ELSE stop // 25 END) AS files_ended FROM e LEFT JOIN broken USING (media_id) GROUP BY media_id""")
def routed_probes(spark, d):
    """ST07, ST08, ST09, J11: probes in any order over files of 25 pages; an error holds a media's timeline where it is."""
    events = V.event_timeline(spark, d)
    count = events.groupBy("media_id").agg(F.count("*").alias("n"))
    of, at = F.floor(F.col("frame_idx") / 25).cast("int"), (F.col("frame_idx") % 25).cast("int")
    pages = events.join(count, "media_id").withColumns({"files": F.ceil(F.col("n") / 25).cast("int"), "file": of, "page": at})
    kind = F.when(F.col("event_id") % 101 == 0, "error").when(F.col("event_id") % 2 == 0, "frame").otherwise("exists")
    probes = pages.select("media_id", F.pmod(F.xxhash64("event_id"), F.lit(1 << 40)).alias("probe"), "file", "page", kind.alias("kind"), "files")
    last = pages.groupBy("media_id", "file", "files").agg((F.max("page") + 1).alias("page"))
    ends = last.select("media_id", F.pmod(F.xxhash64("media_id", "file"), F.lit(1 << 40)).alias("probe"), "file", "page", F.lit("end").alias("kind"), "files")
    known = routing.summary(routing.settled(probes.unionByName(ends)))
    return count.select("media_id").join(known, "media_id", "left").fillna(0)


_TURBO = ", ".join(str(r << 16 | g << 8 | b) for r, g, b in T.palette("turbo"))
#: A packed colour as (alpha, blue, green, red) from red, green, blue of 24 bits.
_ABGR = "(4278190080 + (c % 256) * 65536 + (c // 256 % 256) * 256 + c // 65536)"


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT media_id, frame_idx, list_transform(samples, lambda x: floor(32768 + CAST(x AS DOUBLE) * 32768)) AS s FROM f), b AS (SELECT *, list_min(s) AS lo, list_max(s) AS hi FROM s),
    t AS (SELECT media_id, frame_idx, unnest(CASE WHEN hi > lo THEN list_transform(s, lambda v: floor((v - lo) * 65535 / (hi - lo))) ELSE s END) AS v, unnest(range(0, 64)) AS pos FROM b),
    p AS (SELECT *, media_id % 2 = 1 AS coloured, CAST(floor(v / 256) AS INTEGER) AS g FROM t)
    SELECT media_id, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(pos AS INTEGER) AS pos, CASE WHEN coloured THEN {_ABGR} ELSE 4278190080 + g * 65793 END AS abgr
    FROM (SELECT *, CAST(list_extract([{_TURBO}], g + 1) AS BIGINT) AS c FROM p)""")
def rendered_chain(spark, d):
    """What the operators leave, to 8 bits, through a palette where the media has one, else grey; packed as alpha, blue, green, red."""
    frames = V.embedding_frames(spark, d).withColumns({"samples": F.transform("samples", lambda x: F.floor(32768 + x.cast("double") * 32768).cast("float")), "dtype": F.lit("uint16")})
    made = C.apply_chain(frames).select("media_id", F.col("frame_idx").cast("int").alias("frame_idx"), F.posexplode("samples").alias("pos", "v"))
    grey = F.floor(F.col("v") / 256).cast("int")
    colour = F.when(F.col("media_id") % 2 == 1, T.palette_column("turbo", grey)).otherwise(grey * 0x10101)
    return made.select("media_id", "frame_idx", "pos", T.packed_abgr(colour).alias("abgr"))


@query(f"""WITH {FRAMES_SQL}, b AS (SELECT *, list_min(samples) AS lo, list_max(samples) AS hi FROM f), p AS (SELECT media_id, frame_idx, lo, hi, unnest(samples) AS v, unnest(range(0, 64)) AS pos FROM b),
    k AS (SELECT *, pos % 8 AS x, pos // 8 AS y FROM p WHERE pos % 8 % 3 = 0 AND pos // 8 % 3 = 0)
    SELECT media_id, CAST(frame_idx AS INTEGER) AS frame_idx, 3 AS w, 3 AS h, string_agg(CAST({linear_sql('v', 'lo', 'hi')} AS VARCHAR), ',' ORDER BY pos) AS grey FROM k GROUP BY media_id, frame_idx""")
def thumbnails(spark, d):
    """Frames at most three samples wide and high, every n-th sample kept, in the whole frame's window."""
    frames = packed.with_extent(V.embedding_frames(spark, d))
    return packed.thumbnails(frames, 8, 8, 3).select("media_id", F.col("frame_idx").cast("int").alias("frame_idx"), "w", "h", F.array_join("grey", ",").alias("grey"))


#: Lists of settings for the panes of a customer's view.
LISTS_SQL = """l AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'linear, LutAlpha,colormap' WHEN 1 THEN 'Colormap:diff,clip' WHEN 2 THEN 'linear,odd' WHEN 3 THEN 'colormap:none' WHEN 4 THEN 'lut_alpha' ELSE '' END AS tones,
        CASE c_custkey % 5 WHEN 0 THEN 'off,' || c_custkey % 7 WHEN 1 THEN '0.5, None ,2' WHEN 2 THEN 'x' ELSE c_custkey % 11 || '.25' END AS clips, c_custkey % 90 || ', -' || c_custkey % 13 || '.5' || CASE WHEN c_custkey % 4 = 0 THEN ',1e1' WHEN c_custkey % 4 = 1 THEN ',?' ELSE '' END AS rotations,
        CASE c_custkey % 3 WHEN 0 THEN '1,0, on' WHEN 1 THEN 'true' ELSE 'no,off' END AS shown FROM customer)"""


def _lists(spark, d):
    k = F.col("c_custkey")
    pick = lambda n, *texts: F.element_at(F.array(*(t if hasattr(t, "cast") else F.lit(t) for t in texts)), (k % n + 1).cast("int"))
    return V.table(spark, d, "customer").select(
        k.alias("k"),
        pick(6, "linear, LutAlpha,colormap", "Colormap:diff,clip", "linear,odd", "colormap:none", "lut_alpha", "").alias("tones"),
        pick(5, F.concat(F.lit("off,"), k % 7), "0.5, None ,2", "x", F.concat(k % 11, F.lit(".25")), F.concat(k % 11, F.lit(".25"))).alias("clips"),
        F.concat(k % 90, F.lit(", -"), k % 13, F.lit(".5"), F.when(k % 4 == 0, ",1e1").when(k % 4 == 1, ",?").otherwise("")).alias("rotations"),
        pick(3, "1,0, on", "true", "no,off").alias("shown"),
    )


@query(f"""WITH {LISTS_SQL}, i AS (SELECT k, list_transform(string_split(tones, ','), lambda x: CASE WHEN lower(trim(x)) IN ('linear', 'linearclip', 'clip') THEN 'linear' WHEN lower(trim(x)) IN ('lutalpha', 'lut_alpha') THEN 'lut_alpha' WHEN lower(trim(x)) = 'colormap' THEN 'colormap:turbo'
        WHEN lower(trim(x)) IN ('colormap:diff', 'colormap:bwr', 'colormap:diverging') THEN 'colormap:diverging' WHEN lower(trim(x)) IN ('colormap:turbo', 'colormap:viridis') THEN lower(trim(x)) END) AS t,
        list_transform(string_split(clips, ','), lambda x: CASE WHEN lower(trim(x)) IN ('off', 'none') THEN -1 ELSE TRY_CAST(trim(x) AS FLOAT) END) AS c, list_transform(string_split(rotations, ','), lambda x: TRY_CAST(trim(x) AS DOUBLE)) AS r, list_transform(string_split(shown, ','), lambda x: trim(x) IN ('1', 'true', 'on')) AS s FROM l),
    w AS (SELECT k, CASE WHEN len(list_filter(t, lambda x: x IS NULL)) = 0 THEN t END AS t, CASE WHEN len(list_filter(c, lambda x: x IS NULL)) = 0 THEN c END AS c, CASE WHEN len(list_filter(r, lambda x: x IS NULL)) = 0 THEN r END AS r, s FROM i)
    SELECT k, CAST(p AS INTEGER) AS pane, coalesce(t[p + 1], 'linear') AS tone, round(CAST(coalesce(c[p + 1], 0.01) AS DOUBLE), 4) AS clip, coalesce(r[p + 1], 0) AS rotation, coalesce(s[p + 1], true) AS shown, r IS NOT NULL AND len(r) = 2 AS paired FROM w, (SELECT unnest(range(0, 3)) AS p)""")
def applied_lists(spark, d):
    """Lists of settings onto the three panes of each view; a list with a bad item counts for nothing."""
    parsed = _lists(spark, d).select("k", K.tone_list(F.col("tones"), T.ALIASES, "turbo").alias("tones"), K.clip_list(F.col("clips")).alias("clips"), K.number_list(F.col("rotations")).alias("rotations"), K.number_list(F.col("rotations"), 2).isNotNull().alias("paired"), K.flag_list(F.col("shown")).alias("flags"))
    panes = parsed.withColumn("pane", F.explode(F.array(*map(F.lit, range(3))))).withColumns({"tone": F.lit("linear"), "clip": F.lit(0.01).cast("float"), "rotation": F.lit(0.0), "shown": F.lit(True)})
    lists = {"tone": F.col("tones"), "clip": F.col("clips"), "rotation": F.col("rotations"), "shown": F.col("flags")}
    return L.onto_panes(panes, "k", "pane", lists).select("k", "pane", "tone", F.round(F.col("clip").cast("double"), 4).alias("clip"), "rotation", "shown", "paired")


@query("""WITH RECURSIVE n AS (SELECT user_id AS media_id, count(*) AS n FROM events GROUP BY 1), w AS (SELECT media_id, n, 2::BIGINT AS lo, n - 1 AS hi, 1 + media_id % 4 AS ff, media_id % 3 > 0 AS loops FROM n),
    p AS (SELECT media_id, 0::BIGINT AS tick, lo AS frame FROM w
          UNION ALL SELECT p.media_id, tick + 1, CASE WHEN hi <= lo THEN lo WHEN frame + ff <= hi THEN frame + ff WHEN frame < hi THEN hi WHEN loops THEN lo ELSE frame END FROM p JOIN w USING (media_id) WHERE tick + 1 < n)
    SELECT media_id, tick, frame FROM p""")
def played_frames(spark, d):
    """ST10, W14, O10, O11: the frame after each tick of a window from 2 on, in strides of one to four, some again and again."""
    e = V.event_timeline(spark, d).select("media_id", F.col("frame_idx").alias("tick"), F.count("*").over(Window.partitionBy("media_id")).alias("n"))
    frame = L.played(F.col("tick"), F.lit(2), F.col("n") - 1, 1 + F.col("media_id") % 4, F.col("media_id") % 3 > 0)
    return e.select("media_id", "tick", frame.alias("frame"))


@query("WITH e AS (SELECT user_id AS media_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) SELECT media_id, event_id, row_number() OVER (ORDER BY k, media_id) - 1 AS turn FROM e")
def interleaved_turns(spark, d):
    """Every media's first event, then every media's second, and so on."""
    return L.interleaved(V.event_timeline(spark, d), "media_id", "frame_idx").select("media_id", "event_id", "turn")
