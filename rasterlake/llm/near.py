"""N-gram Jaccard join: a blocked sparse product of documents by n-grams.

Documents are rows and shingles columns of a sparse incidence matrix. Documents
with the same set are one row. The columns are ordered by a corpus-wide count
(rare first), which makes a block of each row, its first ``n - ceil(0.85 n) + 1``
columns, that two linked rows can't both miss. The product over that block finds
the pairs. Pairs whose sizes can't reach the bound are discarded, first by the sizes
of the rows, then by their sizes in each of ``COLUMN_BLOCKS`` blocks of columns:
an overlap is at most the sum of the smaller ones. What remains is multiplied in
``PRODUCT_BLOCKS`` blocks of columns, so no row is ever whole in one place, and the
overlaps of the blocks are added up and held against the bound.

All pairs of a column are never emitted. A first product takes each column
against one of its rows (its pivot, which differs between columns), linear in
the block. Links found there join most of a group of near copies. A second one
takes what is still apart in a column, the rows outside its largest component,
against the rows of other components, so no link between components is missed.

Two rows meet in a column only if it may be the first that they share: they then have no more
in common than what stands from there on, so a column's place in a row bounds the sizes of
the rows that it may be linked to (its reach). A column in which no two rows meet is left out. One with
more than ``CROWD`` rows outside loses those that meet none, and is compared directly too if few of the rest meet.

Where more than ``CROWD`` rows are outside and many meet, as among copies with many edits, the rows
are told apart by their differences from what most of them have in common. Let C be the
columns of more than half of a list's rows, D(x) the columns in which x differs from C,
and d their number. x and y are linked if D(x) and D(y) differ in at most
H = (100 - p)(|x| + |y|) / (100 + p) columns. Call (100 - p)|x| - (100 + p) d(x) the slack
of x. Two rows whose slacks add up to 0 or more are linked whatever they share, so it is
enough to link each with the row of most slack. All others share at least
(d(x) + d(y) - H) / 2 differences, and one at least. That is the same join again, on
differences: a short prefix of the one with fewer of them meets a longer prefix of the
other. A difference whose rows are of one component already links nothing and only fills
places of the prefix. Before that, a row goes whose numbers of differences, alone and
shared, are too far from those of every row of another component; what is then alone lets
more go. A list of rows with a common difference that is still crowded is
told apart in the same way by what most of its rows have in common, without the differences
that come before: two rows meet by the first that they share, and differ in those before it.
It has at most half of the rows, or the difference would be none, so this ends.

Row order needs only be the same everywhere, so the counts may be rough: they
come from a table of ``2 ** SKETCH_BITS`` buckets over all documents, summed by
Spark, and broadcast as one byte a bucket (2 MB whatever the input). A column whose
bucket holds ``HOT`` times the mean or more takes no window over its rows: its pivot
is a partial aggregate, joined back.

Defined cases: a document without words (null, empty, blank) has no shingles and
is its own component; one of fewer than four words has one shingle, the whole;
equal rows are linked if they have words; a very long text is read in blocks of
whole words and has as many shingles as it has; a null id takes part, and is the
component's id only where it has no other; an empty table gives an empty result;
other columns are not read. Sets are told apart by 64-bit sums of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm import words as W
from rasterlake.llm.shared import signed, small, staged, text_only

NGRAM = 4
PERCENT = 85
SKETCH_BITS = 21
#: Blocks of columns whose sizes bound an overlap, and coarser ones in which overlaps are counted.
COLUMN_BLOCKS, PRODUCT_BLOCKS = 256, 8
SKETCH_PARTS = 64
#: Text that a Python worker takes apart at once; its arrays are some fifty times as large.
READ_BYTES = 1 << 18
PIVOT_KINDS = 4
#: A bucket of so many times the mean and so many rows is that of a hot column.
HOT, HOT_ROWS = 16, 1000
#: Rows outside a column's largest component that are still compared directly, and rows of short prefixes in a list of differences.
CROWD, FIRSTS = 32, 4
#: Up to so many times CROWD rows are compared directly if no more than CROWD times their number of pairs may meet.
WIDE = 8
#: Comparisons, in all or for each row, that lists of differences may cost before they are told apart further.
COMPARED, COMPARED_PER_ROW = 20_000, 4
#: So few links are joined in one task; more take the distributed rounds.
LOCAL_LINKS = 10_000
#: What a list has in common meets its rows in so many parts.
SALTS = 16


def _grams(data: np.ndarray, offsets: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds of each row's in them); short rows have one, of all their words."""
    starts, ends, rows = W.spans(data, offsets, W.NOT_SPACE)
    hashes = W.hash_spans(data, starts, ends)
    grams, at = W.gram_hashes(hashes, rows, ngram)
    owner = rows[at]
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    for n in range(1, ngram):
        short = np.flatnonzero(n_words == n)
        if len(short):
            whole, first = W.gram_hashes(hashes, rows, n)
            mine = np.isin(rows[first], short)
            grams, owner = np.append(grams, whole[mine]), np.append(owner, rows[first][mine])
    order = np.argsort(owner, kind="stable")
    return grams[order], np.searchsorted(owner[order], np.arange(len(offsets)))


def _sketch(ngram: int, bits: int, parts: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.int64)
        for _, data, offsets in W.batches(rows, limit=READ_BYTES):
            grams, _ = _grams(data, offsets, ngram)
            counts += np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([p.tobytes() for p in np.split(np.minimum(counts, 2**16 - 1).astype("<u2"), parts)])], names=["part", "counts"])

    return run


def _add_sketches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in rows:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(raw, "<u2").astype(np.uint64)
            total[part] = total[part] + counts if part in total else counts
    levels = {p: np.log2(c.astype(np.float64) + 1) * 4 for p, c in total.items()}
    yield pa.RecordBatch.from_arrays([pa.array(list(levels), pa.int32()), pa.array([v.astype(np.uint8).tobytes() for v in levels.values()], pa.binary())], names=["part", "levels"])


def rarity_levels(docs: DataFrame, ngram: int = NGRAM, bits: int = SKETCH_BITS, parts: int = SKETCH_PARTS) -> np.ndarray:
    """Quarter powers of two of each bucket's count over all documents; one byte a bucket comes to the driver."""
    made = docs.select("text").mapInArrow(_sketch(ngram, bits, parts), "part int, counts binary").repartition("part").mapInArrow(_add_sketches, "part int, levels binary")
    found = {r["part"]: np.frombuffer(r["levels"], np.uint8) for r in made.collect()}
    return np.concatenate([found[p] for p in range(parts)]) if found else np.zeros(1 << bits, np.uint8)


def _identity(grams: np.ndarray) -> int:
    return int(W.mix(grams).sum())


def _prefixes(levels: Broadcast, ngram: int, bits: int, percent: int):
    """Each row's size, name, sizes by block, and its first columns, the hot ones apart."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, shift = levels.value, np.uint64(64 - bits)
        hot = max(4 * np.log2(1 + HOT * np.mean(2.0 ** (level / 4) - 1)), 4 * np.log2(1 + HOT_ROWS))
        for batch, data, offsets in W.batches(rows, limit=READ_BYTES):
            grams, bounds = _grams(data, offsets, ngram)
            sizes, nodes, profiles, prefixes, crowded = [], [], [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = np.unique(grams[a:b])
                n = len(own)
                of = level[(own >> shift).astype(np.int64)]
                rare = np.argsort(of, kind="stable")[: n - -(-percent * n // 100) + 1 if n else 0]
                sizes.append(n)
                nodes.append(_identity(own))
                profiles.append(np.bincount((own & np.uint64(COLUMN_BLOCKS - 1)).astype(np.int64), minlength=COLUMN_BLOCKS))
                prefixes.append(own[rare[of[rare] < hot]].view(np.int64))
                crowded.append(own[rare[of[rare] >= hot]].view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), signed(np.array(nodes, np.uint64)), pa.array(profiles, pa.list_(pa.int32())), pa.array(prefixes, longs), pa.array(crowded, longs)],
                names=["doc_id", "text_key", "n", "node", "profile", "prefix", "hot"],
            )

    return run


def _blocks(ngram: int):
    """The columns of each row in every block of columns, empty blocks too."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.batches(rows, limit=READ_BYTES):
            grams, bounds = _grams(data, offsets, ngram)
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = np.unique(grams[a:b])
                block = own & np.uint64(PRODUCT_BLOCKS - 1)
                out += [own[block == k].view(np.int64) for k in range(PRODUCT_BLOCKS)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), PRODUCT_BLOCKS))
            block = pa.array(np.tile(np.arange(PRODUCT_BLOCKS, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(at), block, pa.array(out, pa.list_(pa.int64()))], names=["node", "block", "grams"])

    return run


def _fits(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _reaches(overlap, total, percent: int):
    return 100 * overlap >= percent * (total - overlap)


def _may_differ(total, percent: int):
    """Columns in which two linked rows of that total size differ at most."""
    return F.floor((100 - percent) * total / (100 + percent))


def _of_pairs(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) with both nodes' ``name`` as ``a_name`` and ``b_name``."""
    for c in "ab":
        pairs = pairs.join(values.select(F.col("node").alias(c), F.col(name).alias(f"{c}_{name}")), c)
    return pairs


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _reach(percent: int):
    """The size up to which a row of ``n`` columns may be linked to rows whose first column in common with it is its ``pos``-th, from 0.

    They have at most the ``n - pos`` columns from there on in common.
    """
    return F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent).cast("long") - F.col("n")


def _meet(a: str, b: str):
    """Whether two rows' sizes are within each other's reach."""
    return (F.col(f"{a}n") <= F.col(f"{b}reach")) & (F.col(f"{b}n") <= F.col(f"{a}reach"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sets_of(wanted: DataFrame, rows: int, nodes: DataFrame, texts: DataFrame, ngram: int) -> DataFrame:
    """(node, block, grams) of the wanted nodes, from the text of one document of each."""
    of = small(nodes.join(wanted, "node").select("node", "first.*"), rows)
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key"))
    one = texts.alias("d").join(of.alias("s"), same).select("node", "text")
    return staged(one.mapInArrow(_blocks(ngram), "node long, block int, grams array<long>"), "sets").dropDuplicates(["node", "block"])


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs (a, b) of at least the similarity: bounded by column blocks, then counted block by block."""
    profiles = nodes.join(small(_ends(pairs), 2 * pairs.count()), "node")
    bound = F.aggregate(F.zip_with("a_profile", "b_profile", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    total = F.aggregate("a_profile", F.lit(0), lambda x, y: x + y) + F.aggregate("b_profile", F.lit(0), lambda x, y: x + y)
    bounded = _of_pairs(pairs, profiles, "profile").select("a", "b", bound.alias("bound"), total.alias("total"))
    possible = staged(bounded.filter(_reaches(F.col("bound"), F.col("total"), percent)).select("a", "b", "total"), "pairs")
    n = possible.count()
    sets = _sets_of(_ends(possible), 2 * n, nodes, texts, ngram)
    left, right = (sets.select(F.col("node").alias(c), "block", F.col("grams").alias(f"{c}_grams")) for c in "ab")
    product = left.join(small(possible, n), "a").join(right, ["b", "block"]).select("a", "b", "total", F.size(F.array_intersect("a_grams", "b_grams")).alias("overlap"))
    counted = product.groupBy("a", "b", "total").agg(F.sum("overlap").alias("overlap"))
    return staged(counted.filter(_reaches(F.col("overlap"), F.col("total"), percent)).select("a", "b"), "links")


def _apart(rows: DataFrame, by: list[str], columns: str) -> DataFrame:
    """Rows (list, node, ...) with their array of columns replaced by ``differ``, where it isn't what over half of the list have.

    ``by`` names the list, and the block of columns if they come in blocks.
    """
    half = rows.groupBy("list").agg(F.count_distinct("node").alias("rows")) if "block" in by else rows.groupBy("list").agg(F.count("*").alias("rows"))
    counts = rows.select(*by, F.explode(columns).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n_have"))
    common = counts.join(half, "list").filter("2 * n_have > rows").groupBy(*by).agg(F.collect_list("token").alias("common"))
    # a large list is many tasks' work
    salted = common.withColumn("salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))))
    both = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(salted, [*by, "salt"], "left")
    shared = F.coalesce("common", F.array().cast("array<long>"))
    return both.withColumn("differ", F.concat(F.array_except(shared, columns), F.array_except(columns, shared))).drop("salt", "common")


def _differences(members: DataFrame, nodes: DataFrame, texts: DataFrame, ngram: int) -> DataFrame:
    """(list, node, n, alone, differ) of members (list, node)."""
    sets = _sets_of(members.select("node").distinct(), members.count(), nodes, texts, ngram)
    parts = _apart(members.join(sets, "node"), ["list", "block"], "grams")
    whole = parts.groupBy("list", "node").agg(F.sum(F.size("grams")).alias("n"), F.flatten(F.collect_list("differ")).alias("differ"))
    return staged(whole.select("list", "node", "n", F.lit(0).alias("alone"), "differ"), "differences")


def _slack(n, d, percent: int):
    return (100 - percent) * n - (100 + percent) * d


def _to_hub(differing: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each list's rows to the one of most slack, where the two slacks suffice and components differ."""
    rows = differing.select("list", "node", _slack(F.col("n"), F.col("alone") + F.size("differ"), percent).alias("slack"))
    hubs = rows.groupBy("list").agg(F.max(F.struct("slack", "node")).alias("hub")).select("list", F.col("hub.slack").alias("most"), F.col("hub.node").alias("hub"))
    near = rows.join(hubs, "list").filter("node <> hub AND slack + most >= 0").select(F.col("node").alias("x"), F.col("hub").alias("y"))
    return _across(_ordered(near), found)


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose components differ."""
    for c in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")), c, "left")
    return pairs.filter(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b")


def _placed_in(differing: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(list, node, n, d, slack, component, differ) of rows of lists, nodes without a link being their own component."""
    d = F.col("alone") + F.size("differ")
    of = differing.select("list", "node", "n", d.alias("d"), _slack(F.col("n"), d, percent).alias("slack"), "differ").join(found, "node", "left")
    return of.withColumn("component", F.coalesce("component", "node"))


def _may_link(rows: DataFrame, percent: int) -> DataFrame:
    """Those rows (list, node, n, d, slack, component, shared) that the numbers of differences leave a row to be linked to.

    x and y differ in what each of them has alone, and in |s(x) - s(y)| of what they have in ``shared`` at
    least. For each s one row a list is compared: its most slack, of all and of those outside the component of the hub.
    """
    weight = 100 + percent
    s = F.size("shared")
    of = rows.withColumns({"s": s, "room_left": F.col("slack") + weight * s})
    hubs = of.groupBy("list").agg(F.max(F.struct("slack", "component")).alias("hub")).select("list", F.col("hub.component").alias("main"))
    of = of.join(hubs, "list")
    steps = of.groupBy("list", "s").agg(F.max("room_left").alias("most"), F.max(F.when(F.col("component") != F.col("main"), F.col("room_left"))).alias("most_out"))
    up, down = Window.partitionBy("list").orderBy("s"), Window.partitionBy("list").orderBy(F.desc("s"))
    reach = lambda c: F.greatest(F.max(F.col(c) + weight * F.col("s")).over(up) - weight * F.col("s"), F.max(F.col(c) - weight * F.col("s")).over(down) + weight * F.col("s"))
    steps = steps.select("list", "s", reach("most").alias("any"), reach("most_out").alias("out"))
    best = F.when(F.col("component") == F.col("main"), F.col("out")).otherwise(F.col("any"))
    return of.join(steps, ["list", "s"]).filter(F.col("room_left") + best >= 0).select(rows.columns)


def _shared(of: DataFrame) -> DataFrame:
    """Rows (list, node, n, d, slack, component, differ) with the differences that a row of another component has, as ``shared``, sorted by their rows."""
    each = of.select("list", "node", "n", "d", "slack", "component", F.explode("differ").alias("token"))
    # differences of the same rows, as those of one edit are, have the same mark and stand together; the first speaks for them
    mark = F.bit_xor(F.xxhash64("node")).alias("mark")
    open_ = each.groupBy("list", "token").agg(F.count("*").alias("rows"), mark, F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("list", "token", "rows", "mark")
    return each.join(open_, ["list", "token"]).groupBy("list", "node", "n", "d", "slack", "component").agg(F.array_sort(F.collect_list(F.struct("rows", "mark", "token"))).alias("shared"))


def _told_apart(differing: DataFrame, found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(links, crowded lists as (list, node, n, alone, columns) if any) of rows in different components that share a difference.

    The prefix of a row that meets one with as many differences or more is ``index`` long, the
    other one's is ``probe`` long; both leave out what no row of another component has.
    """
    of, left = _placed_in(differing, found, percent), None
    while True:
        shared = staged(_may_link(staged(_shared(of), "shared"), percent), "shared")
        was, left = left, shared.count()
        # rows that go leave more differences alone; each time half of the rows or fewer stay, so all times cost twice the first
        if not left or was is not None and 2 * left > was:
            break
        of = shared.withColumn("differ", F.transform("shared", lambda t: t["token"])).drop("shared")
    shared = shared.withColumn("room", F.floor((100 - percent) * F.col("n") / percent))
    alone = F.col("d") - F.size("shared")
    length = lambda most: F.greatest(F.lit(0), F.least(F.size("shared"), (most + 1 - alone).cast("int")))
    places = shared.withColumns({"index": length(F.floor(F.col("room") / 2)), "probe": length(F.col("room")), "left": F.size("shared")}).filter("probe > 0")
    ranked = F.transform(F.slice("shared", F.lit(1), F.col("probe")), lambda t, k: F.struct(t["token"].alias("token"), k.alias("rank"), ((k == 0) | (F.get("shared", k - 1)["mark"] != t["mark"])).alias("begins")))
    placed = places.select("list", "node", "n", "d", "component", "index", "left", F.explode(F.filter(ranked, lambda t: t["begins"])).alias("of"))
    placed = placed.select("list", "node", "n", "d", "component", F.col("of.token").alias("token"), (F.col("of.rank") < F.col("index")).alias("first"), (F.col("left") - F.col("of.rank")).alias("behind"))
    placed = staged(placed, "placed")

    lists = placed.groupBy("list", "token").agg(F.count("*").alias("rows"), F.count(F.when(F.col("first"), 1)).alias("firsts"), F.min("component").alias("low"), F.max("component").alias("high"))
    lists = staged(lists.filter("firsts > 0 AND low <> high").select("list", "token", "rows", "firsts"), "lists")
    cost = lists.agg(F.coalesce(F.sum(F.col("firsts") * F.col("rows")), F.lit(0)).alias("all"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    last = cost["all"] <= max(COMPARED, COMPARED_PER_ROW * cost["rows"])
    few = lists if last else lists.filter(F.col("firsts") <= FIRSTS)
    side = lambda c: [F.col(k).alias(f"{c}_{k}") for k in ("n", "d", "behind", "component")]
    ours = placed.join(few.select("list", "token"), ["list", "token"])
    xs = ours.filter("first").select("list", "token", F.col("node").alias("x"), *side("x"))
    ys = ours.select("list", "token", F.col("node").alias("y"), *side("y"))
    to_share = F.col("x_d") + F.col("y_d") - _may_differ(F.col("x_n") + F.col("y_n"), percent)
    # what is behind the first difference that two rows share bounds how many they share
    fits = (2 * F.least("x_behind", "y_behind") >= to_share) & _fits("x_n", "y_n", percent)
    fewer = (F.col("x_d") < F.col("y_d")) | ((F.col("x_d") == F.col("y_d")) & (F.col("x") < F.col("y")))
    tokens = F.transform("shared", lambda t: t["token"])
    met = xs.join(ys, ["list", "token"]).filter(fewer & (F.col("x_component") != F.col("y_component")) & fits).select("list", "x", "y", to_share.alias("to_share")).distinct()
    for c in "xy":
        met = met.join(shared.select("list", F.col("node").alias(c), tokens.alias(f"{c}_differ")), ["list", c])
    links = _ordered(met.filter(2 * F.size(F.array_intersect("x_differ", "y_differ")) >= F.col("to_share")))
    if last:
        return links, None
    # two rows that share a difference meet by the first that they share: what is before it is alone there
    crowded = placed.join(lists.filter(F.col("firsts") > FIRSTS), ["list", "token"]).select("list", "node", "token", "behind")
    behind = F.slice(tokens, F.size("shared") - F.col("behind") + 1, F.col("behind"))
    parts = crowded.join(shared, ["list", "node"]).select(F.xxhash64("list", "token").alias("list"), "node", "n", (F.col("d") - F.col("behind")).alias("alone"), behind.alias("columns"))
    return links, staged(parts, "crowded")


def _crowded_links(members: DataFrame, found: DataFrame, nodes: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """(node, component) after the links between different components within crowded lists (list, node)."""
    differing = _differences(members, nodes, texts, ngram)
    while True:
        found = _joined(found, staged(_to_hub(differing, found, percent), "links"))
        links, crowded = _told_apart(differing, found, percent)
        found = _joined(found, staged(links, "links"))
        if crowded is None:
            return found
        differing = staged(_apart(crowded, ["list"], "columns").select("list", "node", "n", "alone", "differ"), "differences")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) once more links are known: components are joined, not rows."""
    n = links.count()
    if not n:
        return found
    every = found.unionByName(_ends(links).join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
    of = staged(every, "labels")
    pairs = links
    for c in "ab":
        pairs = pairs.join(of.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")), c)
    between = pairs.filter("a_of <> b_of").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")).distinct()
    up = components(between, n).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return staged(of.join(small(up, 2 * n), "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "labels")


def _in_one_task(links: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of few links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in links:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in parent], pa.int64())], names=["node", "component"])


def components(links: DataFrame, n: int) -> DataFrame:
    """(node, component) of every node with one of the n links or fewer: the smallest reachable node, by min-labels with pointer jumping."""
    if n <= LOCAL_LINKS:
        return links.select("a", "b").repartition(1).mapInArrow(_in_one_task, "node long, component long")
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        new = staged(hooked.join(jump, "component", "left").select("node", "was", F.least("component", "beyond").alias("component")), "labels")
        if not new.filter(F.col("was") != F.col("component")).limit(1).count():
            return labels
        labels = new.select("node", "component")


def _block(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, node, n, reach, ahead, pivot), each once, of the columns of the rows' blocks that more than one row has.

    Of two rows that meet the smaller one reaches its own size, so no two meet in a column whose ``ahead`` is below 0.
    """
    draw = F.xxhash64("node", F.pmod("token", F.lit(PIVOT_KINDS)))
    column = Window.partitionBy("token")
    pivot = F.first(F.struct("node", "n")).over(column.orderBy("draw", "node"))
    of_column = {"low": F.min("node"), "high": F.max("node"), "ahead": F.max(F.col("reach") - F.col("n"))}
    # the draws and reaches are made where the columns meet, so they aren't shuffled
    cold = rows.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")).select("node", "n", "token", "pos").repartition("token").withColumn("draw", draw).withColumn("n", F.col("n").cast("long")).withColumn("reach", _reach(percent))
    cold = cold.withColumns({"pivot": pivot} | {k: v.over(column) for k, v in of_column.items()}).filter("low <> high")
    # copies of one set are one row before they meet, and a hot column is one row a task
    hot = rows.select("node", "n", F.size("prefix").alias("before"), F.posexplode("hot").alias("at", "token")).withColumn("pos", F.col("before") + F.col("at"))
    hot = staged(hot.select("node", "n", "token", _reach(percent).alias("reach")).distinct(), "hot")
    columns = hot.groupBy("token").agg(F.min(F.struct(draw.alias("draw"), "node", "n")).alias("least"), *(v.alias(k) for k, v in of_column.items())).filter("low <> high")
    hot = hot.join(columns.select("token", "ahead", F.struct("least.node", "least.n").alias("pivot")), "token")
    own = ["token", "node", "n", "reach", "ahead", "pivot"]
    # copies of one set are told apart by no column here, and those of a column are in one place already
    return cold.select(own).distinct().unionByName(hot.select(own))


def _may_meet(rows: DataFrame) -> DataFrame:
    """Those rows (token, node, n, reach, component, main, ...) of long columns that may meet a row of another component there.

    x and y meet if each one's size is within the other's reach. For each reach one row a column is
    compared, of the rows of no greater size: the farthest reach of all and of those outside the main component.
    """
    out = F.when(F.col("component") != F.col("main"), F.col("reach"))
    each = rows.select("token", F.explode(F.array(F.struct(F.col("n").alias("size"), F.col("reach").alias("any"), out.alias("out")), F.struct(F.col("reach").alias("size"), F.lit(None).cast("long").alias("any"), F.lit(None).cast("long").alias("out")))).alias("of"))
    sizes = each.groupBy("token", "of.size").agg(F.max("of.any").alias("any"), F.max("of.out").alias("out"))
    up = Window.partitionBy("token").orderBy("size")
    farthest = sizes.select("token", F.col("size").alias("reach"), F.max("any").over(up).alias("any"), F.max("out").over(up).alias("out"))
    best = F.when(F.col("component") == F.col("main"), F.col("out")).otherwise(F.col("any"))
    return rows.join(farthest, ["token", "reach"]).filter(F.col("n") <= best).select(rows.columns)


def _meeting(rows: DataFrame) -> DataFrame:
    """(token, x, y) of rows (token, node, n, reach, component, main) of different components that may meet in a column."""
    side = lambda c: [F.col("node").alias(c), *(F.col(k).alias(f"{c}_{k}") for k in ("n", "reach", "component"))]
    outside, others = rows.filter("component <> main").select("token", *side("x")), rows.select("token", *side("y"), "main")
    once = (F.col("x_component") != F.col("y_component")) & ((F.col("y_component") == F.col("main")) | (F.col("x") < F.col("y")))
    return small(outside, outside.count()).join(others, "token").filter(once & _meet("x_", "y_")).select("token", "x", "y")


def _classes(docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, component) of every row of docs (doc_id, text, text_key); the component is null without words."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    levels = spark.sparkContext.broadcast(rarity_levels(docs, ngram))
    rows = staged(docs.mapInArrow(_prefixes(levels, ngram, SKETCH_BITS, percent), f"doc_id {id_type}, text_key long, n long, node long, profile array<int>, prefix array<long>, hot array<long>"), "rows")
    # one row of the matrix for each distinct set
    nodes = staged(rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("profile").alias("profile")), "nodes")
    block = staged(_block(rows, percent).filter("ahead >= 0").drop("ahead"), "block")

    first = block.filter(F.col("node") != F.col("pivot.node")).filter(_fits("n", "pivot.n", percent)).select(F.col("node").alias("x"), F.col("pivot.node").alias("y"))
    first = staged(_ordered(first), "pairs")
    links = _links(first, nodes, docs, ngram, percent)
    n = links.count()
    found = staged(components(links, n), "labels")

    placed = block.select("token", "node", "n", "reach").join(small(found, 2 * n), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("token", "component").agg(F.count("*").alias("rows")).groupBy("token").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.max(F.struct("rows", "component")).alias("most"))
    apart = parts.filter("parts > 1").select("token", F.col("most.component").alias("main"), (F.col("rows") - F.col("most.rows")).alias("outside"))
    mixed = staged(placed.join(apart, "token"), "apart")
    met = staged(_may_meet(mixed.filter(F.col("outside") > CROWD)).drop("outside"), "met")
    sizes = met.groupBy("token").agg(F.count("*").alias("rows"), F.count(F.when(F.col("component") != F.col("main"), 1)).alias("outside"))
    # of a column's rows, each meets few where they are of many sizes or stand late
    counted = _meeting(met.join(sizes.filter((F.col("outside") > CROWD) & (F.col("rows") <= WIDE * CROWD)).select("token"), "token")).groupBy("token").agg(F.count("*").alias("pairs"))
    direct = staged(sizes.join(counted, "token", "left").filter((F.col("outside") <= CROWD) | ((F.col("rows") <= WIDE * CROWD) & (F.coalesce("pairs", F.lit(0)) <= CROWD * F.col("rows")))).select("token"), "direct")
    few = mixed.filter(F.col("outside") <= CROWD).drop("outside").unionByName(met.join(direct, "token"))
    second = _meeting(few).select("x", "y")
    second = staged(_ordered(second).join(first, ["a", "b"], "left_anti"), "pairs")
    found = _joined(found, _links(second, nodes, docs, ngram, percent))

    # the name of the largest component is one of its rows, the same for all columns that hold it
    crowded = staged(met.join(direct, "token", "left_anti").select(F.col("main").alias("list"), "node").distinct(), "crowded")
    if crowded.limit(1).count():
        found = _crowded_links(crowded, found, nodes, docs, ngram, percent)
    labelled = rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(found, "node", "left")
    return labelled.select("doc_id", "text_key", "n", F.coalesce("component", "node").alias("component"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_only(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    found = staged(_classes(_keyed(docs, id_col, text_col), ngram, percent), "classes")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, but of each component only the text of the smallest id, once.

    Rows without words stay. A row is told by its id and text, so other texts of an id are other rows;
    a null id is the last of all.
    """
    found = staged(_classes(_keyed(docs, id_col, text_col), ngram, percent).filter("n > 0"), "classes")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("kept"), F.count("*").alias("rows"))
    of = staged(found.join(kept.filter("rows > 1"), "component").groupBy("doc_id", "text_key").agg(F.first(F.col("kept.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("kept.text_key") == F.col("text_key"))).alias("stays"), F.count("*").alias("rows")).filter("rows > 1 OR NOT stays"), "grouped")
    n = of.count()
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    same = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.text_key") == F.col("o.text_key"))
    rest = keyed.alias("d").join(small(of, n).alias("o"), same, "left_anti").select("row.*")
    again = of.filter("stays").select("doc_id", "text_key")
    if not again.limit(1).count():
        return rest
    once = keyed.alias("d").join(small(again, n).alias("o"), same).groupBy("d.doc_id", "d.text_key").agg(F.first("row").alias("row")).select("row.*")
    return rest.unionByName(once)
