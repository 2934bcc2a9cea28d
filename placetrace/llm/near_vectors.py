"""Embedding near-duplicates by NN-descent.

Equal vectors become one class.  Every class keeps a list of its nearest
neighbours, first filled from blocks of similar sign codes, then refined by
rounds of neighbours-of-neighbours joins: around each class its neighbours and a
bounded number of classes that list it are compared when one of the two edges
is new, and only pairs that improve a list are passed on.  Lists whose last
entry is above the threshold are saturated and are enlarged.  Every pair above
the threshold that a block or a join sees is linked before lists are cut, as
stars of bounded number.  A list has room of its own for classes outside its
component, so a crowded component cannot crowd out the links that leave it: while
a list of outside classes is saturated, components are formed anew and the
search goes on.  A descent ends when at most one list entry in a thousand changes.

An audit compares vectors chosen by hash alone, others in each audit, with all
rows, until a stated number of them had links; without so many it compares all
rows.  While its recall is below the target the search goes on with other sign
codes, and after the last search all rows are compared exactly, with work that
grows with the square of the table.  Links that an audit finds are kept.  Inside
each component links are counted exactly in blocks of rows.

Edge cases: vectors that are null, empty, zero, hold null or non-finite components
link with nothing, and vectors of different lengths do not link: every length is
searched for itself; a null id
gets no component, is never kept and is not counted; rows that share an id count
as one vector per distinct content; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placetrace.llm.graph import by_key, components
from placetrace.llm.tables import stored

EDGES = "u long, v long, sim double, own boolean, link boolean"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    neighbours: int = 12
    enlarged: int = 48
    codes: int = 8
    block: int = 256
    audited: int = 200
    audit_bytes: int = 8 << 20
    recall: float = 0.99
    searches: int = 3
    seed: int = 3


def _matrix(column, width):
    """The vectors of a binary Arrow column without nulls, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, width))
    first = int(np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0])
    raw = np.frombuffer(column.buffers()[2], np.uint8, 8 * width * len(column), first)
    return raw.copy().view(np.float64).reshape(-1, width)


def _packed(batches):
    """mapInArrow: unit vectors in double precision as bytes; null for vectors that link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("vector").to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            norm = np.sqrt((x * x).sum()) if len(x) and np.isfinite(x).all() else 0.0
            if len(x) and norm == 0.0 and x.any() or np.isinf(norm):  # out of the range of squares
                x = x / np.abs(x).max()
                norm = np.sqrt((x * x).sum())
            out.append((x / norm).tobytes() if norm > 0 else None)
        yield pa.record_batch([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _coded(settings, width, bits, codes):
    """mapInArrow: the block of each class in each sign code."""

    def run(batches):
        planes = {
            c: np.random.default_rng((settings.seed, c)).standard_normal((width, max(bits, 1))) for c in codes
        }
        weights = (1 << np.arange(max(bits, 1), dtype=np.int64)) if bits else np.zeros(1, np.int64)
        for batch in batches:
            x = _matrix(batch.column("unit"), width)
            for c, plane in planes.items():
                code = ((x @ plane) > 0) @ weights + (c << 40)
                yield pa.record_batch(
                    [batch.column("rep"), batch.column("root"), batch.column("unit"), pa.array(code)],
                    names=["rep", "root", "unit", "code"],
                )

    return run


def _best(sims, k, worst=None):
    """Per row the positions of its k best other members, those above ``worst`` only."""
    n = len(sims)
    k = min(k, n - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(n), k)
    columns = top.ravel()
    keep = np.isfinite(sims[rows, columns])
    if worst is not None:
        keep &= sims[rows, columns] > worst[rows]
    return rows[keep], columns[keep]


def _stars(near):
    """(row, column) that connect what the symmetric matrix ``near`` connects: one for each row but the first of a group."""
    rows, columns, seen = [], [], ~near.any(axis=1)
    for i in range(len(near)):
        if seen[i]:
            continue
        reached = front = near[i] | (np.arange(len(near)) == i)
        while front.any():
            front = near[front].any(axis=0) & ~reached
            reached = reached | front
        seen |= reached
        found = np.flatnonzero(reached)
        found = found[found != i]
        rows.append(found)
        columns.append(np.full(len(found), i))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(rows or none), np.concatenate(columns or none)


def _edges(ids, roots, sims, compared, limits, worst, settings):
    """Best edges of each member outside and inside its component, and links of different components, none cut.

    ``compared`` masks the pairs; limits and worst are given for outside and inside.
    """
    same = roots[:, None] == roots[None, :]
    parts = []
    for own in (False, True):
        masked = np.where(compared & (same == own), sims, -np.inf)
        parts.append((*_best(masked, limits[own], worst[own]), own, False))
    parts.append((*_stars(compared & ~same & (sims >= settings.threshold)), False, True))
    rows, columns = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    own, link = (np.concatenate([np.full(len(p[0]), p[i]) for p in parts]) for i in (2, 3))
    values = [ids[rows], ids[columns], sims[rows, columns], own, link]
    return pa.record_batch([pa.array(x) for x in values], names=["u", "v", "sim", "own", "link"])


def _block_neighbours(settings, width):
    def run(batches):
        for group in by_key(batches, "blockid"):
            if group.num_rows < 2:
                continue
            ids, roots = group.column("rep").to_numpy(), group.column("root").to_numpy()
            x = _matrix(group.column("unit"), width)
            for part in np.array_split(np.arange(len(ids)), -(-len(ids) // (4 * settings.block))):
                if len(part) < 2:
                    continue
                sims = x[part] @ x[part].T
                compared = ~np.eye(len(part), dtype=bool)
                limits = (settings.neighbours, settings.neighbours)
                yield _edges(ids[part], roots[part], sims, compared, limits, (None, None), settings)

    return run


def _join_neighbours(settings, width):
    """mapInArrow over centres: pairs of members of which one edge is new and which improve a list or link components."""

    def run(batches):
        for group in by_key(batches, "centre"):
            fresh = group.column("fresh").to_numpy()
            if group.num_rows < 2 or not fresh.any():
                continue
            every, first, which = np.unique(group.column("member").to_numpy(), return_index=True, return_inverse=True)
            if len(every) < 2:
                continue
            table = group.take(pa.array(first))
            new = np.zeros(len(every), bool)
            new[which[fresh.astype(bool)]] = True
            x = _matrix(table.column("unit"), width)
            compared = (new[:, None] | new[None, :]) & ~np.eye(len(every), dtype=bool)
            limits = tuple(int(table.column(f"limit_{k}").to_numpy().max()) for k in ("out", "own"))
            worst = tuple(table.column(f"worst_{k}").to_numpy() for k in ("out", "own"))
            out = _edges(every, table.column("root").to_numpy(), x @ x.T, compared, limits, worst, settings)
            if out.num_rows:
                yield out

    return run


def _ranked(edges, settings, state=None):
    """Edges with ``listed``: among the best of their u, inside or outside its component; others only if they link."""
    one = edges.groupBy("u", "v").agg(
        F.max("sim").alias("sim"), F.min("fresh").alias("fresh"), F.max("own").alias("own"), F.max("link").alias("link")
    )
    limit = F.lit(settings.neighbours)
    if state is not None:
        one = one.join(state.select("u", "limit_out", "limit_own"), "u", "left")
        limit = F.coalesce(F.when(F.col("own"), F.col("limit_own")).otherwise(F.col("limit_out")), limit)
    best = Window.partitionBy("u", "own").orderBy(F.desc("sim"), "v")
    ranked = one.withColumn("listed", F.row_number().over(best) <= limit)
    return ranked.where("listed or link").select("u", "v", "sim", "own", "fresh", "link", "listed")


def _state(lists, settings):
    """Per u: the limits and the entries to beat of its two lists.  Full lists above the threshold grow, and stay grown."""
    near = F.col("sim") >= settings.threshold
    found = lists.groupBy("u").agg(
        *[F.count(F.when(mine, 1)).alias(f"held_{k}") for k, mine in (("out", ~F.col("own")), ("own", F.col("own")))],
        *[F.count(F.when(mine & near, 1)).alias(f"near_{k}") for k, mine in (("out", ~F.col("own")), ("own", F.col("own")))],
        *[F.min(F.when(mine, F.col("sim"))).alias(f"least_{k}") for k, mine in (("out", ~F.col("own")), ("own", F.col("own")))],
    )
    columns = []
    for k in ("out", "own"):
        held, least = F.col(f"held_{k}"), F.col(f"least_{k}")
        limit = F.when(F.col(f"near_{k}") >= settings.neighbours, settings.enlarged)
        limit = limit.otherwise(settings.neighbours)
        columns += [limit.alias(f"limit_{k}"), F.when(held < limit, -2.0).otherwise(least).alias(f"worst_{k}")]
    return found.select("u", *columns)


def _searched(vectors, n, width, settings, codes, old=None):
    """Neighbour lists (u, v, sim, own) after block search in ``codes`` and descent, and links (a, b) between components."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / settings.block))))
    kind = "rep long, root long, unit binary, code long"
    coded = vectors.select("rep", "root", "unit").mapInArrow(_coded(settings, width, bits, codes), kind)
    sizes = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(2 * settings.block))
    blocks = coded.join(sizes, "code").select(
        "rep", "root", "unit", F.xxhash64("code", F.pmod(F.xxhash64("rep", "code"), parts)).alias("blockid")
    )
    found = (
        blocks.repartition("blockid")
        .sortWithinPartitions("blockid")
        .mapInArrow(_block_neighbours(settings, width), EDGES)
        .withColumn("fresh", F.lit(True))
    )
    if old is not None:
        ends = vectors.select("rep", "root")
        placed = old.join(ends.toDF("u", "ru"), "u").join(ends.toDF("v", "rv"), "v")
        placed = placed.select("u", "v", "sim", (F.col("ru") == F.col("rv")).alias("own"), F.lit(False).alias("link"))
        found = found.unionByName(placed.withColumn("fresh", F.lit(False)))
    found = stored(_ranked(found, settings))
    links = [found]
    lists = found.where("listed").drop("link", "listed")
    while True:
        state = stored(_state(lists, settings))
        forward = lists.select(F.col("u").alias("centre"), F.col("v").alias("member"), "fresh")
        listed = Window.partitionBy("centre", "own").orderBy(F.desc("fresh"), F.xxhash64("centre", "member"))
        backward = (
            lists.select(F.col("v").alias("centre"), F.col("u").alias("member"), "own", "fresh")
            .withColumn("place", F.row_number().over(listed))
            .where(F.col("place") <= settings.neighbours)
            .drop("place", "own")
        )
        members = forward.unionByName(backward).unionByName(
            state.select(F.col("u").alias("centre"), F.col("u").alias("member"), F.lit(False).alias("fresh"))
        )
        # Fresh entries come first in the backward lists, so both ends of one have it.
        active = lists.where("fresh").select(F.explode(F.array("u", "v")).alias("centre")).distinct()
        joined = (
            members.join(active, "centre", "left_semi")
            .join(state.withColumnRenamed("u", "member"), "member")
            .join(vectors.select(F.col("rep").alias("member"), "root", "unit"), "member")
            .repartition("centre")
            .sortWithinPartitions("centre")
            .mapInArrow(_join_neighbours(settings, width), EDGES)
        )
        grown = lists.withColumn("fresh", F.lit(False)).withColumn("link", F.lit(False))
        grown = grown.unionByName(joined.withColumn("fresh", F.lit(True)))
        found = stored(_ranked(grown, settings, state))
        links.append(found)
        lists = found.where("listed").drop("link", "listed")
        if lists.where("fresh").count() <= 0.001 * n * settings.neighbours:
            break
    linked = [f.where("link").select(F.col("u").alias("a"), F.col("v").alias("b")) for f in links]
    return lists, reduce(DataFrame.unionByName, linked)


def _against(chosen, settings, width, step=512):
    """mapInArrow: per chosen vector (ids, roots, unit vectors) its links and those inside its component; links that leave it."""

    def run(batches):
        ids, roots, x = chosen.value
        total, found = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        names = ["rep", "total", "found", "a", "b"]
        for batch in batches:
            all_reps, all_roots = batch.column("rep").to_numpy(), batch.column("root").to_numpy()
            all_units = _matrix(batch.column("unit"), width)
            for start in range(0, len(all_reps), 4 * step):
                part = slice(start, start + 4 * step)
                reps, own, y = all_reps[part], all_roots[part], all_units[part]
                for at in range(0, len(ids), step):
                    to = slice(at, at + step)
                    near = (y @ x[to].T >= settings.threshold) & (reps[:, None] != ids[None, to])
                    if not near.any():
                        continue
                    same = own[:, None] == roots[None, to]
                    total[to] += near.sum(axis=0)
                    found[to] += (near & same).sum(axis=0)
                    rows, columns = np.nonzero(near & ~same)
                    # One link for each pair of components is enough.
                    pairs = np.stack([own[rows], roots[to][columns]])
                    kept = np.unique(pairs, axis=1, return_index=True)[1] if len(rows) else rows
                    if len(kept):
                        none = pa.nulls(len(kept), pa.int64())
                        ends = pa.array(reps[rows[kept]]), pa.array(ids[to][columns[kept]])
                        yield pa.record_batch([none, none, none, *ends], names=names)
        linked = np.flatnonzero(total)
        none = pa.nulls(len(linked), pa.int64())
        yield pa.record_batch([*(pa.array(c[linked]) for c in (ids, total, found)), none, none], names=names)

    return run


def audit(vectors, roots, width, settings, search, everything=False):
    """Recall of an audit by brute force, and links (a, b) between components that it found.

    Batches of vectors in the order of a hash of their own for each search are
    compared with all rows until ``audited`` of them had links, or to the end of the
    table.  Recall is the lesser of the share of links that a component joins and
    of its mean over vectors with links, so one large group does not hide the others.
    """
    rooted = vectors.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    rooted = stored(rooted.select("rep", "unit", F.coalesce("root", "rep").alias("root")))
    size = max(1, settings.audit_bytes // (8 * width))
    batches = -(-rooted.count() // size)
    place = F.pmod(F.xxhash64("rep", F.lit(settings.seed), F.lit(search)), F.lit(max(batches, 1)))
    numbers, links = np.zeros(4), []
    for i in range(batches):
        chosen = rooted.where(place == i).collect()
        units = np.frombuffer(b"".join(bytes(r.unit) for r in chosen), np.float64).reshape(-1, width)
        values = np.array([r.rep for r in chosen], np.int64), np.array([r.root for r in chosen], np.int64), units
        shared = vectors.sparkSession.sparkContext.broadcast(values)
        kind = "rep long, total long, found long, a long, b long"
        compared = stored(rooted.mapInArrow(_against(shared, settings, width), kind))
        each = compared.where("rep is not null").groupBy("rep").agg(F.sum("total").alias("total"), F.sum("found").alias("found"))
        sums = each.agg(F.count(F.lit(1)), F.sum("total"), F.sum("found"), F.sum(F.col("found") / F.col("total"))).first()
        numbers += [x or 0 for x in sums]
        links.append(compared.where("a is not null").select("a", "b"))
        shared.unpersist()
        if numbers[0] >= settings.audited and not everything:
            break
    vectors_linked, total, found, shares = numbers
    recall = min(found / total, shares / vectors_linked) if total else 1.0
    return recall, reduce(DataFrame.unionByName, links) if links else None


def _crowded(lists, settings) -> bool:
    """True while a list of outside classes is full above the threshold: it may have lost a link to a further component."""
    full = lists.where(~F.col("own") & (F.col("sim") >= settings.threshold)).groupBy("u").count()
    return not full.where(F.col("count") >= settings.neighbours).isEmpty()


def _counted(settings, width):
    """mapInArrow over units of one or two blocks of a component: links of each member, weighted by class size."""

    def run(batches):
        for group in by_key(batches, "pair"):
            ids, block = group.column("rep").to_numpy(), group.column("block").to_numpy()
            x, copies = _matrix(group.column("unit"), width), group.column("copies").to_numpy()
            near = (x @ x.T) >= settings.threshold
            np.fill_diagonal(near, False)
            if (block != block[0]).any():
                near &= block[:, None] != block[None, :]
            yield pa.record_batch([pa.array(ids), pa.array(near @ copies)], names=["rep", "links"])

    return run


def link_counts(vectors: DataFrame, roots: DataFrame, width: int, settings: Settings) -> DataFrame:
    """(rep, links): rows of other classes of its component linked with each class."""
    members = vectors.join(roots.select(F.col("node").alias("rep"), "root"), "rep")
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * settings.block)).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").withColumn(
        "block", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("blocks")).cast("int")
    )
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("pair"),
        "rep", "block", "unit", "copies",
    )
    counted = (
        units.repartition("pair")
        .sortWithinPartitions("pair")
        .mapInArrow(_counted(settings, width), "rep long, links long")
    )
    return counted.groupBy("rep").agg(F.sum("links").alias("links"))


def searched_components(vectors: DataFrame, n: int, width: int, settings: Settings) -> DataFrame:
    """(node, root) of the linked classes, from as many searches as crowded lists and the audit ask for."""
    lists, roots, search = None, None, 0
    while True:
        codes = range(search * settings.codes, (search + 1) * settings.codes)
        rooted = vectors.withColumn("root", F.col("rep"))
        old = lists.select("u", "v", "sim") if lists is not None else None
        if roots is not None:
            rooted = stored(
                vectors.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
            )
        lists, links = _searched(rooted, n, width, settings, codes, old)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = components(links)
        search += 1
        if _crowded(lists, settings):
            continue
        recall, missed = audit(vectors, roots, width, settings, search)
        if recall < settings.recall and search >= settings.searches:
            _, missed = audit(vectors, roots, width, settings, search, everything=True)
        if missed is not None and not missed.isEmpty():
            roots = components(missed.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        if recall >= settings.recall or search >= settings.searches:
            return roots


def near_vectors(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row with vec_id, n_links, component_id and kept."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    packed = stored(rows.mapInArrow(_packed, "vec_id long, unit binary"))
    usable = F.col("unit").isNotNull() & F.col("vec_id").isNotNull()
    vectors = stored(
        packed.where(usable)
        .groupBy("unit")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("bytes", F.octet_length("unit"))
    )
    # A row for each length of vectors; where there is one class there is nothing to search.
    lengths = vectors.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("bytes").collect()
    placed = []
    for length in lengths:
        width = length.bytes // 8
        mine = vectors.where(F.col("bytes") == length.bytes).drop("bytes")
        roots = searched_components(mine, length.n, width, settings)
        links = link_counts(mine, roots, width, settings)
        placed.append(
            mine.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
            .join(links, "rep", "left")
            .select("unit", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
        )
    none = vectors.where("false").select("unit", F.col("rep").alias("root"), F.lit(0).cast("long").alias("links"))
    joined = reduce(DataFrame.unionByName, placed, none)
    classes = vectors.join(joined, "unit", "left").select(
        "unit", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links")
    )
    found = packed.join(classes, "unit", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce(F.when(usable, F.col("root")), F.col("vec_id")))
    n_links = F.when(usable, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long")
    return found.select("vec_id", n_links.alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
