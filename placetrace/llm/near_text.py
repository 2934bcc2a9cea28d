"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles.  Equal sets become one class first,
so exact copies cost nothing further.  Classes are embedded as minwise tokens;
in each of several independent trees a node picks a few token positions by its
own hash and sends its members to one child per picked token, so similar sets
meet and others part.  Small nodes are compared exhaustively on their tokens.
A large node is compared with a few leaders first: members like one
of them form a star, and stars with a common member are one.  Members outside the
largest such star are compared with all members of the node, in blocks; only if
they are too many for that does the node branch again.  So a group of near copies of
any size ends where it is found, at a cost in proportion to its size.
The classes that met with a similar token vector form
candidate groups; inside these, links are decided on the full shingle sets.
A candidate group of more than ``unit_rows`` classes or ``unit_tokens`` shingles
is split into blocks that are compared pair by pair of blocks, so no task holds
a whole large group and no link is left out.

A pair of similarity s is together in a node of the first level of a tree with a
probability of at least s, so t trees miss a share below (1 - s) ** t of the pairs
that need no second level; each further level costs about one factor of s for a
tree.  The estimate that a met pair must pass lies ``slack`` below the threshold,
which 64 tokens miss with a probability near 1e-5.

Edge cases: null or empty texts have no shingles and link with nothing; a null
id gets no component and is never kept; rows that share an id are one document
that links by any of its texts, with the size of each in its row; an empty table
gives an empty result; other columns are ignored.  Shingles are compared as 64-bit
hashes, equal sets as 128-bit sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrace.llm.graph import by_key, components
from placetrace.llm.tables import stored, texts
from placetrace.llm.textkit import BASE, Hasher, mix, pieces, separators, shingle_sets

SIGNATURE = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, tokens binary"


@dataclass(frozen=True)
class Settings:
    """A pair is linked if ``over * shared >= least * united`` for its shingle sets."""

    words: int = 3
    least: int = 85
    over: int = 100
    tokens: int = 64
    trees: int = 6
    slack: float = 0.24
    node_rows: int = 1024
    leaders: int = 16
    levels: int = 8
    unit_rows: int = 1024
    unit_tokens: int = 4 << 20

    @property
    def threshold(self):
        return self.least / self.over


def _salts(n):
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _signatures(settings):
    def run(batches):
        hasher, apart, salts = Hasher(lower=True), separators(), _salts(settings.tokens)
        for batch in batches:
            sizes, sums, rows = [], [], []
            for _, _, data, offsets in pieces(batch.column("text")):
                sets = shingle_sets(data, offsets, settings.words, hasher, apart)
                n = np.array([len(s) for s in sets])
                filled = np.flatnonzero(n)
                least = np.zeros((len(sets), settings.tokens), np.uint32)
                pair = np.zeros((len(sets), 2), np.uint64)
                if len(filled):
                    every = np.concatenate(sets)
                    at = np.concatenate(([0], np.cumsum(n[filled])[:-1]))
                    for k, salt in enumerate(salts):
                        least[filled, k] = np.minimum.reduceat((every * salt) >> np.uint64(32), at)
                    pair[filled, 0] = np.add.reduceat(mix(every ^ np.uint64(BASE)), at)
                    pair[filled, 1] = np.add.reduceat(mix(every + np.uint64(BASE)), at)
                sizes.append(n)
                sums.append(pair)
                rows += [least[i].tobytes() if n[i] else None for i in range(len(sets))]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            pair = (np.concatenate(sums) if sums else np.zeros((0, 2), np.uint64)).view(np.int64)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(n.astype(np.int64)),
                    pa.array(pair[:, 0]),
                    pa.array(pair[:, 1]),
                    pa.array(rows, pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "f1", "f2", "tokens"],
            )

    return run


def picked(node, tokens, threshold):
    """Token positions that ``node`` branches on: about 1 / threshold of them, at least one."""
    with np.errstate(over="ignore"):
        draws = mix(np.uint64(node) + np.arange(tokens, dtype=np.uint64) * np.uint64(BASE))
    chosen = np.flatnonzero(draws < np.uint64(min(1.0, 1 / (threshold * tokens)) * (2**64 - 1)))
    return chosen if len(chosen) else np.array([int(draws.argmin())])


def child(node, position, values):
    with np.errstate(over="ignore"):
        return mix(mix(np.uint64(node) ^ np.uint64(position + 1)) + values.astype(np.uint64) * np.uint64(BASE))


def _tokens(column, settings):
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, settings.tokens)


def _children(settings, root):
    """mapInArrow: a row for each child node of each member; at the root, for each tree."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _tokens(batch.column("tokens"), settings)
            parts = []
            if root:
                every = np.arange(len(tokens))
                groups = [(mix(np.array([t + 1], np.uint64))[0], every) for t in range(settings.trees)]
            else:
                nodes = batch.column("node").to_numpy()
                groups = [(np.int64(n).view(np.uint64), np.flatnonzero(nodes == n)) for n in np.unique(nodes)]
            for node, members in groups:
                for position in picked(node, settings.tokens, settings.threshold):
                    parts.append((members, child(node, position, tokens[members, position])))
            rows = np.concatenate([p[0] for p in parts])
            nodes = np.concatenate([p[1] for p in parts]).view(np.int64)
            yield pa.record_batch([batch.column("rep").take(pa.array(rows)), pa.array(nodes)], names=["rep", "node"])

    return run


def equal_tokens(some, others):
    """How many tokens each of ``some`` shares with each of ``others``."""
    if len(some) * len(others) <= 1 << 12:
        return (some[:, None, :] == others[None, :, :]).sum(2)
    equal = np.zeros((len(some), len(others)), np.uint8)
    for a, b in zip(some.T, np.ascontiguousarray(others.T), strict=True):
        equal += a[:, None] == b[None, :]
    return equal


def alike_pairs(tokens, least):
    """Pairs (position, start of its set) that connect the members with ``least`` equal tokens.

    Sets are walked from member to member and only what no set holds yet is
    compared, so a group that is like its first member costs one pass.
    """
    left, pairs = np.arange(len(tokens)), []
    while len(left) > 1:
        start, frontier, left = int(left[0]), left[:1], left[1:]
        block = 1
        while len(frontier) and len(left):
            some, frontier = frontier[:block], frontier[block:]
            hit = (equal_tokens(tokens[some], tokens[left]) >= least).any(0)
            found, left = left[hit], left[~hit]
            pairs += [(x, start) for x in found.tolist()]
            frontier = np.concatenate((found, frontier))
            block = max(1, min(block * 4, (1 << 22) // max(1, len(left))))
    return pairs


def _least(settings):
    return int(np.ceil((settings.threshold - settings.slack) * settings.tokens))


def _leaves(settings):
    def run(batches):
        for group in by_key(batches, "node"):
            if group.num_rows < 2:
                continue
            reps = group.column("rep").to_numpy()
            found = alike_pairs(_tokens(group.column("tokens"), settings), _least(settings))
            if found:
                a, b = (reps[list(side)] for side in zip(*found, strict=True))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


STAR = "node long, rep long, mask long, a long, b long"


def _stars(settings):
    """mapInArrow over parts of nodes, leaders first: the mask of leaders each member is like, and edges to them.

    Rows with a null mask connect the leaders that a member has in common.
    """

    def run(batches):
        for group in by_key(batches, "part"):
            member = group.column("member").to_numpy()
            reps, node = group.column("rep").to_numpy(), group.column("node")[0].as_py()
            tokens = _tokens(group.column("tokens"), settings)
            # A leader is there as such and as a member; each leader has one bit.
            order = np.flatnonzero(~member)
            leaders = order[np.argsort(reps[order])][:60]
            mine = np.flatnonzero(member)
            if not len(leaders) or not len(mine):
                continue
            alike = equal_tokens(tokens[mine], tokens[leaders]) >= _least(settings)
            masks = (alike.astype(np.int64) << np.arange(len(leaders))).sum(1)
            lowest = reps[leaders][alike.argmax(1)]
            found = masks > 0
            a, b = reps[mine], lowest
            shown = pa.array(np.where(found, b, a))
            rows = [pa.array(np.full(len(mine), node)), pa.array(a), pa.array(masks), pa.array(a), shown]
            yield pa.record_batch(rows, names=["node", "rep", "mask", "a", "b"])
            ties = [
                (int(reps[leaders[bit]]), int(reps[leaders[first]]))
                for mask in np.unique(masks[found]).tolist()
                for first, *others in [[k for k in range(len(leaders)) if mask >> k & 1]]
                for bit in others
            ]
            if ties:
                one, two = zip(*set(ties), strict=True)
                none = pa.nulls(len(one), pa.int64())
                yield pa.record_batch(
                    [pa.array([node] * len(one)), none, none, pa.array(one), pa.array(two)],
                    names=["node", "rep", "mask", "a", "b"],
                )

    return run


def _main_stars(batches):
    """mapInArrow over nodes: of each mask, whether it belongs to the largest set of stars of its node."""
    for group in by_key(batches, "node"):
        masks, counts = group.column("mask").to_pylist(), group.column("n").to_pylist()
        sets = []
        for mask in masks:
            touched = [s for s in sets if s & mask]
            sets = [s for s in sets if not s & mask] + ([mask | sum_bits(touched)] if mask else [])
        sizes = {s: sum(n for mask, n in zip(masks, counts, strict=True) if mask & s) for s in sets}
        main = max(sets, key=lambda s: (sizes[s], s), default=0)
        columns = [group.column("node").combine_chunks(), pa.array(masks), pa.array([bool(m & main) for m in masks])]
        yield pa.record_batch(columns, names=["node", "mask", "main"])


def sum_bits(masks):
    out = 0
    for mask in masks:
        out |= mask
    return out


def _outsiders(settings):
    """mapInArrow over parts of nodes: edges of the members outside the main stars with all others of the part."""

    def run(batches):
        for group in by_key(batches, "part"):
            main = group.column("main").to_numpy()
            reps, tokens = group.column("rep").to_numpy(), _tokens(group.column("tokens"), settings)
            ours, theirs = np.flatnonzero(~main), np.flatnonzero(main)
            a, b = [], []
            if group.column("salt")[0].as_py() == 0:
                pairs = alike_pairs(tokens[ours], _least(settings))
                a += [reps[ours[x]] for x, _ in pairs]
                b += [reps[ours[y]] for _, y in pairs]
            step = max(1, (1 << 22) // max(1, len(theirs)))
            for at in range(0, len(ours) if len(theirs) else 0, step):
                some = ours[at : at + step]
                alike = equal_tokens(tokens[some], tokens[theirs]) >= _least(settings)
                hit = alike.any(1)  # the main stars hang together, so one edge is enough
                a += reps[some[hit]].tolist()
                b += reps[theirs[alike.argmax(1)[hit]]].tolist()
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _parts(rows, copied, settings, sizes):
    """Rows of nodes dealt to parts of about 4 * ``node_rows``; rows where ``copied`` holds go to every part of theirs."""
    salts = F.ceil(F.col("n") / F.lit(4 * settings.node_rows)).cast("int")
    own = F.array(F.pmod(F.xxhash64("rep", F.lit(5)), salts).cast("int"))
    everywhere = F.sequence(F.lit(0), salts - 1)
    placed = rows.join(sizes.select("node", "n"), "node").withColumn(
        "salt", F.explode(F.when(copied, everywhere).otherwise(own))
    )
    return placed.withColumn("part", F.xxhash64("node", "salt"))


def crowded_edges(members: DataFrame, sizes: DataFrame, tokens: DataFrame, settings: Settings):
    """(edges, members that must branch again) of the nodes in ``sizes`` (node, n)."""
    full = members.join(sizes.select("node"), "node").join(tokens, "rep")
    drawn = F.pmod(F.xxhash64("rep", "node", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    leads = full.join(sizes, "node").where(drawn < settings.leaders / F.col("n")).drop("n")
    both = full.withColumn("member", F.lit(True)).unionByName(leads.withColumn("member", F.lit(False)))
    parts = _parts(both, ~F.col("member"), settings, sizes).select("part", "node", "rep", "member", "tokens")
    stars = stored(
        parts.repartition("part").sortWithinPartitions("part", "member").mapInArrow(_stars(settings), STAR)
    )
    edges = stars.where("a != b").select("a", "b")
    masks = stars.where("mask is not null").groupBy("node", "mask").agg(F.count(F.lit(1)).alias("n"))
    main = masks.repartition("node").sortWithinPartitions("node", "mask").mapInArrow(
        _main_stars, "node long, mask long, main boolean"
    )
    known = stars.where("mask is not null").select("node", "rep", "mask").join(main, ["node", "mask"]).drop("mask")
    # A node in which the draw named no leader has no stars: all of its members are outside.
    known = stored(
        full.select("node", "rep").join(known, ["node", "rep"], "left").withColumn("main", F.coalesce("main", F.lit(False)))
    )
    outside = known.where("not main").groupBy("node").agg(F.count(F.lit(1)).alias("out"))
    outside = stored(outside.join(sizes, "node"))
    few = outside.where(F.col("out") <= 4 * settings.node_rows)
    asked = known.join(few.select("node"), "node").join(tokens, "rep")
    units = _parts(asked, ~F.col("main"), settings, few).select("part", "salt", "rep", "main", "tokens")
    edges = edges.unionByName(
        units.repartition("part").sortWithinPartitions("part", "salt").mapInArrow(_outsiders(settings), "a long, b long")
    )
    again = outside.where(F.col("out") > 4 * settings.node_rows).select("node")
    return edges, full.join(again, "node").select("node", "rep", "tokens"), again


def candidate_edges(classes: DataFrame, settings: Settings) -> DataFrame:
    """Edges that connect classes (rep, tokens) which met in a node and look alike."""
    spark = classes.sparkSession
    edges = spark.createDataFrame([], "a long, b long")
    tokens = classes.select("rep", "tokens")
    members = tokens.mapInArrow(_children(settings, True), "rep long, node long")
    for _ in range(settings.levels):
        members = stored(members)
        sizes = stored(members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        small = sizes.where(F.col("n") <= settings.node_rows).select("node")
        leaf = members.join(small, "node").join(tokens, "rep").select("node", "rep", "tokens")
        edges = edges.unionByName(
            leaf.repartition("node").sortWithinPartitions("node").mapInArrow(_leaves(settings), "a long, b long")
        )
        crowded = sizes.where(F.col("n") > settings.node_rows)
        if crowded.isEmpty():
            return edges
        found, rest, again = crowded_edges(members, crowded, tokens, settings)
        edges = edges.unionByName(found)
        if again.isEmpty():
            return edges
        members = rest.mapInArrow(_children(settings, False), "rep long, node long")
    # What still shares so many picked tokens is taken as one candidate group.
    rest = stored(members)
    first = rest.groupBy("node").agg(F.min("rep").alias("b"))
    return edges.unionByName(rest.join(first, "node").select(F.col("rep").alias("a"), "b").where("a != b"))


def _sets(settings):
    """mapInArrow: the shingle set of each text as bytes, for each unit that compares it; other texts of its id fall out."""

    def run(batches):
        hasher, apart = Hasher(lower=True), separators()
        for batch in batches:
            sets, kept = [], []
            for first, _, data, offsets in pieces(batch.column("text")):
                for i, shingles in enumerate(shingle_sets(data, offsets, settings.words, hasher, apart), first):
                    if len(shingles) == batch.column("n_shingles")[i].as_py():
                        sets.append(shingles.tobytes())
                        kept.append(i)
            columns = [batch.column(c).take(pa.array(kept, pa.int64())) for c in ("rep", "grp", "block", "blocks")]
            yield pa.record_batch(
                [*columns, pa.array(sets, pa.large_binary())], names=["rep", "grp", "block", "blocks", "shingles"]
            )

    return run


def _spread(near):
    """Pairs (position, start of its set) that connect the sets of a symmetric relation."""
    left, pairs = np.arange(len(near)), []
    while len(left):
        start, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            hit = near[np.ix_(frontier, left)].any(0)
            frontier, left = left[hit], left[~hit]
            pairs += [(x, int(start)) for x in frontier.tolist()]
    return pairs


def linked(sets, least, over, sides=None):
    """Pairs of positions that connect the linked sets; with ``sides``, only pairs of different sides.

    Shared counts of all pairs come from matrix products over the tokens that at
    least two sets hold; a pair is then decided with whole numbers.
    """
    n = np.array([len(s) for s in sets], np.int64)
    if len(sets) == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(1, 0)] if over * shared >= least * (n[0] + n[1] - shared) else []
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    often = np.bincount(column, minlength=len(tokens)) >= 2
    number = np.cumsum(often) - 1
    keep = often[column]
    column, row = number[column[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, (1 << 24) // len(sets))
    for start in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        block = np.zeros((len(sets), int(min(width, often.sum() - start))), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        shared += block @ block.T
    near = np.zeros(shared.shape, bool)
    for i in range(len(sets)):
        exact = shared[i].astype(np.int64)
        near[i] = over * exact >= least * (n[i] + n - exact)
        if sides is not None:
            near[i] &= sides != sides[i]
    return _spread(near)


def _verified(settings):
    def run(batches):
        for group in by_key(batches, "unit"):
            reps = group.column("rep").to_numpy()
            if len(reps) < 2:
                continue
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            side = group.column("block").to_numpy()
            across = side if (side != side[0]).any() else None
            pairs = linked(sets, settings.least, settings.over, across)
            if pairs:
                a, b = zip(*pairs, strict=True)
                yield pa.record_batch([pa.array(reps[list(a)]), pa.array(reps[list(b)])], names=["a", "b"])

    return run


def verified_edges(docs: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """Edges that connect the classes linked on their full sets.

    groups: (rep, grp, doc_id, text_hash, n_shingles), the row of ``docs`` that stands for class ``rep``.
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("shingles"))
    half = F.ceil(
        F.greatest(F.col("rows") * 2 / settings.unit_rows, F.col("shingles") * 2 / F.lit(settings.unit_tokens))
    )
    fits = (F.col("rows") <= settings.unit_rows) & (F.col("shingles") <= settings.unit_tokens)
    sizes = sizes.select("grp", F.when(fits, 1).otherwise(half).cast("int").alias("blocks"))
    wanted = groups.join(sizes, "grp").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        "rep",
        "grp",
        "blocks",
        F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int").alias("block"),
    )
    sets = (
        _hashed(docs)
        .join(wanted.hint("merge"), ["doc_id", "text_hash"])  # the same plan at every size
        .mapInArrow(_sets(settings), "rep long, grp long, block int, blocks int, shingles binary")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = sets.withColumn("other", other).withColumn(
        "unit", F.xxhash64("grp", F.least("block", "other"), F.greatest("block", "other"))
    )
    # A block compared with itself is a unit of its own; others hold two blocks.
    return (
        units.select("unit", "rep", "block", "shingles")
        .repartition("unit")
        .sortWithinPartitions("unit")
        .mapInArrow(_verified(settings), "a long, b long")
    )


def _hashed(docs):
    return texts(docs).withColumn("text_hash", F.xxhash64("text"))


SAME = ["f1", "f2", "n_shingles"]


def grouped(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row with its class key, and the classes (key, rep, first row, root of linked classes)."""
    signed = stored(_hashed(docs).mapInArrow(_signatures(settings), SIGNATURE))
    classes = stored(
        signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        .groupBy(*SAME, "tokens")
        .agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", "doc_id").alias("text_hash"))
        .select(*SAME, "tokens", F.struct("doc_id", "text_hash").alias("first"), F.monotonically_increasing_id().alias("rep"))
    )
    candidates = components(candidate_edges(classes, settings))
    groups = candidates.join(classes.drop("tokens"), F.col("node") == F.col("rep")).select(
        "rep", F.col("root").alias("grp"), "first.*", "n_shingles"
    )
    edges = verified_edges(docs, stored(groups), settings)
    roots = components(edges).select(F.col("node").alias("rep"), "root")
    placed = classes.join(roots, "rep", "left").select(*SAME, "rep", "first", F.coalesce("root", "rep").alias("root"))
    return signed.select("doc_id", "text_hash", *SAME), placed


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row with doc_id, n_shingles, component_id and kept."""
    signed, classes = grouped(docs, settings)
    found = stored(signed.join(classes.select(*SAME, "root"), SAME, "left").select("doc_id", "n_shingles", "root"))
    # An id whose rows fell into several groups makes them one.
    spans = found.where("doc_id is not null and root is not null").groupBy("doc_id")
    spans = spans.agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    spans = stored(spans.drop("high"))
    across = found.join(spans, "doc_id").select(F.col("root").alias("a"), F.col("low").alias("b"))
    across = across.where("false") if spans.isEmpty() else components(across).toDF("a", "b")
    joined = across.toDF("root", "whole")
    least = stored(
        classes.join(joined, "root", "left")
        .groupBy("root", F.coalesce("whole", "root").alias("whole"))
        .agg(F.min("first.doc_id").alias("low"))
    )
    least = least.join(least.groupBy("whole").agg(F.min("low").alias("component")), "whole").select("root", "component")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        found.join(least, "root", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def surplus(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text_hash) of the rows that copy another row of ``docs``: all but the first of each group.

    ``text_hash`` is the xxhash64 of the text.  Rows that share an id are judged each by its own text; rows equal in
    both are one document and stay or go together.
    """
    signed, classes = grouped(docs, settings)
    first = classes.groupBy("root").agg(F.min("first").alias("chosen"))
    found = signed.join(classes.join(first, "root").select(*SAME, "chosen"), SAME)
    same = F.struct("doc_id", "text_hash") == F.col("chosen")
    return found.where(F.col("doc_id").isNotNull() & ~same).select("doc_id", "text_hash").distinct()
