"""Near-duplicate documents by an LSH forest of MinHash signatures.

A document's set holds its distinct `shingle`-word shingles. Documents with equal sets
form one class at once. The signature of a class, TREES x DEPTH MinHash values, gives
one sort key per tree; the trees are kept as one table sorted by (tree, key), in which
the rows that share the longest prefixes stand next to each other. Rows that share LEAST
values are a region, and how deep a region is searched follows from its size: in small
ones all pairs are candidates, in larger ones each row meets the BEST rows that share the
most values of the whole signature. Candidates whose signatures agree too little to be
links (four standard deviations below the limit) are dropped, the rest are confirmed on
the full sets: first the best candidate of each class, then every candidate between
classes that these links leave apart.

Regions in which some row has more than BEST likely partners, or that are larger than a
tile or lie in two partitions, are crowds. Where a crowd's rows outside its largest
component fit a tile, they are compared with all its rows on the full sets, in tiles of
bounded size, and only links leave a tile. In wider crowds the keys go deeper: two sets can
only be a link if they share one of the shingles that are rarest among all such rows, as
many of them as the sizes of both leave room for (a prefix filter, by bands of sizes).
Rows of wide crowds meet by those shingles, and what meets is confirmed; only rows of a
shingle that more than LIST of them still have among their rarest are compared in tiles.
So texts that share a long passage but no more than that never meet, and no link is lost
between rows that share LEAST values in some tree; a pair at a similarity of exactly 0.8
shares them in none with a chance of 2 in 10000, a closer pair with less.

Defined cases: A-Z count as a-z; a text with fewer words than a shingle is one shingle;
null, empty and wordless texts have no set and link with nothing; an empty table gives an
empty result; ties are broken by the smaller id; repeated rows are equal sets; rows without
an id link, and are kept where no row of their component has one; very long texts are whole
sets, one in a task's memory at a time; other columns, whatever their names, never enter.
No group is gathered in one task: classes are aggregated before the shuffle, trees are
split by ranges that include the row's id, and crowds are dealt out by shingle or in tiles.
Sets are told apart by 128 bits: 64-bit names that different sets share are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import _spark as S
from .graph import components
from .sketch import in_sketch, sketch_of

#: Trees of the forest, MinHash values in each key, and values that the rows of a region share.
TREES, DEPTH, LEAST = 12, 8, 3
#: Rows of a small region, beside the first, and partners of each row that are candidates in larger ones; crowds are compared in tiles.
REACH, BEST = 4, 8
#: Rows and bytes of sets in a tile, on average.
TILE, TILE_BYTES = 2048, 16 << 20
#: Rows of a wide crowd that meet in pairs by one shingle; counters by which shingles are ordered, a broadcast of 2 MB.
LIST, SLOTS = 64, 1 << 18
#: Least sizes of the bands in which sets of alike sizes meet, each a twentieth above the one before.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, BANDS[-1] * 21 // 20))
#: Names that several sets may share, and times that they are told apart; of 10 ** 10 sets, some three are, once.
SHARED, TURNS = 10_000, 4
WORDS = B.Words(B.SPACES, seed=6)
FEATURES = "struct<n:long,node:long,check:long,signature:binary>"


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Each text's set: sorted distinct 64-bit shingle hashes."""
    buf, off = B.text_bytes(texts)
    for lo, hi in B.slabs(off):
        part, inner = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        starts, ends, first = WORDS.find(part, inner)
        hashes = WORDS.hash(part, starts, ends)
        spans = B.spans_of(hashes, shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(spans[a : b - shingle + 1] if b - a >= shingle else B.spans_of(hashes[a:b], b - a) if b > a else hashes[:0])


def names_of(one: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    if not len(one):
        return 0, 0
    return int(B.mix(one).sum(dtype=B.U64).view(np.int64)), int(B.mix(one * B.U64(B.BASE)).sum(dtype=B.U64).view(np.int64))


def named_by(node: Column) -> Column:
    """What sets are named by, before those that share a name are told apart."""
    return node


def name_of_sets(classes: DataFrame) -> Column:
    """The name of a set, of the columns `node` and `check`: one long for each pair of them among the classes (node, check)."""
    name = named_by(F.col("node"))
    for turn in range(TURNS):
        shared = [r["name"] for r in classes.groupBy(name.alias("name")).count().where("count > 1").select("name").limit(SHARED + 1).collect()]  # by chance, hardly ever any
        if not shared:
            return name
        if len(shared) > SHARED:
            break
        name = F.when(name.isin(shared), F.xxhash64(name, F.col("check"), F.lit(turn))).otherwise(name)
    raise RuntimeError("sets can't be told apart by their hashes")


def limit_of_agreement(similarity: float, values: int) -> int:
    """Equal values below which a pair of the given similarity is four deviations off."""
    return int(values * similarity - 4 * np.sqrt(values * similarity * (1 - similarity)))


def _features(shingle: int):
    seeds = B.mix(np.arange(1, TREES * DEPTH + 1, dtype=B.U64) * B.U64(B.BASE)) | B.U64(1)

    def signatures(sets: list[np.ndarray]) -> np.ndarray:
        """The TREES * DEPTH least values of each set under as many orders."""
        sizes = np.array([len(x) for x in sets])
        out = np.zeros((len(sets), len(seeds)), ">u4")
        full = np.flatnonzero(sizes)
        if len(full):
            values, at = np.concatenate([sets[k] for k in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            for k, seed in enumerate(seeds):
                out[full, k] = np.minimum.reduceat(((values ^ (values >> B.U64(29))) * seed) >> B.U64(32), at)
        return out

    def features(texts: pa.Array) -> pa.Array:
        n, node, check, signed, wait = [], [], [], [], []

        def flush():
            if wait:
                signed.extend(row.tobytes() for row in signatures(wait))
                wait.clear()

        held = 0
        for one in shingle_sets(texts, shingle):
            n.append(len(one))
            with np.errstate(over="ignore"):
                first, second = names_of(one)
            node.append(first)
            check.append(second)
            wait.append(one)
            held += len(one)
            if held > 1 << 16:
                flush()
                held = 0
        flush()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(signed, pa.binary())], ["n", "node", "check", "signature"])

    def typed(texts):
        return features(texts)

    typed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(typed, FEATURES).asNondeterministic()


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: its key, the node, its size, and a byte of each value of the whole signature."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(n, TREES, DEPTH)
        keys = np.ascontiguousarray(values).view(np.uint8).reshape(n, TREES, 4 * DEPTH)
        short = np.ascontiguousarray((values & 255).astype(np.uint8)).reshape(n, TREES * DEPTH)
        short = pa.array([row.tobytes() for row in short], pa.binary())
        for t in range(TREES):
            yield pa.record_batch([pa.array(np.full(n, t, np.int32)), pa.array([k.tobytes() for k in keys[:, t]], pa.binary()), batch.column(0), batch.column(2), short], ["tree", "key", "node", "n", "short"])


def _equal_values(short: np.ndarray, rows: slice) -> np.ndarray:
    """How many values the signatures of `rows` share with all."""
    out = np.zeros((len(short[rows]), len(short)), np.uint8)
    for column in np.ascontiguousarray(short.T):
        out += column[rows][:, None] == column[None, :]
    return out


def _search(agree: int, percent: int):
    """Candidate pairs (a, b, equal) among rows in order; crowds (tree, prefix; equal: -1), and each partition's first and last regions (equal: -2)."""

    def alike(n, m):
        return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)

    def small(nodes, n, short, region, sizes):
        """All pairs of regions of REACH + 1 rows at most."""
        for d in range(1, REACH + 1):
            at = np.flatnonzero((region[d:] == region[:-d]) & (sizes[region[d:]] <= REACH + 1)) if len(nodes) > d else np.zeros(0, np.int64)
            equal = (short[at + d] == short[at]).sum(1)
            fit = (equal >= agree) & (nodes[at + d] != nodes[at]) & alike(n[at + d], n[at])
            yield nodes[at][fit], nodes[at + d][fit], equal[fit]

    def large(nodes, n, short):
        """The BEST pairs of each row of a region, and whether some row has more."""
        more = False
        for a in range(0, len(nodes), 256):
            rows = slice(a, a + 256)
            equal = _equal_values(short, rows)
            equal[(equal < agree) | (nodes[rows, None] == nodes[None, :]) | ~alike(n[rows, None], n[None, :])] = 0
            more |= bool(((equal > 0).sum(1) > BEST).any())
            best = np.argpartition(equal, -BEST, axis=1)[:, -BEST:] if len(nodes) > BEST else np.broadcast_to(np.arange(len(nodes)), equal.shape)
            r, c = np.nonzero(np.take_along_axis(equal, best, 1))
            yield nodes[a + r], nodes[best[r, c]], equal[r, best[r, c]], more

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        ends: list[tuple[int, bytes]] = []

        def rows_of(found: list, crowds: set, equal: int = -1) -> pa.RecordBatch:
            a, b, e = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            m, k, listed = len(a), len(crowds), sorted(crowds)
            at = TaskContext.get().partitionId()
            values = [pa.array(np.append(np.minimum(a, b), np.full(k, at))), pa.array(np.append(np.maximum(a, b), np.zeros(k, np.int64))), pa.array(np.append(e, np.full(k, equal)).astype(np.int32))]
            return pa.record_batch([*values, pa.array([None] * m + [c[0] for c in listed], pa.int32()), pa.array([None] * m + [c[1] for c in listed], pa.binary())], ["a", "b", "equal", "tree", "prefix"])

        def searched(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            tree, nodes, n = (rows[c].to_numpy() for c in ("tree", "node", "n"))
            keys = np.frombuffer(b"".join(rows["key"].to_pylist()), np.uint8).reshape(len(rows), 4 * DEPTH)[:, : 4 * LEAST]
            short = np.frombuffer(b"".join(rows["short"].to_pylist()), np.uint8).reshape(len(rows), TREES * DEPTH)
            new = np.concatenate([[True], (tree[1:] != tree[:-1]) | (keys[1:] != keys[:-1]).any(1)])
            starts = np.append(np.flatnonzero(new), len(rows))
            region, sizes = np.cumsum(new) - 1, np.diff(starts)
            name = lambda k: (int(tree[starts[k]]), keys[starts[k]].tobytes())
            ends[:] = [ends[0] if ends else name(0), name(-2)]
            stay = starts[-1] if last else starts[-2] + sizes[-1] // TILE * TILE  # the last region goes on in the next rows
            crowds, found = set(), list(small(nodes[:stay], n[:stay], short[:stay], region[:stay], sizes))
            for k in np.flatnonzero(sizes > REACH + 1).tolist():
                for a in range(starts[k], min(starts[k + 1], stay), TILE):
                    own = slice(a, min(a + TILE, starts[k + 1]))
                    for x, y, e, more in large(nodes[own], n[own], short[own]):
                        found.append((x, y, e))
                        if more or sizes[k] >= TILE:
                            crowds.add(name(k))
            return rows_of(found, crowds), rows.slice(stay) if stay < len(rows) else None

        for batch in batches:
            if len(batch):
                own = pa.Table.from_batches([batch])
                out, kept = searched(own if kept is None else pa.concat_tables([kept, own]), False)
                yield out
        if kept is not None:
            yield searched(kept, True)[0]
        yield rows_of([], set(ends), -2)

    return of


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b, equal): pairs of nodes that some tree has in one region; equal: values that their signatures share.

    And the crowds, distinct (tree, prefix).
    """
    agree = limit_of_agreement(percent / 100, TREES * DEPTH)
    forest = classes.select("node", "signature", "n").mapInArrow(_plant, "tree int, key binary, node long, n long, short binary")
    n = S.shuffle_partitions(classes.sparkSession)
    order = ["tree", "key", "node"]
    found = S.gathered(forest.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_search(agree, percent), "a long, b long, equal int, tree int, prefix binary"))
    pairs = found.where("equal >= 0").groupBy("a", "b").agg(F.max("equal").alias("equal"))
    # regions that end one partition and begin another are crowds too
    crowds = found.where("equal < 0").groupBy("tree", "prefix").agg(F.max("equal").alias("equal"), F.min("a").alias("lo"), F.max("a").alias("hi")).where("equal = -1 or lo < hi")
    return pairs, crowds.select("tree", "prefix")


def members(classes: DataFrame, crowds: DataFrame) -> DataFrame:
    """(tree, prefix, node): the rows of each crowd."""
    prefixes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.col("signature"), t * (4 * DEPTH) + 1, F.lit(4 * LEAST)))
    return classes.select("node", F.posexplode(prefixes).alias("tree", "prefix")).join(crowds, ["tree", "prefix"]).select("tree", "prefix", "node")


def _links_of_tiles(percent: int):
    """The links between the components of a tile's own rows and of its guests."""

    def links(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        root, n, guest = (rows[c].to_numpy() for c in ("root", "n", "guest"))
        own, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
        pairs = np.zeros((2, 0), np.int64)
        if len(own) and len(guests):
            sets = [unpacked(x) for x in rows["packed"].to_pylist()]
            sizes = np.array([len(sets[k]) for k in guests])
            values, codes = np.unique(np.concatenate([sets[k] for k in guests]), return_inverse=True)
            starts, has = np.cumsum(sizes) - sizes, np.zeros(len(values) + 1, bool)
            found: set[tuple[int, int]] = set()
            for k in own.tolist():
                fit = (root[guests] != root[k]) & (100 * np.minimum(n[guests], n[k]) >= percent * np.maximum(n[guests], n[k]))
                if not fit.any():
                    continue
                where = np.searchsorted(values, sets[k])
                where[where == len(values)] = 0
                where = where[values[where] == sets[k]]
                has[where] = True
                same = np.add.reduceat(has[codes], starts, dtype=np.int64)
                has[where] = False
                at = guests[fit & (100 * same >= percent * (n[guests] + n[k] - same))]
                found.update((min(x, y), max(x, y)) for x, y in zip(root[at].tolist(), [int(root[k])] * len(at), strict=True))
            if found:
                pairs = np.array(sorted(found), np.int64).T
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})

    def typed(rows):
        return links(rows)

    typed.__annotations__ = {"rows": pa.Table, "return": pa.Table}
    return typed


def _rarest(percent: int, counts):
    """Rows by the shingles that a link of theirs must share: (key, node, root, n, least), a key for each shingle and band of sizes.

    `least`: the row's own size is in the band, so that it can be the smaller of two.
    """

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, lows = np.frombuffer(counts.value, np.int64), np.array(BANDS)

        def rows_of(keys: list, own: list) -> pa.RecordBatch:
            times = [len(k) for k in keys]
            node, root, n, least = (np.repeat(np.array(x), times) for x in zip(*own, strict=True))
            return pa.record_batch([pa.array(x) for x in (np.concatenate(keys).view(np.int64), node, root, n, least)], ["key", "node", "root", "n", "least"])

        for batch in batches:
            keys, own, held = [], [], 0
            for node, root, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = unpacked(packed)
                values = values[np.lexsort((values, often[_slots(values)]))]
                least = -(-percent * n // 100)
                first, last = np.searchsorted(lows, [least, n], "right") - 1
                for band in range(first, last + 1):
                    # the smaller of both sets is in this band, so they share this many shingles, or more
                    both = -(-percent * (n + max(least, BANDS[band])) // (100 + percent))
                    keys.append((values[: max(0, len(values) - both + 1)] << B.U64(12)) | B.U64(band))
                    own.append((node, root, n, band == last))
                    held += len(keys[-1])
                if held > 1 << 18:
                    yield rows_of(keys, own)
                    keys, own, held = [], [], 0
            if keys:
                yield rows_of(keys, own)

    return deep


def _slots(values: np.ndarray) -> np.ndarray:
    return ((values * B.U64(B.BASE)) >> B.U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def counted_shingles(sets: DataFrame):
    """How many sets have shingles of each of SLOTS counters: any total order finds all links, a good one has rare shingles first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(SLOTS, np.int64)
        for batch in batches:
            packed = batch.column(0).to_pylist()
            for k in range(0, len(packed), 256):
                often += np.bincount(_slots(unpacked(b"".join(packed[k : k + 256]))), minlength=SLOTS)
        slot = np.flatnonzero(often)
        yield pa.record_batch([pa.array(slot), pa.array(often[slot])], ["slot", "n"])

    found = sets.select("packed").mapInArrow(counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    often = np.zeros(SLOTS, np.int64)
    often[found["slot"].to_numpy()] = found["n"].to_numpy()
    return sets.sparkSession.sparkContext.broadcast(often.tobytes())


def deep_candidates(known: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b, ra, rb) of rows (node, root) that share one of their rarest shingles, and the nodes of those that too many share.

    Any two rows of different roots that are a link are a pair, or both among those nodes.
    """
    own = S.cut(known.join(sets, "node").select("node", "root", "n", "packed"))
    entries = own.mapInArrow(_rarest(percent, counted_shingles(own)), "key long, node long, root long, n long, least boolean")
    lists = S.gathered(entries.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("least").alias("least")).where("lo < hi and least").select("key", "rows"))
    listed = S.cut(entries.join(lists, "key"))
    few = listed.where(F.col("rows") <= LIST)
    one, two = (few.select("key", F.col("node").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("least").alias(f"l{x}")) for x in "ab")
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    pairs = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (F.col("la") | F.col("lb")) & alike).select("a", "b", "ra", "rb").distinct()
    return S.gathered(pairs), S.gathered(listed.where(F.col("rows") > LIST).select("node").distinct())


def crowd_links(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): roots between which a crowd's rows (tree, prefix, node, root) have a link.

    Crowds whose rows outside the largest component fit a tile are compared in tiles; the
    rows of wider ones meet by their rarest shingles, once for all trees.
    """
    known = S.gathered(known.join(sets.select("node", "n"), "node"))
    mixed = S.gathered(_mixed(known))
    if mixed.where("others > 1").isEmpty():
        return _tiled_links(known, mixed, sets, percent)
    wide = S.gathered(known.join(mixed.where("others > 1").select("tree", "prefix"), ["tree", "prefix"]))
    pairs, hot = deep_candidates(wide.select("node", "root").distinct(), sets, percent)
    links = confirmed(pairs, sets, percent).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    narrow = _tiled_links(known, mixed.where("others = 1"), sets, percent)
    if hot.isEmpty():
        return links.unionByName(narrow)
    # shingles that very many have among their rarest: their rows in tiles, those apart after the links found
    met = S.gathered(links.distinct())
    rest = wide.join(hot, "node", "left_semi")
    rest = S.gathered(through(rest, [components(met)]) if not met.isEmpty() else rest)
    return met.unionByName(narrow).unionByName(_tiled_links(rest, S.gathered(_mixed(rest)), sets, percent))


def _mixed(known: DataFrame) -> DataFrame:
    """Crowds of several components: (tree, prefix, most, tiles, others), the largest component, tiles of all rows and of those outside it."""
    each = known.groupBy("tree", "prefix", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    whole = each.groupBy("tree", "prefix").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.max(F.struct("rows", "n", "root")).alias("top")).where("rows > top.rows")
    tiles = lambda rows, n: F.ceil(F.greatest(rows / TILE, n * 6 / TILE_BYTES)).cast("int")
    return whole.select("tree", "prefix", F.col("top.root").alias("most"), tiles(F.col("rows"), F.col("n")).alias("tiles"), tiles(F.col("rows") - F.col("top.rows"), F.col("n") - F.col("top.n")).alias("others"))


def _tiled_links(known: DataFrame, mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b): roots between which rows of a crowd have a link.

    The rows of a crowd are dealt into tiles, and those outside its largest component into
    tiles of guests as well; each tile meets each tile of guests.
    """
    dealt = S.gathered(known.drop("n").join(mixed, ["tree", "prefix"]))
    of = lambda name, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(name)).cast("int")
    as_own = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct("tree", "prefix", of("tiles", 1).alias("i"), j.alias("j"), F.lit(False).alias("guest")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: F.struct("tree", "prefix", i.alias("i"), of("others", 2).alias("j"), F.lit(True).alias("guest")))
    places = F.when(F.col("root") == F.col("most"), as_own).otherwise(F.concat(as_own, as_guest))
    # a node's set joins its places once, and is copied on the way to the tiles
    placed = dealt.groupBy("node", "root").agg(F.flatten(F.collect_list(places)).alias("places")).join(sets, "node")
    unit = placed.select("root", "n", "packed", F.explode("places").alias("at")).select("at.*", "root", "n", "packed")
    return unit.groupBy("tree", "prefix", "i", "j").applyInArrow(_links_of_tiles(percent), "a long, b long").distinct()


def _sets(shingle: int, sketch):
    """The sets, six bytes of each hash, of the rows that the sketch has; null for others."""

    def sets(ids: pa.Array, texts: pa.Array) -> pa.Array:
        wanted = in_sketch(sketch, ids)
        rows = np.flatnonzero(wanted)
        n, node, check, packed = ([None] * len(ids) for _ in range(4))
        for k, one in zip(rows.tolist(), shingle_sets(texts.take(pa.array(rows)), shingle), strict=True):
            with np.errstate(over="ignore"):
                node[k], check[k] = names_of(one)
            n[k], packed[k] = len(one), np.unique(one >> B.U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(packed, pa.binary())], ["n", "node", "check", "packed"], mask=pa.array(~wanted))

    def typed(ids, texts):
        return sets(ids, texts)

    typed.__annotations__ = {"ids": pa.Array, "texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(typed, "struct<n:long,node:long,check:long,packed:binary>").asNondeterministic()


def unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(B.U64).ravel()


def _confirm(percent: int):
    """Whether 100 * intersection >= percent * union."""

    def confirm(x: pa.Array, nx: pa.Array, y: pa.Array, ny: pa.Array) -> pa.Array:
        out = []
        for p, n, q, m in zip(x.to_pylist(), nx.to_pylist(), y.to_pylist(), ny.to_pylist(), strict=True):
            if 100 * min(n, m) < percent * max(n, m):
                out.append(False)
                continue
            p, q = unpacked(p), unpacked(q)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (n + m - both))
        return pa.array(out, pa.bool_())

    def typed(x, nx, y, ny):
        return confirm(x, nx, y, ny)

    typed.__annotations__ = {"x": pa.Array, "nx": pa.Array, "y": pa.Array, "ny": pa.Array, "return": pa.Array}
    return F.arrow_udf(typed, "boolean").asNondeterministic()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) that are links."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("packed").alias("pa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("packed").alias("pb"))
    return pairs.join(one, "a").join(two, "b").withColumn("ok", _confirm(percent)("pa", "na", "pb", "nb")).where("ok").select(*pairs.columns)


def through(rows: DataFrame, joined: list[DataFrame]) -> DataFrame:
    """rows with what their `root` became in each search for components (node, root) among roots."""
    for found in joined:
        whole = found.select(F.col("node").alias("root"), F.col("root").alias("whole"))
        rows = rows.join(whole, "root", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")
    return rows


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept (doc_id is the component's smallest)."""
    named = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))  # rows without an id go by their text
    made = docs.select(F.col(doc_id).cast("long").alias("doc_id"), named.alias("named"), _features(shingle)(F.col(text)).alias("f"))
    rows = S.cut(made.select("doc_id", "named", "f.n", "f.node", "f.check", "f.signature"))
    classes = S.cut(rows.where("n > 0").groupBy("node", "check").agg(F.min("named").alias("named"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    name = name_of_sets(classes)
    rows, classes = rows.withColumn("node", name), classes.withColumn("node", name)
    pairs, crowds = candidates(classes, percent)
    pairs, crowd = S.gathered(pairs), S.gathered(members(classes, S.gathered(crowds)))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowd.select("node")).distinct()
    sketch = sketch_of(classes.join(ends, "node", "left_semi"), "named")
    sets = docs.select(_sets(shingle, sketch)(named, F.col(text)).alias("s")).where("s.n > 0").select("s.*").withColumn("node", name)
    sets = S.gathered(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("packed").alias("packed")), 5000)
    # the best candidate of each node first
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "equal").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "equal"))
    best = both.groupBy("u").agg(F.max_by("v", F.struct("equal", -F.col("v"))).alias("v"))
    links = S.gathered(confirmed(best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), sets, percent))
    roots = S.gathered(components(links))
    # then every other candidate between classes that these links leave apart
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
    more = S.gathered(confirmed(apart, sets, percent))
    joined = [components(more.select(F.col("ra").alias("a"), F.col("rb").alias("b")))] if not more.isEmpty() else []
    # then all pairs of crowds that are still apart
    known = crowd.join(roots, "node", "left").select("tree", "prefix", "node", F.coalesce("root", "node").alias("root"))
    last = S.gathered(crowd_links(through(known, joined), sets, percent))
    if not last.isEmpty():
        joined.append(components(last))
    labelled = through(rows.select("doc_id", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), joined)
    least = labelled.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = labelled.join(least, "root", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; of rows with the kept doc_id, all stay."""
    own = S.free_name(docs, "_drop")
    drop = near_duplicates(docs, doc_id, text, shingle, percent).where("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(drop, F.col(doc_id).cast("long") == F.col(own), "left_anti")


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(S.table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
