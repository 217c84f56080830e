"""Exact n-gram Jaccard self-join of documents, in size-banded tiles.

A document is its set of distinct word n-grams (64-bit hashes).  Two documents
link when ``100 * intersection >= percent * union``.  No link is lost:

1. Documents with equal sets are one *entity* (they link to each other).
2. Any two linked entities share an n-gram among the first ``n - ceil(t n) + 1``
   of each in any common order.  The order puts n-grams that begin very many
   prefixes last (found by a first pass, at most ``max_hot`` of them), so common
   passages rarely bring documents together.
3. A *tile* holds the entities of one size band (and the band below, whose sets
   may still be large enough) that share a prefix n-gram.
4. In each tile all entities are first checked against one leader, the entity
   for which the shared n-gram comes earliest, that is the one with the fewest
   n-grams of its own.  Verified links give first groups.
5. Only tiles that still hold several groups are searched for pairs across
   groups.  A tile is cut into blocks of about ``block`` entities and each pair
   of blocks is one piece of work.  A pair is left to the tile of its first
   common prefix n-gram; each entity carries its first ``_EARLY`` shared n-grams
   to tell (a pair that they do not settle may be reported again, never lost).
6. Positions in the prefix, sizes and the bit counts of hashed bitmap signatures
   bound the overlap of a pair from above; pairs whose bound is too low go no
   further.  The sets of the others are computed again from the texts (a bitmap
   of their rows picks them in one pass) and their sorted arrays intersected.

Links between entities of one group need no search, because only the groups
(connected components) are returned.

Edge cases: null texts and texts without words have an empty set and link with
nothing (each keeps its row); fewer words than ``k`` are one n-gram; repeated
rows have equal sets; a null id counts only where no other id is in the group;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, hash_bitmap, in_bitmap, keep_table, stable_rows, with_row, without_rows
from terrascope.llm.components import components, joined
from terrascope.llm.textvec import Words, text_slices

_BITS = 2048  # of a bitmap signature
_EARLY = 16
_SIGNED = f"{ROW} long, id long, entity long, n long, prefix array<long>, bitmap binary"


def prefix_length(n: int, percent: int) -> int:
    """N-grams of a set of ``n`` of which a linked set must share one."""
    return n - -(-percent * n // 100) + 1


def _entity(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(_BITS, dtype=bool)
    bits[(s & np.uint64(_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def signatures(rows: DataFrame, k: int, percent: int, hot: np.ndarray | None = None,
               hot_rank: np.ndarray | None = None) -> DataFrame:
    """Entity, set size, prefix and bitmap of every row; n-grams in ``hot`` (a
    sorted array) come last in the order, by ``hot_rank``."""
    hot = np.zeros(0, np.uint64) if hot is None else hot

    def run(batches):
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(2)):
                w = Words(data, offs)
                entity, n, prefix, maps = [], [], [], []
                for d in range(b - a):
                    s = w.shingles(d, k)
                    n.append(len(s))
                    if not len(s):
                        entity.append(None)
                        prefix.append(np.zeros(0, np.int64))
                        maps.append(None)
                        continue
                    entity.append(_entity(s))
                    maps.append(_bitmap(s))
                    order = s
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                        late = hot[at] == s
                        if late.any():
                            order = np.concatenate((s[~late], s[late][np.argsort(hot_rank[at[late]], kind="stable")]))
                    prefix.append(order[:prefix_length(len(s), percent)].view(np.int64))
                edge = np.concatenate(([0], np.cumsum([len(p) for p in prefix])))
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(entity, pa.int64()),
                     pa.array(n, pa.int64()), lists, pa.array(maps, pa.binary())],
                    names=[ROW, "id", "entity", "n", "prefix", "bitmap"])

    return rows.mapInArrow(run, _SIGNED)


def hot_ngrams(rows: DataFrame, k: int, percent: int, least: int = 64, max_hot: int = 1 << 18):
    """``(sorted hashes, ranks)`` of the n-grams that begin the most prefixes."""
    counts = (signatures(rows, k, percent).select(F.explode("prefix").alias("g")).groupBy("g")
              .agg(F.count("*").alias("c")).where(F.col("c") >= least))
    counts = keep_table(counts, "hot")
    # the least count that leaves at most max_hot of them
    step = F.floor(F.log2(F.col("c")) * 16)
    histogram = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("m"), F.min("c").alias("low")).collect(), reverse=True)
    held, bound = 0, None
    for r in histogram:
        held += r.m
        if held > max_hot:
            break
        bound = r.low
    if bound is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.where(F.col("c") >= bound).toArrow()
    g, c = got["g"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(g)
    return g[order], c[order]


def _possible(na, nb, apart, percent: int):
    """Sets of these sizes that differ in ``apart`` n-grams or more may link."""
    return apart * (100 + percent) <= (na + nb) * (100 - percent)


def _apart(bits: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray) -> np.ndarray:
    """N-grams by which sets differ at least, from their bitmaps (rows of words):
    rows ``x`` of ``bits`` against rows ``y`` of ``other``, a word at a time, so
    that no bitmap is copied per pair."""
    apart = np.zeros(len(x), dtype=np.int64)
    for j in range(bits.shape[1]):
        apart += np.bitwise_count(bits[:, j][x] ^ other[:, j][y])
    return apart


def _rows_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def bounded(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose bitmaps leave a link possible; ``bitmaps``:
    (entity, n, bitmap)."""
    one = pairs.join(bitmaps.select(F.col("entity").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma")), "a")
    two = one.join(bitmaps.select(F.col("entity").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb")), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                at = np.arange(batch.num_rows)
                ok = _possible(na, nb, _apart(_rows_of(batch.column(4)), at, _rows_of(batch.column(5)), at), percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return two.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, rows: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link, by intersecting their sets; ``reps``:
    (entity, row), a row of each entity.

    A set names its entity, so the sets go straight from the texts to the pairs: one
    shuffle of them serves both joins, and they are not written.  (A copy of a wanted
    row that the bitmap lets pass too repeats a pair.)"""
    wanted = pairs.select(F.col("a").alias("entity")).union(pairs.select(F.col("b").alias("entity"))).distinct()
    bits = hash_bitmap(wanted.join(reps, "entity").select(F.xxhash64("row").alias("h")), "h", 25)

    def sets_of(batches):
        for batch in batches:
            chosen = np.flatnonzero(in_bitmap(bits, batch.column(0).to_numpy().view(np.uint64)))
            if not len(chosen):
                continue
            part = batch.take(pa.array(chosen))
            for a, b, data, offs in text_slices(part.column(1)):
                w = Words(data, offs)
                found = [w.shingles(d, k) for d in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_entity(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["entity", "s"])

    sets = rows.select(F.xxhash64(ROW).alias("h"), "text").mapInArrow(sets_of, "entity long, s binary")
    # the pairs' first members are many, the second may be one leader of many
    one = pairs.join(sets.select(F.col("entity").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("entity").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    return two.mapInArrow(run, "a long, b long")


def cross_pairs(members: DataFrame, percent: int, chunk: int = 1 << 19) -> DataFrame:
    """Pairs across groups that the bounds leave, of the rows of each piece of
    work: (piece, entity, n, pos, part, home, side, bitmap, early); ``side`` 0 and
    1 are two blocks to be compared with each other, 2 is one block; ``early``:
    the entity's first shared n-grams with their positions."""
    def pairs_of(t: pa.Table):
        piece, entity, n, pos, part, home, side = (t.column(i).to_numpy() for i in range(7))
        bits = np.asfortranarray(_rows_of(t.column(7)))
        m = len(piece)
        early = np.zeros((m, _EARLY), dtype=np.int64)
        early_at = np.full((m, _EARLY), np.iinfo(np.int32).max, dtype=np.int64)
        lists = t.column(8).combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(m), count)
        slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        values = lists.flatten()
        early[row, slot] = values.field("g").to_numpy()
        early_at[row, slot] = values.field("pos").to_numpy()
        end = np.searchsorted(piece, piece, side="right")
        follow = end - np.arange(m) - 1
        edge = np.concatenate(([0], np.cumsum(follow)))
        found = []
        a0 = 0
        while a0 < m:
            a1 = max(a0 + 1, int(np.searchsorted(edge, edge[a0] + chunk, side="right")) - 1)
            x = np.repeat(np.arange(a0, a1), follow[a0:a1])
            y = x + 1 + np.arange(len(x)) - np.repeat(edge[a0:a1] - edge[a0], follow[a0:a1])
            a0 = a1
            ok = (part[x] != part[y]) & (home[x] | home[y]) & ((side[x] != side[y]) | (side[x] == 2))
            x, y = x[ok], y[ok]
            ok = ((100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                  & _possible(n[x], n[y], pos[x] + pos[y] + abs((n[x] - pos[x]) - (n[y] - pos[y])), percent))
            x, y = x[ok], y[ok]
            ok = _possible(n[x], n[y], _apart(bits, x, bits, y), percent)
            x, y = x[ok], y[ok]
            for c in range(0, len(x), 20_000):
                p, q = x[c:c + 20_000], y[c:c + 20_000]
                sooner = ((early[p][:, :, None] == early[q][:, None, :])
                          & (early_at[p] < pos[p, None])[:, :, None] & (early_at[q] < pos[q, None])[:, None, :])
                first = ~sooner.any(axis=(1, 2))
                p, q = entity[p[first]], entity[q[first]]
                if len(p):
                    found.append(np.stack((np.minimum(p, q), np.maximum(p, q))))
        if found:
            p = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            piece = t.column(0).to_numpy()
            last = int(np.searchsorted(piece, piece[-1]))
            held = t.slice(last)  # the last piece may go on
            if last and (out := pairs_of(t.slice(0, last).combine_chunks())) is not None:
                yield out
        if held is not None and (out := pairs_of(held.combine_chunks())) is not None:
            yield out

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n, "piece").sortWithinPartitions("piece", "entity")
    return dealt.select("piece", "entity", "n", "pos", "part", "home", "side", "bitmap", "early").mapInArrow(
        run, "a long, b long")


def _entries(chosen: DataFrame, bits: np.ndarray) -> DataFrame:
    """``(entity, n, pos, g)`` of the prefix n-grams that a bitmap lets pass."""
    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            g = lists.flatten().to_numpy()
            count = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(count)), count)
            pos = np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
            at = np.flatnonzero(in_bitmap(bits, g.view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[at])), batch.column(1).take(pa.array(row[at])),
                 pa.array(pos[at].astype(np.int32)), pa.array(g[at])], names=["entity", "n", "pos", "g"])

    return chosen.select("entity", F.col("n").cast("int").alias("n"), "prefix").mapInArrow(
        run, "entity long, n int, pos int, g long")


def linked_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
                  block: int = 2048) -> DataFrame:
    """``(__row, id, n_shingles, component_id, first)`` of every row: the smallest
    id reachable by links, and whether the row is the one to keep of its group
    (smallest id, then first row; a row without n-grams is its own group)."""
    rows = with_row(docs, id_column, text_column)
    hot, rank = hot_ngrams(rows, k, percent)
    signed = keep_table(signatures(rows, k, percent, hot, rank), "signatures")
    rep = F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), F.col(ROW).alias("row"))
    entities = keep_table(signed.where("entity is not null").groupBy("entity").agg(F.min(rep).alias("rep")), "entities")
    reps = entities.select("entity", F.col("rep.row").alias("row"))
    # the one row of each entity that stands for it
    chosen = signed.join(reps.select(F.col("row").alias(ROW)), ROW, "left_semi")

    # n-grams that begin several rows; copies count too, tiles of one entity go later
    shared = signed.select(F.explode("prefix").alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    shared = keep_table(shared.where("c > 1").select("g"), "shared")
    entries = keep_table(_entries(chosen, hash_bitmap(shared, "g", 25)).join(shared, "g"), "entries")
    early = entries.groupBy("entity").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "g"))), 1, _EARLY).alias("early"))
    # sizes of linked sets differ by less than the ratio of two bands
    ratio = 1.001 * 100 / percent
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(ratio))).cast("int")
    tiles = entries.withColumn("band", band).select("g", "entity", "n", "pos", F.explode(F.array(
        F.struct(F.col("band").alias("band"), F.lit(True).alias("home")),
        F.struct((F.col("band") + 1).alias("band"), F.lit(False).alias("home")))).alias("at"))
    tiles = tiles.select(F.xxhash64("g", "at.band").alias("tile"), "at.home", "entity", "n", "pos")
    tile = tiles.groupBy("tile").agg(F.count("*").alias("c"), F.count_if("home").alias("homes"),
                                     F.min(F.struct("pos", "entity", "n")).alias("l")).where("c > 1 and homes > 0")
    tile = tile.select("tile", F.col("l.pos").alias("l_pos"), F.col("l.entity").alias("l_entity"), F.col("l.n").alias("l_n"))

    # one leader per tile
    led = tiles.join(tile, "tile").where("entity != l_entity")
    led = led.where(_possible(F.col("n"), F.col("l_n"), F.col("pos") + F.col("l_pos") + F.abs(
        (F.col("n") - F.col("pos")) - (F.col("l_n") - F.col("l_pos"))), percent))
    stars = keep_table(led.select(F.col("entity").alias("a"), F.col("l_entity").alias("b")).distinct(), "stars")
    likely = keep_table(bounded(stars, chosen.select("entity", "n", "bitmap"), percent), "likely")
    links = keep_table(verify(likely, rows, reps, k, percent), "links")
    groups = keep_table(components(links, "a", "b"), "groups")

    # tiles that still hold several groups
    placed = tiles.join(groups, F.col("entity") == F.col("node"), "left").select(
        "tile", "home", "entity", "n", "pos", F.coalesce("component", F.col("entity")).alias("part"))
    split = (placed.groupBy("tile").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("c"), F.count_if("home").alias("homes"))
        .where("p != q and homes > 0").select("tile", F.ceil(F.col("c") / block).cast("int").alias("blocks")))
    left = placed.join(split, "tile").withColumn("mine", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    work = left.select(F.xxhash64("tile", low, high).alias("piece"), "entity", "n", "pos", "part", "home", side.alias("side"))
    work = work.join(chosen.select("entity", "bitmap").join(early, "entity"), "entity")
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = keep_table(cross_pairs(work, percent).distinct().join(tried, ["a", "b"], "left_anti"), "crossing")
    groups = joined(groups, verify(crossing, rows, reps, k, percent), "a", "b")

    named = entities.join(groups, F.col("entity") == F.col("node"), "left").select(
        "entity", "rep", F.coalesce("component", "entity").alias("component"))
    named = keep_table(named, "named")
    chiefs = named.groupBy("component").agg(F.min("rep").alias("chief"))
    of_entity = named.join(chiefs, "component").select(F.col("entity").alias("e"), "chief")
    out = signed.select(ROW, "id", "entity", "n").join(of_entity, F.col("entity") == F.col("e"), "left")
    alone = F.col("entity").isNull()
    return out.select(ROW, "id", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("id")).otherwise(F.col("chief.id")).alias("component_id"),
                      (alone | (F.col(ROW) == F.col("chief.row"))).alias("first"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each linked group (all columns unchanged)."""
    docs = stable_rows(docs)
    groups = linked_groups(docs, k, percent, id_column, text_column)
    return without_rows(docs, groups.where(~F.col("first")), ROW)
