"""Class-based bigram language model with exchange clustering (Brown et al.).

``p(w | previous) = p(class(w) | class(previous)) * p(w | class(w))``.

* Units.  Each of the at most ``table_words`` most frequent words is a unit of
  its own; a word beyond them belongs to one of ``suffix_buckets`` units by its
  last three bytes, as unseen words do.  The document end is a unit and a class
  of its own and also stands before the first word.
* Clustering.  Spark counts the neighbours of every unit over the whole training
  text and packs them into a row per unit (several for a frequent one).  The
  exchange algorithm first runs in memory on ``clustered_words`` words and
  ``seed_groups`` suffix groups, for a start.  Then sweeps run over that table
  without a shuffle, but for frequent units: a unit's neighbours are summed by
  class, and it moves to the class that raises the likelihood of the class bigrams most.  The driver
  holds the class totals and one class per unit; a sweep that does not raise the
  likelihood is taken back and ends the clustering.
* Emission.  Exact counts of all training words.  Each seen word gives up an
  absolute discount (from the numbers of words seen once and twice); what the
  words of a class give up is the probability of an unseen word there.  The
  probabilities after any class sum to one over all seen words and one unseen
  word per class.
* Transitions are smoothed towards the class frequencies by the number of
  different successors.

Word counts are a table (word hash, count).  Scoring reads every text once: the
at most ``table_words`` most frequent words are looked up in a broadcast array,
the rest are joined with the count table on their hash.  No word of the joined
part is frequent, so the join has no hot key.

Edge cases: a null or empty text is its end alone; repeated rows are counted and
scored each; without training text every token is unseen; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, keep_table, with_row
from terrascope.llm.textvec import Words, mix, text_slices

_END = np.uint64(0xE5D0C0DE00000001)  # stands for the document end among word hashes
_FLUSH = 1_000_000  # distinct words that a task holds before it emits them


@dataclass
class Model:
    """Arrays of a trained model; ``words`` is the table of all training words."""
    words: DataFrame = field(repr=False)
    total: int          # training tokens N
    kinds: int          # distinct training tokens V
    ends: int           # training documents
    least: int          # words with fewer occurrences are not in the arrays
    discount: float
    table: np.ndarray = field(repr=False)       # sorted hashes of the frequent words
    table_count: np.ndarray = field(repr=False)
    table_class: np.ndarray = field(repr=False)
    bucket_class: np.ndarray = field(repr=False)
    trans: np.ndarray = field(repr=False)       # log10 p(class | class)
    class_total: np.ndarray = field(repr=False)
    class_kinds: np.ndarray = field(repr=False)
    top: list = field(repr=False, default_factory=list)  # (hash, count, class) of the clustered words


def suffix_bucket(w: Words, buckets: int) -> np.ndarray:
    """Bucket of every word by its last three bytes."""
    code = np.zeros(len(w.end), dtype=np.uint64)
    for j in range(1, 4):
        at = w.end - j
        code = (code << np.uint64(8)) | np.where(at >= w.start, w.low[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix(code + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)


def _sum_by(keys: np.ndarray, values: np.ndarray):
    kinds, which = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(which, weights=values, minlength=len(kinds)).astype(np.int64)


def word_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """``(h, bucket, n)``: occurrences of every word and of the document end."""
    def run(batches):
        held: list = []
        size = ends = 0

        def merged():
            h = np.concatenate([x[0] for x in held])
            kinds, n = _sum_by(h, np.concatenate([x[2] for x in held]))
            _, first = np.unique(h, return_index=True)
            return kinds, np.concatenate([x[1] for x in held])[first], n

        def emit(h, bucket, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(bucket), pa.array(n)],
                                              names=["h", "bucket", "n"])
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(0)):
                w = Words(data, offs)
                ends += b - a
                h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((h, suffix_bucket(w, buckets)[first], n))
                size += len(h)
                if size > 2 * _FLUSH:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > _FLUSH:
                        yield emit(*held.pop())
                        size = 0
        if held:
            yield emit(*merged())
        if ends:
            yield emit(np.array([_END]), np.array([-1], dtype=np.int32), np.array([ends]))

    return (rows.select("text").mapInArrow(run, "h long, bucket int, n long")
            .groupBy("h", "bucket").agg(F.sum("n").alias("n")))


def _lookup(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Position of each hash in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _merged(held: list):
    return _sum_by(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))


def _summed(parts):
    """``(keys, sums)`` blocks of the ``(keys, values)`` in ``parts``, each key about once."""
    held, size = [], 0
    for keys, values in parts:
        held.append(_sum_by(keys, values))
        size += len(held[-1][0])
        if size > 2 * _FLUSH:
            held = [_merged(held)]
            size = len(held[0][0])
            if size > _FLUSH:
                yield held.pop()
                size = 0
    if held:
        yield _merged(held)


def _blocks(keys: np.ndarray, n: np.ndarray, names: list, split: int):
    """Record batches of 100,000 rows: a key is ``first * split + second``."""
    for a in range(0, len(keys), 100_000):
        k = keys[a:a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(k // split, pa.int32()), pa.array(k % split, pa.int32()),
                                          pa.array(n[a:a + 100_000])], names=names)


def _packed(unit: np.ndarray, piece: np.ndarray, link: np.ndarray, n: np.ndarray, kind) -> pa.RecordBatch:
    """One row per (unit, piece) of links sorted by them: the links (32 bit) and their
    counts (``kind``) as bytes."""
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    ends = np.append(first, len(unit))

    def blobs(x: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [
            None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    return pa.RecordBatch.from_arrays(
        [pa.array(unit[first], pa.int32()), pa.array(piece[first], pa.int32()), blobs(link.astype(np.int32)), blobs(n.astype(kind))],
        names=["unit", "piece", "links", "counts"])


SCHEMA = "unit int, piece int, links binary, counts binary"


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """``(values, bounds)`` of a column of packed numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return values, (ends - ends[0]) // size


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(units, row of every link, links, counts)`` of a batch of the links table."""
    link, bounds = _flat(batch.column(2), np.int32)
    n, _ = _flat(batch.column(3), np.int64)
    return batch.column(0).to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(bounds)), link, n


#: Occurrences of a unit whose links go into one piece, at most.
PIECE = 1 << 21


def unit_pieces(count: np.ndarray, most: int = PIECE) -> np.ndarray:
    """Into how many pieces the links of each unit are cut: by its occurrences, so that
    what a task merges for one piece is bounded whatever the corpus."""
    return np.maximum(1, -(-count // most)).astype(np.int64)


def unit_links(rows: DataFrame, table: np.ndarray, first_bucket: int, buckets: int, pieces: np.ndarray) -> DataFrame:
    """``(unit, piece, links, counts)``: how often each unit stands beside another, over all
    texts; link = 2 * other unit, plus 1 where the other one follows.  Word ``table[i]`` is
    unit 1 + i, the rest are their suffix units.  The links of a unit are packed into one
    row, those of a ``frequent`` unit into a row per piece (by the other unit)."""
    units = first_bucket + buckets

    def place(unit, other):
        cut = pieces[unit]
        return np.where(cut > 1, (mix(other.astype(np.uint64)) % cut.astype(np.uint64)).astype(np.int64), 0)

    def run(batches):
        def parts():
            for batch in batches:
                for _, _, data, offs in text_slices(batch.column(0)):
                    w = Words(data, offs)
                    at = _lookup(table, w.hash)
                    unit = np.where(at >= 0, 1 + at, first_bucket + suffix_bucket(w, buckets))
                    unit = np.insert(unit, w.bound[1:], 0)
                    before = np.concatenate(([0], unit[:-1]))
                    yield before * units + unit, np.ones(len(unit), dtype=np.int64)
        for pair, n in _summed(parts()):
            u, v = pair // units, pair % units
            for unit, other, side in ((u, v, 1), (v, u, 0)):
                piece = place(unit, other)
                order = np.lexsort((piece, unit))
                for a in range(0, len(order), 200_000):
                    some = order[a:a + 200_000]
                    yield _packed(unit[some], piece[some], 2 * other[some] + side, n[some], np.int64)

    def merge(batches):
        """Rows of one (unit, piece) lie together: their links are summed into one row."""
        held = None
        for batch in batches:
            unit, row, link, n = _unpacked(batch)
            key = unit.astype(np.int64) * (int(pieces.max()) + 1) + batch.column(1).to_numpy()
            of = key[row]
            if held is not None:
                of, link, n = (np.concatenate(x) for x in zip(held, (of, link, n)))
            last = int(key[-1])
            order = np.lexsort((link, of))
            of, link, n = of[order], link[order], n[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (link[1:] != link[:-1])
            first = np.flatnonzero(new)
            of, link, n = of[first], link[first], np.add.reduceat(n, first)
            done = int(np.searchsorted(of, last)) if (np.diff(key) >= 0).all() else 0
            held = of[done:], link[done:], n[done:]
            if done:
                yield split(of[:done], link[:done], n[:done])
        if held is not None and len(held[0]):
            yield split(*held)

    def split(of, link, n):
        width = int(pieces.max()) + 1
        out = _packed(of // width, of % width, link, n, np.int64)
        return out.append_column("frequent", pa.array(pieces[out.column(0).to_numpy()] > 1))

    return (rows.select("text").mapInArrow(run, SCHEMA).repartition("unit", "piece")
            .sortWithinPartitions("unit", "piece").mapInArrow(merge, SCHEMA + ", frequent boolean"))


def group_bigrams(links: DataFrame, group: np.ndarray, groups: int) -> np.ndarray:
    """groups x groups bigram counts, ``group`` being that of every unit."""
    def run(batches):
        def parts():
            for batch in batches:
                unit, row, link, n = _unpacked(batch)
                k = np.flatnonzero(link & 1)
                yield group[unit][row[k]].astype(np.int64) * groups + group[link[k] >> 1], n[k]
        if groups > 128:
            for key, n in _summed(parts()):
                yield from _blocks(key, n, ["a", "b", "n"], groups)
            return
        total = np.zeros(groups * groups, np.int64)
        for key, n in parts():
            total += np.bincount(key, weights=n, minlength=len(total)).astype(np.int64)
        key = np.flatnonzero(total)
        yield from _blocks(key, total[key], ["a", "b", "n"], groups)

    got = links.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((groups, groups))
    out[got["a"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
    return out


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(n: np.ndarray) -> float:
    """Class-bigram log likelihood of class totals, without what no class changes."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(axis=1)).sum() - _xlogx(n.sum(axis=0)).sum())


def gains(n: np.ndarray, cls: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Likelihood of every unit in every class, each unit taken out of its class
    ``cls`` alone: ``n`` class totals, ``right`` and ``left`` (units x classes) the
    neighbours of each unit without itself, ``own`` its bigrams with itself."""
    at = np.arange(len(cls))
    gain = np.zeros(right.shape)
    for mine, others, totals in ((right, left, n), (left, right, n.T)):
        k, c = np.nonzero(mine)  # empty cells add nothing
        if not len(k):
            continue
        a, v, row = cls[k], mine[k, c], np.arange(len(k))
        base = totals[:, c].T.copy()
        base[row, a] -= v
        same = np.flatnonzero(c == a)
        base[same] -= others[k[same]]
        base[same, a[same]] -= own[k[same]]
        term = _xlogx(base + v[:, None]) - _xlogx(base)
        term[row, c] = 0  # the diagonal follows below
        first = np.flatnonzero(np.diff(k, prepend=-1))
        gain[k[first]] += np.add.reduceat(term, first, axis=0)
    r, l, o = right.sum(axis=1), left.sum(axis=1), own[:, None]
    diagonal = np.repeat(np.diag(n)[None, :], len(cls), axis=0)
    diagonal[at, cls] -= right[at, cls] + left[at, cls] + own
    gain += _xlogx(diagonal + right + left + o) - _xlogx(diagonal)
    for side, total in ((n.sum(axis=1), r), (n.sum(axis=0), l)):
        rest = np.repeat(side[None, :], len(cls), axis=0)
        rest[at, cls] -= total + own
        gain -= _xlogx(rest + total[:, None] + o) - _xlogx(rest)
    gain[:, 0] = -np.inf
    return gain


def sweep(links: DataFrame, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes after one sweep over all units: every task moves its units one small
    group after another, keeping its own copy of the class totals ``n`` up to date.  A
    unit of one row moves in the task that reads it; the pieces of frequent units are
    summed by class first."""
    classes = len(n)
    width = 2 * classes + 1
    small = cls.astype(np.int16)

    def slots(batch):
        unit, row, link, c = _unpacked(batch)
        other, follows, own = link >> 1, link & 1, unit[row]
        slot = np.where(other == own, 2 * classes, follows * classes + small[other])
        k = np.flatnonzero((other != own) | (follows == 1))
        return unit, row[k], slot[k], c[k]

    def whole(batches):
        totals = n.copy()
        for batch in batches:
            unit, row, slot, c = slots(batch)
            counts = np.bincount(row * width + slot, weights=c, minlength=len(unit) * width).reshape(len(unit), width)
            yield moves(unit, counts, totals)

    def by_class(batches):
        def parts():
            for batch in batches:
                unit, row, slot, c = slots(batch)
                yield unit[row].astype(np.int64) * width + slot, c
        for key, c in _summed(parts()):
            yield from _blocks(key, c, ["unit", "slot", "n"], width)

    def summed(batches):
        totals = n.copy()
        for batch in batches:
            unit = batch.column(0).to_numpy()
            of = np.repeat(np.arange(len(unit)), np.diff(batch.column(1).offsets.to_numpy()))
            x = batch.column(1).flatten()
            counts = np.zeros((len(unit), width))
            counts[of, x.field("slot").to_numpy()] = x.field("n").to_numpy()
            yield moves(unit, counts, totals)

    def moves(unit, counts, totals):
        to = small[unit].astype(np.int64)
        for a in range(0, len(unit), 64):
            part = np.arange(a, min(a + 64, len(unit)))
            left, right, own = counts[part, :classes], counts[part, classes:-1], counts[part, -1]
            gain = gains(totals, to[part], right, left, own)
            stay = gain[np.arange(len(part)), to[part]]
            best = gain.argmax(axis=1)
            for j in np.flatnonzero((gain.max(axis=1) > stay + 1e-9) & (unit[part] > 0)):
                old, new = to[part[j]], best[j]
                for c, sign in ((old, -1), (new, 1)):
                    totals[c, :] += sign * right[j]
                    totals[:, c] += sign * left[j]
                    totals[c, c] += sign * own[j]
                np.maximum(totals, 0, out=totals)  # units of one group may be each other's neighbours
                to[part[j]] = new
        moved = np.flatnonzero(to != small[unit])
        return pa.RecordBatch.from_arrays([pa.array(unit[moved]), pa.array(to[moved], pa.int32())], names=["unit", "to"])

    cold = links.where(~F.col("frequent")).mapInArrow(whole, "unit int, to int")
    counted = links.where("frequent").mapInArrow(by_class, "unit int, slot int, n long")
    counted = counted.groupBy("unit", "slot").agg(F.sum("n").alias("n"))
    hot = (counted.groupBy("unit").agg(F.collect_list(F.struct("slot", "n")).alias("counts")).sortWithinPartitions("unit")
           .mapInArrow(summed, "unit int, to int"))
    got = cold.unionByName(hot).toArrow()  # at most a row per unit
    out = cls.copy()
    out[got["unit"].to_numpy()] = got["to"].to_numpy()
    return out


def cluster(links: DataFrame, seed: np.ndarray, seeds: int, classes: int, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """``(class of every unit, class bigrams)``.  The seed groups (``seed`` of every
    unit) are exchanged in memory for a start; then sweeps move every unit by its
    own neighbours while the likelihood rises."""
    cls = exchange(group_bigrams(links, seed, seeds), classes, sweeps)[seed]
    n = group_bigrams(links, cls, classes)
    for _ in range(sweeps):
        to = sweep(links, cls, n)
        if (to == cls).all():
            break
        now = group_bigrams(links, to, classes)
        # tasks move units at the same time: a sweep that does not help is taken back
        if likelihood(now) <= likelihood(n):
            break
        cls, n = to, now
    return cls, n


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of every unit (unit 0, the document end, has class 0 alone).

    ``pairs``: units x units bigram counts.  Exchange algorithm: a unit is taken
    out of its class and put where the class-bigram log likelihood
    ``sum f(N[c,c']) - sum f(N[c,.]) - sum f(N[.,c'])``, f(x) = x log x, is
    highest; ties keep the present class, then the lowest."""
    def f(x):
        return x * np.log(np.maximum(x, 1e-300))
    units = len(pairs)
    weight = pairs.sum(axis=1)
    order = np.argsort(-weight[1:], kind="stable") + 1
    cls = np.zeros(units, dtype=np.int64)
    cls[order] = 1 + np.arange(units - 1) % max(classes - 1, 1)
    one = np.zeros((units, classes))
    one[np.arange(units), cls] = 1
    right, left = pairs @ one, pairs.T @ one
    n = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = cls[u], pairs[u, u]
            r, l = right[u].copy(), left[u].copy()
            r[a] -= own
            l[a] -= own
            n[a, :] -= r
            n[:, a] -= l
            n[a, a] -= own
            fn = f(n)
            gain_r, gain_l = f(n + r[None, :]) - fn, f(n + l[:, None]) - fn
            d = np.arange(classes)
            gain = gain_r.sum(axis=1) - gain_r[d, d] + gain_l.sum(axis=0) - gain_l[d, d]
            gain += f(n[d, d] + r + l + own) - fn[d, d]
            # wherever the unit goes, each class c is before it l[c] times and after it r[c] times
            out, inn = n.sum(axis=1) + l, n.sum(axis=0) + r
            gain -= f(out + r.sum() + own) - f(out) + f(inn + l.sum() + own) - f(inn)
            gain[0] = -np.inf
            b = a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
            n[b, :] += r
            n[:, b] += l
            n[b, b] += own
            if b != a:
                moved += 1
                cls[u] = b
                right[:, a] -= pairs[:, u]
                right[:, b] += pairs[:, u]
                left[:, a] -= pairs[u, :]
                left[:, b] += pairs[u, :]
        if not moved:
            break
    return cls


def train(docs: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", classes: int = 64,
          clustered_words: int = 767, suffix_buckets: int = 1 << 16, sweeps: int = 8, table_words: int = 1 << 18,
          seed_groups: int = 256, piece: int = PIECE) -> Model:
    """Fit a model on all texts of the rows of ``docs`` where ``usable``."""
    rows = with_row(docs.where(usable), id_column, text_column)
    words = keep_table(word_counts(rows, suffix_buckets), "words")
    total, kinds, once, twice, ends = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2),
        F.coalesce(F.sum(F.when(F.col("bucket") < 0, F.col("n"))), F.lit(0))).first()
    real = words.where("bucket >= 0")
    # the least count that leaves at most table_words words, from a histogram of
    # log-spaced count ranges (a thousand rows at most)
    step = F.floor(F.log2(F.col("n")) * 16)
    histogram = sorted(real.groupBy(step.alias("s")).agg(F.count("*").alias("c"), F.min("n").alias("low")).collect(), reverse=True)
    least, held = int(total) + 1, 0
    for r in histogram:
        held += r.c
        if held > table_words:
            break
        least = r.low
    frequent = real.where(F.col("n") >= least).toArrow()  # at most table_words rows
    h = frequent["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    table, count = h[order], frequent["n"].to_numpy()[order]
    bucket_of = frequent["bucket"].to_numpy().astype(np.int64)[order]
    rank = np.lexsort((table, -count))
    first_bucket = 1 + len(table)
    own = rank[:clustered_words]
    # the start: frequent words alone, all others in groups by their suffix
    groups = min(seed_groups, suffix_buckets)
    seed = np.concatenate(([0], 1 + clustered_words + bucket_of % groups, 1 + clustered_words + np.arange(suffix_buckets) % groups))
    seed[1 + own] = 1 + np.arange(len(own))
    occurrences = np.zeros(first_bucket + suffix_buckets, np.int64)
    occurrences[0], occurrences[1:first_bucket] = ends, count
    rare = real.where(F.col("n") < least).groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).collect()  # a row per bucket
    for r in rare:
        occurrences[first_bucket + r.bucket] = r.n
    pieces = unit_pieces(occurrences, piece)
    links = keep_table(unit_links(rows, table, first_bucket, suffix_buckets, pieces), "links")
    cls, n = cluster(links, seed, 1 + clustered_words + groups, classes, sweeps)
    class_total = n.sum(axis=0)
    successors = (n > 0).sum(axis=1, keepdims=True)
    prior = (class_total + 0.5) / (class_total.sum() + 0.5 * classes)
    weight = np.maximum(successors, 1)
    trans = (n + weight * prior) / (n.sum(axis=1, keepdims=True) + weight)
    bucket_class = cls[first_bucket:]
    table_class = cls[1:first_bucket]
    class_kinds = np.bincount(table_class, minlength=classes).astype(float)
    for r in rare:
        class_kinds[bucket_class[r.bucket]] += r.kinds
    discount = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
    top = [(int(table[i]), int(count[i]), int(table_class[i])) for i in own]
    return Model(words, int(total), int(kinds), int(ends), int(least), discount, table, count, table_class, bucket_class,
                 np.log10(trans), class_total, class_kinds, top)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: ``(__row, id, n_tokens, n_known, base_score, score)``."""
    m, ends = model, model.ends
    words, d, denominator = m.words, m.discount, m.total + m.kinds + 1
    buckets = len(m.bucket_class)
    with np.errstate(divide="ignore"):
        log_total = np.where(m.class_total > 0, np.log10(np.maximum(m.class_total, 1)), 0.0)
        unseen = np.where(m.class_total > 0, np.log10(np.maximum(d * m.class_kinds, 1e-9)), 0.0)
    table, table_class, count, bucket_class, trans = m.table, m.table_class, m.table_count, m.bucket_class, m.trans
    emit = np.log10(count - d) if len(count) else np.zeros(0)
    base_of = np.log10((count + 1) / denominator) if len(count) else np.zeros(0)
    end_base = float(np.log10((ends + 1) / denominator))

    def run(batches):
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(2)):
                w = Words(data, offs)
                at = _lookup(table, w.hash)
                known = at >= 0
                cls = bucket_class[suffix_bucket(w, buckets)]
                gained = np.zeros(len(at))
                base = np.zeros(len(at))
                if len(table):
                    cls = np.where(known, table_class[at], cls)
                    gained = np.where(known, emit[at], 0.0)
                    base = np.where(known, base_of[at], 0.0)
                gained -= log_total[cls]
                of = np.repeat(np.arange(b - a), np.diff(w.bound))
                path = np.insert(cls, w.bound[1:], 0)
                steps = trans[np.concatenate(([0], path[:-1])), path]
                of_step = np.insert(of, w.bound[1:], np.arange(b - a))

                def total(x, owner):
                    return np.bincount(owner, weights=x, minlength=b - a)
                rare = np.flatnonzero(~known)
                # distinct rare words of each document
                by = np.lexsort((w.hash[rare], of[rare]))
                rare = rare[by]
                new = np.ones(len(rare), dtype=bool)
                new[1:] = (w.hash[rare][1:] != w.hash[rare][:-1]) | (of[rare][1:] != of[rare][:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare)))
                one = rare[first]
                edge = pa.array(np.searchsorted(of[one], np.arange(b - a + 1)), pa.int32())
                tail = pa.StructArray.from_arrays(
                    [pa.array(w.hash[one].view(np.int64)), pa.array(times.astype(np.int32)), pa.array(unseen[cls[one]])],
                    names=["h", "times", "unseen"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(np.diff(w.bound) + 1), pa.array(total(known.astype(float), of).astype(np.int64) + (ends > 0)),
                     pa.array(total(base, of) + end_base), pa.array(total(gained, of) + total(steps, of_step)),
                     pa.ListArray.from_arrays(edge, tail)],
                    names=[ROW, "id", "n_tokens", "n_known", "base", "score", "tail"])

    part = keep_table(with_row(docs, id_column, text_column).mapInArrow(
        run, f"{ROW} long, id long, n_tokens long, n_known long, base double, score double, "
             "tail array<struct<h:long,times:int,unseen:double>>"), "scored")
    rare = words.where((F.col("bucket") >= 0) & (F.col("n") < m.least)).select("h", "n")
    tail = part.select(ROW, F.explode("tail").alias("t")).select(ROW, "t.h", "t.times", "t.unseen").join(rare, "h", "left")
    n = F.coalesce("n", F.lit(0))
    tail = tail.groupBy(F.col(ROW).alias("t_row")).agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("t_known"),
        F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(denominator)))).alias("t_base"),
        F.sum(F.col("times") * F.when(n > 0, F.log10(n - F.lit(d))).otherwise(F.col("unseen"))).alias("t_score"))
    zero = F.lit(0.0)
    return part.drop("tail").join(tail, F.col(ROW) == F.col("t_row"), "left").select(
        ROW, "id", "n_tokens", (F.col("n_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("t_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("t_score", zero)).alias("score"))
