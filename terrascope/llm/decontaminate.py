"""Benchmark decontamination by template canonicalisation.

Texts are read as words without edge punctuation, lower-cased, in which numbers,
units after a number, and names (capitalised words inside a sentence) become
typed placeholders; the words they stand for are the *slots*.  Windows of
``window`` template words are hashed, and documents meet benchmark items by a
hash join of windows, so a question with other numbers or names is still found.
A pair of document and item is reported when the matched windows cover enough of
the item (``min_cover`` of its windows, or ``min_run`` windows for a long one)
and the slots agree: each slot word of the item must stand for one word of the
document throughout (``min_consistent`` of the slot words do).  Both are judged
for each occurrence of the item in the document and for the document as a whole;
one that passes reports the pair.  An occurrence is a band of equal or near
offsets (position in the document less position in the item), no wider than the
item, so that two copies are never in one band.

Windows with fewer than ``min_literals`` plain words are no templates: a row of
numbers says nothing.  They are met as written (by a hash of their words), and as
a template where one of ``LONGER`` words around them has enough plain words; so
every item has a key at each place.  ``total`` counts all
places; the cover of the template windows alone decides too.  Items shorter than a window are one window of their own
length; one of fewer than ``min_words`` words, which inside a text cannot be told from
chance, is met by documents that are that item and nothing else.  The first word of an item counts both as a word and as a name, since
its capital says nothing.

Benchmark windows set bits of a bitmap of fixed size, which is sent to the tasks
that read the documents; a document window whose bit is not set is dropped there,
the rest are joined with the benchmark windows, so false hits of the bitmap cost
time only.  The join is a shuffle join that Spark may turn into a broadcast by
its own size limit.

Edge cases: null and empty texts match nothing; repeated document rows are
reported each, repeated items with the same id count as one; a null item id is an
item of its own; empty tables give empty results; other columns are ignored by
``matches`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, hash_bitmap, in_bitmap, keep_table, ship, stable_rows, with_row, without_rows
from terrascope.llm.textvec import Words, mix, sequence_hash, text_slices

#: Number words and units.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen
half twice first second third""".split()
UNIT_WORDS = """km m cm mm mile miles meter meters metre metres kilometer kilometers foot feet inch inches yard yards kg g mg
gram grams kilogram kilograms ton tons pound pounds ounce ounces liter liters litre litres ml gallon gallons second seconds
minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree
degrees celsius fahrenheit volt volts watt watts joule joules newton newtons hertz byte bytes""".split()

#: Lengths of the longer windows where names and numbers are dense.
LONGER = (12, 16, 24)
_LITERAL = np.uint64(1004)
_WHOLE = np.uint64(0x51ED270B9F3C6A85)
#: Fixed value: words that an occurrence may be shifted by words put in or left out.
BAND = 8

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_INNER = np.zeros(256, dtype=bool)  # second byte of a capitalised word
_INNER[97:123] = True
_INNER[0x80:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_NUMBER, _UNIT, _NAME = (mix(np.array([i], dtype=np.uint64))[0] for i in (1001, 1002, 1003))


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return np.sort(Words(data, np.array([0, len(data)])).hash)


_NUMBER_HASH, _UNIT_HASH = _hashes(NUMBER_WORDS), _hashes(UNIT_WORDS)


def template(data: np.ndarray, offs: np.ndarray):
    """``(literal, canon, slot, capital, bound)`` of the words of a slice: hash of
    each word, of its template word, whether that is a placeholder, whether it is
    capitalised; text ``d`` owns ``bound[d]:bound[d+1]``."""
    n = len(data)
    w = Words(data, offs, hashes=False)
    if not len(w.start):
        z = np.zeros(0, dtype=np.uint64)
        return z, z, np.zeros(0, bool), np.zeros(0, bool), w.bound
    at = np.arange(n)
    after = np.minimum.accumulate(np.where(_PUNCT[data], n, at)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(_PUNCT[data], -1, at))
    start = np.minimum(after[w.start], w.end)
    end = np.maximum(before[w.end - 1] + 1, start)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    # a sentence starts at a text, after a stop sign and at a new line
    begins = np.zeros(len(start), dtype=np.int64)
    begins[1:] = _STOP[data[w.end[:-1] - 1]] | (lines[w.start[1:]] > lines[w.end[:-1]])
    of = np.repeat(np.arange(len(offs) - 1), np.diff(w.bound))
    kept = np.flatnonzero(end > start)
    start, end, of, begins = start[kept], end[kept], of[kept], np.cumsum(begins)[kept]
    if not len(kept):
        z = np.zeros(0, dtype=np.uint64)
        return z, z, np.zeros(0, bool), np.zeros(0, bool), np.zeros(len(offs), dtype=np.int64)
    opens = np.ones(len(kept), dtype=bool)
    opens[1:] = (begins[1:] > begins[:-1]) | (of[1:] != of[:-1])
    literal = w.span_hash(start, end)
    number = _DIGIT[data[start]] | np.isin(literal, _NUMBER_HASH)
    unit = np.isin(literal, _UNIT_HASH)
    unit[1:] &= number[:-1] & (of[1:] == of[:-1])
    unit[0] = False
    second = data[np.minimum(start + 1, n - 1)]
    latin = (data[start] == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    third = data[np.minimum(start + 2, n - 1)]
    capital = (_UPPER[data[start]] & _INNER[second] & (end - start > 1)) | (latin & _INNER[third] & (end - start > 2))
    name = capital & ~opens & ~number & ~unit
    canon = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, literal)))
    return literal, canon, number | unit | name, capital, np.searchsorted(of, np.arange(len(offs)))


def _windows(canon: np.ndarray, slot: np.ndarray, n: int, min_literals: int):
    """``(hash, usable)`` of every window of ``n`` template words."""
    h = sequence_hash(canon, n)
    run = np.concatenate(([0], np.cumsum(~slot)))
    return h, run[n:n + len(h)] - run[:len(h)] >= min(min_literals, n)


def _literal_windows(literal: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words as written; no template has it."""
    return mix(sequence_hash(literal, n) ^ _LITERAL)


def _whole_texts(literal: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` words as a whole text; no window has it."""
    return mix(sequence_hash(literal, n) ^ _WHOLE)


def benchmark_windows(items: DataFrame, window: int, min_literals: int, min_words: int, id_column: str,
                      text_column: str) -> DataFrame:
    """``(item_id, at, total, usable, n, h, plain, slots)``: the windows of every
    item; ``total`` is its number of windows, ``usable`` of templates among them;
    ``plain``: the key is that of the words as written."""
    def run(batches):
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(1)):
                literal, canon, slot, capital, bound = template(data, offs)
                rows = []
                for d in range(b - a):
                    s, e = bound[d], bound[d + 1]
                    n = min(window, e - s)
                    if not n:
                        continue
                    h, ok = _windows(canon[s:e], slot[s:e], n, min_literals)
                    size, usable = len(h), int(ok.sum())

                    def add(i, at, n, key, mark, plain=False):
                        words = literal[s + i:s + i + n]
                        rows.append((a + d, int(at), size, usable, int(n), int(key.view(np.int64)), plain,
                                     words[mark].view(np.int64)))
                    if n < min_words:
                        usable = 0
                        add(0, 0, n, _whole_texts(literal[s:e], n)[0], np.zeros(n, dtype=bool), True)
                        continue
                    for i in np.flatnonzero(ok):
                        words = slice(s + i, s + i + n)
                        add(i, i, n, h[i], slot[words])
                        if i == 0 and capital[s]:
                            other = canon[words].copy()
                            other[0] = _NAME if not slot[s] else literal[s]
                            mark = slot[words].copy()
                            mark[0] = not slot[s]
                            add(0, 0, n, sequence_hash(other, n)[0], mark)
                    if usable == size:
                        continue
                    written = _literal_windows(literal[s:e], n)
                    longer = [(m, *_windows(canon[s:e], slot[s:e], m, min_literals)) for m in LONGER if n < m <= e - s]
                    for i in np.flatnonzero(~ok):
                        add(i, i, n, written[i], np.zeros(n, dtype=bool), True)
                        for m, g, fits in longer:
                            j = min(i, len(g) - 1)  # at the end of an item it reaches back
                            if fits[j]:
                                add(j, i, m, g[j], slot[s + j:s + j + m])
                                break
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                         pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64()),
                         pa.array(cols[6], pa.bool_()), pa.array(cols[7], pa.list_(pa.int64()))],
                        names=["item_id", "at", "total", "usable", "n", "h", "plain", "slots"])

    one = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text_column).cast("string").alias("text"))
    return one.dropDuplicates().mapInArrow(run, "item_id long, at int, total int, usable int, n int, h long, "
                                        "plain boolean, slots array<long>")


def matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            item_column: str = "item_id", item_text_column: str = "text", window: int = 8, min_literals: int = 5,
            min_words: int = 4, min_cover: float = 0.5, min_run: int = 6, min_consistent: float = 0.8) -> DataFrame:
    """``(__row, id, item_id, matched, total, cover, slots, consistent, exact)`` of
    every contaminated pair; ``exact``: no slot was changed."""
    ship(docs.sparkSession)
    asked = keep_table(benchmark_windows(items, window, min_literals, min_words, item_column, item_text_column), "windows")
    # at most window - min_words + 1 lengths of either kind, and LONGER
    lengths = sorted((r.n, r.plain) for r in asked.select("n", "plain").distinct().collect())
    bits = hash_bitmap(asked, "h")

    def run(batches):
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(2)):
                literal, canon, slot, _, bound = template(data, offs)
                first = np.repeat(np.arange(b - a), np.diff(bound))
                for n, plain in lengths:
                    if len(canon) < n:
                        continue
                    if n < min_words:
                        h = _whole_texts(literal, n)
                        ok = np.zeros(len(h), dtype=bool)
                        ok[bound[:-1][np.diff(bound) == n]] = True
                    elif plain:
                        h = _literal_windows(literal, n)
                        ok = np.ones(len(h), dtype=bool)
                    else:
                        h, ok = _windows(canon, slot, n, min_literals)
                    ok &= first[:len(h)] == first[n - 1:n - 1 + len(h)]
                    ok &= in_bitmap(bits, h)
                    hit = np.flatnonzero(ok)
                    if len(hit):
                        values = [literal[i:i + n][slot[i:i + n] & (not plain)].view(np.int64) for i in hit]
                        at = pa.array(a + first[hit])
                        pos = hit - bound[first[hit]]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(hit), n), pa.int32()),
                             pa.array(h[hit].view(np.int64)), pa.array(pos), pa.array(values, pa.list_(pa.int64()))],
                            names=[ROW, "id", "n", "h", "pos", "d_slots"])

    found = with_row(docs, id_column, text_column).mapInArrow(
        run, f"{ROW} long, id long, n int, h long, pos long, d_slots array<long>")
    # bands of offsets: the whole document, the item's length, a few words; each also shifted by half
    offset, length = F.col("pos") - F.col("at"), F.col("total") + F.least("n", F.lit(window)) - 1
    bands = [F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("band"))]
    for k, width in enumerate((length, F.least(length, F.lit(BAND)))):
        for shift in (0, 1):
            at = F.floor((offset + F.lit(shift) * F.floor(width / 2)) / width)
            bands.append(F.struct(F.lit(1 + 2 * k + shift).alias("kind"), at.alias("band")))
    hits = keep_table(found.join(asked, ["h", "n"]), "hits")
    pairs = hits.withColumn("place", F.explode(F.array(*bands)))
    key = [ROW, "id", "item_id", "total", "place"]
    of_template = F.when(~F.col("plain") & (F.col("n") <= window), F.col("at"))
    cover = pairs.groupBy(*key).agg(F.countDistinct("at").alias("matched"), F.countDistinct(of_template).alias("templates"),
                                    F.max("usable").alias("usable"))
    slots = pairs.select(*key, F.explode(F.arrays_zip("slots", "d_slots")).alias("s")).select(
        *key, F.col("s.slots").alias("mine"), F.col("s.d_slots").alias("theirs"))
    # a slot word agrees where it has one reading in the occurrence
    read = slots.groupBy(*key, "mine").agg(F.countDistinct("theirs").alias("readings"),
                                           F.bool_and(F.col("mine") == F.col("theirs")).alias("same"))
    agree = read.groupBy(*key).agg(F.count("*").alias("slots"), F.avg((F.col("readings") == 1).cast("double")).alias("share"),
                                   F.bool_and("same").alias("same"))
    on = [F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in key]
    out = cover.alias("c").join(agree.alias("s"), on, "left").select(
        *[F.col(f"c.{x}").alias(x) for x in key], "matched", "templates", "usable", F.coalesce("slots", F.lit(0)).alias("slots"),
        F.coalesce("share", F.lit(1.0)).alias("consistent"), F.coalesce("same", F.lit(True)).alias("exact"))
    # where names and numbers are dense, a changed copy meets the templates only
    part = F.when(F.col("usable") > 0, F.col("templates") / F.col("usable"))
    out = out.withColumn("cover", F.greatest(F.col("matched") / F.col("total"), part))
    out = out.where(((F.col("cover") >= min_cover) | (F.col("matched") >= min_run)) & (F.col("consistent") >= min_consistent))
    # the widest cover of a pair, unchanged slots first
    best = F.max(F.struct("cover", "matched", "exact", "consistent", "slots", "total")).alias("b")
    return out.groupBy(ROW, "id", "item_id").agg(best).select(
        ROW, "id", "item_id", "b.matched", "b.total", "b.cover", "b.slots", "b.consistent", "b.exact")


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item (all columns unchanged)."""
    docs = stable_rows(docs)
    return without_rows(docs, matches(docs, items, **options).select(ROW).distinct(), ROW)
