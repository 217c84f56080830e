"""Homomorphic multiset fingerprints of documents, in DataFrame operations.

A text is a multiset of paragraphs (its lines).  Each paragraph is hashed to a
wide vector and a document's fingerprint is the sum of its paragraphs' vectors,
lane by lane modulo powers of two: the order of paragraphs does not matter, and
inserting or deleting a paragraph adds or subtracts its vector.

* ``EXACT`` lanes modulo 2**32 hold hashes of the whole paragraph: two multisets
  are equal when all lanes are (a chance of about 2**-256 otherwise).
* ``SKETCH`` lanes modulo 2**32 (as signed ints) hold, per paragraph, the number of its word
  triples whose hash has the lane's bit.  Twice a lane less the number of triples
  (kept in one more lane modulo 2**32) is a sum of random signs, so the product
  of two documents' lanes estimates how many triples they share: the likeness
  ``2 <a,b> / (|a|^2 + |b|^2)``, cut to 0..1, needs the fingerprints only.
  Paragraphs of fewer than three words count as one triple.

Every step is a projection, a join on a row number or a grouped sum with
map-side combination, so a document of any length is summed where it is read.

Edge cases: null and empty texts have the zero fingerprint (equal, likeness 1
to each other, 0 to others); repeated rows are fingerprinted each; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, bind, keep_table, with_row

EXACT = 8
SKETCH = 64
_EXACT_MOD = 1 << 32
_LOW32 = 0xFFFFFFFF
_PAIR = 0x0000000100000001  # one bit of each 32-bit half of a long


def _signed(lane: Column) -> Column:
    """The representative nearest to zero modulo 2**32."""
    half = _EXACT_MOD // 2
    return F.pmod(lane + half, F.lit(_EXACT_MOD)) - half


def _triples(text: Column) -> Column:
    """Hashes of the word triples of a line."""
    triples = bind(F.transform(F.split(text, " "), lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    return F.when(text.isNotNull(), triples)


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` plus ``exact array<long>``, ``sketch array<int>`` and ``n long``:
    the fingerprint of each text (``keys`` identify a row)."""
    lines = texts.select(*keys, F.explode_outer(
        F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x != "")).alias("p"))
    t = lines.select(*keys, "p", F.posexplode_outer(_triples(F.col("p"))).alias("at", "t"))
    # a paragraph's exact lanes ride on its first triple
    wide = [F.when(F.col("at") == 0, F.xxhash64(F.lit(i), F.col("p"))) for i in range(EXACT // 2)]
    t = t.select(*keys, "t", *[w.alias(f"w{i}") for i, w in enumerate(wide)])
    sums = t.groupBy(*keys).agg(
        F.count("t").alias("n"),
        *[F.sum(F.col(f"w{i}").bitwiseAND(F.lit(_LOW32))).alias(f"e{2 * i}") for i in range(EXACT // 2)],
        *[F.sum(F.shiftrightunsigned(f"w{i}", 32)).alias(f"e{2 * i + 1}") for i in range(EXACT // 2)],
        # two lanes in one long: bit i and bit 32 + i of the hash
        *[F.sum(F.shiftrightunsigned("t", i).bitwiseAND(F.lit(_PAIR))).alias(f"s{i}") for i in range(SKETCH // 2)])
    low = [F.col(f"s{i}").bitwiseAND(F.lit(_LOW32)) for i in range(SKETCH // 2)]
    high = [F.shiftrightunsigned(f"s{i}", 32) for i in range(SKETCH // 2)]

    def lanes(columns, modulo, kind):
        return F.array(*[F.coalesce(modulo(c), F.lit(0)).cast(kind) for c in columns])
    return sums.select(*keys, lanes([F.col(f"e{i}") for i in range(EXACT)], lambda c: F.pmod(c, F.lit(_EXACT_MOD)), "long").alias("exact"),
                       lanes(low + high, _signed, "int").alias("sketch"), F.pmod("n", F.lit(_EXACT_MOD)).alias("n"))


def combine(a: dict[str, Column], b: dict[str, Column], sign: int = 1) -> dict[str, Column]:
    """Fingerprint of a document after inserting (``sign`` 1) or deleting (-1)
    the paragraphs of ``b``: lane-wise sum or difference modulo the powers."""
    def lanes(x, y, modulo, kind):
        return F.zip_with(x, y, lambda p, q: modulo(p.cast("long") + q.cast("long") * F.lit(sign)).cast(kind))
    return {"exact": lanes(a["exact"], b["exact"], lambda c: F.pmod(c, F.lit(_EXACT_MOD)), "long"),
            "sketch": lanes(a["sketch"], b["sketch"], _signed, "int"),
            "n": F.pmod(a["n"] + b["n"] * F.lit(sign), F.lit(_EXACT_MOD))}


def text_form(fp: dict[str, Column]) -> Column:
    """A fingerprint as lower-case hex: exact lanes, triple count, sketch lanes."""
    def hexed(lanes, width):
        return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(_LOW32)))), width, "0")), "")
    return F.concat(hexed(fp["exact"], 8), F.lpad(F.lower(F.hex(fp["n"])), 8, "0"), hexed(fp["sketch"], 8))


def likeness(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Likeness (0 to 1) of two fingerprints; 1 when their exact lanes agree."""
    def signs(fp):
        # the lane is known modulo 2**32
        return F.transform(fp["sketch"], lambda s: _signed(s.cast("long") * 2 - fp["n"]).cast("double"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    va, vb = signs(a), signs(b)
    norm = dot(va, va) + dot(vb, vb)
    value = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(va, vb) * 2.0 / norm))).otherwise(F.lit(0.0))
    return F.when(a["exact"] == b["exact"], F.lit(1.0)).otherwise(value)


def successors(rows: DataFrame) -> DataFrame:
    """``(row, id, n_chars, next_row)`` of ``rows`` (``__row``, ``id``, ``n_chars``)
    in ascending (id, row) order, the last followed by the first.  Rows are
    range-partitioned, numbered inside their part, and parts are chained through
    one row each."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "id", ROW).withColumn("part", F.spark_partition_id())
    ranged = keep_table(ranged, "order")
    firsts = ranged.groupBy("part").agg(F.min(F.struct("id", ROW)).alias("f")).select("part", F.col(f"f.{ROW}").alias("first"))
    chain = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per part
    after = firsts.select("part", F.coalesce(
        F.lead("first").over(chain), F.first("first").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).alias("after"))
    inside = F.lead(ROW).over(Window.partitionBy("part").orderBy("id", ROW))
    return (ranged.withColumn("inside", inside).join(after, "part")
            .select(ROW, "id", "n_chars", F.coalesce("inside", "after").alias("next_row")))


def edited_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(__row, id, n_chars, next_row, text, edited)``: every document beside its
    edited text, whose last floor(n/2) code points are replaced by the first as
    many (or all) of the next document."""
    base = with_row(docs, id_column, text_column).select(ROW, "id", F.coalesce("text", F.lit("")).alias("text"))
    order = keep_table(successors(base.select(ROW, "id", F.length("text").cast("long").alias("n_chars"))), "successors")
    asked = order.select(F.col("next_row").alias(ROW), F.col(ROW).alias("to_row"),
                         F.floor(F.col("n_chars") / 2).cast("int").alias("half"), F.col("id").alias("to_id"),
                         "n_chars", "next_row")
    body = base.select(ROW, "text")
    heads = body.join(asked, ROW).select(F.col("to_row").alias(ROW), F.col("to_id").alias("id"), "n_chars", "next_row",
                                         "half", F.left("text", F.col("half")).alias("head"))
    kept = F.left("text", (F.col("n_chars") - F.col("half")).cast("int"))
    return body.join(heads, ROW).select(ROW, "id", "n_chars", "next_row", "text", F.concat(kept, "head").alias("edited"))


def edit_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: fingerprints of its text and its edited text, their
    likeness, and the likeness to the next document's fingerprint."""
    pair = edited_documents(docs, id_column, text_column)
    facts = pair.select(ROW, "id", "n_chars", "next_row", F.sha2("edited", 256).alias("edited_sha256"))
    both = pair.select(ROW, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                                              F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("x"))
    both = fingerprints(both.select(ROW, "x.kind", "x.body"), [ROW, "kind"], "body")
    both = both.groupBy(ROW).agg(*[F.max(F.when(F.col("kind") == k, F.struct("exact", "sketch", "n"))).alias(f"f{k}")
                                   for k in (0, 1)])
    own = keep_table(facts.join(both, ROW), "fingerprints")
    following = own.select(F.col(ROW).alias("next_row"), F.col("f0").alias("g"))
    joined = own.join(following, "next_row")

    def lanes(name):
        return {k: F.col(f"{name}.{k}") for k in ("exact", "sketch", "n")}
    return joined.select("id", "n_chars", "edited_sha256", text_form(lanes("f0")).alias("fingerprint"),
                         text_form(lanes("f1")).alias("edited_fingerprint"),
                         likeness(lanes("f0"), lanes("f1")).alias("near_edited"),
                         likeness(lanes("f0"), lanes("g")).alias("near_next"))
