"""Document fingerprints: one-permutation MinHash in built-in column functions only.

Each shingle of a text is hashed once; the top bits of the hash choose a bin, and a bin keeps its
smallest hash. An empty bin takes the value of another bin, the first non-empty one in a probe order of
its own that is the same for all documents (optimal densification), so equal positions of two
fingerprints still agree with the probability that the shingle sets' Jaccard similarity gives. Of each value
the lowest four bits are stored, as one hexadecimal digit; the share of digits that agree by chance is
taken out of the likeness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.llm.common import ascii_lower, words

BIN_BITS = 7
BINS = 1 << BIN_BITS
#: Probes that an empty bin makes one after the other; after them, all filled bins are looked at at once.
PROBES = 4
#: Words of a shingle.
WORDS = 5
#: Chance that two stored values agree without being equal.
CHANCE = 1 / 16
#: Most buckets that documents are ordered in; a bucket is sorted by one task, on disk if need be.
MAX_BUCKETS = 16_384


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def probe_order() -> tuple[list[int], list[int], list[int]]:
    """Of each bin: odd factor, its inverse modulo the bins, and offset. The jth probe of bin b goes to bin
    (factor * j + offset) modulo the bins."""
    factors, inverses, offsets = [], [], []
    for b in range(BINS):
        mixed = (b * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64
        mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        factor = mixed >> 40 & (BINS - 1) | 1
        factors.append(factor)
        inverses.append(pow(factor, -1, BINS))
        offsets.append(mixed >> 50 & (BINS - 1))
    return factors, inverses, offsets


def fingerprint(text: Column) -> Column:
    """128 hexadecimal digits; the empty string for a text without words (null: empty).

    Shingles are five words of the text in ASCII lower case, or all words of a shorter text. How often a
    shingle occurs doesn't matter.
    """
    factors, inverses, offsets = (F.array(*map(F.lit, x)) for x in probe_order())

    def hashes(w: Column) -> Column:
        last = F.greatest(F.size(w) - WORDS, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))

    def bin_of(h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")

    def smallest(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1))))

    def digits(h: Column) -> Column:
        """The digits of sorted values h, one a bin: they are written with a blank for each empty bin, which then looks for its donor."""
        place = lambda x: bin_of(x).bitwiseXOR(F.lit(BINS // 2))  # noqa: E731  # longs sort the upper half of the bins first

        def written(x: Column, i: Column) -> Column:
            gap = place(x) - F.when(i == 0, F.lit(-1)).otherwise(place(F.get(h, i - 1))) - 1
            return F.concat(F.repeat(F.lit(" "), gap), F.substr(F.lit("0123456789abcdef"), x.bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(1)))

        half = F.lit(BINS // 2)
        turned = F.rpad(F.array_join(F.transform(h, written), ""), F.lit(BINS), F.lit(" "))
        return let(F.concat(F.substr(turned, half + 1, half), F.substr(turned, F.lit(1), half)), lambda held: F.when(F.instr(held, " ") == 0, held).otherwise(let(F.transform(h, bin_of), lambda filled: densified(held, filled))))

    def densified(held: Column, filled: Column) -> Column:
        digit_at = lambda b: F.substr(held, b + 1, F.lit(1))
        probe = lambda b, j: F.pmod(F.get(factors, b) * j + F.get(offsets, b), F.lit(BINS))

        def at(own: Column, b: Column) -> Column:
            early = [F.nullif(digit_at(probe(b, F.lit(j))), F.lit(" ")) for j in range(PROBES)]
            first = F.array_min(F.transform(filled, lambda x: F.pmod(F.get(inverses, b) * (x - F.get(offsets, b)), F.lit(BINS))))
            return F.when(own != " ", own).otherwise(F.coalesce(*early, digit_at(probe(b, first))))

        return F.array_join(F.transform(F.split(held, ""), at), "")

    def whole(w: Column) -> Column:
        made = let(F.transform(w, lambda x: F.xxhash64(x)), lambda x: let(F.sort_array(hashes(x)), lambda y: let(smallest(y), digits)))
        return F.when(F.size(w) == 0, F.lit("")).otherwise(made)

    return let(words(ascii_lower(text)), whole)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, of the shingle sets of two fingerprints: the share of equal
    digits without those equal by chance. Two texts without words are alike (1), one with words and one
    without are not (0); null if one is null."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    plain = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - CHANCE) / (1 - CHANCE))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).when(a.isNotNull() & b.isNotNull(), plain)


def _bucket(bounds: list[int], number: Column) -> Column:
    """How many bounds (ascending) are at most ``number``, by bisection."""
    if not bounds:
        return F.lit(0)
    steps, limits = len(bounds).bit_length(), F.array(*[F.lit(b).cast("long") for b in bounds])

    def step(s: Column, _: Column) -> Column:
        middle = ((s["low"] + s["high"]) / 2).cast("int")
        right = F.coalesce(F.get(limits, middle) <= number, F.lit(False))
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(middle).alias("high")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), step, lambda s: s["low"])


def with_next(docs: DataFrame, id_col: str, text_col: str, made: dict[str, Column]) -> DataFrame:
    """docs (long ids and texts) with the columns ``made`` of each row, and next, a struct of the text and these columns
    of the row that follows by id (null first), then by text; the first row follows the last.

    Rows are dealt to buckets that hold a range of ids each, cut at quantiles, and the first row of each
    bucket is added to the end of the one before it; so one shuffle moves every row once, and no task
    sorts more than a bucket. Ids are compared as longs; only the place of the cuts is approximate. Columns are made
    after that shuffle, once a row.
    """
    spark = docs.sparkSession
    wanted = min(MAX_BUCKETS, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = docs.select(F.col(id_col).cast("double").alias("x")).where("x is not null").approxQuantile("x", [i / wanted for i in range(1, wanted)], 0.25 / wanted)
    bounds = sorted({max(-(2**63), min(2**63 - 1, int(q))) for q in quantiles})
    held = docs.withColumn("_bucket", F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(_bucket(bounds, F.col(id_col))))
    # a null sorts before all ids: a struct of (is not null, id) has their order
    place = F.struct(F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"))
    # at most MAX_BUCKETS rows from here to the broadcast
    firsts = held.groupBy("_bucket").agg(F.min(place).alias("_first"))
    order = Window.orderBy("_bucket")
    firsts = firsts.withColumn("_to", F.lag("_bucket").over(order)).withColumn("_last", F.max("_bucket").over(Window.partitionBy()))
    firsts = firsts.select(F.col("_bucket").alias("_own"), "_first", F.coalesce("_to", "_last").alias("_to"))
    guests = held.join(F.broadcast(firsts), (F.col("_bucket") == F.col("_own")) & (place == F.col("_first")))
    guests = guests.groupBy("_to").agg(F.min(text_col).alias(text_col)).select(F.lit(None).cast("long").alias(id_col), text_col, F.col("_to").alias("_bucket"), F.lit(1).alias("_guest"))
    every = held.select(id_col, text_col, "_bucket", F.lit(0).alias("_guest")).unionByName(guests)
    # made once rows lie by bucket, which is how the window wants them: work is as even as buckets, however few files there are
    every = every.repartition("_bucket").withColumns(made)
    by_id = Window.partitionBy("_bucket").orderBy("_guest", F.col(id_col).asc_nulls_first(), text_col)
    return every.withColumn("next", F.lead(F.struct(text_col, *made)).over(by_id)).where("_guest = 0").drop("_guest", "_bucket")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row of docs. Null texts count as empty; equal texts have equal
    fingerprints; repeated rows and null ids are kept; other columns are ignored."""
    return docs.select(docs[id_col].alias("doc_id"), fingerprint(docs[text_col].cast("string")).alias("fingerprint"))


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the beginning of the next
    document, with their likeness and that of the next document's. Null ids come first; documents of one
    id follow each other by text (and meet in one task's sort); a single document is its own next. Null texts count as empty, texts
    are taken whole whatever their length, other columns are ignored whatever their names, and an empty table gives an
    empty result."""
    held = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    held = with_next(held, "doc_id", "text", {"fingerprint": fingerprint(F.col("text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr(F.col("next")["text"], F.lit(1), half))
    held = held.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    held = held.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return held.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")["fingerprint"]).alias("near_next"),
    )
