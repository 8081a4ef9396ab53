"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line (text between line feeds) of ``MIN_CHARS`` characters or more goes if a
line before it, in the order of doc_id and place, is within ``EDITS``
insertions, deletions or substitutions of characters; equal lines are at
distance 0. What is before a line counts whether or not it goes itself.

Of shorter lines only exact repeats go, and only those of ``exact_chars``
characters or more: all but empty lines in ``dedup_lines`` and
``line_digests``.

Distinct lines are split into EDITS + 1 segments. Of two lines within EDITS,
one segment of the shorter lies unchanged in the longer, at one of a few
places that their lengths allow (multi-match-aware selection), so lines are
joined on hashes of length, segment number and segment. Letter counts that
differ by more than EDITS edits can explain drop a pair inside the join; the
rest is verified by Spark's banded edit distance, which stops beyond EDITS. (A
bit-parallel band can be written in built-in functions, one step of an
aggregate() for each character, and gives the same distances, but takes some
hundred times as long; figures are in the README.)

Texts move once: one exchange of the documents by key serves the segments, the
verification and the result. Lines are known by 64-bit hashes (among n
distinct lines n * n / 2**65 pairs agree by chance, 3 of 10**10 lines),
documents by that of doc_id and text. Lines that hold more than a part of
all places (there are few of those) are dealt over all tasks when places are
compared with the earliest one.

Defined results: null text stays null and has no lines; repeated rows (equal
doc_id and text) are one document; rows of one doc_id and different text are
ordered by key, null doc_ids come first; lines of any length are whole; an
empty table gives no rows; extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, partitions

EDITS, MIN_CHARS = 2, 24
#: Letters that are counted before a pair is verified.
COUNTED = "etaoinsrhdlu"


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(less, segment, shift): where a line may hold a segment of one that is ``less`` characters shorter."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def segment_rows(lines: DataFrame, places: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """h, counts, key (hash of length, segment number and characters) and own (whether the line itself has this segment there) for each line and place.

    ``wide`` has four bytes for each character, so a segment is cut without
    a walk over the characters before it.
    """
    each = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(p, ("less", "i", "shift"), strict=True))) for p in places)))
    rows = lines.select("h", "counts", "n", "wide", each.alias("at"))
    size = F.col("n") - F.col("at.less")
    first = F.floor(size * F.col("at.i") / (edits + 1)).cast("int")
    last = F.floor(size * (F.col("at.i") + 1) / (edits + 1)).cast("int")
    cut = F.substring("wide", (first + F.col("at.shift")) * 4 + 1, (last - first) * 4)
    return rows.select(F.xxhash64(size, F.col("at.i"), cut).alias("key"), "h", "counts", ((F.col("at.less") == 0) & (F.col("at.shift") == 0)).alias("own"))


def letter_counts(line: Column) -> Column:
    """In an int: counts of COUNTED modulo 4, two bits each, and above them that of all other characters modulo 256."""
    n = F.length(line)
    counts = [n - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED]
    out, rest = F.lit(0), n
    for k, c in enumerate(counts):
        out, rest = out.bitwiseOR(F.shiftleft(c.bitwiseAND(F.lit(3)), 2 * k)), rest - c
    return out.bitwiseOR(F.shiftleft(rest.bitwiseAND(F.lit(255)), 2 * len(COUNTED)))


def counts_apart(a: Column, b: Column) -> Column:
    """A lower bound of the sum of the counts' differences: a letter's is 1 where it is odd, 2 where it is 2 modulo 4."""
    bits = 2 * len(COUNTED)
    x = a.bitwiseXOR(b)
    letters = (1 << bits) - 1
    odd = x.bitwiseAND(F.lit(0x55555555 & letters))
    two = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555 & letters)).bitwiseAND(F.bitwise_not(odd))
    rest = F.abs(F.shiftrightunsigned(a, bits) - F.shiftrightunsigned(b, bits))
    return F.bit_count(odd) + 2 * F.bit_count(two) + F.least(rest, 256 - rest)


def remove_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """All columns of docs, text without the lines that go, and two last columns: the numbers of lines and of those that went.

    Exact repeats go from ``exact_chars`` characters on (``min_chars`` if None), lines within ``edits`` from ``min_chars`` on.
    """
    exact_chars = min_chars if exact_chars is None else exact_chars
    names = docs.columns
    # names that no column of docs has
    KEY, OWN, GONE, N_LINES, N_REMOVED = (free_name(x, names) for x in ("__doc_key", "__own", "__gone", "__n_lines", "__n_removed"))
    n_parts = partitions(docs.sparkSession)
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", "text"))
    dealt = keyed.repartition(n_parts, KEY)
    # a predicate that is always true, reads all columns and is not pushed down: the exchange is the same for every use
    whole = (F.hash(*[F.col(f"`{n}`") for n in names]) + F.rand(7)) > F.lit(-4e9)
    lines = F.split("text", "\n", -1)

    spots = keyed.select("doc_id", KEY, F.posexplode(lines).alias("line_no", "line")).where(F.length("line") >= exact_chars)
    spots = spots.select(F.xxhash64("line").alias("h"), F.struct("doc_id", KEY, "line_no").alias("spot"))
    # all uses read both columns, so that they share one exchange
    firsts = spots.groupBy("h").agg(F.min("spot").alias("first"), F.count("*").alias("n")).where("first IS NOT NULL AND n > 0")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """h and line of the first spots in ``wanted``, from the dealt documents."""
        of_doc = wanted.groupBy(F.col(f"first.{KEY}").alias(KEY)).agg(F.collect_set("first.line_no").alias(OWN))
        found = dealt.join(of_doc.hint("shuffle_hash"), KEY).where(whole)
        found = found.select(OWN, F.posexplode(lines).alias("line_no", "line")).where(F.array_contains(OWN, F.col("line_no")))
        return found.select(F.xxhash64("line").alias("h"), "line")

    searched = texts_of(firsts)
    if exact_chars < min_chars:
        searched = searched.where(F.length("line") >= min_chars)
    every = searched.select("h", letter_counts(F.col("line")).alias("counts"), F.length("line").alias("n"), F.encode("line", "UTF-32").alias("wide"))
    # each line is prepared once, and both sides of the join are one exchange: a line's own segments are among its probes.
    # which side is the index is told inside the join, by both sides, since a filter of one side would make that another exchange
    rows = segment_rows(every, probes(edits), edits)
    index, probe = (rows.select("key", *(F.col(c).alias(c + x) for c in ("h", "counts", "own"))) for x in "ab")
    differ = F.when(F.col("ownb"), F.col("owna") & (F.col("ha") < F.col("hb"))).otherwise(F.col("owna") & (F.col("ha") != F.col("hb")))
    met = index.join(probe, (index["key"] == probe["key"]) & differ & (counts_apart(F.col("countsa"), F.col("countsb")) <= 2 * edits))
    met = met.select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    involved = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(firsts, "h")
    known = texts_of(involved)
    close = pairs.join(known.select(F.col("h").alias("a"), F.col("line").alias("la")), "a").join(known.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b")
    close = close.where(F.levenshtein("la", "lb", edits) >= 0).select("a", "b")
    # one row is dealt out twice: a union of two uses would verify each pair twice and plan all that is above for each
    either = F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("b").alias("near")), F.struct(F.col("b").alias("h"), F.col("a").alias("near"))))
    both = close.select(either.alias("row")).select("row.h", "row.near")
    beside = both.join(firsts.withColumnRenamed("h", "near"), "near").groupBy("h").agg(F.min("first").alias("beside"))
    earliest = firsts.join(beside, "h", "left").where("n > 1 OR beside IS NOT NULL")
    earliest = earliest.select("h", "n", F.least("first", F.coalesce("beside", "first")).alias("earliest"))

    # at most 4 * n_parts lines have more than that part of all places; each is dealt over n_parts tasks
    total = F.broadcast(firsts.agg(F.sum("n").alias("all"), F.max("first").alias("last")))
    often = F.col("n") > F.col("all") / (4 * n_parts)
    common = F.broadcast(firsts.crossJoin(total).where(often).select("h", F.lit(True).alias("common")))
    one, parts = F.array(F.lit(0)), F.sequence(F.lit(0), F.lit(n_parts - 1))
    many = earliest.crossJoin(total).select("h", "earliest", F.explode(F.when(often, parts).otherwise(one)).alias("salt"))
    dealt_out = F.array(F.pmod(F.xxhash64("spot"), F.lit(n_parts)).cast("int"))
    places = spots.join(common, "h", "left").select("h", "spot", F.explode(F.when(F.col("common"), dealt_out).otherwise(one)).alias("salt"))
    gone = places.join(many, ["h", "salt"]).where(F.col("spot") > F.col("earliest"))
    gone = gone.groupBy(F.col(f"spot.{KEY}").alias(KEY)).agg(F.collect_set("spot.line_no").alias(GONE))
    full = dealt.join(gone.hint("shuffle_hash"), KEY, "left")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(GONE, i)), "\n")
    text = F.when(F.col(GONE).isNull(), F.col("text")).otherwise(kept)
    return full.select(*[(text.alias("text") if c == "text" else F.col(f"`{c}`")) for c in names], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(N_LINES), F.when(F.col(GONE).isNull(), 0).otherwise(F.size(GONE)).cast("long").alias(N_REMOVED))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_md5 of each document."""
    done = remove_lines(docs.select("doc_id", "text"), exact_chars=1)
    n_lines, n_removed = done.columns[-2:]
    return done.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col(n_lines)).cast("long").alias("n_lines"), F.col(n_removed).alias("n_removed"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go, exact repeats of any length among them; a document all of whose lines went goes, too."""
    done = remove_lines(docs, exact_chars=1)
    whole = (F.col(done.columns[-1]) == 0) | (F.length(F.trim("text")) > 0)
    return done.where(whole).select(*[F.col(f"`{c}`") for c in docs.columns])
