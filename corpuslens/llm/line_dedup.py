"""Removal of multi-line chunks that recur anywhere in the corpus.

A rolling hash over the hashes of neighbouring lines decides where a chunk ends, so the same
passage is cut alike wherever it stands, and lines put in before it shift nothing. Chunks meet
on a hash; those that meet are then compared byte by byte with the first of their kind, which
stays. Everything runs in the JVM. Texts are shuffled once, by document; only chunks with an
equal hash elsewhere travel to the comparison.

Chunks meet only where cuts fall inside a passage. On request a second kind of chunk is added, from each
line down and up, just long enough to hold over 50 words: whatever is repeated for so long is covered
by such chunks wherever it is cut, and each of them must stand whole at one earlier place to go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import stored

#: Lines that the rolling hash sees; one line in so many may end a chunk.
WINDOW = 2
LINES = 3
FACTOR = 31
#: Lines with something in them that a chunk needs to be compared at all.
LEAST = 2
#: Chunks that start or end at every line are the shortest with more words than this.
WORDS = 50


def lines_of(text: Column) -> Column:
    """Lines of a text; none for NULL and empty ones."""
    return F.when(F.length(text) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def _line_hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))


def _ends(hashes: Column, window: int, mean: int) -> Column:
    """1-based last lines of the chunks."""

    def marked(i: Column) -> Column:
        rolled = F.lit(0).cast("long")
        for j in range(window):
            at = F.when(i > j, F.get(hashes, i - j - 1)).otherwise(F.lit(0).cast("long"))
            rolled = rolled + at * FACTOR**j
        return F.pmod(rolled, F.lit(mean)) == 0

    def last(i: Column) -> Column:
        n = F.size(hashes)
        # of marked lines in a row the first counts, and no chunk is one line if the text has more
        return (i == n) | ((i > 1) & (i < n - 1) & marked(i) & ~marked(i - 1))

    return F.when(F.size(hashes) > 0, F.filter(F.sequence(F.lit(1), F.size(hashes)), last)).otherwise(
        F.array().cast("array<int>")
    )


def _chunk_text(lines: Column, s: Column, e: Column) -> Column:
    return F.array_join(F.slice(lines, s, e - s + 1), "\n")


def _described(lines: Column, s: Column, e: Column) -> Column:
    text = _chunk_text(lines, s, e)
    full = F.size(F.filter(F.slice(lines, s, e - s + 1), lambda x: F.length(F.trim(x)) > 0))
    return F.struct(s.alias("s"), e.alias("e"), F.xxhash64(text).alias("h"), F.length(text).alias("n"), full.alias("full"))


def _chunked(docs: DataFrame, window: int, mean: int, passages: bool) -> DataFrame:
    """``row_key, doc_id, chunks``: first and last line, hash and length of each chunk worth comparing; ``n_chunks``.

    With ``passages`` the chunks that start or end at every line are among them; they overlap.
    """
    lined = docs.select("row_key", "doc_id", lines_of(F.col("text")).alias("lines"))
    hashed = lined.withColumn("hashes", _line_hashes(F.col("lines")))
    ended = hashed.withColumn("ends", _ends(F.col("hashes"), window, mean))
    lines = F.col("lines")
    starts = F.concat(F.array(F.lit(1)), F.transform(F.slice(F.col("ends"), 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda x: x + 1))
    starts = F.when(F.size("ends") > 0, starts).otherwise(F.array().cast("array<int>"))
    found = F.filter(F.zip_with(starts, F.col("ends"), lambda s, e: _described(lines, s, e)), lambda c: c["full"] >= LEAST)
    if passages:
        filled = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.length(F.trim(F.get(lines, i - 1))) > 0)
        ended = ended.withColumn("filled", F.when(F.size("lines") > 0, filled).otherwise(F.array().cast("array<int>")))
        words = F.transform("filled", lambda i: F.size(F.filter(F.split(F.get(lines, i - 1), r"\s+"), lambda x: x != "")))
        ended = ended.withColumn("words", words).withColumn("down", _reach(F.col("words"))).withColumn("up", _reach(F.reverse("words")))
        # the shortest chunk from each line down, and from each line up: together they cover a passage to its ends
        down = F.zip_with("filled", "down", lambda s, j: F.struct(s.alias("s"), F.get("filled", j - 1).alias("e")))
        up = F.zip_with(F.reverse("filled"), "up", lambda e, j: F.struct(F.get("filled", F.size("filled") - j).alias("s"), e.alias("e")))
        spans = F.array_distinct(F.filter(F.concat(down, up), lambda c: c["s"].isNotNull() & c["e"].isNotNull()))
        found = F.array_distinct(F.concat(found, F.transform(spans, lambda c: _described(lines, c["s"], c["e"]))))
    return ended.select("row_key", "doc_id", F.size("ends").alias("n_chunks"), found.alias("chunks"))


def _reach(words: Column) -> Column:
    """For each filled line the number of the one that the shortest chunk from it reaches: ``LEAST`` lines, over ``WORDS`` words; else NULL."""
    none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("j"))

    def done(a: Column) -> Column:
        return (a["w"] > WORDS) & (a["j"] >= LEAST)

    def ends(x: Column, k: Column) -> Column:
        # a filled line has a word, so no chunk needs more lines than these
        near = F.slice(words, k + 1, WORDS + LEAST)
        last = F.aggregate(near, none, lambda a, w: F.when(done(a), a).otherwise(F.struct((a["w"] + w).alias("w"), (a["j"] + 1).alias("j"))))
        return F.when(done(last), k + last["j"])

    return F.transform(words, ends)


def _united(spans: DataFrame) -> DataFrame:
    """``row_key, s, e`` of the stretches of lines that overlapping spans cover."""
    by_start = Window.partitionBy("row_key").orderBy("s", "e")
    before = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("new", (F.coalesce(before, F.lit(0)) < F.col("s")).cast("int"))
    island = F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    return apart.withColumn("island", island).groupBy("row_key", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def deduplicated(docs: DataFrame, window: int = WINDOW, mean: int = LINES, passages: bool = False) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``, and ``n_lines, n_chunks, removed_chunks, removed_lines``.

    Of equal chunks the first stays, by doc_id (NULL last), then by place. Chunks with fewer than
    two lines that hold more than blanks are left alone. NULL texts stay NULL and have no lines,
    like empty ones. Repeated rows are one document and get equal results. Other columns pass
    through; the four counters replace columns of their names. With ``passages`` every passage of
    several lines and over 50 words goes that stands whole at one earlier place, however chunks are
    cut; ``removed_chunks`` counts the stretches of lines removed instead. The first copy of a line
    always stays.
    """
    counters = ("n_lines", "n_chunks", "removed_chunks", "removed_lines")
    own = docs.drop(*counters)
    keyed = own.withColumn("_line_dedup_row", F.xxhash64("doc_id", F.col("text").cast("string")))
    slim = keyed.select(F.col("_line_dedup_row").alias("row_key"), "doc_id", F.col("text").cast("string"))
    chunked = stored(_chunked(slim, window, mean, passages), "chunks")

    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "s")
    each = chunked.select("row_key", "doc_id", F.explode("chunks").alias("c")).select("row_key", "doc_id", "c.s", "c.e", "c.h", "c.n").distinct()
    met = each.groupBy("h", "n").agg(F.count("*").alias("copies"), F.min(order).alias("first")).where("copies > 1").drop("copies")
    # what each document has to show for the comparison: its candidate chunks, by place
    place = F.struct("s", "e", "h", "n", ((F.col("first.row_key") == F.col("row_key")) & (F.col("first.s") == F.col("s"))).alias("is_first"))
    shown = each.join(met, ["h", "n"]).groupBy("row_key").agg(F.array_sort(F.collect_list(place)).alias("places"))
    shown = stored(shown, "places")

    texts = slim.select("row_key", "text")
    # merge joins: the same plan at every size, never a broadcast of lists that grow with the corpus
    lined = texts.join(shown.hint("merge"), "row_key").select("row_key", "places", lines_of(F.col("text")).alias("lines"))
    pieces = lined.select(
        "row_key",
        F.explode(
            F.transform("places", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["h"].alias("h"), c["n"].alias("n"), c["is_first"].alias("is_first"), _chunk_text(F.col("lines"), c["s"], c["e"]).alias("piece")))
        ).alias("c"),
    ).select("row_key", "c.*")
    firsts = pieces.where("is_first").select("h", "n", F.col("piece").alias("first_piece")).distinct()
    same = pieces.where("NOT is_first").join(firsts, ["h", "n"]).where("piece = first_piece")
    if passages:
        same = _united(same.select("row_key", "s", "e"))
    gone = same.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("_line_dedup_gone"))

    whole = lines_of(F.col("text").cast("string"))
    before = F.transform("_line_dedup_gone", lambda g: g["s"] - 1)
    after = F.transform("_line_dedup_gone", lambda g: g["e"] + 1)
    kept = F.flatten(
        F.zip_with(
            F.concat(F.array(F.lit(1)), after),
            F.concat(before, F.array(F.size("_line_dedup_lines"))),
            lambda s, e: F.slice("_line_dedup_lines", s, F.greatest(e - s + 1, F.lit(0))),
        )
    )
    counts = chunked.select(F.col("row_key").alias("_line_dedup_row"), "n_chunks").distinct()
    return (
        keyed.join(gone.withColumnRenamed("row_key", "_line_dedup_row").hint("merge"), "_line_dedup_row", "left")
        .join(counts, "_line_dedup_row", "left")
        .withColumn("_line_dedup_lines", whole)
        .select(
            *(c if c != "text" else F.when(F.col("_line_dedup_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") for c in own.columns),
            F.size("_line_dedup_lines").alias("n_lines"),
            "n_chunks",
            F.when(F.col("_line_dedup_gone").isNull(), 0).otherwise(F.size("_line_dedup_gone")).alias("removed_chunks"),
            F.coalesce(F.aggregate("_line_dedup_gone", F.lit(0), lambda a, g: a + g["e"] - g["s"] + 1), F.lit(0)).alias("removed_lines"),
        )
    )
