"""Line dedup by winnowing, in DataFrame functions only.

A gram is the shortest run of lines from some line on that has at least GRAM_WORDS words. Winnowing
takes, in each window of starts that lie less than GRAM_WORDS words apart, the gram of the smallest
hash (the later of equal ones) as a fingerprint. All grams of the window at the first line of a run
of MIN_WORDS = 2 x GRAM_WORDS words or more lie in that run, so any two such runs of equal lines
share a fingerprint: a text of which no fingerprint occurs twice has no line to lose. In the others
each line gives two spans, the shortest runs of MIN_WORDS words or more that start and that end with
it. A line of a repeated run lies in a span within that run, so a line is deleted if, and only if, one
of its spans has an equal one earlier in (id, line) order. Each span has a first occurrence of its
own, so no pair of texts is compared, however frequent their lines are. A deleted line always has an
equal one earlier; first occurrences stay.

Matches are extended by uniting spans that meet, not by comparing the two texts of a fingerprint line by
line: a fingerprint has one first occurrence, but a run may repeat one of any later text, and comparing
with all of them would be all pairs of a frequent line. Lines and runs are compared by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import cut

GRAM_WORDS, MIN_WORDS = 25, 50
#: Lines of a text that are looked at together, with what a run at their ends takes on both sides.
PART_LINES = 512


def _parts(lines: DataFrame, margin: int) -> DataFrame:
    """Texts cut into rows of PART_LINES lines, lo to hi of h, g and w (which have the margin too); base: lines before h.

    Higher-order functions copy an array for each slice of it, so only short arrays are sliced in them
    and the work stays in proportion to a text's lines.
    """
    n, begin = F.size("h"), F.greatest(F.col("part") * PART_LINES - margin, F.lit(0))
    cut_up = lines.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / PART_LINES).cast("int"))))
    arrays = (F.slice(c, begin + 1, F.lit(PART_LINES + 2 * margin)).alias(c) for c in ("h", "g", "w"))
    return cut_up.select("key", "part", begin.alias("base"), (F.col("part") * PART_LINES - begin).alias("lo"), (F.least((F.col("part") + 1) * PART_LINES, n) - begin).alias("hi"), *arrays)


def _grams(gram_words: int) -> Column:
    """For each line: lines in its gram and the gram's hash; null where the text ends before."""

    def gram(i: Column) -> Column:
        step = F.aggregate(
            F.slice("w", i + 1, gram_words),
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")),
            lambda acc, w: F.when(acc["words"] >= gram_words, acc).otherwise(F.struct((acc["words"] + w).alias("words"), (acc["n"] + 1).alias("n"))),
        )
        # a blank line weighs one word, so that no gram has more than gram_words lines
        return F.transform(F.array(step), lambda s: F.when(s["words"] >= gram_words, F.struct(F.xxhash64(F.slice("h", i + 1, s["n"])).alias("hash"), (-i).alias("at"), s["n"].alias("n"))))[0]

    return F.transform(F.sequence(F.lit(0), F.size("h") - 1), gram)


def _spans(gram_words: int, min_words: int) -> Column:
    """(hash, at, n, gram) of a part: of the shortest runs of min_words words that start, and that end, with each line; gram: lines of its first gram_words words."""

    def lines(w: Column, least: int = min_words) -> Column:
        step = F.aggregate(
            w,
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")),
            lambda acc, x: F.when(acc["words"] >= least, acc).otherwise(F.struct((acc["words"] + x).alias("words"), (acc["n"] + 1).alias("n"))),
        )
        return F.transform(F.array(step), lambda s: F.when(s["words"] >= least, s["n"]))[0]

    def ending(i: Column) -> Column:
        begin = F.greatest(i - (min_words - 1), F.lit(0))
        return F.transform(F.array(lines(F.reverse(F.slice("w", begin + 1, i - begin + 1)))), lambda n: F.struct((i - n + 1).alias("at"), n.alias("n")))[0]

    every = F.sequence(F.col("lo"), F.col("hi") - 1)
    starting = F.transform(every, lambda i: F.struct(i.alias("at"), lines(F.slice("w", i + 1, min_words)).alias("n")))
    started = F.transform(F.array(starting), lambda a: F.concat(a, F.filter(F.transform(every, ending), lambda s: s["n"].isNotNull() & ~F.coalesce(F.get(a, s["at"] - F.col("lo"))["n"] == s["n"], F.lit(False)))))[0]
    spans = F.filter(started, lambda s: s["n"].isNotNull())
    return F.transform(spans, lambda s: F.struct(F.struct(F.xxhash64(F.slice("h", s["at"] + 1, s["n"])).alias("a"), F.xxhash64(F.slice("g", s["at"] + 1, s["n"]), F.lit("second")).alias("b")).alias("hash"), (s["at"] + F.col("base")).alias("at"), s["n"].alias("n"), lines(F.slice("w", s["at"] + 1, gram_words), gram_words).alias("gram")))


def find_repeats(docs: DataFrame, gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, ranges): ranges of line numbers, both ends included, of later repeated runs; rows without any don't come."""
    rows = docs.select(F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("text")).alias("key"), docs[text_col].cast("string").alias("text")).where("key.id is not null and text is not null")
    lines = rows.select("key", F.split("text", "\n").alias("lines"))
    lines = lines.select("key", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.xxhash64(x, F.lit("second"))).alias("g"), F.transform("lines", lambda x: F.greatest(F.regexp_count(x, F.lit(r"\S+")), F.lit(1))).alias("w"))
    lines = _parts(lines, 2 * min_words).withColumn("grams", _grams(gram_words))
    # the window at a line spans as many starts as its gram has lines; windows that follow often pick the same
    here = F.filter(F.slice("grams", F.col("lo") + 1, F.col("hi") - F.col("lo")), lambda g: g.isNotNull())
    picked = F.transform(here, lambda g: F.array_min(F.slice("grams", 1 - g["at"], g["n"])))
    fresh = lambda p: F.filter(p, lambda g, i: (i == 0) | (F.get(p, i - 1)["at"] != g["at"]))
    lines = cut(lines.withColumn("picked", F.transform(F.array(picked), fresh)[0]).select("key", "part", "base", "lo", "hi", "h", "g", "w", "picked"))
    marks = lines.select("key", "base", F.explode("picked").alias("m")).select("key", F.col("m.hash").alias("hash"), (F.col("base") - F.col("m.at")).alias("at"))
    repeated = marks.groupBy("hash").agg(F.min(F.struct("key", "at")).alias("lo"), F.max(F.struct("key", "at")).alias("hi")).where("lo <> hi").select("hash")
    touched = marks.join(repeated, "hash").select("key").distinct()
    spans = cut(lines.join(touched, "key", "left_semi").dropDuplicates(["key", "part"]).select("key", F.explode(_spans(gram_words, min_words)).alias("s")).select("key", "s.hash", "s.at", "s.n", "s.gram"))
    first = spans.groupBy("hash").agg(F.min(F.struct("key", "at")).alias("lo"), F.max(F.struct("key", "at")).alias("hi")).where("lo <> hi").select("hash", F.col("lo").alias("first"))
    later = spans.join(first, "hash").where(F.struct("key", "at") != F.col("first"))
    # within one text the first gram stays whole
    lo = F.when(F.col("key") == F.col("first.key"), F.greatest(F.col("at"), F.col("first.at") + F.col("gram"))).otherwise(F.col("at"))
    found = later.select("key", lo.alias("lo"), (F.col("at") + F.col("n") - 1).alias("hi")).where("lo <= hi")
    # a range for all spans that meet: a list per span would be long in a text that is a copy as a whole
    before = Window.partitionBy("key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    fresh = found.withColumn("new", F.coalesce(F.col("lo") > F.max("hi").over(before) + 1, F.lit(True)).cast("int"))
    part = F.sum("new").over(Window.partitionBy("key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0))
    merged = fresh.withColumn("part", part).groupBy("key", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def dedup_lines(docs: DataFrame, gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later repeated runs cut out of text_col, and two columns: n_lines, n_removed.

    Lines are what newlines separate; equal ones agree in all bytes (in 128 bits of hash). Null texts stay null (no lines), empty
    ones have one line. Rows with a null id are left as they are and serve as nobody's source. Rows
    that repeat both id and text are one text: none of them loses lines to the other. Within one text
    the first GRAM_WORDS words of a run that overlaps its own repetition stay. A text whose
    lines all go becomes empty. Columns named n_lines or n_removed are replaced; others stay.
    """
    ranges = find_repeats(docs, gram_words, min_words, id_col, text_col).select(F.col("key.id").alias("_id"), F.col("key.text").alias("_hash"), F.col("ranges").alias("_ranges"))
    text = docs[text_col].cast("string")
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("_row")  # so that no column's name can clash
    rows = docs.select(whole, docs[id_col].alias("_own"), F.xxhash64(text).alias("_text"))
    joined = rows.join(ranges, (F.col("_own") == F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    text = F.col(f"_row.`{text_col}`").cast("string")
    lines = F.split(text, "\n")
    stays = F.filter(lines, lambda _, i: ~F.exists("_ranges", lambda r: (r["lo"] <= i) & (i <= r["hi"])))
    joined = joined.select("_row", F.when(text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.when(F.col("_ranges").isNotNull(), stays).alias("_kept"))
    cleaned = F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(text)
    added = {"n_lines": F.col("n_lines"), "n_removed": F.when(F.col("_kept").isNotNull(), F.col("n_lines") - F.size("_kept")).otherwise(0)}
    columns = [cleaned.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns if c not in added]
    return joined.select(*columns, *(x.alias(c) for c, x in added.items()))
