"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines count as the same if their words differ by at most one edit (a word
changed, added or missing). Every line emits its whole word sequence and each
sequence that lacks one word, as hashed keys; lines within one edit share a key:
the same one-word gap (a changed word) or the gap of one and the whole of the
other (an added word). Of the lines at a key only the earliest is joined to the
others, so a key shared by very many lines gives one candidate per line, not all
pairs. Candidates are verified by their words.

Lines that can't have a partner emit no neighbourhood: after one edit the first
half or the last half of the shorter line is whole in both, so a line that shares
no half with another distinct line is left out beforehand, without loss.

Texts are read three times and shuffled once, for the result; in between lines are
hashes (96 bits) and places.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barfold.llm.common import stored

#: Fewest words of a line that may differ by a word: one edit in five is a similarity of 0.8.
MIN_WORDS = 5


#: Lines (24 bytes each) up to which the lines to look at again are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def _words(line: str) -> Column:
    return F.array_remove(F.split(line, " "), "")


#: A line's place: rows are told apart by id and text, so that texts that share an id are documents of their own.
PLACE = ("doc_id", "of_text", "line_no")


def _lines(docs: DataFrame) -> DataFrame:
    """``PLACE`` and ``line`` of every line that isn't blank, without outer blanks."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("of_text"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select(*PLACE, F.trim("line").alias("line")).where("line <> ''")


def _halves() -> Column:
    """Keys of the halves that a line may share with one that is an edit away; none for short lines."""
    w, n = F.col("words"), F.size("words")

    def halves(m: Column) -> list[Column]:
        p = F.floor(m / 2).cast("int")
        return [
            F.xxhash64(m, F.lit(0), F.slice(w, F.lit(1), p)),
            F.xxhash64(m, F.lit(1), F.slice(w, n - (m - p) + 1, m - p)),
        ]

    return F.when(n >= MIN_WORDS, F.array(*halves(n), *halves(n - 1)))


def one_edit(x: str, y: str) -> Column:
    """Whether word lists ``x`` and ``y`` differ by one edit at most."""
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int")
    n, m = F.size(x), F.size(y)

    def rest(words: str, start: Column) -> Column:
        return F.slice(F.col(words), start, F.greatest(F.size(words) - start + 1, F.lit(0)))

    return (
        (first > F.greatest(n, m))
        | ((n == m) & (rest(x, first + 1) == rest(y, first + 1)))
        | ((n == m + 1) & (rest(x, first + 1) == rest(y, first)))
        | ((m == n + 1) & (rest(x, first) == rest(y, first + 1)))
    )


def _may_have_partner(lines: DataFrame) -> DataFrame:
    """``first`` of the distinct lines that share a half with another one."""
    keyed = lines.select("first", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("lines")).where("lines > 1")
    return keyed.join(shared, "half", "left_semi").select("first").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """``first, key, gap``: a hash of each line's words without one, and (gap -1) of all of them.

    A word's hash depends on its place, moved up by one behind the gap. The hashes before and behind a gap are two
    running values over the line, so a line costs as much as it has words, however long it is.
    """
    each = lines.select("first", F.size("words").alias("n"), F.posexplode("words").alias("gap", "word")).select(
        "first", "n", "gap", F.xxhash64("word", "gap").alias("here"), F.xxhash64("word", F.col("gap") - 1).alias("moved"))
    line = Window.partitionBy("first")
    so_far = line.orderBy("gap").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = each.withColumns({
        "upto": F.bit_xor("here").over(so_far), "passed": F.bit_xor("moved").over(so_far), "every": F.bit_xor("moved").over(line)})
    behind = F.col("every").bitwiseXOR(F.col("passed"))
    without = F.struct(F.col("upto").bitwiseXOR(F.col("here")).bitwiseXOR(behind).alias("key"), F.col("gap").alias("gap"))
    whole = F.struct(F.col("upto").alias("key"), F.lit(-1).alias("gap"))
    return run.select("first", F.inline(F.when(F.col("gap") == F.col("n") - 1, F.array(without, whole)).otherwise(F.array(without))))


def near_repeats(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``first`` of the distinct lines that an earlier one equals but for one word."""
    partners = stored(_may_have_partner(lines).select("first.*"), "partners")
    if partners.count() <= BROADCAST_LINES:
        partners = F.broadcast(partners)
    again = _lines(docs).join(partners, list(PLACE)).dropDuplicates(PLACE)
    may = stored(again.select(F.struct(*PLACE).alias("first"), _words("line").alias("words")), "may")

    variants = stored(_variants(may), "variants")
    # The earliest line at each key and gap; keys where nothing meets are left behind here.
    at_gap = variants.groupBy("key", "gap").agg(F.min("first").alias("same"), F.count("*").alias("lines"))
    at_key = at_gap.groupBy("key").agg(
        F.min(F.when(F.col("gap") >= 0, F.col("same"))).alias("gapped"),
        F.min(F.when(F.col("gap") < 0, F.col("same"))).alias("whole"), F.max("lines").alias("lines"),
    ).where((F.col("gapped").isNotNull() & F.col("whole").isNotNull()) | (F.col("lines") > 1))
    met = stored(variants.join(at_key.drop("lines"), "key"), "met")
    same = met.groupBy("key", "gap").agg(F.min("first").alias("same"))
    pairs = met.join(same, ["key", "gap"]).select("first", F.col("same").alias("partner")).unionByName(met.select(
        "first", F.when(F.col("gap") < 0, F.col("gapped")).otherwise(F.col("whole")).alias("partner")
    )).where(F.col("partner") < F.col("first")).distinct()
    theirs = may.select(F.col("first").alias("partner"), F.col("words").alias("theirs"))
    verified = pairs.join(theirs, "partner").join(may, "first").where(one_edit("words", "theirs"))
    return verified.select("first").distinct()


def repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, of_text, line_no`` of every line that an earlier one equals or differs from by one word.

    Earlier means a smaller (doc_id, hash of the row's text, line_no); which lines were dropped themselves
    does not matter. Lines are compared without outer blanks, words are what blanks separate; blank
    lines and rows with a null ``doc_id`` or text take no part. Rows with one id and different texts are
    documents of their own; a row repeated with the same text counts as the same document.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    places = _lines(docs).withColumn("words", _words("line")).select(
        *PLACE, F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), _halves().alias("halves")
    )
    places = stored(places, "places")
    lines = stored(places.groupBy("h1", "h2").agg(
        F.min(F.struct(*PLACE)).alias("first"), F.first("halves").alias("halves")
    ), "distinct")
    near = stored(near_repeats(docs, lines).withColumn("near", F.lit(True)), "near")
    known = lines.drop("halves").join(near, "first", "left")
    later = F.struct(*PLACE) != F.col("first")
    return places.drop("halves").join(known, ["h1", "h2"]).where(F.col("near") | later).select(*PLACE)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; the earliest stays.

    Columns and rows stay as they are, but ``n_chars``, if there, follows the new
    text, and ``n_lines`` / ``n_dropped`` (bigint) are added: lines of the row's
    text, and how many went. A null text stays null with 0 lines; a text whose
    lines all went is empty.
    """
    gone = stored(repeats(docs), "repeats").groupBy(F.col("doc_id").alias("_id"), F.col("of_text").alias("_of")).agg(
        F.sort_array(F.collect_set("line_no")).alias("at"))
    # One mark a line up to the last that goes, so that looking up a line costs the same wherever it is.
    before = F.transform("at", lambda x, i: x - F.when(i > 0, F.get("at", i - 1) + 1).otherwise(0))
    marks = F.array_join(F.transform(before, lambda n: F.concat(F.repeat(F.lit("."), n), F.lit("x"))), "")
    gone = gone.select("_id", "_of", F.split(marks, "").alias("_gone"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda line, i: F.coalesce(F.get("_gone", i) != "x", F.lit(True)))
    out = docs.drop("n_lines", "n_dropped").join(
        gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_of")), "left")
    out = out.withColumn("_kept", F.when(F.col("_gone").isNull(), lines).otherwise(kept))
    out = out.withColumns({
        "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"),
        "n_dropped": F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).cast("bigint"),
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")),
    })
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
