"""Removal of lines that recur across documents, by a tree of line templates.

A line goes down a tree of fixed depth: first by its number of words, then word by word through its first ``DEPTH`` words;
words with a digit count as variable. What meets in a leaf may be one template with variable fields: a word of a later
place is fixed if two different lines of the leaf share it there, else it is a field; leading words are fixed unless variable.
A line keeps its template if at least ``SIMILAR`` of its words are fixed; otherwise it stands for itself, digits aside. One that stands for itself and
has more words with a digit than without (rows of numbers) is compared exactly, with its digits. A template that stands in two
documents or more recurs: its lines stay in the first of these documents, by id, and are dropped in all others.

Everything is counted, not gathered: lines are first merged into distinct ones, leaves and fields are aggregates over these,
and only lines of leaves with several different lines are opened word by word. No leaf, line or template meets in one
task; joins on a hot line have narrow rows and are split by the engine.

Defined results: a document is its (doc_id, text); repeated rows are one document and get the same text. Null text stays
null, empty text empty. Lines of fewer than ``SHORTEST`` words are never dropped, unless they are long without blanks:
``LONG`` characters, or ``LETTERS`` letters of scripts that are written without blanks. A null id comes before all others. Other
columns pass through, whatever their names (but for any called n_lines or n_dropped). ``n_lines`` and ``n_dropped`` count the lines of a text and those dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Scratch, packed, place, restored
from parley.session import stage

#: Leading words that choose a leaf; words of the shortest line that can recur; share of fixed words that makes a template.
DEPTH, SHORTEST, SIMILAR = 3, 3, 0.75

#: Characters, or letters of scripts without blanks, from which a line of fewer words can recur.
LONG, LETTERS = 24, 6
_BLANKLESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
#: Stands between the masked words of a line and the line as it is, where that is compared too; no line holds it.
EXACT = "\n"

#: A word with a digit, in a line whose only blanks are single spaces.
VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"

#: Documents whose 8-byte marks may be broadcast to pick texts before these move: 8 MB. More are joined as they are.
FEW_DOCS = 1_000_000

DOC = ("doc_id", "mark")
LINE = ("line_a", "line_b")


def _key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mark", F.xxhash64("text"))


def _masked(line: Column) -> Column:
    """The line with its variable words masked, and as it is behind ``EXACT`` if more than half of its words are variable."""

    def form(masked: Column) -> Column:
        words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
        masks = (F.length(masked) - F.length(F.replace(masked, F.lit("<*>"), F.lit("")))) / 3
        return F.when(2 * masks > words, F.concat(masked, F.lit(EXACT), line)).otherwise(masked)

    return F.get(F.transform(F.array(F.regexp_replace(line, VARIABLE, "<*>")), form), F.lit(0))


def _split(rows: DataFrame) -> DataFrame:
    """One row per line: place, words joined by single blanks in lower case, variable words masked.

    Lines with more variable words than others have the unmasked words behind ``EXACT``.

    Blanks are brought into this form in the text as a whole, each step only where it changes something; the text is then cut
    into lines once, and only lines with a digit are looked at word by word.
    """

    def where(test, change) -> None:
        nonlocal text  # bound as a variable, so that it is computed once
        text = F.get(F.transform(F.array(text), lambda t: F.when(test(t), change(t)).otherwise(t)), F.lit(0))

    text = F.lower("text")
    where(lambda t: t.contains("\t") | t.contains("\r") | t.contains("\x0b") | t.contains("\x0c"), lambda t: F.translate(t, "\t\r\x0b\x0c", "    "))
    where(lambda t: t.contains("  "), lambda t: F.regexp_replace(t, " {2,}", " "))
    where(lambda t: t.contains(" \n") | t.contains("\n "), lambda t: F.regexp_replace(t, " ?\n ?", "\n"))
    formed = F.transform(F.split(F.trim(text), "\n", -1), lambda line: F.when(line.rlike("[0-9]"), _masked(line)).otherwise(line))
    whole = rows.select(*DOC, formed.alias("lines"))
    return whole.select(*DOC, F.posexplode("lines").alias("place", "words")).where("words <> ''")


def _leaves(lines: DataFrame) -> DataFrame:
    n = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1
    plain = F.substring_index("words", EXACT, -1)
    foreign = F.octet_length("words") > F.length("words")
    return (
        lines.withColumn("wide", (F.length(plain) >= LONG) | foreign & plain.rlike(rf"(?:[{_BLANKLESS}][^{_BLANKLESS}]*+){{{LETTERS}}}"))
        .withColumn("exact", F.when(F.col("words").contains(EXACT), F.xxhash64("words")).otherwise(F.lit(0).cast("long")))
        .withColumn("words", F.substring_index("words", EXACT, 1))
        .withColumn("n", n)
        .where((F.col("n") >= SHORTEST) | F.col("wide"))
        .drop("wide")
        .withColumn("leaf", F.xxhash64("n", F.substring_index("words", " ", DEPTH)))
        .withColumn("line_a", F.xxhash64("words"))
        .withColumn("line_b", F.xxhash64(F.lit(1), "words"))
    )


def _same(a: DataFrame, b: DataFrame, names, how: str) -> DataFrame:
    """Join on equal names, null equal to null; keeps the names of the left side."""
    right = b.select(*(F.col(c).alias(f"_{c}") if c in names else c for c in b.columns))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return a.join(right, on, how).drop(*(f"_{c}" for c in names))


def picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents whose mark is wanted, so that only their texts move in the join that follows; all if there are too many."""
    if wanted.count() > FEW_DOCS:
        return docs
    marks = wanted.select(F.col("mark").alias("_few")).distinct()
    return docs.join(F.broadcast(marks), F.col("mark") == F.col("_few"), "left_semi")


def templates(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """line_a, line_b and the template (tmpl_a, tmpl_b) of every distinct line whose template has fields.

    docs: doc_id, mark, text. distinct: a row per distinct line with its leaf, length and first occurrence.
    """
    crowded = distinct.where(F.col("n") > DEPTH).groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1").select("leaf")
    opened = distinct.join(crowded, "leaf", "left_semi").select("leaf", *LINE, "n", F.col("first.doc_id").alias("doc_id"), F.col("first.mark").alias("mark"), F.col("first.place").alias("place"))
    # one occurrence of each such line gives its words; a document lists the places that are wanted of it
    wanted = opened.groupBy(*DOC).agg(F.collect_set("place").alias("wanted"))
    wanted = scratch.stage(wanted)
    texts = _same(picked(docs, wanted), wanted, DOC, "inner").withColumn("all", F.split("text", "\n", -1))
    texts = texts.select(*DOC, F.array_join(F.transform("wanted", lambda i: F.get("all", i)), "\n").alias("text"))
    lead = F.size(F.filter(F.slice(F.split("words", " "), 1, DEPTH), lambda word: word != "<*>"))
    lines = _leaves(_split(texts)).select("leaf", *LINE, "n", "words", lead.alias("lead")).dropDuplicates(list(LINE))
    words = (
        lines.select("leaf", *LINE, "n", "lead", F.posexplode(F.split("words", " ")).alias("at", "word"))
        .where((F.col("at") >= DEPTH) & (F.col("word") != "<*>"))
        .withColumn("word", F.xxhash64("word"))
    )
    words = scratch.stage(words)
    fixed = words.groupBy("leaf", "at", "word").agg(F.count("*").alias("lines")).where("lines > 1").drop("lines")
    kept = words.join(fixed, ["leaf", "at", "word"]).groupBy(*LINE, "leaf", "n", "lead").agg(
        F.count("*").alias("n_fixed"), F.sum(F.xxhash64("at", "word").cast("decimal(38,0)")).alias("sum_a"), F.sum(F.xxhash64(F.lit(1), "at", "word").cast("decimal(38,0)")).alias("sum_b")
    )
    general = kept.where((F.col("n_fixed") + F.col("lead")) >= SIMILAR * F.col("n")).select(*LINE, F.xxhash64("leaf", "n_fixed", "sum_a").alias("tmpl_a"), F.xxhash64("leaf", "n_fixed", "sum_b").alias("tmpl_b"))
    return general


def recurring(docs: DataFrame) -> DataFrame:
    """doc_id, mark and the places of the lines to drop, for every document that has any."""
    scratch = Scratch(docs.sparkSession)
    places = scratch.stage(_leaves(_split(docs)).drop("words"))
    occurrence = F.struct("doc_id", "mark", "place")
    distinct = scratch.stage(places.groupBy(*LINE, "exact", "leaf", "n").agg(F.min(occurrence).alias("first"), F.max(occurrence).alias("last")))
    general = templates(docs, distinct, scratch)
    owned = distinct.join(general, list(LINE), "left").withColumn("tmpl_a", F.coalesce("tmpl_a", F.when(F.col("exact") == 0, F.col("line_a")).otherwise(F.col("exact")))).withColumn("tmpl_b", F.coalesce("tmpl_b", "line_b"))
    owned = scratch.stage(owned.select(*LINE, "exact", "tmpl_a", "tmpl_b", "first", "last"))
    across = owned.groupBy("tmpl_a", "tmpl_b").agg(F.min("first").alias("head"), F.max("last").alias("tail"))
    other = ~(F.col("head.doc_id").eqNullSafe(F.col("tail.doc_id")) & (F.col("head.mark") == F.col("tail.mark")))
    across = across.where(other).select("tmpl_a", "tmpl_b", F.col("head.doc_id").alias("head_id"), F.col("head.mark").alias("head_mark"))
    lines = owned.join(across, ["tmpl_a", "tmpl_b"]).select(*LINE, "exact", "head_id", "head_mark")
    dropped = places.join(lines, [*LINE, "exact"]).where(~(F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("mark") == F.col("head_mark"))))
    drops = stage(dropped.groupBy(*DOC).agg(F.collect_set("place").alias("drop")))
    scratch.clear()
    return drops


def _deduplicated(documents: DataFrame) -> DataFrame:
    """Packed rows with their new text, n_lines and n_dropped."""
    rows = _key(packed(documents, "doc_id", "text"))
    drops = recurring(rows.select(*DOC, "text").where("text IS NOT NULL"))
    joined = _same(rows, drops, DOC, "left").withColumn("lines", F.split("text", "\n", -1))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    new = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("int")
    n_dropped = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("int")
    return joined.select("packed_row", new.alias("text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def drop_recurring(documents: DataFrame) -> DataFrame:
    """documents without recurring lines, with n_lines and n_dropped as last columns."""
    return restored(_deduplicated(documents), documents, {"text": F.col("text")}, {"n_lines": F.col("n_lines"), "n_dropped": F.col("n_dropped")})


def keep_rest(documents: DataFrame, length: str = "n_chars") -> DataFrame:
    """documents without recurring lines, in their own columns; the column of lengths follows the text.

    A document that consists of nothing but recurring lines goes; one that was empty before stays.
    """
    rows = _deduplicated(documents).where((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    replaced = {"text": F.col("text")}
    if length in documents.columns:
        old = F.col(f"packed_row.c{place(documents, length)}")
        replaced[length] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(old).cast(documents.schema[place(documents, length)].dataType)
    return restored(rows, documents, replaced)
