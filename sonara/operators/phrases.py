"""Removal of known spurious phrases from segments, by column functions.

A segment is a list of units (its words, or what blanks part in its text). It is written as one string of marks: a unit with
words is `<said>`, or `<^said>` if it begins with a capital, and its own end follows as `!` (a sentence ends there) or `-`; a
unit without words is its end alone. A language's phrases are one pattern over such strings, the longest first, so a search
from the left takes the longest phrase at each place and none that overlap, and borders of units are part of the pattern.
Runs (a phrase, or a unit that is in none, each with the wordless units behind it) then look at their neighbours only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonara.functions.text import ends_sentence, normal_words, plain_lower, starts_upper
from sonara.operators import scan
from sonara.schema import WORD

#: Words of a phrase that goes wherever it stands.
ANYWHERE = 3

#: A small list to begin with; give your own as {language: [phrase, ...]}.
SEED = {
    "en": ["thanks for watching", "thank you for watching", "please subscribe", "subtitles by", "thank you"],
    "de": ["untertitel im auftrag", "vielen dank"],
    "fr": ["merci d'avoir regardé", "sous-titres réalisés"],
    "es": ["gracias por ver", "subtítulos realizados"],
    "ru": ["продолжение следует", "спасибо за просмотр"],
}

#: Phrases that a block list may have: it travels with every task.
LIST_MOST = 100_000
#: What parts two words of a phrase: a blank inside a unit, or a unit's end and the next one's beginning.
_BETWEEN = r"(?: |>[!-]+<\^?)"


def blocklist(spark: SparkSession, phrases: dict[str, list[str]]) -> DataFrame:
    """(language, phrase, words) with the words normalised."""
    rows = [(lang, p) for lang, ps in phrases.items() for p in ps]
    return spark.createDataFrame(rows, "language string, phrase string").withColumn("words", normal_words(F.col("phrase")))


def phrase_lists(listed: DataFrame) -> dict[str, list[str]]:
    """{language: [phrase, ...]} of rows (language, phrase, ordinal), as a phrase file is read; for filter_phrases. Null phrases
    are left out. A list beyond LIST_MOST phrases is an error, as lists go to every task."""
    rows = listed.filter(F.col("language").isNotNull() & F.col("phrase").isNotNull()).select("language", "ordinal", "phrase").limit(LIST_MOST + 1).collect()
    if len(rows) > LIST_MOST:
        raise ValueError(f"a block list may have {LIST_MOST} phrases")
    found: dict[str, list[str]] = {}
    for language, _, phrase in sorted(map(tuple, rows)):
        found.setdefault(language, []).append(phrase)
    return found


def whole_matches(texts: DataFrame, phrases: DataFrame, text: str, language: str) -> DataFrame:
    """The rows of texts that are a phrase of their language and nothing else, by words, or by trimmed lower case where
    neither has words. phrases is the block list: a few thousand rows, so Catalyst broadcasts it by its size."""
    named = phrases.select(F.col("language").alias("_lang"), F.col("words").alias("_words"), F.when(F.size("words") == 0, F.lower(F.trim("phrase"))).alias("_bare")).distinct()
    words = normal_words(F.col(text))
    same = (F.col(language) == F.col("_lang")) & (words == F.col("_words")) & ((F.size(words) > 0) | (F.lower(F.trim(text)) == F.col("_bare")))
    return texts.join(named, same, "left_semi")


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def patterns(spark: SparkSession, phrases: dict[str, list[str]]) -> DataFrame:
    """(language, pattern, bare) of each language: a pattern over marks that fits its phrases with words, null if it has
    none, and the phrases without words, trimmed and in lower case."""
    if sum(map(len, phrases.values())) > LIST_MOST:
        raise ValueError(f"a block list may have {LIST_MOST} phrases")
    listed = blocklist(spark, phrases).filter(F.col("phrase").isNotNull())
    worded = F.when(F.size("words") > 0, F.struct((-F.size("words")).alias("rank"), F.array_join("words", _BETWEEN).alias("way")))
    held = listed.groupBy("language").agg(F.array_sort(F.collect_set(worded)).alias("ways"), F.collect_set(F.when(F.size("words") == 0, plain_lower(_trimmed(F.col("phrase"))))).alias("bare"))
    either = F.array_join(F.transform("ways", lambda w: w["way"]), "|")
    return held.select("language", F.when(F.size("ways") > 0, F.concat(F.lit(r"<\^?(?:"), either, F.lit(r")>[!-]+"))).alias("pattern"), "bare")


def marks(units: Column) -> Column:
    """The string of marks of an array of units."""
    seen = F.transform(units, lambda u: F.struct(F.array_join(normal_words(u), " ").alias("said"), starts_upper(u).alias("upper"), F.when(ends_sentence(u), "!").otherwise("-").alias("stop")))
    each = F.transform(seen, lambda u: F.when(u["said"] == "", u["stop"]).otherwise(F.concat(F.when(u["upper"], "<^").otherwise("<"), u["said"], F.lit(">"), u["stop"])))
    return F.array_join(each, "")


def _goes(before: Column, run: Column, after: Column) -> Column:
    """Whether a run goes, by itself and the runs beside it; the text's ends are runs without text."""
    repeated = (before["listed"] & (before["said"] == run["said"])) | (after["listed"] & (after["said"] == run["said"]))
    opens = (before["run"] == "") | F.endswith(before["run"], F.lit("!")) | F.startswith(run["run"], F.lit("<^"))
    closes = (after["run"] == "") | F.regexp_extract(run["run"], "([!-]+)$", 1).contains("!") | F.startswith(after["run"], F.lit("<^"))
    return run["listed"] & ((run["n"] >= ANYWHERE) | ((run["n"] == ANYWHERE - 1) & (repeated | (opens & closes))))


def clean_phrases(segments: DataFrame, phrases: dict[str, list[str]] | DataFrame, language: str = "language") -> DataFrame:
    """segments (start_ns, end_ns, text, words, language, ...) with phrases taken out of text and words, and a new column
    `dropped`: nothing is left of the row. phrases are lists by language, or the rows of a phrase file.

    A segment that consists of phrases goes. Of others, phrases of three words or more go, and those of two that are
    repeated back to back or stand apart: behind the text's start, a sentence's end or with a capital, and before the text's
    end, a sentence's end or a capital. Units without words go with the one before. Start and end move only with words at
    the edges. A segment without any words goes if its text is a phrase without words. Rows that keep all units keep their
    text as it is, nulls too; so do rows whose language is null or has no list. Null words and units are empty. Row by row:
    no row moves. The pattern of a language travels with every task, which LIST_MOST bounds.
    """
    phrases = phrase_lists(phrases) if isinstance(phrases, DataFrame) else phrases
    names = segments.columns
    listed = patterns(segments.sparkSession, phrases).select(F.col("language").alias("_lang"), F.col("pattern").alias("_pattern"), F.concat(F.lit("^(?:"), "pattern", F.lit(")$")).alias("_whole"), F.concat(F.lit("("), "pattern", F.lit("|<[^>]*>[!-]+)")).alias("_parts"), F.col("bare").alias("_bare"))
    rows = segments.join(F.broadcast(listed), segments[language] == F.col("_lang"), "left")
    in_text = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)(\S+)"), F.lit(1))
    spoken = F.transform("words", lambda w: F.coalesce(w["word"], F.lit("")))
    rows = rows.withColumn("_units", F.when(F.col("_lang").isNotNull(), F.when(F.size("words") > 0, spoken).otherwise(in_text)))
    rows = rows.withColumn("_marks", marks(F.col("_units")))
    runs = F.when(F.regexp_like("_marks", F.col("_pattern")), F.regexp_extract_all("_marks", F.col("_parts"), F.lit(1)))
    said = F.transform(runs, lambda r: F.struct(r.alias("run"), F.regexp_extract_all(r, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("w"), F.regexp_like(r, F.col("_whole")).alias("listed")))
    run = lambda r, said, n, listed: F.struct(r.alias("run"), said.alias("said"), n.alias("n"), listed.alias("listed"))
    rows = rows.withColumn("_runs", F.transform(said, lambda r: run(r["run"], F.array_join(r["w"], " "), F.size(r["w"]), r["listed"])))
    # units without words before all others stay
    rows = rows.withColumn("_head", F.regexp_extract("_marks", "^([!-]*)", 1))
    edge = lambda text: F.array(run(text, F.lit(""), F.lit(0), F.lit(False)))
    rows = rows.withColumns({"_before": F.concat(edge(F.col("_head")), F.slice("_runs", 1, F.size("_runs") - 1)), "_after": F.concat(F.slice("_runs", 2, F.size("_runs")), edge(F.lit("")))})
    judged = F.transform(F.arrays_zip("_before", "_runs", "_after"), lambda z: F.struct(_goes(z["_before"], z["_runs"], z["_after"]).alias("gone"), F.length(F.regexp_replace(z["_runs"]["run"], "[^!-]", "")).alias("units")))
    rows = rows.withColumn("_judged", judged)
    all_gone = F.forall("_runs", lambda r: r["listed"]) | F.forall("_judged", lambda r: r["gone"])
    bare = ~F.col("_marks").contains("<") & F.array_contains("_bare", plain_lower(_trimmed(F.coalesce("text", F.lit("")))))
    cut = F.exists("_judged", lambda r: r["gone"])
    stay = F.concat(F.array_repeat(F.lit(True), F.length("_head")), F.flatten(F.transform("_judged", lambda r: F.array_repeat(~r["gone"], r["units"]))))
    rows = rows.withColumn("_stay", F.when(cut, stay))
    left = lambda x: F.transform(F.filter(F.zip_with(x, "_stay", lambda v, s: F.struct(v.alias("v"), s.alias("s"))), lambda z: z["s"]), lambda z: z["v"])
    rows = rows.withColumns({"_text": F.array_join(F.transform(left("_units"), _trimmed), " "), "_words": F.when(F.size("words") > 0, left("words")).otherwise(F.col("words"))})
    worded, first, last = F.size("words") > 0, F.get("_words", F.lit(0)), F.try_element_at("_words", F.lit(-1))
    new = {
        "text": F.when(F.col("_stay").isNull(), F.col("text")).otherwise(F.col("_text")),
        "words": F.when(F.col("_stay").isNull(), F.col("words")).otherwise(F.col("_words")),
        "start_ns": F.when(worded & ~F.get("_stay", F.lit(0)), first["start_ns"]).otherwise(F.col("start_ns")),
        "end_ns": F.when(worded & ~F.try_element_at("_stay", F.lit(-1)), last["end_ns"]).otherwise(F.col("end_ns")),
    }
    return rows.select(*(new[n].alias(n) if n in new else F.col(f"`{n}`") for n in names), F.coalesce(all_gone, bare, F.lit(False)).alias("dropped"))


def filter_phrases(segments: DataFrame, phrases: dict[str, list[str]] | DataFrame, language: str = "language", block: Column | None = None) -> DataFrame:
    """Segments (rec_id, id, start_ns, end_ns, text, words, language) without phrases, numbered anew from 1 by id, then time
    and text; see clean_phrases. Large recordings take a block of ids, as scans do."""
    columns = ["rec_id", F.col("id").cast("int").alias("id"), "start_ns", "end_ns", "text", F.col("words").cast(f"array<{WORD}>").alias("words"), language]
    cleaned = clean_phrases(segments.select(*columns), phrases, language)
    # rows that go are numbered along and left out behind the exchange, so that texts are looked at once
    numbered = scan.scanned(cleaned, "rec_id", ["id", "start_ns", "end_ns", "text"], block, _number=scan.running_sum(F.when(F.col("dropped"), 0).otherwise(1)))
    return numbered.filter(~F.col("dropped")).select("rec_id", F.col("_number").cast("int").alias("id"), "start_ns", "end_ns", "text", "words", language)
