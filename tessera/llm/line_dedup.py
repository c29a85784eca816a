"""Line deduplication over content-defined chunks, in DataFrame operations only.

A text is split at newlines. Every line is hashed, a rolling hash combines each line with the one
before, and where it is divisible by ``divisor`` (and the place before was not) a chunk ends. A cut
depends on two or three neighbouring lines alone, so the cuts of a passage are the same wherever it
stands, and chunks between cuts have two lines or more. Chunks of at least ``min_lines`` lines that
occur at several places are grouped by fingerprint, then by their bytes; the first place (smallest
doc_id, then chunk number) keeps the chunk and the other places lose it.

Chunks miss repeats that hold no two cuts. ``dedup_runs`` first takes the repeated chunks as above and
then what they leave: every run of ``min_lines`` lines that is not inside a chunk that goes is a window,
grouped by fingerprint, then by its bytes, and all lines of a window that occurs earlier (smallest
doc_id, then line number) go too. A chunk that goes holds earlier windows only, so every repeated run
of ``min_lines`` lines or more is found, as if all windows had been compared.

Null texts stay null, texts without repeated chunks stay as they are, and a text all of whose
chunks go becomes empty: no row is dropped. Texts of any length are cut whole. Equal rows (same
doc_id and text) count as one document and are treated alike. Null doc_ids order last. Extra columns,
whatever their names, are kept; only in the reports, columns named as the report's own are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

DIVISOR, MIN_LINES = 4, 2


def line_chunks(docs: DataFrame, text: str, divisor: int) -> DataFrame:
    """Add ``_ld_chunks``: array of strings, which joined by newlines give the text; ``_ld_starts``: their first lines.

    The lines are joined again with a flag before each, 1 where a chunk starts, and split at the
    flagged newlines: every expression walks its array once, whatever the number of lines.
    """
    line_hash = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")
    shifted = lambda c, first: F.concat(F.array(first), F.slice(F.col(c), F.lit(1), F.size(c) - 1))
    return (
        docs.withColumn("_ld_lines", F.split(F.col(text), "\n", -1))
        .withColumn("_ld_hash", F.transform("_ld_lines", line_hash))
        .withColumn("_ld_cut", F.zip_with("_ld_hash", shifted("_ld_hash", F.lit(0).cast("long")), lambda h, p: F.pmod(h + p * 31, F.lit(divisor)) == 0))
        .withColumn("_ld_cut", F.zip_with("_ld_cut", shifted("_ld_cut", F.lit(False)), lambda c, p: c & ~p))
        .withColumn("_ld_flag", F.zip_with("_ld_lines", shifted("_ld_cut", F.lit(False)), lambda x, c: F.concat(F.when(c, "1").otherwise("0"), x)))
        .withColumn("_ld_chunks", F.transform(F.split(F.substring(F.array_join("_ld_flag", "\n"), 2, 2**31 - 1), "\n1", -1), lambda x: F.replace(x, F.lit("\n0"), F.lit("\n"))))
        .withColumn("_ld_starts", F.filter(F.transform(shifted("_ld_cut", F.lit(True)), lambda c, i: F.when(c, i)), F.isnotnull))
        .drop("_ld_lines", "_ld_hash", "_ld_cut", "_ld_flag")
    )


def repeated_chunks(documents: DataFrame, work: Workspace, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """``_ld_id, _ld_text, chunk, lines``: the places (document, chunk number) that lose their chunk."""
    keyed = documents.select(F.col("doc_id").alias("_ld_id"), F.xxhash64("text").alias("_ld_text"), F.col("text"))
    # The outer form keeps the optimiser from repeating the whole expression in a filter below it.
    chunks = (
        line_chunks(keyed, "text", divisor).select("_ld_id", "_ld_text", F.posexplode_outer("_ld_chunks").alias("chunk", "body"))
        .withColumn("lines", 1 + F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))).where(F.col("lines") >= min_lines)
        .withColumn("print", F.xxhash64("body"))
    )
    place = F.struct(F.col("_ld_id").isNull().alias("last"), "_ld_id", "_ld_text", "chunk")
    several = lambda least: least.where("low <> high").drop("high")
    prints = work.save(several(chunks.groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high"))).select("print"))
    found = work.save(chunks.join(prints, "print"))
    # A table of its own: the places of a common chunk are then a skewed side of a join, which can be split.
    first = work.save(several(found.groupBy("print", "body").agg(F.min(place).alias("low"), F.max(place).alias("high"))))
    lost = found.join(first.hint("merge"), ["print", "body"]).where(place != F.col("low")).select("_ld_id", "_ld_text", "chunk", "lines").distinct()
    lost = work.save(lost)
    work.drop(prints, found, first)
    return lost


def _keyed(documents: DataFrame) -> DataFrame:
    """``kept`` (a struct of all columns but text), the text, and its key; no column of the input stands beside them."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    return documents.select(F.struct(*rest).alias("kept"), F.col("text"), F.xxhash64("text").alias("_ld_key"))


def _beside(documents: DataFrame, gone: DataFrame) -> DataFrame:
    # A merge join at every size: the plan measured on a small corpus is the one a large corpus runs.
    rows = _keyed(documents)
    return rows.join(gone.hint("merge"), rows["kept.doc_id"].eqNullSafe(gone["_ld_id"]) & (rows["_ld_key"] == gone["_ld_text"]), "left")


def _columns(documents: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``documents`` with the new text; ``n_chars`` is recounted where the text changed."""
    values = {"text": F.col("_ld_new").alias("text")}
    if "n_chars" in documents.columns:
        count = F.length("_ld_new").cast(documents.schema["n_chars"].dataType)
        values["n_chars"] = F.when(F.col("_ld_gone").isNull(), F.col("kept.n_chars")).otherwise(count).alias("n_chars")
    return [values.get(c, F.col(f"kept.`{c}`")) for c in documents.columns if c not in but]


def dedup_lines(documents: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """``documents`` with repeated chunks removed, plus ``lines_removed`` and ``chunks_removed``."""
    work = Workspace(documents.sparkSession, "line-dedup")
    lost = repeated_chunks(documents, work, divisor, min_lines)
    gone = lost.groupBy("_ld_id", "_ld_text").agg(F.collect_set("chunk").alias("_ld_gone"), F.sum("lines").alias("_ld_count"))
    kept = F.expr("filter(_ld_chunks, (c, i) -> not array_contains(_ld_gone, i))")
    cut = line_chunks(_beside(documents, gone), "text", divisor).withColumn("_ld_new", F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return cut.select(
        *_columns(documents, ("lines_removed", "chunks_removed")),
        F.coalesce("_ld_count", F.lit(0)).cast("long").alias("lines_removed"),
        F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("chunks_removed"),
    )


def _window(lines: str, at: Column, min_lines: int) -> Column:
    return F.concat_ws("\n", *[F.get(lines, at + k) for k in range(min_lines)])


def repeated_runs(documents: DataFrame, work: Workspace, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """``_ld_id, _ld_text, at``: the windows of ``min_lines`` lines, by first line, that occur earlier.

    Those inside a repeated chunk come from ``repeated_chunks``; only the others are compared as windows.
    """
    chunks = repeated_chunks(documents, work, divisor, min_lines)
    gone = chunks.groupBy("_ld_id", "_ld_text").agg(F.collect_set("chunk").alias("_ld_gone"))
    own = [F.col("kept.doc_id").alias("_ld_id"), F.col("_ld_key").alias("_ld_text")]
    none = F.array().cast("array<int>")
    # array_except hashes and get does not walk: the work grows with the lines.
    inside = F.flatten(F.transform("_ld_gone", lambda k: F.sequence(F.get("_ld_starts", k), F.coalesce(F.get("_ld_starts", k + 1), F.size("_ld_lines")) - min_lines)))
    every = F.when(F.size("_ld_lines") >= min_lines, F.sequence(F.lit(0), F.size("_ld_lines") - min_lines)).otherwise(none)
    cut = line_chunks(_beside(documents, gone), "text", divisor).withColumn("_ld_lines", F.split("text", "\n", -1)).withColumn("_ld_inside", F.coalesce(inside, none))
    entry = lambda i, key: F.struct(i.alias("at"), key.cast("long").alias("print"))
    outside = F.transform(F.array_except(every, "_ld_inside"), lambda i: entry(i, F.xxhash64(_window("_ld_lines", i, min_lines))))
    windows = work.save(cut.select(*own, F.inline(F.concat(outside, F.transform("_ld_inside", lambda i: entry(i, F.lit(None)))))))
    work.drop(chunks)
    place = F.struct(F.col("_ld_id").isNull().alias("last"), "_ld_id", "_ld_text", "at")
    several = lambda least: least.where("low <> high").drop("high")
    prints = work.save(several(windows.where("print is not null").groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high"))).select("print"))
    asked = work.save(windows.join(prints.hint("merge"), "print").select("_ld_id", "_ld_text", "at"))
    asked_of = asked.groupBy("_ld_id", "_ld_text").agg(F.collect_set("at").alias("_ld_at"))
    lines = _beside(documents, asked_of).where("_ld_at is not null").select(*own, F.split("text", "\n", -1).alias("_ld_lines"), F.explode("_ld_at").alias("at"))
    # Tables of their own, as for chunks: the places of a common window are a skewed side that can be split.
    found = work.save(lines.select("_ld_id", "_ld_text", "at", _window("_ld_lines", F.col("at"), min_lines).alias("body")).withColumn("print", F.xxhash64("body")))
    first = work.save(several(found.groupBy("print", "body").agg(F.min(place).alias("low"), F.max(place).alias("high"))))
    later = found.join(first.hint("merge"), ["print", "body"]).where(place != F.col("low"))
    lost = work.save(later.select("_ld_id", "_ld_text", "at").unionByName(windows.where("print is null").select("_ld_id", "_ld_text", "at")).distinct())
    work.drop(windows, prints, asked, found, first)
    return lost


def _without_runs(documents: DataFrame, min_lines: int) -> DataFrame:
    lost = repeated_runs(documents, Workspace(documents.sparkSession, "line-runs"), min_lines=min_lines)
    gone = lost.groupBy("_ld_id", "_ld_text").agg(F.collect_set("at").alias("_ld_gone"))
    # array_except hashes: the work grows with the lines, not with their square.
    lines = F.flatten(F.transform("_ld_gone", lambda at: F.sequence(at, at + (min_lines - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), lines)
    return (
        _beside(documents, gone).withColumn("_ld_lines", F.split("text", "\n", -1))
        .withColumn("_ld_kept", F.when(F.col("_ld_gone").isNotNull(), F.transform(kept, lambda i: F.get("_ld_lines", i))))
        .withColumn("_ld_new", F.coalesce(F.array_join("_ld_kept", "\n"), F.col("text")))
    )


def remove_repeated_runs(documents: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``documents``, with the same columns, without the lines of repeated runs."""
    return _without_runs(documents, min_lines).select(*_columns(documents))


def dedup_runs(documents: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``documents`` without the lines of repeated runs, plus ``lines_removed``."""
    removed = F.coalesce(F.size("_ld_lines") - F.size("_ld_kept"), F.lit(0)).cast("long").alias("lines_removed")
    return _without_runs(documents, min_lines).select(*_columns(documents, ("lines_removed",)), removed)
