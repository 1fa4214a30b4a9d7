"""Sentence-aware overlapping chunks, and the pages that they lie on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.cleaning import trim_space
from paperloom.operators.page_join import overlapping

SEPARATOR = r"\n\n+|(?<=[.!?])\s+"
#: Characters of a bin when chunks and pages meet.
CHAR_WIDTH = 2048
SPANS = "array<struct<start:int,end:int>>"


def sentences(text: Column) -> Column:
    """Units between blank lines and after sentence ends; blank units are dropped."""
    return F.filter(F.split(text, SEPARATOR), lambda u: u.rlike(r"\S"))


def unit_spans(text: Column) -> Column:
    """[start, end) of the units, from the lengths of the units and of what separates them."""
    lengths = F.transform(F.split(text, SEPARATOR, -1), lambda u: F.struct(F.length(u).alias("n"), u.rlike(r"\S").alias("full")))
    gaps = F.transform(F.regexp_extract_all(text, F.lit(SEPARATOR), F.lit(0)), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + x["lengths"]["n"]
        out = F.when(x["lengths"]["full"], F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end"))))).otherwise(a["out"])
        return F.struct((end + F.coalesce(x["gaps"], F.lit(0))).alias("at"), out.alias("out"))

    return F.aggregate(F.arrays_zip(lengths.alias("lengths"), gaps.alias("gaps")), start, step, lambda a: a["out"])


def hard_split(length: Column, size: int, overlap: int) -> Column:
    """Fixed windows that stop at the first one to reach the end."""
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), length - overlap - 1), F.lit(size - overlap))
    return F.when(length > 0, F.transform(steps, lambda s: F.struct(s.alias("start"), F.least(s + size, length).alias("end")))).otherwise(F.array().cast(SPANS))


def chunk_spans(text: Column, size: int = 3000, overlap: int = 400) -> Column:
    """Greedy windows over sentence units: at most one chunk ends at each unit, so a chunk may exceed ``size``."""
    units, n = unit_spans(text), F.length(text)
    start = F.struct(F.lit(0).alias("start"), F.array().cast(SPANS).alias("out"))

    def step(a: Column, u: Column) -> Column:
        full = (u["end"] - a["start"] > size) & (a["start"] < u["start"])
        emitted = F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), u["start"].alias("end"))))
        return F.when(full, F.struct(F.greatest(a["start"], u["start"] - overlap).alias("start"), emitted.alias("out"))).otherwise(a)

    folded = F.aggregate(units, start, step, lambda a: F.when(a["start"] < n, F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), n.alias("end"))))).otherwise(a["out"]))
    return F.when(text.rlike(r"\S"), folded).otherwise(hard_split(n, size, overlap))


def chunk_documents(docs: DataFrame, text: str, size: int = 3000, overlap: int = 400) -> DataFrame:
    """A row for each chunk with stripped content; empty ones are dropped, but the numbering keeps their place."""
    spans = docs.select("*", F.posexplode(chunk_spans(F.col(text), size, overlap)).alias("chunk_index", "span"))
    content = trim_space(F.expr(f"substring({text}, span.start + 1, span.end - span.start)"))
    return spans.withColumn("chunk_content", content).where("chunk_content <> ''").withColumns({"start_char": F.col("span.start"), "end_char": F.col("span.end")}).drop("span")


def page_offsets(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """char_start and char_end of each page in the text joined by newlines."""
    from pyspark.sql.window import Window

    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    return pages.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length(text))


def page_ranges(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """First and last page that each chunk overlaps; a join by bins of CHAR_WIDTH characters, so that a document of very many pages is no nested comparison."""
    spans = chunks.select(F.col("doc_id").alias("scope"), "chunk_index", F.col("start_char").alias("a_first"), (F.col("end_char") - 1).alias("a_last"))
    laid = pages.select(F.col("doc_id").alias("scope"), "page_number", F.col("char_start").alias("b_first"), (F.col("char_end") - 1).alias("b_last"))
    both = overlapping(spans, laid, CHAR_WIDTH).groupBy(F.col("scope").alias("doc_id"), "chunk_index")
    return both.agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
