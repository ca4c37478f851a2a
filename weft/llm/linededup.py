"""Line dedup by content-defined line chunks, in DataFrame functions only.

1. Each non-blank line has a hash; lines whose hash occurs twice or more are repeated. A document's runs of
   consecutive repeated lines (blank lines between them don't count) are the only places where repeated passages can be.
2. A run is cut between two lines wherever a repeated passage ends there: where the ordered pair of the lines does not itself repeat, or
   occurs less often than the pair before or after it (one passage next to another). Between those borders it is cut where a rolling hash over
   the last two line hashes meets a mask, unless the place before meets it, too, or a border lies next to it. Whether a place is cut depends on
   its neighbours only, so the same passage is cut in the same way wherever it stands, an insertion moves only the cuts next to it, and a document
   of any number of lines is cut by windows over its rows. A line of ``LONG_WORDS`` words or more always makes its own chunk: a passage that was put on one line.
   A pair that repeats across a border is a chunk of two lines besides, so that a line left alone between two cuts goes with its neighbour.
3. Chunks of two lines or more, and long single lines, are candidates. Their texts are fetched and compared byte by
   byte (grouped by the text itself, with a partial aggregation): all but the first occurrence, by doc_id and line, are removed.

Runs and candidates travel as hashes; the texts of all documents move twice, to fetch candidates and to apply the removals.
Hot lines and hot passages are pre-aggregated before they move and joined from a side that is one row each.

Cases: a null text stays null and an empty one empty; texts are handled whole; rows that repeat a doc_id and text count
as one and change in the same way; rows without a doc_id pass unchanged and don't count as occurrences; blank lines are left out of comparisons
and stay, inside of removed passages, too; other columns pass through, whatever their names; no row is dropped, a document whose every line goes
keeps an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm._columns import bound, free_names, numbered
from weft.session import materialize, table

LONG_WORDS = 50
MEAN_LINES = 4
_DOC = ["doc_id", "_key"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _spaced(line: Column) -> Column:
    return F.translate(line, "\t\n\x0b\x0c\r", "     ")


def _has_words(line: Column) -> Column:
    return F.length(F.trim(_spaced(line))) > 0


def repeated_lines(keyed: DataFrame, text: str) -> DataFrame:
    """(doc_id, _key, k, pos, h, long, p) of lines that occur more than once. k, pos: place among non-blank and among all lines; p: occurrences of the pair of a line and the next."""
    kept = F.filter(F.transform(_lines(F.col(text)), lambda line, i: F.struct(i.alias("pos"), line.alias("line"))), lambda x: _has_words(x["line"]))
    kept = keyed.where(F.col("doc_id").isNotNull()).select(*_DOC, kept.alias("kept"))
    both = F.arrays_zip(F.col("kept").alias("x"), F.slice("kept", F.lit(2), F.size("kept")).alias("y"))
    lines = kept.select(*_DOC, F.posexplode(both).alias("k", "b")).select(*_DOC, "k", F.col("b.x").alias("x"), F.col("b.y").alias("y"))
    words = F.size(F.filter(F.split(_spaced(F.col("x.line")), " "), lambda w: w != ""))
    # the last line of a document makes a pair of its own, so that no null key gathers in one task
    pair = F.when(F.col("y").isNull(), F.xxhash64(*_DOC, F.lit("end"))).otherwise(F.xxhash64(F.xxhash64("x.line"), F.xxhash64("y.line")))
    lines = lines.select(*_DOC, "k", F.col("x.pos").alias("pos"), F.xxhash64("x.line").alias("h"), pair.alias("h2"), (words >= LONG_WORDS).alias("long"))
    lines = materialize(lines, "lines")
    # written, so that the joins deal the lines anew and may split a hot one
    again = materialize(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "again")
    pairs = materialize(lines.groupBy("h2").agg(F.count(F.lit(1)).alias("p")).where("p > 1"), "pairs")
    found = lines.join(again, "h").join(pairs, "h2", "left").select(*_DOC, "k", "pos", "h", "long", F.coalesce("p", F.lit(1)).alias("p"))
    return found.repartition(*_DOC).distinct()


def marked_cuts(lines: DataFrame, mean: int = MEAN_LINES) -> DataFrame:
    """Add run, border and cut: whether a run begins or a passage ends before a line, and whether a chunk begins with it."""
    lines = lines.withColumn("run", F.col("k") - F.row_number().over(W.partitionBy(*_DOC).orderBy("k")))
    at = W.partitionBy(*_DOC, "run").orderBy("k")
    pair = lambda back: F.coalesce(F.lag("p", back).over(at), F.lit(1))
    less = (pair(1) < pair(2)) | (pair(1) < F.when(F.lead("k").over(at).isNull(), 1).otherwise(F.col("p")))
    first = F.lag("k").over(at).isNull()
    border = first | F.col("long") | F.coalesce(F.lag("long").over(at), F.lit(False)) | (pair(1) < 2) | less
    lines = lines.withColumn("border", border).withColumn("roll", F.xxhash64(F.lag("h").over(at), F.lag("h", 2).over(at)))
    # two lines at least on both sides, up to the next borders: these lie in the same places wherever the passage stands
    apart = ~F.col("border") & ~F.coalesce(F.lag("border").over(at), F.lit(True)) & ~F.coalesce(F.lead("border").over(at), F.lit(True))
    lines = lines.withColumn("meets", apart & (F.pmod("roll", F.lit(mean)) == 0))
    return lines.withColumn("cut", F.col("border") | (F.col("meets") & ~F.lag("meets", 1, False).over(at)))


def candidate_chunks(keyed: DataFrame, text: str) -> DataFrame:
    """(doc_id, _key, first, last): line numbers of the chunks that are multi-line or long."""
    lines = marked_cuts(repeated_lines(keyed, text))
    at = W.partitionBy(*_DOC, "run").orderBy("k")
    begun = F.max(F.when(F.col("cut"), F.col("k"))).over(at.rowsBetween(W.unboundedPreceding, 0))
    # a line counts for its chunk, named by its first line, and for the pair with the line before it where both repeat across a border
    part = lambda name, first, n: F.struct(name.alias("chunk"), first.alias("first"), F.col("pos").alias("last"), F.lit(n).alias("n"), F.col("long"))
    across = F.col("border") & (F.coalesce(F.lag("p").over(at), F.lit(1)) > 1)
    lines = lines.select(*_DOC, part(begun, F.col("pos"), 1).alias("own"), F.when(across, part(-1 - F.col("k"), F.lag("pos").over(at), 2)).alias("pair"))
    parts = lines.select(*_DOC, F.explode(F.filter(F.array("own", "pair"), lambda x: x.isNotNull())).alias("c")).select(*_DOC, "c.*")
    chunks = parts.groupBy(*_DOC, "chunk").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.bool_or("long").alias("long"))
    return chunks.where("n > 1 OR long").select(*_DOC, "first", "last")


def removed_lines(keyed: DataFrame, text: str) -> DataFrame:
    """(doc_id, _key, spans: array of first, last) of the chunks that stand in an earlier place, too."""
    where = candidate_chunks(keyed, text)
    listed = where.groupBy(*_DOC).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    body = lambda lines, s: F.array_join(F.filter(F.slice(lines, s["first"] + 1, s["last"] - s["first"] + 1), _has_words), "\n")
    bodies = bound(_lines(F.col(text)), lambda lines: F.transform("spans", lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), body(lines, s).alias("chunk"))))
    chunks = keyed.join(listed, _DOC).select(*_DOC, F.explode(bodies).alias("c")).select(*_DOC, "c.*")
    # written, so that the join deals the chunks anew and may split a hot one
    chunks = materialize(chunks, "chunks")
    place = F.struct("doc_id", "_key", "first")
    seen = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")).where("n > 1")
    seen = materialize(seen, "seen")
    gone = chunks.join(seen.select("chunk", "kept"), "chunk").where(place != F.col("kept"))
    return gone.groupBy(*_DOC).agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all but the first occurrence of each repeated chunk cut from ``text``; adds n_lines_removed (with an underscore behind it if ``docs`` has that name)."""
    rows, at = numbered(docs)
    rows = rows.withColumn("_key", F.xxhash64(F.coalesce(F.col(at[text]), F.lit("")))).withColumn("doc_id", F.col(at["doc_id"]))
    removed = removed_lines(rows.select(*_DOC, at[text]), at[text])
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))

    def cut(lines: Column) -> Column:
        gone = bound(inside, lambda places: F.filter(F.array_distinct(places), lambda i: _has_words(F.get(lines, i))))
        left = lambda g: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g), lambda i: F.get(lines, i))
        return bound(gone, lambda g: F.struct(F.array_join(left(g), "\n").alias("text"), F.size(g).alias("n")))

    joined = rows.join(removed, _DOC, "left").withColumn("_cut", F.when(F.col("spans").isNotNull(), bound(_lines(F.col(at[text])), cut)))
    out = [F.when(F.col("_cut").isNull(), F.col(n)).otherwise(F.col("_cut.text")) if c == text else F.col(n) for c, n in at.items()]
    return joined.select(*out, F.coalesce("_cut.n", F.lit(0))).toDF(*docs.columns, *free_names(["n_lines_removed"], docs.columns))


def deduped_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their texts cut; n_chars, if there is one, follows."""
    out = dedup_lines(docs, text).drop(*free_names(["n_lines_removed"], docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
