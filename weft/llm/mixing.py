"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean repetition rate: its target share of all rows over its actual share. A document's
count of copies is the Poisson distribution of that rate inverted at a number in [0, 1) hashed from seed, doc_id and
text, so it depends on nothing else and comes out the same in any run. Rows are exploded by their counts, and
a second hash gives each copy its place: the output is dealt by it and sorted in each part, a global shuffle. Wholly equal rows
share their place and are dealt by the part they come from, too, so that however many they are no task gets them all.

Counts per source are one pre-aggregated grouping. The table of rates has one row per source: it is
broadcast only if its row count, which is checked, is at most ``BROADCAST_SOURCES``; else it is joined by source. A row's number is drawn once.
A rate is split into units of at most ``MAX_RATE`` that are inverted one by one and added up (a sum of
Poisson variables is one of the summed rate), so large rates neither underflow nor need long tables.

Cases: a null source is a source of its own, named null in ``weights`` by None; sources that ``weights`` doesn't name get
no copies, nor does any where the weights add up to nothing; a null or empty text is a document like any other; repeated rows draw equal
counts (they share their hash); other columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._columns import bound, free_names, numbered
from weft.session import table

BROADCAST_SOURCES = 10_000
MAX_RATE = 16.0
TERMS = 96
#: The default target: shares in proportion to the rows of a source to this power.
TEMPERATURE = 0.5


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 over the seed and the columns."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1, as an array."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / k)).alias("cdf"),
        ),
    )
    return terms["cdf"]


def source_rates(docs: DataFrame, source: str = "source", weights: dict | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """One row per source: its name, rows, target share, mean repetition rate and the cumulative Poisson table of one unit."""
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        sizes = sizes.withColumn("_weight", F.pow(F.col("rows").cast("double"), F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_name string, _weight double")
        sizes = sizes.join(given, F.col("_source").cast("string").eqNullSafe(F.col("_name")), "left").drop("_name").fillna(0.0, ["_weight"])
    total = sizes.agg(F.sum("rows").cast("double").alias("_rows"), F.sum("_weight").alias("_weights"))
    rated = sizes.crossJoin(F.broadcast(total)).withColumn("share", F.try_divide("_weight", "_weights"))  # one row joined
    rated = rated.withColumn("rate", F.col("share") * F.col("_rows") / F.col("rows"))
    units = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1))
    return rated.withColumn("_units", units.cast("int")).select(
        "_source", "rows", "share", "rate", "_units", poisson_cdf(F.col("rate") / F.col("_units")).alias("_cdf")
    )


def mix_sources(docs: DataFrame, weights: dict | None = None, seed: str = "mix", source: str = "source", text: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count; adds copy (from 1) and shuffle_key, by which rows are dealt.

    Where ``docs`` has one of these names, the added column has an underscore behind it.
    """
    rates = source_rates(docs, source, weights, temperature)
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows, at = numbered(docs)
    joined = rows.join(F.broadcast(rates) if small else rates, F.col(at[source]).eqNullSafe(F.col("_source")))
    of_text = F.md5(F.coalesce(F.col(at[text]), F.lit("")).cast("binary"))
    own = F.md5(F.concat_ws("|", F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")), of_text).cast("binary"))

    def drawn(own: Column) -> Column:
        draws = F.transform(F.sequence(F.lit(1), F.col("_units")), lambda unit: uniform(seed, own, unit))
        count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("_cdf", lambda c: c <= u)))
        place = lambda i: F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), own, i.cast("string")).cast("binary"))
        return bound(count, lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(1), n)), lambda i: F.struct(i.alias("copy"), place(i).alias("key"))))

    copies = joined.select(*at.values(), F.explode(F.when(F.col("rate") > 0, bound(own, drawn))).alias("_x"))
    # an exchange in any session; equal rows, which share their place, are dealt apart by the part they come from
    placed = copies.select(*at.values(), F.col("_x.copy").alias("copy"), F.col("_x.key").alias("shuffle_key"), F.spark_partition_id().alias("_from"))
    dealt = placed.repartition("shuffle_key", "_from").sortWithinPartitions("shuffle_key").drop("_from")
    return dealt.toDF(*docs.columns, *free_names(["copy", "shuffle_key"], docs.columns))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows with the columns of ``docs`` only."""
    return mix_sources(docs, **how).drop(*free_names(["copy", "shuffle_key"], docs.columns))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     weighted AS (SELECT source, n, pow(CAST(n AS DOUBLE), {TEMPERATURE}) AS w FROM sizes),
     rated AS (SELECT source, w / sum(w) OVER () * CAST(sum(n) OVER () AS DOUBLE) / n AS rate FROM weighted),
     units AS (SELECT source, rate, CAST(greatest(ceil(rate / {MAX_RATE}), 1) AS INTEGER) AS u FROM rated),
     own AS (SELECT d.*, u.u, u.rate / u.u AS r, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS o
             FROM documents d JOIN units u ON d.source IS NOT DISTINCT FROM u.source),
     drawn AS (SELECT own.*, unit, CAST('0x' || substr(md5('mix|' || o || '|' || unit), 1, 13) AS BIGINT) / pow(2.0, 52) AS x
               FROM own, unnest(range(1, u + 1)) AS t(unit)),
     terms AS (SELECT source, u.rate / u.u AS r, k, exp(-u.rate / u.u + k * ln(u.rate / u.u) - lgamma(k + 1)) AS p
               FROM units u, range(0, {TERMS}) AS t(k)),
     cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
     counts AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.o, d.unit, count(c.k) AS n
                FROM drawn d LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.x
                GROUP BY ALL),
     total AS (SELECT doc_id, text, lang, source, n_chars, o, CAST(sum(n) AS INTEGER) AS copies FROM counts GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('mix|place|' || o || '|' || copy) AS shuffle_key
FROM total, unnest(range(1, copies + 1)) AS t(copy)
"""
