"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in BATCHES ranges of doc_id, as if they arrived one batch after the other. A run is a table of line hashes, bucketed and sorted by hash, with the place (doc_id, line) that each line was first met. A batch shuffles its own lines once, marks the first place of each, merge-joins them with every run (bucketed alike, so runs are never shuffled) and becomes a run of level 0 itself, of the lines that no run has. FANOUT runs of a level are compacted into one of the next level. The first place of a line in order of (doc_id, line number) stays, all its other copies go; documents are rebuilt from their remaining lines.

Lines are compared after trimming spaces and tabs, by two 64-bit hashes. Blank lines are structure: they always stay.

Defined cases: a null text stays null, an empty one empty; a null doc_id comes before all others; rows that share doc_id and text are one document and share its fate (both stay, with the same lines); of rows that share a doc_id but not the text the lower text hash comes first; other columns, whatever their names, are kept and never read; an empty table gives an empty one. A document that loses every one of its non-blank lines is dropped. Time is linear in a text's length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import remove, row_of, stored, table, tune, work_dir

BATCHES, FANOUT = 4, 3
_KEY = ("h1", "h2")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r")) == ""


class Runs:
    """The levelled runs: bucketed tables in the shared folder. A table holds all of a batch's lines; the run is its fresh ones, of which each hash has one."""

    def __init__(self, spark, path: str, buckets: int, fanout: int):
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.names: list[str] = []

    def write(self, rows: DataFrame) -> DataFrame:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        self.names.append(name)
        rows.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        return self.spark.table(name)

    def all(self) -> list[DataFrame]:
        return [t for level in self.levels for t in level]

    def add(self, run: DataFrame) -> None:
        """A new run; full levels are merged upwards."""
        self.levels[0].append(run)
        k = 0
        while len(self.levels[k]) >= self.fanout:
            merged = self.levels[k][0]
            for t in self.levels[k][1:]:
                merged = merged.unionByName(t)
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self.write(merged.repartition(self.buckets, *_KEY)))
            self.levels[k] = []
            k += 1

    def forget(self) -> None:
        """Take the tables out of the catalog, and their files away."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{self.path}/{name}")


def repeated_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(id, th, lines): for each document (doc_id and text hash) the sorted line numbers, from 0, that were met before."""
    spark = tune(docs.sparkSession)
    work = work_dir(spark, "lines")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text").where("text IS NOT NULL")
    cuts = sorted(set(own.select(F.percentile_approx("id", [i / batches for i in range(1, batches)])).first()[0] or [])) if batches > 1 else []
    number = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = (
        own.select("id", "th", number.alias("batch"), F.posexplode(_lines(F.col("text"))).alias("line", "s"))
        .where(~_blank(F.col("s")))
        .withColumn("s", F.trim("s", F.lit(" \t\r")))
        .select("batch", "id", "th", "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"))
    )
    path = f"{work}/lines"
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = Runs(spark, work, buckets, fanout)
    try:
        judged = []
        order = Window.partitionBy(*_KEY).orderBy(F.col("id").asc_nulls_first(), "th", "line")
        for k in range(len(cuts) + 1):
            # rows that are the same place have the same rank; one of them speaks for them in the run
            batch = lines.where(F.col("batch") == k).drop("batch").repartition(buckets, *_KEY)
            batch = batch.withColumns({"met": F.rank().over(order) > 1, "one": F.row_number().over(order) == 1})
            for run in runs.all():
                batch = batch.hint("merge").join(run.select(*_KEY, F.lit(True).alias("hit")), [*_KEY], "left").withColumn("met", F.col("met") | F.col("hit").isNotNull()).drop("hit")
            judged.append(runs.write(batch))
            runs.add(judged[-1].where("one AND NOT met"))
        gone = judged[0]
        for j in judged[1:]:
            gone = gone.unionByName(j)
        return stored(gone.where("met").groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("lines")), f"{work}/gone")
    finally:
        runs.forget()
        remove(spark, path)


def _without(text: Column, gone: Column) -> Column:
    """The text's lines but those of the sorted numbers: the stretches between them, put together. The outer lambda binds the lines, so that they are split once."""
    lines = _lines(text)
    bounds = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    bound = F.array(F.struct(lines.alias("l"), bounds.alias("b")))
    stretch = lambda p: F.transform(F.sequence(F.lit(0), F.size(p["b"]) - 2), lambda k: F.slice(p["l"], F.get(p["b"], k) + 2, F.get(p["b"], k + 1) - F.get(p["b"], k) - 1))
    return F.flatten(F.transform(bound, stretch)[0])


def dedup_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The documents with their repeated lines taken out; columns as in docs, n_chars (if there) brought up to date."""
    gone = repeated_lines(docs, batches, fanout)
    # the whole row is one column here, so that no name can clash
    rows = docs.select(row_of(docs).alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("own_th"), F.col("text").isNull().alias("bare"))
    met = rows.join(gone, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_th") == F.col("th")) & ~F.col("bare"), "left")
    rest = _without(F.col("row.text"), F.col("lines"))
    out = met.select("row", F.when(F.col("lines").isNotNull(), F.struct(F.array_join(rest, "\n").alias("text"), F.exists(rest, lambda x: ~_blank(x)).alias("some"))).alias("cut"))
    out = out.where("cut IS NULL OR cut.some")
    row = F.col("row").withField("text", F.col("cut.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("cut.text").cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(F.col("cut").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")


def op7_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH doc AS (SELECT doc_id, text, lang, source, n_chars FROM documents),
 line AS (SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS s FROM doc, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
 marked AS (SELECT *, trim(s, ' ' || chr(9) || chr(13)) AS t FROM line),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, line) AS n FROM marked),
 rest AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS text, bool_or(t <> '') AS some FROM ranked WHERE n = 1 OR t = '' GROUP BY doc_id),
 had AS (SELECT doc_id, bool_or(t <> '' AND n > 1) AS lost FROM ranked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN had.lost THEN rest.text ELSE d.text END AS text, d.lang, d.source,
 CASE WHEN had.lost THEN length(rest.text) ELSE d.n_chars END AS n_chars
FROM doc d LEFT JOIN had USING (doc_id) LEFT JOIN rest USING (doc_id)
WHERE NOT coalesce(had.lost, FALSE) OR coalesce(rest.some, FALSE)
"""
