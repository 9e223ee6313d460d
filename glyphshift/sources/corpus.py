"""Corpus sources and model sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphshift.session import delete_folder, scratch


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", text: str = "text") -> DataFrame:
    """Records with a text column; of plain text files, a row for each line. Only the columns that are used are read."""
    if fmt == "text":
        return spark.read.text(path).withColumnRenamed("value", "text")
    return spark.read.format(fmt).load(path).withColumnRenamed(text, "text")


def dealt(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """`df` in as many partitions as there are cores, or as asked for, where a scan gives fewer: a file of one row group is one
    task's otherwise, however long what follows takes."""
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by its keys, several partitions a core: what takes long to work on isn't merged into a few large ones."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


#: A `row` element behind its name: attributes, and the end of the tag. A value may run over lines; it can't hold "<".
ELEMENT = r"""(?s)^((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*/?>"""


def read_comment_dump(spark: SparkSession, path: str) -> DataFrame:
    """id and text of the `row` elements of an XML dump; rows without either attribute are skipped. The file is read in splits,
    whose records end where the next element begins; what isn't the inside of such an element, as the document's head, is no
    row. Comments and CDATA sections aren't told apart from elements."""
    records = spark.read.option("lineSep", "<row").text(path).where(F.col("value").rlike(ELEMENT))
    parsed = records.select(F.from_xml(F.concat(F.lit("<row"), F.regexp_extract("value", ELEMENT, 1), F.lit("/>")), "_Id long, _Text string").alias("r"))
    return parsed.where("r._Id is not null and r._Text is not null").select(F.col("r._Id").alias("id"), F.col("r._Text").alias("text"))


def write_comment_dump(comments: DataFrame, path: str) -> None:
    """(id, text) as `row` elements with attributes; each part file is a document of its own."""
    rows = comments.select(F.col("id").alias("_Id"), F.col("text").alias("_Text"))
    rows.write.format("xml").option("rootTag", "comments").option("rowTag", "row").save(path)


def write_model(ngrams: DataFrame, path: str) -> None:
    """The n-gram store, partitioned by model and order, so that a reader prunes to what it needs."""
    ngrams.write.mode("overwrite").partitionBy("model", "n").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, cnt long, model string, n int").parquet(path).select("model", "n", "gram", "cnt")


#: The model file: an object of three maps and the vocabulary size, an entry a line.
SECTIONS = {4: "quadgram_counts", 3: "trigram_counts", 2: "bigram_counts"}


def write_json_model(ngrams: DataFrame, vocabulary: int, path: str) -> None:
    """One model (n, gram, cnt) as a JSON file: entries are sorted and written by all tasks, and their files are strung together,
    so that no row or task holds a model."""
    spark, order = ngrams.sparkSession, {n: k for k, n in enumerate(SECTIONS)}
    ends = {r.n: (r.low, r.high) for r in ngrams.groupBy("n").agg(F.min("gram").alias("low"), F.max("gram").alias("high")).collect()}
    begin = lambda n: ("{\n" if order[n] == 0 else "") + f'  "{SECTIONS[n]}": {{'
    quoted = F.regexp_extract(F.to_json(F.struct("gram")), '(?s)^\\{"gram":(.*)\\}$', 1)
    first, last = F.lit(""), F.lit(",")
    for n, (low, high) in ends.items():
        own = F.col("n") == n
        first, last = F.when(own & (F.col("gram") == low), begin(n) + "\n").otherwise(first), F.when(own & (F.col("gram") == high), "\n  },").otherwise(last)
    place = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))[F.col("n")]
    every = ngrams.select(place.alias("part"), "gram", F.concat(first, F.lit("    "), quoted, F.lit(": "), F.col("cnt").cast("string"), last).alias("value"))
    empty = [(order[n], "", begin(n) + "},") for n in SECTIONS if n not in ends]
    parts = scratch(spark)
    every.unionByName(spark.createDataFrame(empty, "part int, gram string, value string")).orderBy("part", "gram").select("value").write.text(parts)
    string_together(spark, parts, path, f'  "vocab_size": {vocabulary}\n}}\n')
    delete_folder(spark, parts)


def string_together(spark: SparkSession, folder: str, path: str, tail: str) -> None:
    """The part files of a folder, in order, and `tail` as one file, copied as streams."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    files = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in sorted(f.getPath().toString() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")):
            piece = files.open(jvm.org.apache.hadoop.fs.Path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, conf, False)
            finally:
                piece.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()


def json_entries(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """key and value of all entries of a model file, read in splits. Of a file with an entry a line, the separator is the line's
    end; of one without line ends it is what stands between entries, a comma, a blank and the next quote: inside a string a
    backslash stands before a quote, so neither ever cuts one."""
    entry = r'^(?:\s*\{?\s*"?\w+": \{\s*"|\s*")?((?:[^"\\]|\\.)*)": ([0-9]+)'
    found = spark.read.option("lineSep", separator).text(path).where(F.col("value").rlike(entry))
    quoted = F.concat(F.lit('{"key":"'), F.regexp_extract("value", entry, 1), F.lit('"}'))
    return found.select(F.from_json(quoted, "key string")["key"].alias("key"), F.regexp_extract("value", entry, 2).cast("long").alias("value"))


def read_json_models(spark: SparkSession, paths: dict[str, str], separator: str = "\n") -> DataFrame:
    """model, n, gram, cnt of model files by name. A gram's order is its length."""
    every = None
    for name, path in paths.items():
        part = json_entries(spark, path, separator).where("key != 'vocab_size'").select(F.lit(name).alias("model"), F.length("key").alias("n"), F.col("key").alias("gram"), F.col("value").alias("cnt"))
        every = part if every is None else every.unionByName(part)
    return every


def json_vocabulary(spark: SparkSession, path: str, separator: str = "\n") -> int:
    return json_entries(spark, path, separator).where("key = 'vocab_size'").agg(F.max("value")).first()[0]


def load_models(ngrams: DataFrame, names: list[str], override: DataFrame | None = None) -> DataFrame:
    """The named models of a store. `so` is optional: where it is missing, `en` stands for it. `override` replaces models of
    the same names. A missing required model is an error."""
    if override is not None:
        ngrams = ngrams.join(override.select("model").distinct(), "model", "left_anti").unionByName(override)
    here = {r.model for r in ngrams.select("model").distinct().collect()}
    if missing := [n for n in names if n not in here and n != "so"]:
        raise ValueError(f"models are missing: {', '.join(missing)}")
    chosen = ngrams.where(F.col("model").isin(*[n for n in names if n in here]))
    if "so" in names and "so" not in here:
        chosen = chosen.unionByName(ngrams.where("model = 'en'").withColumn("model", F.lit("so")))
    return chosen
