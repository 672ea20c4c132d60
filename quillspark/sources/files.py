"""Reading and writing the file formats of a text corpus and its networks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, lang, path, text) of text files <path>/<lang>/<name>.txt, one row a file."""
    df = spark.read.text(f"{path}/*/*.txt", wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    parts = F.split(F.url_decode(F.col("path")), "/")
    return df.select(F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.[^.]*$", 1).alias("file_name"), F.element_at(parts, -2).alias("lang"), "path", "text")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def write_lists(df: DataFrame, column: str, path: str, sep: str = ",") -> None:
    """An array a line, its items joined by sep; null items are left out."""
    write_lines(df.select(F.array_join(column, sep).alias("line")), "line", path)


def read_lists(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(items) of each line; an empty line is an empty array."""
    items = F.split("line", f"[{sep}]")
    return read_lines(spark, path).select(F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(items).alias("items"))


def write_arrays(df: DataFrame, path: str) -> None:
    """Arrays of numbers with their keys, as Parquet: the form of a file of named arrays."""
    df.write.mode("overwrite").parquet(path)


def sniff_separator(spark: SparkSession, path: str, skip: int = 0, candidates: str = ",;\tƒ|") -> str:
    """The candidate that stands most often in the first line after skip lines of a file."""
    head = spark.read.text(path).limit(skip + 1).collect()
    line = head[skip]["value"] if len(head) > skip else ""
    return max(candidates, key=lambda c: (line.count(c), -candidates.index(c)))


def read_csv(spark: SparkSession, path: str, schema: str, sep: str | None = ",", na: str = "NA", header: bool = True, skip: int = 0) -> DataFrame:
    """A table with a stated schema; na is null. Separators of one character, such as ';' or 'ƒ'; none is sniffed.

    skip is the number of lines before the header of a single file, which start with '#'.
    """
    sep = sep or sniff_separator(spark, path, skip)
    return spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue=na, quote='"', escape='"', comment="#" if skip else None)


def append_csv(df: DataFrame, path: str, sep: str = ",", na: str = "NA") -> None:
    df.write.mode("append").csv(path, sep=sep, header=True, nullValue=na, quote='"', escape='"')


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, old, new, priority) of a replacement table with separator ƒ; '' as a value means to delete."""
    df = read_csv(spark, path, "file_name string, to_replace string, replace_with string, priority string", sep="ƒ")
    new = F.when(F.coalesce("replace_with", F.lit("''")) == "''", "").otherwise(F.col("replace_with"))
    return df.select("file_name", F.col("to_replace").alias("old"), new.alias("new"), "priority")


def read_edges(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return spark.read.csv(path, schema="src long, dst long, w double", sep=sep)


def write_edges(df: DataFrame, path: str, sep: str = " ") -> None:
    df.select("src", "dst", "w").write.mode("overwrite").csv(path, sep=sep)


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """(node, vec) of the text format: a line 'n d', then a name and d numbers a line. Lines that are no vector of d numbers raise."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    # the head is the line of two whole numbers that says how many other lines there are; a name with one number is a vector
    n = parts.count() - 1
    is_head = (F.size("p") == 2) & (F.col("p")[0] == str(n)) & F.col("p")[1].rlike("^[0-9]+$")
    head = parts.where(is_head).select(F.col("p")[1].cast("int").alias("d")).orderBy("d").limit(1)
    rows = parts.where(~is_head).crossJoin(F.broadcast(head))
    good = F.when(F.size("p") == F.col("d") + 1, F.transform(F.slice("p", 2, F.col("d")), lambda x: x.cast("double"))).otherwise(F.raise_error(F.lit("a vector has another length than the first line says")))
    return rows.select(F.col("p")[0].alias("node"), good.alias("vec"))


def write_word2vec(df: DataFrame, path: str) -> None:
    """The head line, then the vectors, as text files in this order of names."""
    n = df.count()
    d = df.select(F.max(F.size("vec"))).first()[0] or 0
    body = df.select(F.concat_ws(" ", F.col("node").cast("string"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    head = df.sparkSession.createDataFrame([(f"{n} {d}",)], "value string").coalesce(1)
    head.write.mode("overwrite").text(path)
    body.write.mode("append").text(path)


def write_graphml(edges: DataFrame, path: str) -> None:
    """The nodes and edges of a network as elements of GraphML, a line each, inside one document."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    nodes = edges.select(F.col("src").alias("n")).unionAll(edges.select(F.col("dst").alias("n"))).distinct()
    lines = nodes.select(F.lit(1).alias("o"), F.concat(F.lit('<node id="'), esc("n"), F.lit('"/>')).alias("value"))
    lines = lines.unionAll(edges.select(F.lit(2), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('"><data key="w">'), F.col("w").cast("string"), F.lit("</data></edge>"))))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">'
    ends = edges.sparkSession.createDataFrame([(0, head), (3, "</graph></graphml>")], "o int, value string")
    # in the order of o over the parts: a range partition a kind of line, and the lines of a kind spread by a salt of their own
    lines.unionAll(ends).repartitionByRange("o", F.xxhash64("value")).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_matrix(edges: DataFrame, path: str, diagonal: float = 1.0) -> None:
    """The matrix of a network as CSV, a row a node with one column a node, in the order of names: as wide as it is, so for merged texts."""
    names = sorted(r["n"] for r in edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct().collect())
    rows = edges.groupBy("src").pivot("dst", names).agg(F.first("w"))
    cells = [F.when(F.col("src") == n, F.lit(diagonal)).otherwise(F.col(f"`{n}`")).alias(n) for n in names]
    rows.select(F.col("src").alias("file_name"), *cells).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) of a matrix CSV, the diagonal included; empty cells are left out."""
    wide = spark.read.csv(path, header=True, quote='"', escape='"')
    names = wide.columns[1:]
    cells = F.array(*[F.struct(F.lit(n).alias("dst"), F.col(f"`{n}`").cast("double").alias("w")) for n in names])
    return wide.select(F.col(f"`{wide.columns[0]}`").alias("src"), F.explode(cells).alias("c")).select("src", "c.dst", "c.w").where("w IS NOT NULL")


def read_or_create(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; made and written first if it isn't there as a whole."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def search_lines(files: DataFrame, pattern: str, whole_word: bool = False) -> DataFrame:
    """(path, line_no from 1, line) of the lines of (path, text) that match, whatever the case."""
    pat = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])" if whole_word else f"(?i){pattern}"
    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.where(F.col("line").rlike(pat)).select("path", (F.col("i") + 1).alias("line_no"), "line")
