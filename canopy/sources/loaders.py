"""Files into nodes and back: CSV, JSON, text, directories, delimited files, key bytes, and the stored tree itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import nodes as N


def csv(spark: SparkSession, path: str, prefix: str = "^DATA", globals_per_row: bool = False, sep: str = ",") -> DataFrame:
    """Nodes prefix(line, column) = trimmed field; the first data line is 2, columns count from 0.

    With ``globals_per_row`` each line is a tree of its own, named prefix and line number.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    # ids grow along the file but jump between its splits: a line's number is its place in that order
    numbered = lines.select("value", F.row_number().over(_by("at")).alias("line")).filter("line > 1")
    fields = numbered.select("line", F.posexplode(F.split("value", r"\Q" + sep + r"\E", -1)).alias("column", "field"))
    line, column = F.col("line").cast("string"), F.col("column").cast("string")
    name = F.concat(F.lit(prefix), line) if globals_per_row else F.lit(prefix)
    subs = F.array(column) if globals_per_row else F.array(line, column)
    return fields.select(name.alias("name"), subs.alias("subs"), F.trim("field").alias("value"))


def _by(column: str):
    # one file's lines in one order: loaders are for files that one task reads
    return Window.orderBy(column)


def json(spark: SparkSession, path: str, prefix: str = "^DATA") -> DataFrame:
    """Nodes of a top-level array: text elements become prefix(i), text fields of objects prefix(i, key); other fields are empty."""
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.expr("cast(try_parse_json(value) as array<variant>)")).alias("i", "item"))
    i, kind = F.col("i").cast("string"), F.schema_of_variant("item")
    plain = items.filter(kind == "STRING").select(F.lit(prefix).alias("name"), F.array(i).alias("subs"), F.col("item").cast("string").alias("value"))
    objects = items.filter(kind.startswith("OBJECT")).select("i", F.explode(F.expr("cast(item as map<string, variant>)")).alias("key", "field"))
    value = F.when(F.schema_of_variant("field") == "STRING", F.col("field").cast("string")).otherwise(F.lit(""))
    return plain.unionByName(objects.select(F.lit(prefix).alias("name"), F.array(i, F.col("key")).alias("subs"), value.alias("value")))


def text(spark: SparkSession, path: str, name: str = "^TEXT") -> DataFrame:
    """A whole file as one node."""
    return spark.read.text(path, wholetext=True).select(F.lit(name).alias("name"), F.array().cast("array<string>").alias("subs"), "value")


def directory(spark: SparkSession, path: str, name: str = "^DIR") -> DataFrame:
    """A node for each file of a directory, by file name; folders within aren't entered."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=False)
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return files.select(F.lit(name).alias("name"), F.array(file).alias("subs"), "value")


def delimited(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Rows of a delimited file with a header; quotes mean nothing."""
    return spark.read.csv(path, sep=sep, header=True, quote="")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A file's lines, as a loop of reads until its end gets them."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_lines(df: DataFrame, path: str, column: str, append: bool = False) -> None:
    """A column as lines of text."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("append" if append else "overwrite").text(path)


def thesaurus(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The lookup tables of a thesaurus: terms, broader, related, synonyms, citations, and both ways between terms and citations."""
    read = lambda f: delimited(spark, f"{folder}/{f}")

    def pair(f: str, a: str, b: str) -> DataFrame:
        df = read(f)
        return df.select(F.col(df.columns[0]).alias(a), F.col(df.columns[1]).alias(b))

    subjects = pair("eric_citation_subjects.txt", "document", "term")
    terms = read("eric_thesaurus.txt")
    return {
        "terms": terms.withColumnRenamed(terms.columns[0], "term"),
        "broader": pair("eric_thesaurus_bt.txt", "term", "broader"),
        "related": pair("eric_thesaurus_rt.txt", "term", "related"),
        "synonyms": pair("eric_thesaurus_synonyms.txt", "synonym", "term"),
        "citations": pair("eric_citations.txt", "document", "rest"),
        "citation_terms": subjects,
        "term_citations": subjects.select("term", "document"),
    }


def encoded_key(name: Column, subs: Column) -> Column:
    """name and subscripts with a zero byte after each."""
    return F.concat(F.array_join(F.concat(F.array(name), subs), "\x00"), F.lit("\x00"))


def decoded_key(key: Column) -> Column:
    """A key's parts, the name first; empty subscripts are lost, as they are in the bytes' own reading."""
    return F.filter(F.split(key, "\x00", -1), lambda x: x != "")


def save(nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nodes as a table partitioned by tree, so that reads of one tree skip all others."""
    nodes.select("subs", "value", "name").write.mode(mode).partitionBy("name").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("name").cast("string"), "subs", "value")


class Store:
    """A stored tree with the operations of a key-value store; each call is a plan over the whole, writes are one commit."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    def get(self, name: str, *subs: str) -> str:
        r = self.nodes.filter((F.col("name") == name) & (F.col("subs") == F.array(*map(F.lit, subs)).cast("array<string>"))).select("value").first()
        return r["value"] if r else ""

    def batch_put(self, rows: list[tuple[str, list[str], str]]) -> None:
        self.nodes = N.put(self.nodes, N.of_rows(self.nodes.sparkSession, rows))

    def batch_delete(self, keys: list[tuple[str, list[str]]]) -> None:
        self.nodes = N.delete(self.nodes, self.nodes.sparkSession.createDataFrame([(n, [str(x) for x in s]) for n, s in keys], "name string, subs array<string>"))

    def names(self, prefix: str = "") -> list[str]:
        return [r["name"] for r in N.names(self.nodes, prefix).orderBy("name").collect()]

    def sync(self, path: str) -> None:
        save(self.nodes, path)
