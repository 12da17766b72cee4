"""Sources: JSON lines, text files, memories and checkpoints, blocks made of plain texts, PDF files through a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import layout


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; a line that is not an object of it raises. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, modificationTime`` of the files below a folder, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime").orderBy("path")


def read_texts(spark: SparkSession, path: str, most: int = 50_000) -> DataFrame:
    """``path, text`` of whole text files, cut at ``most`` characters with a mark."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), T.truncate(F.col("value"), most).alias("text"))


def file_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``document_id, source_path, file_name, sha256, content`` of files; the id follows from the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    digest = F.sha2("content", 256)
    return files.select(F.concat(F.lit("pdf_"), F.substring(digest, 1, 20)).alias("document_id"), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), digest.alias("sha256"), "content")


def parse_files(files: DataFrame, reader: Callable[[bytes], Iterator[dict]], kind: str = "blocks") -> DataFrame:
    """Layout rows of files by a plug-in: ``reader(content)`` yields dictionaries with the columns of ``blocks``,
    ``pages`` or ``tables`` but the id. A task holds one file at a time."""
    import pandas as pd

    shape = {"blocks": layout.BLOCKS, "pages": layout.PAGES, "tables": layout.TABLES}[kind]
    names = [f.split()[0] for f in shape.split(", ")]

    def run(batches):
        for b in batches:
            for ident, content in zip(b["document_id"], b["content"], strict=True):
                rows = [{"document_id": ident, **r} for r in reader(content)]
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("document_id", "content").mapInPandas(run, shape)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that the optimizer knows to be empty, so that joins with it cost nothing."""
    return spark.range(1).where("false").selectExpr(*[f"CAST(NULL AS {kind}) AS {name}" for name, kind in (f.split(" ", 1) for f in schema.split(", "))])


def clean_metadata(metadata):
    """A metadata map without null and empty values."""
    return F.map_filter(metadata, lambda _, v: v.isNotNull() & (v != ""))


def text_layout(docs: DataFrame, ident: str = "doc_id", text: str = "text", lines_per_page: int = 40) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``documents, pages, blocks, tables`` of plain texts: a block per line, pages of a fixed number of lines, one font."""
    base = docs.select(F.col(ident).cast("string").alias("document_id"), T.text_of(F.col(text)).alias("text"))
    lines = base.select("document_id", F.posexplode(T.lines(F.col("text"))).alias("at", "text"))
    page, row = (F.floor(F.col("at") / lines_per_page) + 1).cast("int"), (F.col("at") % lines_per_page).cast("double")
    top = 90 + row * 16
    blocks = lines.select(
        "document_id", page.alias("page_number"), F.col("at").alias("block_no"), F.lit(72.0).alias("x0"), top.alias("y0"), F.lit(520.0).alias("x1"), (top + 12).alias("y1"), "text", F.lit("native").alias("source"), F.lit(12.0).alias("max_font_size"),
        F.lit(12.0).alias("avg_font_size"), F.lit(False).alias("bold"), F.lit(False).alias("monospace"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("string").alias("heading_source"), F.array(F.struct(F.col("text").alias("text"), F.lit(72.0).alias("x0"))).alias("lines"),
    )
    n_lines = F.greatest(F.size(T.lines(F.col("text"))), F.lit(1))
    count = F.ceil(n_lines / lines_per_page).cast("int")
    documents = base.select("document_id", F.concat(F.lit("text:"), "document_id").alias("source_path"), F.concat("document_id", F.lit(".txt")).alias("file_name"), F.sha2("text", 256).alias("sha256"), count.alias("page_count"))
    pages = base.select("document_id", F.explode(F.sequence(F.lit(1), count)).alias("page_number"), F.length("text").cast("int").alias("native_text_char_count")).select(
        "document_id", "page_number", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.lit(0).alias("rotation"), F.lit(False).alias("used_ocr"), "native_text_char_count"
    )
    return documents, pages, blocks, empty(docs.sparkSession, layout.TABLES)


def load_checkpoint(checkpoints: DataFrame, run_id: str, state_schema: str | None = None) -> DataFrame:
    """The newest state of a run, parsed if a schema is given."""
    from vellum.operators.tabular import latest

    row = latest(checkpoints.where(F.col("run_id") == run_id), "run_id", "updated_at")
    return row if state_schema is None else row.withColumn("state", F.from_json("state_json", state_schema))


def model_ids(value: str | None, default: list[str]) -> list[str]:
    """Names from a comma-separated setting, or the default."""
    found = [x.strip() for x in (value or "").split(",") if x.strip()]
    return found or default


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table, memories and checkpoints among them. With a numeric ``key`` and its ``bounds`` it is read in
    ``parts`` at once; filters and columns go to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


#: Font sizes that stand for the tags of headings, and tags whose text is one block.
HEADING_SIZES = {"h1": 24.0, "h2": 20.0, "h3": 17.0, "h4": 15.0}
BLOCK_TAGS = {"p", "li", "ul", "ol", "table", "tr", "div", "pre", "td", "th", "blockquote", "figcaption", "section", "article", "title", *HEADING_SIZES}


def html_blocks(content: bytes) -> Iterator[dict]:
    """A reader for :func:`parse_files`: the text blocks of an HTML page in the order of the source, one below the other
    on pages of 60, headings by font size and ``pre`` as monospace."""
    from html.parser import HTMLParser

    found: list[tuple[str, str]] = []

    class Parser(HTMLParser):
        open_: list[str] = ["p"]
        text: list[str] = []
        hidden = 0

        def close_block(self):
            body = "".join(self.text)
            body = body.strip("\n") if self.open_[-1] == "pre" else " ".join(body.split())
            if body.strip():
                found.append((self.open_[-1], body))
            self.text = []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            if tag in BLOCK_TAGS:
                self.close_block()
                self.open_ = [*self.open_, tag]
            elif tag == "br":
                self.text.append("\n" if self.open_[-1] == "pre" else " ")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0
            if tag in BLOCK_TAGS and tag in self.open_[1:]:
                self.close_block()
                while self.open_.pop() != tag:
                    pass

        def handle_data(self, data):
            if not self.hidden:
                self.text.append(data)

    parser = Parser()
    parser.feed(content.decode("utf-8", "replace"))
    parser.close_block()
    for k, (tag, text) in enumerate(found):
        y, size = 60.0 + k % 60 * 12, HEADING_SIZES.get(tag, 12.0)
        yield {
            "page_number": k // 60 + 1, "block_no": k, "x0": 50.0, "y0": y, "x1": 545.0, "y1": y + 11, "text": text, "source": "html", "max_font_size": size, "avg_font_size": size, "bold": tag in HEADING_SIZES or tag == "th",
            "monospace": tag == "pre", "heading_level": None, "heading_source": None, "lines": [{"text": x, "x0": 50.0 + 6 * (len(x) - len(x.lstrip()))} for x in text.split("\n")],
        }
