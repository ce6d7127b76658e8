"""The source list (Markdown bullets of site URLs and ``wechat:`` accounts)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK_RE, WS, WS_CHARS, py_strip
from ..operators.numbering import numbered
from ..session import materialize

ACCOUNT_PREFIX = "wechat:"
# The bullet and URL patterns of the source list.
BULLET_RE = r"^[-*]" + WS + r"+(.+)$"
URL_RE = r"(?i)^https?://[^" + WS_CHARS + r"/$.?#].[^" + WS_CHARS + r"]*$"
SOURCES_SCHEMA = "seq bigint, kind string, value string, valid boolean"


def parse_source_lines(lines: DataFrame, line_col: str = "line", seq_col: str = "line_no") -> DataFrame:
    """S1 over a table of lines ``(line_no, line)``: one row per bullet.
    ``kind`` is 'account' for ``wechat:`` entries (any case) and 'web'
    otherwise; web entries must look like a URL (``valid``).  Duplicates
    are kept; order is ``seq`` = line number."""
    line = py_strip(F.col(line_col))
    item = py_strip(F.regexp_extract(line, BULLET_RE, 1))
    is_acct = F.lower(item).startswith(ACCOUNT_PREFIX)
    name = py_strip(F.substring(item, len(ACCOUNT_PREFIX) + 1, 1 << 30))
    # the account reader allows whitespace between the prefix and the name
    out = lines.select(F.col(seq_col).cast("bigint").alias("seq"), line.alias("_l"), item.alias("_item"),
                       is_acct.alias("_acct"), name.alias("_name"))
    out = out.filter(F.col("_l").rlike(BULLET_RE))
    return out.select(
        "seq",
        F.when(F.col("_acct"), F.lit("account")).otherwise(F.lit("web")).alias("kind"),
        F.when(F.col("_acct"), F.col("_name")).otherwise(F.col("_item")).alias("value"),
        F.when(F.col("_acct"), F.col("_name") != "").otherwise(F.col("_item").rlike(URL_RE)).alias("valid"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of the text files at ``path``, numbered from 0 in
    file order.  Files are read line by line through Spark's file system, in
    parts of a file where it is long; a line is then cut at the other breaks
    that Python knows.  The number is the line's position by file, start of
    the part, and order in it."""
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("nth"), "value")
    read = materialize(read)            # the ids hold for this one reading
    lines = read.select("file", "start", "nth", F.posexplode(F.split("value", LINE_BREAK_RE)).alias("part", "line"))
    return numbered(lines, ["file", "start", "nth", "part"], "line_no").select((F.col("line_no") - 1).alias("line_no"), "line")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """S1 from a text file; a missing file gives an empty table."""
    try:
        lines = read_lines(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SOURCES_SCHEMA)
    return parse_source_lines(lines)


def web_sources(sources: DataFrame) -> DataFrame:
    return sources.filter((F.col("kind") == "web") & F.col("valid"))


def account_sources(sources: DataFrame) -> DataFrame:
    return sources.filter((F.col("kind") == "account") & F.col("valid"))


def source_lines_from_tables(pages: DataFrame, events: DataFrame) -> DataFrame:
    """A source-list text derived from the given tables: a heading, one
    bullet per page URL (every 9th invalid, every 13th with a '*' bullet),
    then one ``wechat:`` bullet per event type in mixed case."""
    web = pages.select(
        (F.col("page_id") * 2 + 10).alias("line_no"),
        F.when(F.col("page_id") % 9 == 4, F.concat(F.lit("- not a url "), F.col("url")))
         .when(F.col("page_id") % 13 == 0, F.concat(F.lit("* "), F.col("url")))
         .otherwise(F.concat(F.lit("- "), F.col("url"))).alias("line"))
    blanks = pages.select((F.col("page_id") * 2 + 11).alias("line_no"), F.lit("").alias("line"))
    # accounts: one bullet per distinct event type, in name order (the
    # distinct set is the followed-account list, a handful of rows)
    types = events.select("event_type").distinct()
    acct = types.select(
        (F.lit(10 ** 9) + F.row_number().over(Window.orderBy("event_type"))).alias("line_no"),   # one row per followed account
        F.concat(F.lit("- "), F.when(F.length("event_type") % 2 == 0, F.lit("WeChat:")).otherwise(F.lit("wechat: ")),
                 F.col("event_type")).alias("line"))
    head = pages.sparkSession.createDataFrame([(0, "# sources"), (1, "## web")], "line_no long, line string")
    return head.unionByName(web).unionByName(blanks).unionByName(acct)
