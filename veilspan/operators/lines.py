"""Line zones: kinds of lines, numeric density, and blocks carried over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import fold, literal, struct
from ..functions.rules import ascii_bounds

VITALS = r"(?i)\b(?:bp|hr|rr|spo2|temp)[ :]+[0-9]"
MEDS = r"(?i)\b[0-9.]+ ?(?:mg|mcg|units|ml)\b.*\b(?:daily|bid|tid|qid|prn|qhs|weekly)\b"
LAB = r"(?i)^[ \t]*[A-Za-z][A-Za-z0-9 ]{0,30}[: \t]+[0-9]+(?:\.[0-9]+)?[ \t]*(?:\(|[A-Za-z/%^0-9]*[ \t]*$)"
LAB_HEADER = r"(?i)^[ \t]*(?:labs?|laboratory|results)[ \t]*:?[ \t]*$"
IMAGING = r"(?i)^[ \t]*(?:ct|mri|x-?ray|ultrasound|echo)\b.*:?[ \t]*$"
NARRATIVE = r"(?i)^[ \t]*(?:assessment|plan|hpi|history|impression|subjective)\b"


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line_no, start, end, line)``: the lines of each text with code-point offsets, counted in the row."""

    def step(s: str, x: str) -> tuple[str, str]:
        row = struct(line_no=f"{s}.n", start=f"{s}.at", end=f"{s}.at + length({x})", line=x)
        return struct(n=f"{s}.n + 1", at=f"{s}.at + length({x}) + 1"), f"array({row})"

    split = f"split(coalesce({text}, ''), '\\n', -1)"
    kind = "struct<line_no:int,start:bigint,end:bigint,line:string>"
    return docs.select(key, F.inline(F.expr(fold(split, "named_struct('n', 0, 'at', cast(0 as bigint))", kind, step, "line"))))


def kind(line: Column) -> Column:
    """The kind of a line on its own, in the order of precedence."""
    return (
        F.when(F.trim(line) == "", "blank")
        .when(line.rlike(ascii_bounds(NARRATIVE)), "narrative")
        .when(line.rlike(ascii_bounds(IMAGING)), "imaging")
        .when(line.rlike(ascii_bounds(VITALS)), "vitals")
        .when(line.rlike(ascii_bounds(MEDS)), "meds")
        .when(line.rlike(ascii_bounds(LAB)), "lab")
        .when(line.rlike(ascii_bounds(LAB_HEADER)), "lab_header")
        .otherwise("narrative")
    )


def kind_expr(line: str) -> str:
    """:func:`kind` as SQL text."""
    tests = (("narrative", NARRATIVE), ("imaging", IMAGING), ("vitals", VITALS), ("meds", MEDS), ("lab", LAB), ("lab_header", LAB_HEADER))
    return f"case when trim({line}) = '' then 'blank' " + " ".join(f"when {line} rlike {literal(ascii_bounds(p))} then '{k}'" for k, p in tests) + " else 'narrative' end"


def density(line: Column) -> Column:
    """The share of digits in a line."""
    digits = F.length(F.regexp_replace(line, "[^0-9]", ""))
    return F.when(F.length(line) > 0, F.round(digits / F.length(line), 6)).otherwise(0.0)


def zones(lines: DataFrame, key: str = "doc_id", gap: int = 40, ahead: int = 3) -> DataFrame:
    """Adds kind and zone: a lab header counts if a lab line follows within ``ahead`` lines; a short line between lab lines is lab; imaging lasts until a narrative header or two blanks."""
    order = Window.partitionBy(key).orderBy("line_no")
    k = lines.withColumn("kind", kind(F.col("line")))
    soon = F.greatest(*[F.coalesce((F.lead("kind", i).over(order) == "lab").cast("int"), F.lit(0)) for i in range(1, ahead + 1)])
    header = F.when((F.col("kind") == "lab_header") & (soon == 1), "lab").when(F.col("kind") == "lab_header", "narrative").otherwise(F.col("kind"))
    k = k.withColumn("base", header)
    between = (F.lag("base").over(order) == "lab") & (F.lead("base").over(order) == "lab") & (F.length("line") <= gap) & (F.col("base") == "narrative")
    k = k.withColumn("smooth", F.when(between, "lab").otherwise(F.col("base")))
    twice = (F.col("kind") == "blank") & (F.lag("kind").over(order) == "blank")
    event = F.when(F.col("kind") == "imaging", 1).when(F.col("line").rlike(ascii_bounds(NARRATIVE)) | twice, 0)
    open_block = F.last(event, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    zone = F.when((F.coalesce(open_block, F.lit(0)) == 1) & F.col("smooth").isin("narrative", "imaging"), "imaging").otherwise(F.col("smooth"))
    return k.withColumn("zone", zone).drop("base", "smooth")


def blank_runs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, first_line, lines)``: maximal runs of blank lines."""
    order = Window.partitionBy(key).orderBy("line_no")
    blank = lines.where(F.trim("line") == "").withColumn("g", F.col("line_no") - F.row_number().over(order))
    return blank.groupBy(key, "g").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("lines")).drop("g")
