"""The scalar operators as functions of SQL text."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import formulas, latex, text
from scriptorium.operators import classify

#: name: (SQL type that it returns, column function of one text)
SCALAR: dict[str, tuple[str, object]] = {
    "clean_text": ("STRING", text.clean),
    "clean_extracted": ("STRING", text.clean_extracted),
    "repair_doubled": ("STRING", text.repair_doubled),
    "token_estimate": ("INT", text.token_estimate),
    "text_density": ("DOUBLE", text.density),
    "drop_footers": ("STRING", text.drop_footers),
    "drop_fillers": ("STRING", text.drop_fillers),
    "clean_answer": ("STRING", text.clean_answer),
    "strip_rtf": ("STRING", text.strip_rtf),
    "plausible_latex": ("BOOLEAN", text.plausible_latex),
    "latex_escape": ("STRING", latex.escape),
    "sanitize_formula": ("STRING", latex.sanitize_formula),
    "text_block": ("STRING", latex.text_block),
    "babel_name": ("STRING", latex.babel_name),
    "subject_of": ("STRING", classify.subject),
    "is_transcript": ("BOOLEAN", classify.is_transcript),
}


_PIECE = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(and|or|[=<>!+*/%&|^-]+)(?=\()")


def as_sql(column: Column) -> str:
    """A column as SQL text: the column's own rendering, with operators in prefix form quoted as function names."""
    return _PIECE.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], column._jc.node().sql())


def register(spark: SparkSession) -> list[str]:
    """Make the scalar operators callable in spark.sql as temporary functions, and formula conversion as an Arrow UDF."""
    done = []
    for name, (kind, function) in SCALAR.items():
        spark.sql(f"create or replace temporary function {name}(t string) returns {kind} return {as_sql(function(F.col('t')))}")
        done.append(name)
    spark.udf.register("omml_to_latex", F.udf(formulas.to_latex, "string", useArrow=True))
    return [*done, "omml_to_latex"]


def apply_scalar(df, name: str, column: str, out: str):
    """A scalar operator by name."""
    return df.withColumn(out, SCALAR[name][1](F.col(column)))
