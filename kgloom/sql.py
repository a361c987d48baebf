"""The library for spark.sql: register(spark) adds its functions and the table function code_patterns to a session.

    SELECT * FROM code_patterns(TABLE(SELECT file_path, source FROM sources) PARTITION BY file_path)

gives (file_path, pattern, parsed) of C sources in parallel by file. Scalar functions are SQL expressions that Catalyst inlines, not
Python: kg_norm(name), kg_jaccard(a, b).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import BooleanType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

FUNCTIONS = {
    "kg_norm(name STRING) RETURNS STRING": "regexp_replace(translate(coalesce(name, ''), '（）', '()'), '\\\\s+', '')",
    "kg_jaccard(a STRING, b STRING) RETURNS DOUBLE": """coalesce(try_divide(
        size(array_intersect(filter(split(lower(a), ''), c -> c <> ''), filter(split(lower(b), ''), c -> c <> ''))),
        size(array_union(filter(split(lower(a), ''), c -> c <> ''), filter(split(lower(b), ''), c -> c <> '')))), 0.0D)""",
}


class CodePatterns:
    """A row for each pattern in a source; where its brackets don't match, one row without pattern, parsed false. The table argument has
    a column `source`; any others it is partitioned by come back."""

    @staticmethod
    def analyze(sources: AnalyzeArgument) -> AnalyzeResult:
        if not sources.isTable or "source" not in sources.dataType.fieldNames():
            raise ValueError("code_patterns takes a table with a column source")
        schema = StructType([f for f in sources.dataType.fields if f.name != "source"])
        return AnalyzeResult(schema.add("pattern", StringType()).add("parsed", BooleanType()))

    def eval(self, sources: Row) -> Iterator[tuple]:
        from kgloom.operators.extract import syntax_patterns

        given = [v for k, v in sources.asDict().items() if k != "source"]
        found = syntax_patterns(sources["source"]) if sources["source"] is not None else set()
        if found is None:
            yield (*given, None, False)
        else:
            for pattern in sorted(found):
                yield (*given, pattern, True)


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("code_patterns", udtf(CodePatterns))
