"""Table functions for SQL texts, for a lateral join with the table whose columns they read."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from vellumflow.functions.text import OCR_OPEN, OCR_PAGE, OCR_PAGE_END
from vellumflow.operators.assemble import WHITE

SLICES = "document_slices"
_FIGURE = re.compile(f"{re.escape(OCR_OPEN)}|{re.escape(OCR_PAGE)}[0-9]+{re.escape(OCR_PAGE_END)}")


def _line_start(text: str, marker: str, start: int) -> int:
    """Where a marker stands at the start of a line, from start on; -1 if it does not."""
    if start == 0 and text.startswith(marker):
        return 0
    at = text.find("\n" + marker, start)
    return at + 1 if at >= 0 else -1


class DocumentSlices:
    """The slices of a text between its markers, as functions.text.slices() has them, a row each; no row where the cut cannot be trusted."""

    @staticmethod
    def analyze(markdown: AnalyzeArgument, markers: AnalyzeArgument) -> AnalyzeResult:
        kind = markers.dataType
        if not isinstance(markdown.dataType, (T.StringType, T.NullType)):
            raise ValueError(f"{SLICES}: the text must be a string, not {markdown.dataType.simpleString()}")
        element = kind.elementType if isinstance(kind, T.ArrayType) else None
        if not isinstance(element, T.StructType) or {"marker", "is_sub_document"} - set(element.names):
            raise ValueError(f"{SLICES}: the markers must be an array of structs with marker and is_sub_document, not {kind.simpleString()}")
        return AnalyzeResult(T.StructType().add("ordinal", T.LongType()).add("text", T.StringType()).add("is_sub_document", T.BooleanType()).add("is_figure", T.BooleanType()))

    def eval(self, markdown: str | None, markers: list | None) -> Iterator[tuple]:
        if not markdown or not markers:
            return
        starts, after = [], 0
        for m in markers:
            marker = m["marker"]
            if marker is None or not marker.strip(WHITE):
                return
            at = _line_start(markdown, marker, after)
            if at < 0:
                at = _line_start(markdown, marker.replace("&lt;", "<"), after)
            if at < 0:
                return
            starts.append(at)
            after = at + 1
        starts[0] = 0
        ordinal = 0
        for m, begin, end in zip(markers, starts, [*starts[1:], len(markdown)]):
            text = markdown[begin:end].strip(WHITE)
            if text:
                yield ordinal, text, m["is_sub_document"], bool(_FIGURE.fullmatch(m["marker"].strip(WHITE)))
                ordinal += 1


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL texts of a session."""
    spark.udtf.register(SLICES, udtf(DocumentSlices))
