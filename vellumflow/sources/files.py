"""Files as rows: upload rules, sniffing, provider choice, encodings, HTML to Markdown."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumflow.functions import model as M

#: What may be uploaded.
UPLOADS = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "txt": "text/plain", "csv": "text/csv", "html": "text/html", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tiff": "image/tiff"}
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff")
#: First bytes of media files, as hexadecimal digits.
MAGIC = {"FFD8FF": "jpeg", "89504E470D0A1A0A": "png", "47494638": "gif", "424D": "bmp", "49492A00": "tiff", "4D4D002A": "tiff", "255044462D": "pdf"}


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path that may be uploaded: by ending and size. The content is read only for files that pass."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(accepted(F.col("path"), F.col("length")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def accepted(path: Column, length: Column, content_type: Column | None = None) -> Column:
    ending = extension(path)
    fine = ending.isin(*UPLOADS) & (length > 0) & (length <= M.UPLOAD_BYTES)
    if content_type is None:
        return fine
    pairs = F.create_map(*[F.lit(x) for kv in UPLOADS.items() for x in kv])
    return fine & (F.try_element_at(pairs, ending) == content_type)


def sniff(content: Column) -> Column:
    """Media type by the first bytes, or null."""
    head = F.hex(F.substring(content, 1, 12))
    webp = head.startswith("52494646") & head.endswith("57454250")
    return F.coalesce(F.when(webp, F.lit("webp")), *[F.when(head.startswith(magic), F.lit(kind)) for magic, kind in MAGIC.items()])


def needs_ocr(ending: Column, text: Column) -> Column:
    """Images always; PDFs without a letter or digit in their text layer."""
    return ending.isin(*IMAGES) | ((ending == "pdf") & ~F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{Nd}]"))


class Providers:
    """Text providers by file ending: the highest priority wins, of equals the one registered first; none is an error row."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, int, int]] = []

    def register(self, name: str, endings: list[str], priority: int = 0) -> None:
        self.rows += [(e.lower(), name, priority, -len(self.rows)) for e in endings]

    def choose(self, files: DataFrame, ending: str) -> DataFrame:
        """Adds provider, null if no provider can handle the file. The registry is code, so it may be broadcast."""
        known = files.sparkSession.createDataFrame(self.rows, "ending string, name string, priority int, seniority int")
        best = known.groupBy(F.col("ending").alias("_ending")).agg(F.max(F.struct("priority", "seniority", "name"))["name"].alias("provider"))
        return files.join(F.broadcast(best), F.lower(F.col(ending)) == F.col("_ending"), "left").drop("_ending")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes: a byte order mark or strict UTF-8, else Shift-JIS as Windows writes it."""

    def one(data: bytes) -> str | None:
        if data is None:
            return None
        for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if data.startswith(mark):
                return data.decode(name, "replace")
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("cp932", "replace")

    return content.map(one)


#: Our rules from HTML to Markdown, step by step, in a syntax that Java and RE2 share.
HTML = (
    (r"(?is)<(script|style|head|nav|footer)[^>]*>.*?</(script|style|head|nav|footer)>", ""),
    (r"(?is)<!--.*?-->", ""),
    *((rf"(?is)<h{k}[^>]*>\s*(.*?)\s*</h{k}>", "\n\n" + "#" * k + r" \1" + "\n\n") for k in range(1, 7)),
    (r"(?is)<li[^>]*>\s*", "\n- "),
    (r"(?is)<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>", r"[\2](\1)"),
    (r"(?is)<(strong|b)>(.*?)</(strong|b)>", r"**\2**"),
    (r"(?is)<br[^>]*>", "\n"),
    (r"(?is)</?(p|div|ul|ol|table|tr|section|article)[^>]*>", "\n\n"),
    (r"(?is)<[^>]+>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
)


def html_to_markdown(html: Column) -> Column:
    steps = [(p, r.replace("\\1", "$1").replace("\\2", "$2")) for p, r in HTML]
    return F.btrim(reduce(lambda t, s: F.regexp_replace(t, *s), steps, html), F.lit(" \n\t"))
