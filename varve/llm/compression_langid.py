"""Language identification by compression.

Each language has a Zstandard raw-content dictionary of training text. A text is encoded in pieces
with every dictionary; the language whose dictionary gives the fewest bytes wins, and a prediction
whose margin over the runner-up is narrow is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNDETERMINED = "und"
#: Pieces short enough that the dictionary, not the text's own history, carries the matches.
PIECE_BYTES = 2048
_LETTER = regex.compile(r"\p{L}")
RESULT = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
)


@dataclass(frozen=True)
class CompressionModel:
    """Dictionary content by language; ``min_margin`` is the relative lead in bytes below which a prediction is rejected."""

    dictionaries: dict[str, bytes]
    min_margin: float = 0.02
    level: int = 3

    def sizes(self, encoders: list[zstandard.ZstdCompressor], text: str) -> np.ndarray:
        data = text.lower().encode()
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        return np.array([sum(len(e.compress(p)) for p in pieces) for e in encoders], dtype=np.int64)

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for _, content in sorted(self.dictionaries.items()):
            table = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            table.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(level=self.level, dict_data=table, write_content_size=False, write_dict_id=False))
        return made

    def predict(self, text: Column) -> Column:
        """A struct (lang_pred, score, rejected) for a whole text.

        ``und`` with score 0 for a null text, one without a letter, or when no language was
        learned; such rows and narrow margins have ``rejected`` true. Equal sizes go to the first
        language by name. The score is 0 without a lead and nears 1 as the lead grows.
        """
        names = sorted(self.dictionaries)
        this = self

        @F.pandas_udf(RESULT)
        def apply(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoders = this.encoders()
            for series in texts:
                rows = [this._judge(names, encoders, t) for t in series]
                yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

        return apply(text)

    def _judge(self, names: list[str], encoders: list, text: str | None) -> tuple[str, float, bool]:
        if not names or text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(encoders, text)
        best = int(sizes.argmin())
        if len(names) == 1:
            return names[0], 1.0, False
        margin = (float(np.partition(sizes, 1)[1]) - float(sizes[best])) / float(sizes[best])
        return names[best], 1.0 - math.exp(-margin / 0.05), margin < self.min_margin


def fit(
    docs: DataFrame,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    texts_per_language: int = 128,
    text_bytes: int = 2048,
    max_languages: int = 256,
    **options: float,
) -> CompressionModel:
    """Build one dictionary per language from a bounded sample of the rows where ``train`` holds.

    At most ``texts_per_language`` whole texts of each of the ``max_languages`` most frequent
    languages are used, the first by hash of the id among those of at most ``text_bytes`` bytes; a
    language that has only longer texts is learned from one of them. Null languages and texts
    without a letter are not learned from. An empty table gives a model that answers ``und``.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id_"), F.col(lang).cast("string").alias("lang_"), F.col(text).alias("text_")
    )
    rows = rows.where(F.regexp_like("text_", F.lit(r"\p{L}")))
    common = rows.groupBy("lang_").count().orderBy(F.desc("count"), "lang_").limit(max_languages).select("lang_")
    # The rank limit is pushed below the shuffle, so each task sends at most texts_per_language rows of a language.
    long = F.octet_length("text_") > text_bytes
    first = F.row_number().over(Window.partitionBy("lang_").orderBy(long, F.xxhash64("id_"), "id_"))
    sample = (
        rows.withColumn("n_", first)
        .where((F.col("n_") <= texts_per_language) & (~long | (F.col("n_") == 1)))
        .join(F.broadcast(common), "lang_", "left_semi")
        .collect()
    )
    content: dict[str, bytes] = {}
    for row in sorted(sample, key=lambda r: (r["lang_"], -r["n_"])):
        content[row["lang_"]] = content.get(row["lang_"], b"") + row["text_"].lower().encode() + b"\n"
    return CompressionModel(content, **options)
