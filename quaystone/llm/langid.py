"""Language identification by compression: the language whose dictionary packs a text smallest.

Each language has a raw-content dictionary of sampled text. A text is cut into blocks, every block is
compressed with each dictionary, and the sizes are summed, so all of a long text counts alike. If the second
best is nearly as small the answer is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaystone.llm._common import stash

BLOCK = 2048
LEVEL = 3


@dataclass
class LanguageModel:
    """dictionaries: text bytes for each language."""

    dictionaries: dict[str, bytes]

    def packers(self) -> dict[str, zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=max(map(len, self.dictionaries.values()), default=0), source_size=BLOCK, write_checksum=0, write_content_size=0, write_dict_id=0
        )
        out = {}
        for lang, data in sorted(self.dictionaries.items()):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            out[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        return out

    @staticmethod
    def judge(text: str | None, packers: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float, float]:
        """The language, a score from 0 to 1, and the margin: by how much the second best is larger, as a share."""
        if not text or not packers or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        data = text.encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = {lang: sum(len(p.compress(b)) for b in blocks) for lang, p in packers.items()}
        order = sorted(sizes, key=lambda x: (sizes[x], x))
        best = sizes[order[0]]
        # a byte saved in a hundred doubles or so the odds
        weight = sum(math.exp(-70.0 * (sizes[x] - best) / len(data)) for x in order)
        return order[0], 1.0 / weight, (sizes[order[1]] - best) / best if len(order) > 1 else 1.0

    def column(self, text: Column, min_margin: float = 0.0) -> Column:
        """A struct of lang, score, margin. Below ``min_margin`` lang is ``und``."""

        @F.pandas_udf("lang string, score double, margin double")
        def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            packers = self.packers()
            for batch in texts:
                rows = [self.judge(t, packers) for t in batch]
                yield pd.DataFrame(
                    {"lang": [x if m >= min_margin else "und" for x, _, m in rows], "score": [s for _, s, _ in rows], "margin": [m for _, _, m in rows]}
                )

        return judge(text)


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 100, dictionary_bytes: int = 1 << 16, piece: int = 512
) -> LanguageModel:
    """Dictionaries from a bounded sample: pieces of the ``docs_per_lang`` texts of each language whose hash is smallest.

    The chosen texts, whatever their length, are cut whole into pieces of ``piece`` characters; those pieces whose hash is
    smallest fill the language's dictionary, so long texts give more of it and no part of a text is preferred. Only
    hashes are ranked; the chosen texts are fetched by them. At most ``dictionary_bytes`` for each language reach the
    driver. Equal texts count once. Rows with a null text or language, or without a letter, are left out; ids are not looked at.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    order = W.partitionBy("lang").orderBy("h")
    # equal hashes share a rank, so a text that fills the table takes one place
    hashes = rows.groupBy("lang", "h").agg(F.count("*").alias("copies"))
    chosen = stash(hashes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_lang).select("lang", "h"))
    # docs_per_lang rows for each language, as labels are few
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(piece))
    pieces = texts.select("lang", F.explode(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(piece)))).alias("piece"))
    best = W.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    ranked = pieces.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= -(-dictionary_bytes // piece))
    found: dict[str, list[bytes]] = {}
    for r in ranked.orderBy("lang", "rank").select("lang", "piece").toLocalIterator():
        found.setdefault(r["lang"], []).append(r["piece"].encode("utf-8", "surrogatepass"))
    return LanguageModel({lang: _pack(parts, dictionary_bytes) for lang, parts in found.items()})


def _pack(parts: list[bytes], most: int) -> bytes:
    """The first pieces that fit, the first of all at the end, where it is nearest to what is compressed."""
    out, size = [], 0
    for p in dict.fromkeys(parts):
        if size + len(p) + 1 <= most:
            out.append(p)
            size += len(p) + 1
    return b"\n".join(reversed(out)) or parts[0][:most]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.0) -> DataFrame:
    """doc_id, lang_pred, score, margin for each row of docs.

    lang_pred is ``und`` with score 0 for texts that are null or have no letter (of a Unicode class L), for all texts if
    the model has no language, and for margins below ``min_margin``. Equal sizes go to the first language by name.
    The whole of a text is judged, block by block. Repeated rows are judged one by one and alike; null ids stay. Other
    columns are ignored. No rows give no rows.
    """
    judged = docs.select(F.col(id_col).alias("doc_id"), model.column(F.col(text_col), min_margin).alias("j"))
    return judged.select("doc_id", F.col("j.lang").alias("lang_pred"), "j.score", "j.margin")
