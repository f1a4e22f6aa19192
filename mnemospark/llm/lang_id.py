"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of sample texts. A text is encoded whole with
every dictionary; the one that gives the fewest bytes names the language. The margin to the second smallest
tells how sure that is, and a narrow margin rejects the decision (column `accepted`).
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table, through_python

#: Characters of a passage. Passages of whole texts are what dictionaries are made of.
PASSAGE_CHARS = 512
#: Bytes that a dictionary is to hold, and bytes of all together: with more languages than fit, each has less.
DICTIONARY_BYTES, MODEL_BYTES = 160_000, 64 << 20
LEVEL, MIN_MARGIN = 6, 0.01


def dictionaries(docs: DataFrame, size: int = DICTIONARY_BYTES, model: int = MODEL_BYTES, seed: int = 11) -> dict[str, bytes]:
    """One raw-content dictionary for each non-null lang of docs, made of a sample of passages.

    All texts are cut in passages of PASSAGE_CHARS, wherever they stand, and drawn by a hash at a rate that gives
    about min(size, model / languages) bytes of each language; all passages set the rate. The driver receives
    one count per language and about `model` bytes at most. Null and empty texts teach nothing; repeated rows
    count as often as they come; ties of the hash go by the passage itself.
    """
    known = docs.where("lang IS NOT NULL AND length(text) > 0").select("doc_id", "lang", "text")
    chars = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not chars:
        return {}
    share = min(size, model // len(chars))
    rate = F.create_map(*[x for k, n in chars.items() for x in (F.lit(k), F.lit(int(min(1.0, share / n) * (1 << 40))))])
    passages = known.select("doc_id", "lang", rate[F.col("lang")].alias("rate"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE_CHARS}}}"), F.lit(0))).alias("at", "passage"))
    drawn = passages.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "at")).where(F.pmod("h", F.lit(1 << 40)) < F.col("rate"))
    texts: dict[str, list] = {}
    for lang, h, passage in drawn.select("lang", "h", "passage").collect():
        texts.setdefault(lang, []).append((h, passage))
    return {lang: b" ".join(plain(t) for _, t in sorted(texts[lang])) for lang in sorted(texts)}


_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """The letters of the whole text in lower case; every other run of characters is one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


class Compressors:
    """A compressor per language and the decision from the sizes it gives, one and the same for every length."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(content)
        self.whole = [self._of(content[x], level) for x in self.langs]

    @staticmethod
    def _of(data: bytes, level: int):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def decide(self, text: str | None) -> tuple[str, float]:
        """(lang, margin): margin is the share of bytes that the best saves against the second, 0 to 1.
        No text, no letter or nothing learned: ("und", 0). Ties go to the first lang in order."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        data = plain(text)
        sizes = [len(c.compress(data)) for c in self.whole]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for k, s in enumerate(sizes) if k != best), default=None)
        return self.langs[best], 1.0 if rest is None else (rest - sizes[best]) / rest


def identify(docs: DataFrame, content: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the margin), accepted (a margin of min_margin or
    more). Repeated rows repeat the result; an empty table gives none; other columns are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # MODEL_BYTES at most, about

    def work():
        compressors = Compressors(shared.value)

        def each(part: pa.RecordBatch) -> dict:
            found = [compressors.decide(t) for t in part.column(1).to_pylist()]
            return {"doc_id": part.column(0), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found],
                    "accepted": [x[1] >= min_margin for x in found]}

        return each

    return through_python(docs.select("doc_id", "text"), work, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = dictionaries(docs.where(~held_out()))
    return identify(docs, content).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
