"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled with excerpts of documents of
that language. A text is encoded once with each dictionary; the language whose dictionary gives
the smallest encoding is the prediction, and the share by which the second smallest is larger
is the margin. A prediction with a margin below ``min_margin`` is marked as rejected. Texts go
in lower case with runs of other characters than letters as one space, whole, in blocks of
``block_bytes``, so that a long text is judged by all of its blocks alike and not by the start
alone.

Fitting takes a bounded sample: of every language the texts with the lowest hashes, about
``excerpts`` of them, one excerpt of at most ``excerpt_chars`` characters each, as much as
fills ``dict_bytes``. Which documents may be learned from is the caller's filter; prediction
reads the text alone. The number of languages is bounded by ``max_languages`` (more raise an
error, as each costs an encoding of every text).

Defined results: a null text, or one without a letter, is ``und`` with score 0 and margin 0, as
is every text if nothing was learned; equal sizes go to the language with more documents to
learn from, then to the smaller name; null languages and texts without a letter teach nothing;
a row with a null id is not held out and teaches nothing; repeated rows stay, a row each; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.llm.common import map_rows

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    dict_bytes: int = 1 << 16
    excerpts: int = 400
    excerpt_chars: int = 1000
    level: int = 9
    block_bytes: int = 2048
    min_margin: float = 0.03
    max_languages: int = 200
    #: Nats of evidence for each byte that an encoding is shorter, in the score.
    nats_per_byte: float = 0.15


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` divided by ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def letters(text: str) -> bytes:
    """Lower-case runs of letters between single spaces, as UTF-8."""
    return (" " + " ".join(LETTERS.findall(text.lower())) + " ").encode("utf-8")


def excerpt(text: str, number: int, chars: int) -> str:
    """``chars`` characters of the text from a place that ``number`` chooses."""
    at = number % max(1, len(text) - chars + 1)
    return text[at:at + chars]


@dataclass(frozen=True)
class Model:
    """Languages, most documents first, with the content of their dictionaries."""

    languages: list[str]
    contents: list[bytes]
    settings: Settings

    def encoders(self):
        import zstandard

        out = []
        for content in self.contents:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=self.settings.level)
            out.append(zstandard.ZstdCompressor(level=self.settings.level, dict_data=known))
        return out

    def sizes(self, text: str, encoders) -> list[int]:
        """Bytes that the text takes with every dictionary."""
        data, step = letters(text), self.settings.block_bytes
        blocks = [data[at:at + step] for at in range(0, len(data), step)]
        return [sum(len(encoder.compress(block)) for block in blocks) for encoder in encoders]

    def judge(self, sizes: list[int]) -> tuple[str, float, float]:
        """(language, score, margin)."""
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        second = min((s for k, s in enumerate(sizes) if k != best), default=None)
        margin = 0.0 if second is None else (second - sizes[best]) / second
        odds = sum(math.exp(-self.settings.nats_per_byte * min(s - sizes[best], 4000)) for s in sizes)
        return self.languages[best], 1 / odds, margin


def fit(docs: DataFrame, *, settings: Settings = Settings(), lang_col: str = "lang", text_col: str = "text") -> Model:
    """Dictionaries from a bounded sample of ``docs``, all of whose rows may be learned from. Eager."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(settings.max_languages + 1).collect()
    if len(totals) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    totals = sorted(((r["lang"], r["n"]) for r in totals), key=lambda r: (-r[1], r[0]))
    if not totals:
        return Model([], [], settings)
    # So small a share of the hashes passes that about twice the sample is left, then the lowest hashes are taken.
    spot = F.xxhash64("text")
    place = F.shiftrightunsigned(spot, 1) / F.lit(2.0**63)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in totals for x in (lang, min(1.0, 2 * settings.excerpts / n))]), F.col("lang"))
    near = known.filter(place < share).select("lang", spot.alias("spot"), "text").dropDuplicates(["lang", "spot"])
    longest = settings.excerpt_chars

    def start():
        def step(columns):
            langs, spots, texts = columns
            return [langs, spots, [excerpt(text, spot & 0xFFFFFFFF, longest) if has_letter(text) else None
                                   for spot, text in zip(spots, texts, strict=True)]]

        return step

    rows = map_rows(near, ["lang", "spot", "text"], "lang string, spot bigint, excerpt string", start).filter("excerpt is not null").collect()
    contents: dict[str, bytes] = {}
    for lang, _ in totals:
        mine = sorted((r["spot"] % (1 << 64), r["excerpt"]) for r in rows if r["lang"] == lang)[:settings.excerpts]
        contents[lang] = b"".join(letters(text) for _, text in mine)[:settings.dict_bytes]
    taught = [lang for lang, _ in totals if contents[lang].strip()]
    return Model(taught, [contents[lang] for lang in taught], settings)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 4,
             fold: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score, margin, rejected) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        encoders = model.encoders()

        def step(columns):
            ids, held, texts = columns
            out = []
            for text in texts:
                if model.languages and has_letter(text):
                    out.append(model.judge(model.sizes(text, encoders)))
                else:
                    out.append((UNDETERMINED, 0.0, 0.0))
            margins = [round(m, 9) for _, _, m in out]
            return [ids, held, [lang for lang, _, _ in out], [round(s, 9) for _, s, _ in out], margins,
                    [m < model.settings.min_margin for m in margins]]

        return step

    flagged = docs.select(id_col, F.coalesce(in_fold(id_col, folds, fold), F.lit(False)).alias("is_held_out"), text_col)
    return map_rows(flagged, flagged.columns, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, "
                    "margin double, rejected boolean", start)
