"""Quality rules: base counts and tokeniser fertility with bands per language.

Every whole text is split into words; each word is encoded once per worker by a
public vocabulary with byte fallback. Characters per token, the share of
byte-fallback tokens and the entropy of the tokens must lie in the bands of the
document's language, or of the text's script if its language has none.

Defined results: a null or empty text has no words, so it fails the base rules;
an unknown or null language takes the band of the text's script, and ``*`` if that
has none; repeated rows and ties are
judged alike; texts of any length are read whole; an empty table gives an empty table;
other columns pass through, and a column that has the result's name gives way to it.
Measures are null where there are no tokens.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common


@dataclass(frozen=True)
class Band:
    """Accepted range of characters per token, most byte fallback, and least entropy.

    A text of n tokens needs ``min(entropy_floor, entropy_slope * log2(n))``
    bits, and may leave the range of characters per token by ``slack/sqrt(n)``,
    the sampling error of a short text.
    """

    low: float
    high: float
    fallback: float = 0.05
    entropy_floor: float = 4.3
    entropy_slope: float = 0.45
    slack: float = 1.5


#: Bands by language, else by the script that most letters of the text have, else ``*``.
#: High ends are above real prose under the 32k vocabulary (characters a token: English
#: reference prose 2.4-4.2, other Latin passages 1.9-2.9, Cyrillic 2.1-2.2); low ends are
#: above fragments (random Latin letters 1.5). Scripts that the vocabulary spells letter
#: by letter lie near 1, so there the share of fallback and the entropy decide.
BANDS = {
    "en": Band(1.88, 5.00),
    "de": Band(1.95, 4.50),
    "es": Band(1.72, 4.50),
    "fr": Band(1.72, 4.50),
    "vi": Band(0.90, 3.00, fallback=0.15),
    "Latn": Band(1.65, 5.00),
    "Cyrl": Band(1.60, 4.50),
    "Grek": Band(0.70, 2.50, entropy_floor=3.8),
    "Arab": Band(0.70, 2.50, fallback=0.15, entropy_floor=3.8),
    "Hebr": Band(0.70, 2.50, fallback=0.15, entropy_floor=3.5),
    "Deva": Band(0.50, 2.00, fallback=0.25, entropy_floor=3.8),
    "Thai": Band(0.60, 2.00, fallback=0.25, entropy_floor=3.8),
    "Geor": Band(0.60, 2.00, fallback=0.15, entropy_floor=3.5),
    "Hang": Band(0.45, 2.00, fallback=0.40),
    "Kana": Band(0.50, 2.00, fallback=0.40),
    "Hani": Band(0.50, 2.00, fallback=0.40),
    "*": Band(0.60, 8.00, fallback=0.50, entropy_floor=3.5),
}

#: First code point of each range and its script, "" for what no script is told from.
_RANGES = [
    (0x0, ""), (0x41, "Latn"), (0x5B, ""), (0x61, "Latn"), (0x7B, ""), (0xC0, "Latn"), (0x250, ""), (0x370, "Grek"), (0x400, "Cyrl"), (0x530, "*"), (0x590, "Hebr"), (0x600, "Arab"),
    (0x700, "*"), (0x750, "Arab"), (0x780, "*"), (0x8A0, "Arab"), (0x900, "Deva"), (0x980, "*"), (0xE00, "Thai"), (0xE80, "*"), (0x10A0, "Geor"), (0x1100, "Hang"), (0x1200, "*"), (0x1E00, "Latn"),
    (0x1F00, "Grek"), (0x2000, ""), (0x2C00, "*"), (0x2E80, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Hani"), (0x4DC0, ""), (0x4E00, "Hani"), (0xA000, "*"), (0xAC00, "Hang"), (0xD7B0, ""), (0xF900, "Hani"),
    (0xFB00, ""), (0xFB1D, "Hebr"), (0xFB50, "Arab"), (0xFE00, ""), (0xFE70, "Arab"), (0xFF00, ""), (0x10000, "*"), (0x1F000, ""), (0x20000, "Hani"), (0x32000, ""),
]
_FROM = np.array([r[0] for r in _RANGES])
_SCRIPTS = sorted({r[1] for r in _RANGES} - {""})
_SCRIPT_OF = np.array([_SCRIPTS.index(r[1]) if r[1] else len(_SCRIPTS) for r in _RANGES])

_NOT_WORD_CHARS = bytes(range(0x80, 0xC0)) + b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"

MEASURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType())]
    + [T.StructField("n_tokens", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "fallback_share", "token_entropy")]
    + [T.StructField("kept", T.BooleanType())]
)


class Pieces:
    """A vocabulary with byte fallback; packs each word's token ids as 16-bit integers."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        if size > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 pieces")
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.table = common.WordTable(self.encode)

    def encode(self, words: list[bytes]) -> list[bytes]:
        found = self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        return [struct.pack(f"<{len(ids)}H", *ids) for ids in found]


def repeated_words(hashes: np.ndarray, width: int = 8) -> int:
    """Words in windows of this width that the text holds twice or more."""
    windows = common.window_hashes(hashes, width)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return int(common.covered(np.flatnonzero(again), width, len(hashes)).sum())


def script(text: bytes) -> str:
    """The script of most letters; Japanese is told by a tenth of kana; ``*`` if there are none or it has no band."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    n = np.bincount(_SCRIPT_OF[np.searchsorted(_FROM, points, side="right") - 1], minlength=len(_SCRIPTS) + 1)[:-1]
    if not n.any():
        return "*"
    found = _SCRIPTS[int(n.argmax())]
    return "Kana" if found == "Hani" and n[_SCRIPTS.index("Kana")] * 10 >= n.sum() else found


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(text.translate(None, _NOT_WORD_CHARS)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(common.word_hashes(words)),
    )


def judge(text: bytes, words: list[bytes], lang: str | None, pieces: Pieces, bands: dict[str, Band]) -> tuple:
    n = len(words)
    chars, symbols, dup_lines, repeats = base_counts(text, words)
    failed = n < 20 or 100 * repeats > 30 * n
    ids = np.frombuffer(b"".join(map(pieces.table.__getitem__, words)), np.uint16)
    if not len(ids):
        return n, chars, symbols, dup_lines, repeats, failed, 0, None, None, None, False
    counts = np.bincount(ids)
    counts = counts[counts > 0] / len(ids)
    entropy = float(-(counts * np.log2(counts)).sum()) + 0.0
    fallback = float(pieces.is_byte[ids].mean())
    per_token = chars / len(ids)
    band = bands[lang] if lang in bands else bands.get(script(text), bands["*"])
    slack = band.slack / math.sqrt(len(ids))
    good = (
        band.low - slack <= per_token <= band.high + slack
        and fallback <= band.fallback
        and entropy >= min(band.entropy_floor, band.entropy_slope * math.log2(len(ids)))
    )
    return n, chars, symbols, dup_lines, repeats, failed, len(ids), per_token, fallback, entropy, good and not failed


def measure(docs: DataFrame, model_path: str, bands: dict[str, Band] = BANDS, text: str = "text", lang: str = "lang", out: str = "rules") -> DataFrame:
    """docs with one struct column more, named out: the counts and verdict of each row.

    The vocabulary file is read on the driver and broadcast (it has a fixed
    size); a worker's table of words is bounded by ``TABLE_ENTRIES`` and one batch.
    """
    common.small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    arrow = pa.struct([(f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.dataType.simpleString()]) for f in MEASURES])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        common.lean_worker()
        pieces = Pieces(model.value)
        for texts, langs in batches:
            rows, names = [], iter(langs.to_pylist())
            for portion in common.portions(common.binaries(texts)):
                words = [text.split() for text in portion]
                pieces.table.admit(words)
                rows += [judge(text, ws, next(names), pieces, bands) for text, ws in zip(portion, words, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(arrow), arrow, strict=True)], fields=list(arrow))

    language = F.col(lang) if lang in docs.columns else F.lit(None)
    return docs.withColumn(out, F.arrow_udf(run, MEASURES)(common.as_bytes(text), language.cast("string")))
