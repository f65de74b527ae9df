"""Language identification by compression.

For every language a bounded sample of passages of labelled texts becomes the raw-content
dictionary of a zstandard compressor.  A text, reduced to its lower-cased letters and single
spaces, is cut into blocks, every block is compressed with each dictionary, and the language
whose sizes add up to least is chosen.  Sizes are whole bytes, so two may be equal; then the sizes
at the next of ``LEVELS`` are added.  Where the runner-up comes within ``MARGIN`` (texts in two
languages, texts too short to tell) the row is marked as rejected.  Sizes alone decide, whatever
the length of the text.

The dictionaries are all that is learned: languages times ``DICT_BYTES``, a fixed bound for a
given set of languages, sent to the tasks with the function.  Prediction is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, utf8

DICT_BYTES = 200_000
#: Characters of a passage that may be drawn for a dictionary.
PASSAGE = 500
BLOCK = 4096
#: Compression levels: the first for all texts, the others where the least sizes are equal.
LEVELS = (6, 11, 3)
MARGIN = 0.02
UNKNOWN = "und"
#: All ASCII but letters becomes a space.
_BLANK = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def letters_of(text: bytes) -> bytes:
    """Lower-cased words of a text, joined by spaces; of ASCII, only letters are kept."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(_BLANK).split())


def has_letter(text: bytes) -> bool:
    plain = text.translate(_BLANK).strip()
    return bool(plain) and any(c.isalpha() for c in plain.decode("utf-8", "replace"))


class Classifier:
    """Compressors of all languages, in the order of their names."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = BLOCK, levels: tuple[int, ...] = LEVELS):
        self.block, self.languages, self.levels = block, sorted(dictionaries), levels
        self.dictionaries, self.compressors = dictionaries, {}

    def sizes(self, blocks: list[bytes], level: int) -> list[int]:
        """Compressed size of all blocks with each dictionary."""
        import zstandard as zs

        if level not in self.compressors:
            self.compressors[level] = []
            for name in self.languages:
                data = zs.ZstdCompressionDict(self.dictionaries[name], dict_type=zs.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=level)
                self.compressors[level].append(zs.ZstdCompressor(dict_data=data, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))
        return [sum([len(c.compress(b)) for b in blocks]) for c in self.compressors[level]]

    def classify(self, text: bytes) -> tuple[str, float]:
        """Language and margin: by how much of the runner-up's size the chosen one is smaller."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        words = letters_of(text)
        blocks = [words[at : at + self.block] for at in range(0, len(words), self.block)]
        total = [0] * len(self.languages)
        for level in self.levels:
            total = [a + b for a, b in zip(total, self.sizes(blocks, level))]
            least, second = sorted(total)[:2]
            if least < second:
                break
        return self.languages[total.index(least)], 1 - least / second


def learn_dictionaries(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = DICT_BYTES, passage: int = PASSAGE) -> dict[str, bytes]:
    """A dictionary of up to ``size`` bytes per language, of passages of ``passage`` characters of its labelled texts.

    Every passage of every distinct text is as likely to be drawn, by a hash of the text and the passage's
    place, so the draw doesn't depend on how rows are laid out, and repeated texts count once.  Null and
    empty texts and null languages teach nothing; a language with less than 8 letters is left out.  Only
    counts and the drawn passages, about twice ``size`` for each language, reach the driver.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.length(text_col).alias("chars")
    )
    # copies count once, as they are drawn all or none
    chars = {r["lang"]: r["n"] for r in known.select("lang", "h", "chars").distinct().groupBy("lang").agg(F.sum("chars").alias("n")).collect()}
    if not chars:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in chars.items() for x in (lang, min(1.0, 2 * size / n))])
    places = F.sequence(F.lit(0), F.floor((F.col("chars") - 1) / passage).cast("int"))
    drawn = F.filter(places, lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    passages = known.select("lang", "h", "text", F.explode(drawn).alias("i")).select("lang", "h", "i", F.xxhash64("h", "i").alias("key"), F.substr("text", F.col("i") * passage + 1, F.lit(passage)).alias("text"))
    out: dict[str, bytes] = {}
    # at once, as a local iterator runs a job for each partition
    for r in passages.groupBy("lang", "h", "i", "key").agg(F.min("text").alias("text")).orderBy("key", "h", "i").collect():
        if len(out.setdefault(r["lang"], b"")) < size:
            out[r["lang"]] += letters_of(r["text"].encode()) + b" "
    return {k: v[:size] for k, v in out.items() if len(v) >= 8}


def learning_rows(doc_id: Column) -> Column:
    """The fold that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN, prefix: str = "lang_") -> DataFrame:
    """All columns of ``df``, then ``<prefix>pred``, ``<prefix>score`` and ``<prefix>rejected``.

    ``pred`` is a learned language, or ``und`` where the text is null or has no letter (or
    nothing was learned); these are rejected, as are texts whose margin is below ``margin``.
    ``score`` is 0.5 at a margin of zero and rises to 1; 0 for ``und``.  Whole texts count.
    Ties go to the first language by name.  Every input row gives one row; an empty table none.
    A clash with an input column is an error: choose another ``prefix``.
    """
    new = [prefix + x for x in ("pred", "score", "rejected")]
    if set(new) & set(df.columns):
        raise ValueError(f"columns {new} are taken")
    at = df.columns.index(text_col)
    held: list[Classifier] = []

    def predict(batches) -> Iterator:
        import pyarrow as pa

        if not held:
            held.append(Classifier(dictionaries))
        for part in slices(batches, 1024, at):
            found = [held[0].classify(t) for t in utf8(part.column(at))]
            columns = [
                pa.array([lang for lang, _ in found], pa.string()),
                pa.array([0.0 if lang == UNKNOWN else 0.5 + 0.5 * min(1.0, m / 0.25) for lang, m in found], pa.float64()),
                pa.array([lang == UNKNOWN or m < margin for lang, m in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *new])

    fields = [T.StructField(n, t) for n, t in zip(new, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return df.mapInArrow(predict, T.StructType([*df.schema.fields, *fields]))
