"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram of a word (bracketed
by spaces) binds its letters: the product of the first vector rotated by two,
the second rotated by one, and the third. A text bundles (adds) the vectors of
its trigrams, a language those of its labelled texts. A text has the language
whose prototype it has the largest cosine with (ties: the first by name).

Nulls and edge cases: a null text, or one without a letter, is ``und`` with
score 0, as is any text if nothing was learned. Rows without ``lang`` or
``doc_id`` are not learned from; a row without ``doc_id`` is not held out.
Repeated rows are learned from and named each. An empty table gives no rows.
Extra columns are ignored, or carried along if asked for by name.
The prototypes are a vector per language label, the only thing collected.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import slices, texts

DIM = 1024
SEED = 0x9E3779B97F4A7C15
UNKNOWN = "und"
_IS_LETTER: list[np.ndarray] = []  # made once in each worker


def _letters() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)]))
    return _IS_LETTER[0]


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A vector of +1 and -1 for each code point, the same in every process."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(dim // 64) + np.arange(dim // 64, dtype=np.uint64)
        x = (x + np.uint64(1)) * np.uint64(SEED)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, cut before white space."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def bundle(parts: list[str], owner: np.ndarray, n: int, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The trigram bundles of ``n`` texts, and their numbers of letters.
    ``parts``: pieces of the texts; ``owner``: the text of each piece."""
    low = [f" {p.lower()} " for p in parts]
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    piece = np.repeat(np.arange(len(low)), [len(p) for p in low])
    is_letter = _letters()[chars]
    letters = np.bincount(owner[piece[is_letter]], minlength=n)
    keep = is_letter.copy()
    keep[0:1] = True
    keep[1:] |= is_letter[:-1] | (piece[1:] != piece[:-1])  # of a run of others the first, as a space
    chars, piece = np.where(is_letter, chars, 32)[keep], piece[keep]
    points, index = np.unique(chars, return_inverse=True)
    index, k = index.astype(np.int64), len(points)
    if len(index) < 3:
        return np.zeros((n, dim)), letters
    whole = (chars[1:-1] != 32) & (piece[2:] == piece[:-2])
    code = ((index[:-2] * k + index[1:-1]) * k + index[2:])[whole]
    text = owner[piece[:-2][whole]]
    grams, gram = np.unique(code, return_inverse=True)
    v = letter_vectors(points, dim)
    first, second = np.roll(v, 2, 1), np.roll(v, 1, 1)
    out, width = np.zeros((n, dim)), max(1, min(8192, (8 << 20) // max(n, 1)))
    for at in range(0, len(grams), width):
        g = grams[at:at + width]
        bound = (first[g // (k * k)] * second[g // k % k] * v[g % k]).astype(np.float32)
        here = slice(None) if len(grams) <= width else (gram >= at) & (gram < at + len(g))
        counts = np.bincount(text[here] * len(g) + gram[here] - at, minlength=n * len(g))
        out += counts.reshape(n, len(g)).astype(np.float32) @ bound
    return out, letters


def bundles(whole: list[str], dim: int = DIM, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The trigram bundle and the number of letters of each text."""
    vectors, letters = np.zeros((len(whole), dim)), np.zeros(len(whole), np.int64)
    parts, owner, held = [], [], 0

    def flush() -> None:
        if parts:
            v, c = bundle(parts, np.array(owner) - owner[0], owner[-1] - owner[0] + 1, dim)
            vectors[owner[0]:owner[-1] + 1] += v
            letters[owner[0]:owner[-1] + 1] += c

    for i, text in enumerate(whole):
        for piece in _pieces(text, size):
            if held + len(piece) > size:
                flush()
                parts, owner, held = [], [], 0
            parts.append(piece)
            owner.append(i)
            held += len(piece)
    flush()
    return vectors, letters


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is held out from learning: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """The prototype of each language: the sum of the bundles of all its labelled texts."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            vectors, _ = bundles(texts(batch), dim)
            for lang in dict.fromkeys(langs):
                total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(0)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([*total]), pa.array([v.astype(np.int64).tolist() for v in total.values()])], ["lang", "vector"])

    train = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang")
    sums = (train.mapInArrow(run, "lang string, vector array<long>")
            .select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")))
    found: dict[str, np.ndarray] = {}
    for lang, i, x in sums.collect():  # dim numbers a language
        found.setdefault(lang, np.zeros(dim))[i] = x
    return {k: found[k] for k in sorted(found) if found[k].any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], columns: list[str] | None = None,
             pred: str = "lang_pred", score: str = "score", n_letters: str | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (all) with the predicted language and its score, under the names ``pred`` and ``score``,
    and the number of letters, if it is given a name."""
    columns = docs.columns if columns is None else columns
    names, dim = [*prototypes], len(next(iter(prototypes.values()), np.zeros(DIM)))
    unit = np.array([p / np.linalg.norm(p) for p in prototypes.values()]).reshape(len(names), dim)

    def run(batches):
        for batch in slices(batches):
            vectors, letters = bundles(texts(batch), dim)
            norm = np.linalg.norm(vectors, axis=1)
            known = (letters > 0) & (norm > 0) & bool(names)
            cosine = vectors @ unit.T / np.where(norm > 0, norm, 1)[:, None] if names else np.zeros((len(norm), 1))
            best = cosine.argmax(1)
            langs = [names[b] if ok else UNKNOWN for b, ok in zip(best, known)]
            scores = np.where(known, np.clip(cosine.max(1), 0, 1), 0.0)
            new = {pred: pa.array(langs, pa.string()), score: pa.array(scores, pa.float64())}
            if n_letters:
                new[n_letters] = pa.array(letters, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new.values()], [*columns, *new])

    source = docs.select(*dict.fromkeys([*columns, "text"]))
    schema = StructType([*(source.schema[c] for c in columns), StructField(pred, StringType()), StructField(score, DoubleType()),
                         *([StructField(n_letters, LongType())] if n_letters else [])])
    return source.mapInArrow(run, schema)


def _length_class(n_letters: str) -> Column:
    """Texts of 1, 2 to 3, 4 to 7, ... letters."""
    return F.floor(F.log2(F.col(n_letters)) + 1e-9).cast("int")


def learned_bounds(named: DataFrame, pred: str, score: str, n_letters: str, lowest: float = 0.001, least: int = 100) -> dict[int, float]:
    """Per class of text lengths, the score from which a text counts as one of the learned languages: half of the score
    that all but the ``lowest`` share of the texts learned from reach, that is half way between them and chance
    (cosine 0). All rows learned from that got their own language count; a class of fewer than ``least`` takes the
    bound of the class below, and texts shorter than any such class have none."""
    learned = (F.col(pred) == F.col("lang")) & F.col("doc_id").isNotNull() & ~held_out()
    counted = (named.where(learned & (F.col(n_letters) > 0))
               .groupBy(_length_class(n_letters).alias("length"), F.floor(F.col(score) * 1000).cast("int").alias("milli"))
               .agg(F.count("*").alias("n")).collect())  # at most 1 001 rows a class
    bounds: dict[int, float] = {}
    bound = 0.0
    for length in range(64):
        bars = sorted((milli, n) for k, milli, n in counted if k == length)
        total = sum(n for _, n in bars)
        if total >= least:
            passed = 0
            for milli, n in bars:
                passed += n
                if passed > lowest * total:
                    bound = milli / 2000
                    break
        bounds[length] = bound
    return bounds


def known(bounds: dict[int, float], pred: str, score: str, n_letters: str) -> Column:
    """Whether a text is in one of the learned languages, by the ``bounds``."""
    bound = F.element_at(F.create_map(*(F.lit(x) for item in bounds.items() for x in item)), _length_class(n_letters))
    return (F.col(pred) != UNKNOWN) & (F.col(score) >= F.coalesce(bound, F.lit(0.0)))
