"""Language identification: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.llm.util import bound_batches, pieces_of

#: The classifier is fitted on at most this many labelled rows a language, none longer than SAMPLE_CHARS.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_CHARS = 20_000
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-3
UNDETERMINED = "und"
#: Score of a text that no one-versus-rest classifier claims (winning value 0); calibration may only lower it.
UNCLAIMED = 0.5
FOLDS = 5
#: Normalised texts below this many bytes are a word or two: too little to tell that no language claims them.
JUDGED_BYTES = 16
#: Texts scored in one matrix product, and bytes after which a product is not enlarged.
BLOCK_TEXTS, BLOCK_BYTES = 256, 1 << 20

_not_letters = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    """Lower case; each run of what is not a letter is one space."""
    return b" " + _not_letters.sub(" ", text.lower()).strip().encode() + b" "


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_codes(data: bytes) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of bytes; two zero bytes end a text and stand for what a short gram lacks."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    three = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return three


ORDERS = (0xFFFFFF, 0xFFFF00, 0xFF0000)


@lru_cache(maxsize=1)
def _table(vocabulary: bytes) -> np.ndarray:
    codes = np.frombuffer(vocabulary, np.int32)
    kind = np.int16 if len(codes) < 1 << 15 else np.int32
    table = np.full(1 << 24, -1, kind)
    table[codes] = np.arange(len(codes), dtype=kind)
    return table


def presence(texts: list[bytes], vocabulary: bytes) -> np.ndarray:
    """0/1 matrix: which grams of the vocabulary each text has."""
    table, width = _table(vocabulary), len(vocabulary) // 4
    out = np.zeros((len(texts), width), np.float32)
    flat = out.reshape(-1)
    codes = gram_codes(b"".join(t + b"\0\0" for t in texts))
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * width, [len(t) + 2 for t in texts])[: len(codes)]
    for mask in ORDERS:
        at = table[codes & mask]
        ok = at >= 0
        flat[row[ok] + at[ok]] = 1
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    vocabulary: bytes
    landmarks: np.ndarray
    weights: np.ndarray
    #: texts that score less cannot be placed
    min_score: float = 0.0

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Normalised presence kernel between rows of ``x`` and the landmarks: shared grams over the root of both counts."""
        own = np.sqrt(np.maximum(x.sum(1), 1))
        other = np.sqrt(np.maximum(self.landmarks.sum(1), 1))
        return (x @ self.landmarks.T) / (own[:, None] * other[None, :])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.kernel(presence(texts, self.vocabulary)) @ self.weights


def fit(texts: list[bytes], labels: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model | None:
    """Kernel ridge regression in the span of the landmarks, the first texts of each language in the given order."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    chosen = [i for lang in languages for i in [k for k, x in enumerate(labels) if x == lang][:landmarks_per_language]]
    codes = np.unique(np.concatenate([gram_codes(texts[i] + b"\0\0")[:, None] & np.array(ORDERS, np.int32) for i in chosen]))
    vocabulary = codes.astype(np.int32).tobytes()
    model = Model(languages, vocabulary, presence([texts[i] for i in chosen], vocabulary), np.zeros((len(chosen), len(languages)), np.float32))
    k = np.concatenate([model.kernel(presence(texts[i : i + BLOCK_TEXTS], vocabulary)) for i in range(0, len(texts), BLOCK_TEXTS)]).astype(np.float64)
    kzz = k[chosen]
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    w = np.linalg.solve(k.T @ k + ridge * len(texts) * (kzz + 1e-6 * np.eye(len(chosen))), k.T @ y)
    return Model(languages, vocabulary, model.landmarks, w.astype(np.float32))


def calibrated_minimum(texts: list[bytes], labels: list[str]) -> float:
    """The least score that a labelled text gets from a model of the other folds, at most ``UNCLAIMED``."""
    least = UNCLAIMED
    for held in range(FOLDS):
        rest = [i for i in range(len(texts)) if i % FOLDS != held]
        model = fit([texts[i] for i in rest], [labels[i] for i in rest])
        part = [t for t in texts[held::FOLDS] if len(t) >= JUDGED_BYTES]
        for at in range(0, len(part) if model else 0, BLOCK_TEXTS):
            least = min(least, float((model.scores(part[at : at + BLOCK_TEXTS]).max(1).min() + 1) / 2))
    return max(0.0, least)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, calibrate: bool = False, most_chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit on a bounded sample: of each language the ``per_language`` rows of at most ``most_chars`` whose hashed id is smallest.

    Spark limits each language within a task before it shuffles; the shuffled rows hold no text.  Of rows that repeat an id
    and a language one text is taken, so what reaches the driver stays within the bound.  Null ids, languages and texts and
    texts without a letter teach nothing; nothing to learn from gives None.  ``calibrate`` also sets the model's
    ``min_score`` from folds of the sample held out in turn.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= most_chars))
    order = Window.partitionBy(lang_col).orderBy(F.xxhash64(F.lit(11), id_col), id_col)
    picked = usable.select(id_col, lang_col).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_language)
    ids = F.broadcast(picked.groupBy(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")).agg(F.min("__n").alias("__n")))
    found = usable.join(ids, (F.col(id_col) == F.col("__id")) & (F.col(lang_col) == F.col("__lang")))
    rows = found.groupBy(lang_col, "__n").agg(F.min(text_col).alias("__text")).select(lang_col, "__text", "__n").collect()
    rows = sorted((r for r in rows if has_letter(r[1])), key=lambda r: (r[0], r[2], r[1]))
    texts, labels = [normalised(r[1]) for r in rows], [r[0] for r in rows]
    model = fit(texts, labels)
    return replace(model, min_score=calibrated_minimum(texts, labels)) if model and calibrate else model


def _judged(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    while todo:
        block, size = [], 0
        while todo and len(block) < BLOCK_TEXTS and size < BLOCK_BYTES:
            i = todo.pop()
            block.append((i, normalised(texts[i])))
            size += len(block[-1][1])
        s = model.scores([t for _, t in block])
        best = s.argmax(1)
        for (i, _), k, v in zip(block, best, s):
            lang[i], score[i] = model.languages[k], float(min(1.0, max(0.0, (v[k] + 1) / 2)))
    return lang, score


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): score is the winning regression value mapped from [-1, 1] to [0, 1].

    Null texts and texts without a letter are ``und`` with score 0; so is all without a model (nothing labelled).
    Whole texts are read, however long; ties go to the first language in order; repeated rows get the same answer;
    other columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in pieces_of(batches):
            lang, score = _judged(b.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def filter_language(docs: DataFrame, model: Model | None, text_col: str = "text", languages: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (all columns) without the rows that are ``und``, score less than the model's ``min_score`` (unless they are
    shorter than JUDGED_BYTES) or, if given, are outside ``languages``.  Without a model nothing can be told apart: rows with a letter stay."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in pieces_of(batches):
            texts = b.column(text_col).to_pylist()
            if model is None:
                keep = [has_letter(t) for t in texts]
            else:
                keep = [x != UNDETERMINED and (v >= model.min_score or len(normalised(t)) < JUDGED_BYTES) and (languages is None or x in languages) for t, x, v in zip(texts, *_judged(texts, model))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
