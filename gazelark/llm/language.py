"""Language identification with string kernels.

A text's presence set holds its distinct letter n-grams of one to three characters (a blended
spectrum), hashed to COORDINATES places; the kernel of two texts is the size of their sets'
intersection over the geometric mean of their sizes. So that the places never fill up, a text of more
than PIECE characters is cut into pieces, which overlap by all but one character of the longest
n-gram, and its kernel is the mean of theirs, weighted by their lengths; where such a text is
learned from, its piece of most places stands for it. LANDMARKS learned texts give a Nystroem map
K(x, landmarks) K(landmarks, landmarks)^-1/2, on which one ridge regression for each language is
fitted against the rest; a text is scored by two matrix products.

Learning reads text and language only, of at most SAMPLE_BUCKETS documents a language (those with
the least hash in their bucket). lang, source and doc_id don't enter a prediction.

Edge cases: a null text or one without letters is `und` with score 0; texts of any length are
read whole; with no labelled documents every text is `und`, and the stage keeps every text with
letters; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored; a null doc_id is not held out
and not learned from.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.llm.tables import map_texts, read

COORDINATES = 1 << 14
ORDERS = 3
PIECE = 2048
SAMPLE_BUCKETS = 400
LANDMARKS = 96
RIDGE = 1e-2
SHARPNESS = 4.0
LEAST_KNOWN = 0.25
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> itself where it is a letter (general category L), else a blank."""
    if not _letters:
        points = np.arange(0x110000, dtype=np.uint32)
        is_letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
        _letters.append(np.where(is_letter, points, 32).astype(np.uint32))
    return _letters[0]


def presence(texts: list[str | None]) -> list[np.ndarray | None]:
    """The sorted places of each text's n-grams; None without letters."""
    fold = _fold()
    lowered = ["", *[(t or "").lower() for t in texts]]  # a blank before the first as before the others
    raw = np.frombuffer(" ".join(lowered).encode("utf-32-le", "surrogatepass") + b" \0\0\0", np.uint32)
    code = fold[np.minimum(raw, 0x10FFFF)]
    blank = code == 32
    keep = ~(blank & np.concatenate([[False], blank[:-1]]))
    before = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum([len(t) + 1 for t in lowered])
    limits = before[ends]
    c = code[keep].astype(np.uint64)
    shift = np.uint64(64 - COORDINATES.bit_length() + 1)
    grams, rolled = [], np.zeros(len(c), np.uint64)
    for n in range(ORDERS):
        rolled = (rolled[: len(c) - n] + c[n:] + np.uint64(1)) * _MIX
        rolled ^= rolled >> np.uint64(29)
        grams.append(((rolled * _MIX) >> shift).astype(np.int64))
    out: list[np.ndarray | None] = []
    seen = np.zeros(COORDINATES, bool)
    for a, b in zip(limits[:-1], limits[1:]):
        own = c[a:b]
        if not len(own) or int(own.max()) == 32:
            out.append(None)
            continue
        seen[:] = False
        for n, g in enumerate(grams):
            seen[g[a : max(a, b - n)]] = True
        out.append(np.flatnonzero(seen))
    return out


def pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All pieces of all texts, and the number of the text that each is of."""
    step = PIECE - (ORDERS - 1)
    parts, owners = [], []
    for i, text in enumerate(texts):
        text = text or ""
        own = [text] if len(text) <= PIECE else [text[a : a + PIECE] for a in range(0, len(text) - (ORDERS - 1), step)]
        parts += own
        owners += [i] * len(own)
    return parts, np.array(owners, np.int64)


def richest(texts: list[str | None]) -> list[np.ndarray | None]:
    """The places of each text's piece of most places, the first of equal ones; None without letters."""
    parts, owners = pieces(texts)
    best: list[np.ndarray | None] = [None] * len(texts)
    for i, own in zip(owners.tolist(), presence(parts)):
        if own is not None and (best[i] is None or len(own) > len(best[i])):
            best[i] = own
    return best


def _rows(sets: list[np.ndarray]) -> np.ndarray:
    """Presence vectors of unit length."""
    x = np.zeros((len(sets), COORDINATES), np.float32)
    for row, places in zip(x, sets):
        row[places] = 1 / np.sqrt(max(1, len(places)))
    return x


class Model:
    """Landmarks' presence vectors and the regressions' weights on kernel values."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.landmarks, self.weights, self.bias = languages, landmarks, weights, bias

    @staticmethod
    def fit(sets: list[np.ndarray], labels: list[str]) -> Model:
        languages = sorted(set(labels))
        examples = [[i for i, own in enumerate(labels) if own == name] for name in languages]
        order = [own[k] for k in range(max(map(len, examples))) for own in examples if k < len(own)]  # landmarks go round the languages
        x = _rows([sets[i] for i in order])
        y = np.array([languages.index(labels[i]) for i in order])
        landmarks = x[:LANDMARKS]
        values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
        mapped = (x @ landmarks.T).astype(np.float64) @ root
        target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
        # every language weighs the same, however often it was sampled
        weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y][:, None]
        ones = np.hstack([mapped, np.ones((len(y), 1))])
        solved = np.linalg.solve(ones.T @ (ones * weight) + RIDGE * len(y) / 100 * np.eye(ones.shape[1]), ones.T @ (target * weight))
        return Model(languages, landmarks, (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))

    def predict(self, texts: list[str | None]) -> list[list]:
        """[languages, scores in 0 to 1, how well known the n-grams are].

        The last is the share of the text's n-grams that a landmark has, from 0 where it is what
        n-grams by chance would give, to 1 where it is all; null without letters.
        """
        names, scores, known = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        parts, owners = pieces(texts)
        sets = presence(parts)
        lettered = np.array([i for i, s in enumerate(sets) if s is not None], np.int64)
        if not len(lettered):
            return [names, scores, known]
        if not self.languages:
            for i in owners[lettered].tolist():
                known[i] = 1.0
            return [names, scores, known]
        held = (self.landmarks > 0).any(axis=0)
        chance = min(float(held.mean()), 0.99)
        kernels = np.vstack([_rows([sets[i] for i in lettered[a : a + 256]]) @ self.landmarks.T for a in range(0, len(lettered), 256)])
        values = kernels @ self.weights + self.bias
        firsts = np.flatnonzero(np.diff(owners[lettered], prepend=-1))
        lengths = np.array([len(parts[i]) for i in lettered], np.float32)
        counts = np.diff(np.append(firsts, len(lettered)))
        lengths /= np.repeat(np.add.reduceat(lengths, firsts), counts)
        values = np.add.reduceat(values * lengths[:, None], firsts)
        familiar = np.add.reduceat(np.array([float(held[sets[i]].mean()) for i in lettered]) * lengths, firsts)
        shares = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)).astype(np.float64))
        shares /= shares.sum(axis=1, keepdims=True)
        for i, row, k, f in zip(owners[lettered][firsts].tolist(), shares, values.argmax(axis=1), familiar):
            names[i], scores[i] = self.languages[k], float(row[k])
            known[i] = max(0.0, (float(f) - chance) / (1 - chance))
        return [names, scores, known]


def sample(docs: DataFrame, buckets: int = SAMPLE_BUCKETS) -> DataFrame:
    """doc_id of at most `buckets` documents a language that may be learned from."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    mixed = F.xxhash64("doc_id")
    return usable.groupBy("lang", F.pmod(mixed, F.lit(buckets)).alias("bucket")).agg(F.min_by("doc_id", mixed).alias("doc_id")).select("doc_id", "lang")


def fit(docs: DataFrame) -> Model:
    """A model from the documents' sample; only packed presence sets reach the driver."""
    chosen = sample(docs)
    learned = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    packed = map_texts(
        learned.select(F.struct("doc_id", "lang").alias("own"), "text"), "own", "text",
        [T.StructField("packed", T.BinaryType())],
        lambda texts: [[None if s is None else np.packbits(np.isin(np.arange(COORDINATES), s)).tobytes() for s in richest(texts)]],
    )
    rows = sorted({(r["own"]["doc_id"], r["own"]["lang"], bytes(r["packed"])) for r in packed.where("packed IS NOT NULL").collect()})
    if not rows:
        return Model([], np.zeros((0, COORDINATES), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    return Model.fit([np.flatnonzero(np.unpackbits(np.frombuffer(r[2], np.uint8))) for r in rows], [r[1] for r in rows])


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType())]


def predictions(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, known. The model, of a size fixed by LANDMARKS and COORDINATES, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, key, text, FIELDS, lambda texts: shared.value.predict(texts))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = read(spark, sf_dir, "documents")
    out = predictions(docs, fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as they are, but those without letters and those in no language that was learned:
    their n-grams are hardly better known (LEAST_KNOWN) than by chance, however many languages there are."""
    model = fit(docs)
    scored = predictions(docs.select(F.struct(*docs.columns).alias("row")), model, "row", "row.text")
    return scored.where(F.col("known") >= LEAST_KNOWN).select("row.*")
