"""SentencePiece-style encoding and decoding: N-best segmentations over the lattice of pieces.

A forward Viterbi pass gives the best score of every prefix; a backward A* search from the end
takes these scores as its heuristic, which is exact, so it reaches the start with the best
segmentation first, then the second best, and so on. A place is left at most N times, as none of
the N best can need it more often, and equal totals go on from the place nearest the start, so
the work is linear in the text also where very many segmentations score the same.

The public vocabulary holds merge ranks, no probabilities; a piece's score here is its log
probability under Zipf's law on that rank, rounded to a multiple of 2**-24, so that sums are exact
and equal scores are equal, in whatever order they were added. Text gets a blank in front, blanks belong to pieces
like other characters, and a character that no piece is gets its UTF-8 bytes as byte pieces, so
that decoding gives the text back exactly.

Two neighbouring characters that stand together in no piece are a certain boundary: the lattice
falls apart there, and the parts between boundaries are looked up. New parts of a batch go through
Viterbi together, forward for the scores and backward for the margin of the second best; only the
parts with the least margins can differ among a text's N best, and A* runs on these.

Edge cases: a null or empty text has no pieces, score 0 and one segmentation; texts of any length
are encoded whole; of equal scores, the one with the longer last piece (then the one before it,
and so on) is the best; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.llm.tables import map_texts, read

MODEL = "piece_bpe_32k.model"
N_BEST = 4
CACHE_ENTRIES = 200_000
SLICE_CHARS = 2_000_000  # so that many new parts go through the batch together
LONGEST_TOGETHER = 24  # characters of a part that goes through the batch
_BASE = np.uint64(0x9E3779B97F4A7C15)


def exact(score: float) -> float:
    """The nearest multiple of 2**-24: sums of such numbers up to 2**29 have no rounding error."""
    return float(round(float(score) * 2**24)) / 2**24


class Vocabulary:
    """Pieces (with blanks as blanks), their scores, byte pieces and the certain boundaries."""

    def __init__(self, pieces: list[str | None], scores: list[float], byte_ids: list[int]):
        """pieces: None where an id stands for no text; byte_ids: the ids of the 256 byte pieces."""
        self.ids = {p: i for i, p in enumerate(pieces) if p}
        self.scores = np.array(scores)
        self.byte_ids = byte_ids
        self.byte_score = float(min(scores[i] for i in self.ids.values())) - 1.0
        self.longest = max(map(len, self.ids))
        self.texts = [(p or "").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.texts[i] = bytes([b])
        characters = sorted(set("".join(self.ids)))
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        size = len(characters) + 1
        self.together = np.zeros((size, size), bool)
        for p in self.ids:
            c = self.classes[[ord(x) for x in p]]
            self.together[c[:-1], c[1:]] = True
        self._hash_table()

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        own = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        total = np.log(sum(1 / r for r in range(1, len(own) + 1)))
        scores, pieces = [0.0] * n, [None] * n
        for rank, i in enumerate(sorted(own, key=lambda i: (-model.get_score(i), i)), 1):
            scores[i] = exact(-np.log(rank) - total)
            pieces[i] = model.id_to_piece(i).replace("▁", " ")
        return Vocabulary(pieces, scores, [byte_ids[b] for b in range(256)])

    def _hash_table(self) -> None:
        """Piece hash -> id, in two tables without collisions."""
        hashes = np.array([self._hash(p) for p in self.ids], np.uint64)
        ids = np.array(list(self.ids.values()), np.int32)
        self.bits = max(8, int(len(ids)).bit_length() + 4)
        self.tables = []
        for level in range(8):
            slot = self._slots(hashes, level)
            _, first = np.unique(slot, return_index=True)
            keys, values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            keys[slot[first]], values[slot[first]] = hashes[first], ids[first]
            self.tables.append((keys, values))
            left = np.ones(len(ids), bool)
            left[first] = False
            hashes, ids = hashes[left], ids[left]
            if not len(ids):
                return
        raise ValueError("pieces with equal hashes")

    def _slots(self, hashes: np.ndarray, level: int) -> np.ndarray:
        return ((hashes * np.uint64(0xBF58476D1CE4E5B9 + 2 * level * 0x632BE59BD9B4E019 & (2**64 - 1) | 1)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * int(_BASE) + int(self.classes[ord(c)]) * 0x94D049BB133111EB + 1) % 2**64
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of piece hashes; -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        for level, (keys, values) in enumerate(self.tables):
            slot = self._slots(hashes, level)
            np.copyto(out, values[slot], where=keys[slot] == hashes)
        return out

    # --- one part ---

    def edges(self, text: str, end: int) -> list[tuple[int, float, list[int]]]:
        """(start, score, ids) of the lattice's edges into `end`, the longest first."""
        out = []
        for start in range(max(0, end - self.longest), end):
            i = self.ids.get(text[start:end])
            if i is not None:
                out.append((start, float(self.scores[i]), [i]))
        if not out or out[-1][0] != end - 1:
            raw = text[end - 1].encode("utf-8", "surrogatepass")
            out.append((end - 1, self.byte_score * len(raw), [self.byte_ids[b] for b in raw]))
        return out

    def viterbi(self, text: str) -> list[float]:
        """The best score of every prefix."""
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max(best[start] + score for start, score, _ in self.edges(text, end)))
        return best

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids), best first: backward A* on the forward scores."""
        best = self.viterbi(text)
        # total score, place, number (no two are equal), score from the place to the end, pieces from there
        heap: list[tuple] = [(-best[-1], len(text), 0, 0.0, None)]
        out, pushed, left = [], 1, [0] * (len(text) + 1)
        while heap and len(out) < n:
            total, end, _, after, path = heapq.heappop(heap)
            if end == 0:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((-total, ids))
                continue
            left[end] += 1
            if left[end] > n:
                continue
            for start, score, ids in self.edges(text, end):
                heapq.heappush(heap, (-(best[start] + (score + after)), start, pushed, score + after, (ids, path)))
                pushed += 1
        return out

    # --- many parts of one length ---

    def together_best(self, texts: list[str]) -> list[tuple[bytes, float, float]]:
        """(ids as 16-bit bytes, score, margin of the second best) of texts of equal length."""
        m, n = len(texts), len(texts[0])
        c = self.classes[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].reshape(m, n).T.astype(np.uint64)
        step = c * np.uint64(0x94D049BB133111EB) + np.uint64(1)
        ids: dict[tuple[int, int], np.ndarray] = {}
        scores: dict[tuple[int, int], np.ndarray] = {}
        rolled = np.zeros((n, m), np.uint64)
        for length in range(1, min(n, self.longest) + 1):
            rolled = rolled[: n - length + 1] * _BASE + step[length - 1 :]
            found = self.find(rolled)
            value = np.where(found >= 0, self.scores[found], -np.inf)
            for start in range(n - length + 1):
                ids[start, start + length], scores[start, start + length] = found[start], value[start]
        odd = np.zeros(m, bool)
        for at in range(n):
            odd |= ids[at, at + 1] < 0
        forward, back = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int64)
        forward[0] = 0.0
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                total = forward[start] + scores[start, end]
                better = total > forward[end]
                np.copyto(forward[end], total, where=better)
                np.copyto(back[end], start, where=better)
        behind = np.full((n + 1, m), -np.inf)
        behind[n] = 0.0
        for start in range(n - 1, -1, -1):
            for end in range(start + 1, min(n, start + self.longest) + 1):
                np.maximum(behind[start], scores[start, end] + behind[end], out=behind[start])
        taken = np.full((n + 1, m), -1, np.int64)  # start of the best path's edge into each end
        at = np.full(m, n)
        rows = np.arange(m)
        path = np.full((n, m), -1, np.int64)
        for k in range(n - 1, -1, -1):
            live = at > 0
            start = back[at, rows]
            taken[at[live], rows[live]] = start[live]
            at = np.where(live, start, 0)
        second = np.full(m, -np.inf)
        for (start, end), value in scores.items():
            on = taken[end] == start
            path[start] = np.where(on, ids[start, end], path[start])
            np.maximum(second, np.where(on, -np.inf, forward[start] + value + behind[end]), out=second)
        with np.errstate(invalid="ignore"):
            margin = np.maximum(forward[n] - second, 0.0)
        flat = path.T
        counts = (flat >= 0).sum(axis=1)
        raw = flat[flat >= 0].astype("<u2").tobytes()
        ends = np.cumsum(counts) * 2
        out = []
        for i, (end, count, best, gap, strange) in enumerate(zip(ends.tolist(), counts.tolist(), forward[n].tolist(), margin.tolist(), odd.tolist())):
            out.append(self.alone(texts[i]) if strange else (raw[end - 2 * count : end], best, gap))
        return out

    def alone(self, text: str) -> tuple[bytes, float, float]:
        found = self.n_best(text, 2)
        return np.array(found[0][1], "<u2").tobytes(), found[0][0], found[0][0] - found[1][0] if len(found) > 1 else float("inf")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))


class Encoder:
    """N-best encoding of texts, with bounded tables of parts seen before."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.others: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}  # of a part in the columns below
        self.ids: list[bytes] = []
        self.scores, self.margins = np.empty(1024), np.empty(1024)

    def cut(self, text: str) -> list[str]:
        v = self.vocabulary
        c = v.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = (np.flatnonzero(~v.together[c[:-1], c[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]

    def _add(self, parts: list[str], found: list[tuple[bytes, float, float]]) -> None:
        start, end = len(self.ids), len(self.ids) + len(parts)
        if end > len(self.scores):
            room = np.empty(2 * end - len(self.scores))
            self.scores, self.margins = np.concatenate([self.scores, room]), np.concatenate([self.margins, room])
        ids, self.scores[start:end], self.margins[start:end] = zip(*found)
        self.ids += ids
        self.places.update(zip(parts, range(start, end)))

    def _learn(self, new: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for p in new:
            by_length.setdefault(len(p), []).append(p)
        for length, own in sorted(by_length.items()):
            if length <= LONGEST_TOGETHER:
                for a in range(0, len(own), 20_000):
                    self._add(own[a : a + 20_000], self.vocabulary.together_best(own[a : a + 20_000]))
            else:
                self._add(own, [self.vocabulary.alone(p) for p in own])

    def __call__(self, texts: list[str | None], n: int) -> list[tuple[bytes, list[float], list[list[tuple[str, list[int]]]]]]:
        """For each text: ids of the best as 16-bit bytes, the scores of the n best, and each one's
        changes against the best: (part, ids in its place)."""
        cuts = [self.cut(" " + t) if t else [] for t in texts]
        needed = set(chain.from_iterable(cuts))
        new = needed - self.places.keys()
        if len(self.ids) + len(new) > CACHE_ENTRIES:
            self._forget()
            new = needed
        self._learn(new)
        out = []
        for parts in cuts:
            at = list(map(self.places.__getitem__, parts))
            ids = b"".join(map(self.ids.__getitem__, at))
            total, margins = float(self.scores[at].sum()), self.margins[at]
            ranked: list[tuple[float, list]] = [(0.0, [])]
            for k in np.argsort(margins, kind="stable")[: n - 1].tolist():
                if margins[k] == np.inf:
                    break
                options = self._alternatives(parts[k], n)
                more = [(gap + g, [*changes, (parts[k], own)]) for gap, changes in ranked for g, own in options]
                ranked = sorted(ranked + more, key=lambda x: x[0])[:n]
            out.append((ids, [total - gap for gap, _ in ranked], [changes for _, changes in ranked]))
        return out

    def _alternatives(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """(loss against the best, ids) of the second to the n-th best."""
        if (part, n) not in self.others:
            if len(self.others) > CACHE_ENTRIES // 8:
                self.others.clear()
            found = self.vocabulary.n_best(part, n)
            self.others[part, n] = [(found[0][0] - score, ids) for score, ids in found[1:]]
        return self.others[part, n]

    def decode(self, ids: bytes) -> str:
        """The text of a best segmentation's 16-bit ids."""
        return self.vocabulary.decode(np.frombuffer(ids, "<u2").tolist()).decode("utf-8", "surrogatepass")[1:]


_encoders: dict[str, Encoder] = {}


def encoder(model: str = MODEL) -> Encoder:
    """One for each model and Python worker. model: a public model's name or a path."""
    if model not in _encoders:
        import public_tokenizers

        _encoders[model] = Encoder(Vocabulary.load(model if "/" in model else public_tokenizers.path(model)))
    return _encoders[model]


FIELDS = [
    T.StructField("n_pieces", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("n_best_changed_pieces", T.LongType()),
    T.StructField("round_trip", T.BooleanType()),
]


def _digests(model: str, n: int):
    def compute(texts: list[str | None]) -> list[list]:
        own, rows = encoder(model), []
        for text, (ids, scores, changes) in zip(texts, own(texts, n)):
            text = text or ""
            back = (own.decode(ids) if ids else "") == text
            for part, other in chain.from_iterable(changes):
                back = back and own.vocabulary.decode(other) == part.encode("utf-8", "surrogatepass")
            rows.append((len(ids) // 2, zlib.crc32(ids), scores, sum(len(other) for _, other in chain.from_iterable(changes)), back))
        return [list(c) for c in zip(*rows)] if rows else [[] for _ in FIELDS]

    return compute


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """key, ids: the best segmentation of each text."""
    def compute(texts: list[str | None]) -> list[list]:
        return [[np.frombuffer(ids, "<u2").tolist() for ids, _, _ in encoder(model)(texts, 1)]]

    return map_texts(docs, key, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], compute, SLICE_CHARS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every text, and whether each decodes to the text."""
    out = map_texts(read(spark, sf_dir, "documents"), "doc_id", "text", FIELDS, _digests(MODEL, N_BEST), SLICE_CHARS)
    return out.withColumn("scores", F.array_join(F.transform("scores", lambda s: F.format_string("%.6f", s)), " "))
