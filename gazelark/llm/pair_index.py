"""BPE encoding and decoding by a pair occurrence index.

The words of a slice of a partition that were not met before are laid end to end as symbols. An
index maps each mergeable pair to all its positions there. The ranks that have positions are
applied in ascending order: every position of a rank is merged, and the lists of the pairs that
a merge makes are extended; positions that an earlier merge has used up are recognised by their
symbols and passed over. So each merge costs a constant, in words of any length, and a word is
merged once however often it stands in the slice. Applying a rank to all words at once is right
where no merge uses a symbol before the rank that makes it, which is checked when a tokenizer
is loaded.

Normalisation and the cut into words are the tokenizer file's own. Words met, and the chunks between
blanks that they stand in, are remembered up to REMEMBERED_CHARS; then all are forgotten and met anew.

Edge cases: a null or empty text has no ids and decodes to an empty text; texts and words of any
length are encoded whole; the strings of special tokens inside a text are those tokens, as the
tokenizer has it; repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from itertools import chain

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark.llm.tables import map_texts, read

TOKENIZER = "word_bpe_49k.json"
REMEMBERED_CHARS = 4_000_000  # of words and chunks met in a Python worker, beside which their ids stand
SLICE_CHARS = 2_000_000  # so that many new words go through the index together
_BLANKS = re.compile("[\n\t\r]")  # with the blank, white space of which no word holds any; nothing composes across it
#: Characters below U+0300, where nothing composes and all tables agree, but for white space and the controls that only some count as such.
_PLAIN = re.compile("[\x00-\x08\x0e-\x1b\x21-\x84\x86-\x9f\xa1-\u02ff]*")
#: Byte-level BPE's characters of bytes: printable ones are themselves, the others follow from U+0100 in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {chr(b): b for b in _PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}


class Merges:
    """Ranked merges of symbols: (left, right) -> rank, and what each rank makes."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        """pairs in the order of their ranks; made: the symbol that each becomes."""
        self.rank = {pair: r for r, pair in enumerate(pairs)}
        self.pairs, self.made = pairs, made
        self.size = 1 + max(chain(made, *pairs), default=0)
        keys = np.array([a * self.size + b for a, b in pairs] or [-1], np.int64)
        self.key_ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_ranks]
        last = {s: r for r, s in enumerate(made)}
        early = [r for r, pair in enumerate(pairs) for s in pair if last.get(s, -1) >= r]
        if early or len(self.rank) < len(pairs):
            raise ValueError(f"ranks can't be applied to all words at once: a merge before its parts, or twice ({early[:3]})")

    def _positions(self, symbols: np.ndarray) -> dict[int, list[int]]:
        """rank -> all positions of its pair."""
        keys = symbols[:-1] * self.size + symbols[1:]
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = np.flatnonzero((self.keys[slot] == keys) & (symbols[:-1] >= 0) & (symbols[1:] >= 0))
        ranks = self.key_ranks[slot[at]]
        order = np.argsort(ranks, kind="stable")
        found, first = np.unique(ranks[order], return_index=True)
        return {r: places.tolist() for r, places in zip(found.tolist(), np.split(at[order], first[1:]))}

    def apply(self, words: list[list[int]]) -> list[tuple[int, ...]]:
        """The symbols of each word after all merges."""
        symbols: list[int] = []
        starts = []
        for word in words:
            starts.append(len(symbols))
            symbols += word
            symbols.append(-1)  # in no pair, so nothing is merged across words
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, index = self.rank.get, self._positions(np.array(symbols, np.int64))
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            (left, right), new = self.pairs[rank], self.made[rank]
            places = index.pop(rank)
            places.sort()  # equal symbols in a row are merged from the left
            for at in places:
                if symbols[at] != left:
                    continue
                gone = after[at]
                if symbols[gone] != right:
                    continue
                symbols[at], symbols[gone] = new, -2
                following, previous = after[gone], before[at]
                after[at] = following
                before[following] = at
                found = rank_of((symbols[previous], new))
                if found is not None:
                    if found in index:
                        index[found].append(previous)
                    else:
                        index[found] = [previous]
                        heapq.heappush(active, found)
                found = rank_of((new, symbols[following]))
                if found is not None:
                    if found in index:
                        index[found].append(at)
                    else:
                        index[found] = [at]
                        heapq.heappush(active, found)
        return [tuple([s for s in symbols[a : a + len(word)] if s >= 0]) for a, word in zip(starts, words)]


class Encoder:
    """A tokenizer file's ids: its normaliser and cut into words, and the merges by the index."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model["unk_token"] or model["dropout"] or model["byte_fallback"] or model["continuing_subword_prefix"] or model["ignore_merges"]:
            raise ValueError(f"not a plain BPE tokenizer: {path}")
        tokenizer = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        split = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(self.vocabulary[a], self.vocabulary[b]) for a, b in split], [self.vocabulary[a + b] for a, b in split])
        characters = {b: c for c, b in BYTES.items()}
        self.inner = [self.vocabulary.get(characters[b]) for b in range(256)]
        self.final = [self.vocabulary.get(characters[b] + self.suffix) for b in range(256)]
        self.pattern = self._plain_pattern(tokenizer)
        self.normalise, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        added = tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"special tokens that reach into their surroundings: {path}")
        self.special = {t.content: i for i, t in added.items()}
        if any(c.isspace() for s in self.special for c in s):
            raise ValueError(f"special tokens with white space: {path}")
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings: list[str] = [""] * (1 + max(chain(self.vocabulary.values(), self.special.values())))
        for s, i in chain(self.vocabulary.items(), self.special.items()):
            self.strings[i] = s
        self.joined = (lambda ids: " ".join(ids)) if tokenizer.decoder is None else tokenizer.decoder.decode
        self._forget()

    @staticmethod
    def _plain_pattern(tokenizer) -> regex.Pattern | None:
        """The file's pattern of words for plain characters, where it lower-cases and keeps what the
        pattern matches. Line ends, which separate chunks, are matched as well."""
        own = json.loads(tokenizer.to_str())
        steps, cuts = own["normalizer"].get("normalizers", []), own["pre_tokenizer"].get("pretokenizers", [])
        split = cuts[0] if cuts else {}
        known = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        if not known or not split["invert"] or split["behavior"] != "Removed" or "Regex" not in split["pattern"] or steps[1]["content"] != " ":
            return None
        return regex.compile(f"{split['pattern']['Regex']}|\n")

    def _forget(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {s: (i,) for s, i in self.special.items()}
        self.chunks: dict[str, tuple[int, ...]] = {"": ()}  # tuples of numbers cost the collector nothing
        self.known_chars = 0

    def _cut_chunk(self, chunk: str) -> list[str]:
        """Its words, by the tokenizer's own steps; a special token stands alone."""
        parts = self.special_pattern.split(chunk) if self.special_pattern else [chunk]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif part:
                out += [bytes(map(BYTES.__getitem__, w)).decode() for w, _ in self.cut(self.normalise(part))]
        return out

    def cut_chunks(self, chunks: list[str]) -> dict[str, list[str]]:
        """chunk -> its words. Chunks of plain characters are cut together."""
        plain = [c for c in chunks if _PLAIN.fullmatch(c) and not (self.special_pattern and self.special_pattern.search(c))] if self.pattern else []
        out: dict[str, list[str]] = {}
        if plain:
            flat = self.pattern.findall("\n".join(plain).lower())
            ends = [i for i, w in enumerate(flat) if w == "\n"]
            for chunk, a, b in zip(plain, [-1, *ends], [*ends, len(flat)]):
                out[chunk] = flat[a + 1 : b]
        for chunk in chunks:
            if chunk not in out:
                out[chunk] = self._cut_chunk(chunk)
        return out

    def _letters(self, word: str) -> list[int]:
        raw = word.encode()
        found = [*map(self.inner.__getitem__, raw[:-1]), self.final[raw[-1]]]
        return found if None not in found else [i for i in found if i is not None]

    def __call__(self, texts: list[str | None]) -> list[list[int]]:
        cut = [_BLANKS.sub(" ", t).split(" ") if t else [] for t in texts]
        new = self.cut_chunks(list(set(chain.from_iterable(cut)).difference(self.chunks)))
        words = list(set(chain.from_iterable(new.values())).difference(self.words))
        self.words.update(zip(words, self.merges.apply([self._letters(w) for w in words])))
        for chunk, own in new.items():
            self.chunks[chunk] = tuple(chain.from_iterable(map(self.words.__getitem__, own))) if len(own) != 1 else self.words[own[0]]
        out = [list(chain.from_iterable(map(self.chunks.__getitem__, own))) for own in cut]
        self.known_chars += sum(map(len, words)) + sum(map(len, new))
        if self.known_chars > REMEMBERED_CHARS:
            self._forget()
        return out

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer decodes, with its special tokens: without a decoder, blanks between the tokens."""
        return self.joined([self.strings[i] for i in ids])


_encoders: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """One for each tokenizer file and Python worker. name: a public tokenizer's name or a path."""
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(name if os.sep in name else public_tokenizers.path(name))
    return _encoders[name]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """key, ids: the ids of each text."""
    return map_texts(docs, key, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], lambda texts: [encoder(tokenizer)(texts)], SLICE_CHARS)


def decode(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """key, text of rows (key, ids); null ids decode to an empty text."""
    schema = T.StructType([tokens.select(key).schema[0], T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            texts = [encoder(tokenizer).decode(own or []) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0].type), pa.array(texts, kinds[1].type)], schema=kinds)

    return tokens.select(key, ids).mapInArrow(run, schema)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """key, ids, decoded: the ids of each text and the text that they decode to, in one pass."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def compute(texts: list[str | None]) -> list[list]:
        own = encoder(tokenizer)
        ids = own(texts)
        return [ids, [own.decode(i) for i in ids]]

    return map_texts(docs, key, text, fields, compute, SLICE_CHARS)


def digest(ids: Column) -> Column:
    return F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded, as digests."""
    both = round_trip(read(spark, sf_dir, "documents"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
