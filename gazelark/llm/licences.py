"""Licence scan by a positional index of rare words.

Each template is posted under the two words of its key phrase that have the highest IDF (over all
documents), with their places in the notice. Either word's places in a text, less its place in the
notice, are starts of the notice, and the starts that both words give are the candidates; a template
stands where enough of its words and all words of its key phrase agree. As the key phrase must be
whole, no place is missed, however many notices a text holds. Everything is one projection over the
word array, without a shuffle but for the words' document counts.

Edge cases: a null or empty text has no words, no places, empty labels and score 0; texts of any
length are scanned whole; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazelark.llm.notices import templates
from gazelark.llm.tables import read

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that the base labels are defined by.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

TEMPLATES = templates()
LEAST_SHARE = 0.6
_SHIFT = 1000  # templates are shorter; starts before the text's first word stay positive


def words_of(text: Column) -> Column:
    """Lower-cased A-Z and split; the two letters that lower() would turn into ASCII go another way."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = F.when(text.contains("K") | text.contains("İ"), ascii_only).otherwise(F.lower(text))
    return F.array_remove(F.split(low, BREAK), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _templates() -> tuple[list[str], list[list[str]], list[tuple[int, int]]]:
    labels, words, keys = [], [], []
    for label, notice, key in TEMPLATES:
        w, k = notice.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        labels.append(label)
        words.append(w)
        keys.append((at, len(k)))
    return labels, words, keys


def vocabulary() -> list[str]:
    """The words of the key phrases."""
    return sorted({w for _, _, key in TEMPLATES for w in key.split()})


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, df: in how many documents each word of a key phrase stands."""
    held = F.array_intersect(words_of(F.col(text)), _strings(vocabulary()))
    return docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def scan(docs: DataFrame, counts: dict[str, int], text: str = "text", out: str = "licences") -> DataFrame:
    """docs with a column `out`: struct(n_words, base_starts, base_hits, found (label, start, share, key)).

    counts: document counts of the key phrases' words, a bounded vocabulary. Names that start with
    _gz_ are the operator's own; docs' other columns may have any.
    """
    labels, notices, keys = _templates()
    rarest = [sorted(range(at, at + n), key=lambda p: (counts.get(notices[t][p], 0), notices[t][p], p)) for t, (at, n) in enumerate(keys)]
    first, second = [r[0] for r in rarest], [r[min(1, len(r) - 1)] for r in rarest]
    anchors, others = (sorted({notices[t][p] for t, p in enumerate(ps)}) for ps in (first, second))
    texts = F.array(*[_strings(n) for n in notices])
    key_at = F.array(*[F.lit(at) for at, _ in keys])
    key_len = F.array(*[F.lit(n) for _, n in keys])
    words = F.col("_gz_words")
    places = F.sequence(F.lit(0), F.size(words) - 1)
    none = F.array().cast("array<int>")

    def base(phrase: str) -> Column:
        parts = phrase.split()

        def here(i: Column) -> Column:
            out = F.get(words, i) == parts[0]
            for k, p in enumerate(parts[1:], 1):
                out = out & F.coalesce(F.get(words, i + k) == p, F.lit(False))
            return out

        return F.when(F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1]), F.filter(places, here)).otherwise(none)

    def starts(vocabulary: list[str], posted: list[int]) -> Column:
        """Template and start, packed, for every place of every word that templates are posted under."""
        postings = {w: [t * _SHIFT + p for t, p in enumerate(posted) if notices[t][p] == w] for w in vocabulary}
        codes = F.create_map(*[x for w, ps in postings.items() for x in (F.lit(w), F.array(*[F.lit(p).cast("long") for p in ps]))])

        def of(w: Column) -> Column:
            at = F.filter(places, lambda i: F.get(words, i) == w)
            return F.flatten(F.transform(at, lambda i: F.transform(F.element_at(codes, w), lambda p: F.floor(p / _SHIFT) * F.lit(2**32) + i - p % _SHIFT + _SHIFT)))

        return F.flatten(F.transform(F.array_intersect(_strings(vocabulary), words), of))

    def verified(c: Column) -> Column:
        t, start = F.floor(c / 2**32).cast("int"), (c % F.lit(2**32)).cast("int") - _SHIFT
        notice = F.get(texts, t)

        def agree(offset: Column, n: Column) -> Column:
            return F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(F.when(start + offset + j >= 0, F.get(words, start + offset + j)) == F.get(notice, offset + j), F.lit(False))))

        return F.struct(
            F.get(_strings(labels), t).alias("label"),
            start.alias("start"),
            (agree(F.lit(0), F.size(notice)) / F.size(notice)).alias("share"),
            (agree(F.get(key_at, t), F.get(key_len, t)) == F.get(key_len, t)).alias("key"),
        )

    candidates = F.array_intersect(starts(anchors, first), starts(others, second))
    found = F.filter(F.transform(candidates, verified), lambda v: v["key"] & (v["share"] >= LEAST_SHARE))
    empty = F.array().cast("array<struct<label:string,start:int,share:double,key:boolean>>")
    cut = docs.withColumn("_gz_words", words_of(F.col(text)))
    cut = cut.withColumns({f"_gz_at_{k}": base(p) for k, p in enumerate(BASE.values())})
    hits = F.array_compact(F.array(*[F.when(F.size(f"_gz_at_{k}") > 0, F.lit(label)) for k, label in enumerate(BASE)]))
    whole = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.concat(*[F.col(f"_gz_at_{k}") for k in range(len(BASE))]).alias("base_starts"),
        hits.alias("base_hits"),
        F.when(F.arrays_overlap(words, _strings(anchors)) & F.arrays_overlap(words, _strings(others)), found).otherwise(empty).alias("found"),
    )
    return cut.withColumn(out, whole).drop("_gz_words", *[f"_gz_at_{k}" for k in range(len(BASE))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence places and labels of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = {r["word"]: r["df"] for r in document_counts(docs).collect()}  # at most the vocabulary's size
    found = scan(docs, counts)
    starts, hits, notices = F.col("licences.base_starts"), F.col("licences.base_hits"), F.col("licences.found")
    labels = F.array_sort(F.array_distinct(F.concat(hits, F.transform(notices, lambda v: v["label"]))))
    score = F.greatest(F.when(F.size(starts) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform(notices, lambda v: v["share"])), F.lit(0.0)))
    return found.select(
        "doc_id",
        "licences.n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(hits), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )


def _oracle() -> str:
    """By brute force: every place of every word of every key phrase starts a comparison of whole notices."""
    labels, notices, keys = _templates()
    rows = ", ".join(f"({t}, '{labels[t]}', {p}, '{w}', {'true' if keys[t][0] <= p < keys[t][0] + keys[t][1] else 'false'})" for t in range(len(labels)) for p, w in enumerate(notices[t]))
    base = " UNION ALL ".join(
        f"SELECT a.rid, a.p, '{label}' AS label FROM w a" + "".join(f" JOIN w w{k} ON w{k}.rid = a.rid AND w{k}.p = a.p + {k} AND w{k}.word = '{x}'" for k, x in enumerate(phrase.split()) if k) + f" WHERE a.word = '{phrase.split()[0]}'"
        for label, phrase in BASE.items()
    )
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(text, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM t),
w AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS p FROM d),
n(t, label, p, word, is_key) AS (VALUES {rows}),
c AS (SELECT DISTINCT w.rid, n.t, w.p - n.p AS start FROM w JOIN n USING (word) WHERE n.is_key),
v AS (SELECT c.rid, c.t, n.label, c.start, count(w.word) / count(*) AS share, bool_and(w.word IS NOT NULL OR NOT is_key) AS whole_key
  FROM c JOIN n ON n.t = c.t LEFT JOIN w ON w.rid = c.rid AND w.p = c.start + n.p AND w.word = n.word GROUP BY ALL),
f AS (SELECT * FROM v WHERE whole_key AND share >= {LEAST_SHARE}),
b AS ({base}),
bs AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION SELECT rid, label FROM f) GROUP BY rid),
m AS (SELECT rid, max(share) AS share FROM f GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(share, 0.0)::DOUBLE) AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN l USING (rid) LEFT JOIN m USING (rid)
"""


ORACLE_SQL = _oracle()
