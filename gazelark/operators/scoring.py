"""Scoring, admission and routing of items, as column expressions over a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazelark import fixed
from gazelark.functions import predicates as P
from gazelark.functions import text as X
from gazelark.lexicon import Axis, Lexicon, Stream, term_pattern


def _plain(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("’"), F.lit("'"))


def _names(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in pairs])) if pairs else F.array().cast("array<string>")


def _whole(title: Column, body: Column) -> Column:
    return F.concat_ws(" ", _plain(title), _plain(body))


def byline_bypass(author: Column, lexicon: Lexicon) -> Column:
    """The first listed byline within the author, or null."""
    low = F.lower(F.coalesce(author, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(b)), F.lit(b)) for b in lexicon.bylines]) if lexicon.bylines else F.lit(None).cast("string")


def _hits(lexicon: Lexicon, title: Column, headline: Column, text: Column) -> dict[str, Column]:
    """What patterns find, by name: each axis in the text and in the headline, money, and the veto."""
    veto = F.coalesce(
        F.nullif(F.regexp_extract(headline, term_pattern(lexicon.noise), 0), F.lit("")),
        F.when(P.short_title_veto(title), F.lit("short headline")),
        F.when(P.question_veto(title), F.lit("question headline")),
    )
    out = {"_gz_money": text.rlike("(?i)" + lexicon.money), "_gz_veto": veto}
    for s in lexicon.streams:
        for a in s.axes:
            out[f"_gz_{s.name}_{a.name}"] = text.rlike(a.pattern)
            out[f"_gz_{s.name}_{a.name}_title"] = headline.rlike(a.pattern)
    return out


def _found(lexicon: Lexicon, title: Column, body: Column) -> tuple[list[str], Column]:
    """Names, and a struct of _hits and of each stream's veto of promises; the texts are made once a row."""
    texts = F.struct(_plain(title).alias("headline"), _whole(title, body).alias("text"))
    names = list(_hits(lexicon, title, title, title))
    promises = {s.name: a for s in lexicon.streams for a in s.axes if a.name == s.promise_axis and lexicon.promises}

    def hits(t: Column) -> Column:
        return F.struct(t["text"].alias("text"), *[c.alias(name) for name, c in _hits(lexicon, title, t["headline"], t["text"]).items()])

    def promised(h: Column, stream: str, axis: Axis) -> Column:
        giving = F.regexp_extract_all(h["text"], F.lit(axis.pattern), F.lit(0))
        only = F.forall(giving, lambda g: g.rlike(term_pattern(lexicon.promises)))
        return F.when(h[f"_gz_{stream}_{axis.name}"] & ~h["_gz_money"], F.when(only, F.lit("promise without a figure")))

    def whole(h: Column) -> Column:
        return F.struct(*[h[name].alias(name) for name in names], *[promised(h, s, a).alias(f"_gz_{s}_promised") for s, a in promises.items()])

    return [*names, *[f"_gz_{s}_promised" for s in promises]], X.let(X.let(texts, hits), whole)


def _verdict(stream: Stream, lexicon: Lexicon, author: Column, known: dict[str, Column]) -> dict[str, Column]:
    """The fields of a verdict that admission goes by, from what _found gives."""
    money, veto = known["_gz_money"], known["_gz_veto"]
    hits = [(a, known[f"_gz_{stream.name}_{a.name}"]) for a in stream.axes]
    score = sum((F.when(hit, a.points).otherwise(0) for a, hit in hits), F.when(money, lexicon.money_points).otherwise(0))
    axes = F.concat(_names([(a.name, hit) for a, hit in hits]), F.when(money, F.array(F.lit("money"))).otherwise(F.array().cast("array<string>")))
    title_axes = _names([(a.name, known[f"_gz_{stream.name}_{a.name}_title"]) for a in stream.axes])
    none = F.array().cast("array<string>")
    return {
        "score": F.when(veto.isNull(), score).otherwise(0),
        "axes": F.when(veto.isNull(), axes).otherwise(none),
        "title_axes": F.when(veto.isNull(), title_axes).otherwise(none),
        "vetoed": F.coalesce(veto, known.get(f"_gz_{stream.name}_promised", F.lit(None).cast("string"))),
        "bypass": F.when(veto.isNull(), byline_bypass(author, lexicon)),
    }


def score_stream(stream: Stream, lexicon: Lexicon, title: Column, body: Column, author: Column, known: dict[str, Column] | None = None) -> Column:
    """struct(score, axes, title_axes, matched, vetoed, bypass). A veto leaves nothing else.

    known: what _found gives, computed already.
    """
    if known is None:
        names, found = _found(lexicon, title, body)
        return X.let(found, lambda h: score_stream(stream, lexicon, title, body, author, {name: h[name] for name in names}))
    v = _verdict(stream, lexicon, author, known)
    none = F.array().cast("array<string>")
    some = lambda t: F.concat(*[F.slice(F.regexp_extract_all(t, F.lit(a.pattern), F.lit(0)), 1, 3) for a in stream.axes])
    matched = F.slice(F.array_distinct(F.transform(X.let(_whole(title, body), some), lambda m: F.lower(F.trim(m)))), 1, 6) if stream.axes else none
    v = {"score": v["score"], "axes": v["axes"], "title_axes": v["title_axes"], "matched": F.when(known["_gz_veto"].isNull(), matched).otherwise(none), "vetoed": v["vetoed"], "bypass": v["bypass"]}
    return F.struct(*[c.alias(name) for name, c in v.items()])


def admits_stream(stream: Stream, verdict: Column | dict[str, Column], source_threshold: Column) -> Column:
    """Not vetoed, and by byline or by anchors, title axes, companions and the threshold, the
    source's own if it has one, raised where the relevance axis is missing."""
    names = lambda values: F.array(*[F.lit(v) for v in values])
    threshold = F.coalesce(source_threshold, F.lit(stream.threshold))
    if stream.relevance_axis and stream.threshold_off_axis:
        off = ~F.array_contains(verdict["axes"], stream.relevance_axis)
        threshold = F.when(off, F.greatest(threshold, F.lit(stream.threshold_off_axis))).otherwise(threshold)
    ok = verdict["score"] >= threshold
    if stream.anchors:
        ok = ok & F.arrays_overlap(verdict["title_axes"], names(stream.anchors))
    if stream.companions:
        ok = ok & F.arrays_overlap(verdict["axes"], names(stream.companions))
    if stream.min_title_axes:
        ok = ok & (F.size(verdict["title_axes"]) >= stream.min_title_axes)
    return verdict["vetoed"].isNull() & (verdict["bypass"].isNotNull() | ok)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the input has too few partitions for work that is mostly matching."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def route(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """items with a verdict struct for each stream, named after it, and `stream`, the first that admits, or null.

    What the patterns find is generated as columns, through which no filter is pushed: each pattern
    is matched once a row whatever is asked of the outcome, and verdicts that nobody reads cost nothing.
    """
    title, body, author = F.col("title"), F.col("body"), F.col("author")
    names, found = _found(lexicon, title, body)
    known = {name: F.col(name) for name in names}
    first = F.coalesce(*[F.when(admits_stream(s, _verdict(s, lexicon, author, known), F.col("threshold")), F.lit(s.name)) for s in lexicon.streams])
    out = spread(items).select("*", F.inline(F.array(found)))
    return out.select(*items.columns, *[score_stream(s, lexicon, title, body, author, known).alias(s.name) for s in lexicon.streams], first.alias("stream"))


def scored(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """items with a verdict struct for each stream, named after it."""
    return route(items, lexicon).drop("stream")


def loose_gate(lexicon: Lexicon, stream: Column) -> Column:
    """The lenient gate: any verdict without a veto that scores, or a byline; sources' thresholds
    don't count. Kept for comparison; route() is what admits."""
    first = lexicon.streams[0]
    later = F.lit(False)
    for s in lexicon.streams[1:]:
        later = later | (stream == s.name)
    v = F.col(first.name)
    return F.coalesce(later, F.lit(False)) | (v["vetoed"].isNull() & (v["bypass"].isNotNull() | (v["score"] > 0)))


def near_misses(routed: DataFrame, lexicon: Lexicon, axes: tuple[str, ...] = ("giving", "giving_topic"), limit: int = 25) -> DataFrame:
    """Items that no stream admits, without a veto and with a giving axis; the best `limit`."""
    v = F.col(lexicon.streams[0].name)
    hit = F.arrays_overlap(v["axes"], F.array(*[F.lit(a) for a in axes]))
    return routed.where(F.col("stream").isNull() & v["vetoed"].isNull() & hit).orderBy(v["score"].desc(), "ord").limit(limit)


def explain_score(routed: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row for each item and stream: score, threshold, axes, matches, anchor and veto."""
    rows = F.array(
        *[
            F.struct(F.lit(s.name).alias("of"), F.lit(s.threshold).alias("needs"), F.col(s.name).alias("verdict"), F.array_join(F.array_intersect(F.col(s.name)["title_axes"], F.array(*[F.lit(a) for a in s.anchors]).cast("array<string>")), ",").alias("anchor"))
            for s in lexicon.streams
        ]
    )
    return routed.select("url", F.explode(rows).alias("x")).select("url", "x.of", "x.needs", "x.verdict.score", F.array_join("x.verdict.axes", ",").alias("axes"), F.array_join("x.verdict.matched", ",").alias("matched"), "x.anchor", "x.verdict.vetoed")


def newsworthy(title: Column, sector: Column) -> Column:
    """Points of an event: 0 for local programmes; size, notable names, length, sector and yearly words add up."""
    score = (
        F.when(title.rlike(fixed.BIG_EVENT), 3).otherwise(0)
        + F.when(title.rlike(fixed.NOTABLE_EVENT), 1).otherwise(0)
        + F.when(F.size(F.split(X.collapse(title), " ")) >= 4, 1).otherwise(0)
        + F.when(F.coalesce(sector, F.lit("")).isin(fixed.EVENT_SECTORS), 2).otherwise(0)
        + F.when(title.rlike(fixed.YEARLY_EVENT), 1).otherwise(0)
    )
    return F.when(title.rlike(fixed.LOCAL_EVENT), 0).otherwise(score)


def model_news_score(newsworthy_flag: Column) -> Column:
    return F.when(newsworthy_flag, 6).otherwise(0)


def gift_bucket(known: Column, hint: Column, outlet_hint: Column, amount: Column) -> Column:
    a, b, c, d = fixed.GIFT_BUCKETS
    return F.when(known, a).when(hint | outlet_hint, b).when(amount >= fixed.LARGE_GIFT, c).otherwise(d)


def judged_bucket(known: Column, angle: Column, buckets: list[str] = fixed.JUDGED_BUCKETS) -> Column:
    """A gift's bucket by a model's verdict: whose angle it has (donor, recipient, both, unclear, or
    another). buckets: the names for a known person, donor, recipient or both, unclear, and the rest."""
    person, donor, recipient, unclear, rest = buckets
    return F.when(known, person).when(angle == "donor", donor).when(angle.isin("recipient", "both"), recipient).when(F.coalesce(angle, F.lit("unclear")) == "unclear", unclear).otherwise(rest)


def bucket_rank(bucket: Column, order: list[str]) -> Column:
    out = None
    for i, name in enumerate(order):
        out = F.when(bucket == name, i) if out is None else out.when(bucket == name, i)
    return out.otherwise(len(order))


#: Lengths of the runs of characters by which names are met.
RUNS = (3, 6, 12, 24)


def known_people(items: DataFrame, people: DataFrame, most: int = 3) -> DataFrame:
    """items with known_person: up to three names of the dimension anywhere within the title, by name.

    Names are met by a run of their characters, then verified, so neither side is multiplied with the
    other: of the lengths in RUNS, the longest that fits, and of the name's runs of it the one which
    the fewest names hold. So names that all begin alike or have a number's digits in common are met
    by what is their own. Titles are cut into runs of those lengths only that names are met by.
    Names of fewer than three characters don't count. Both sides are shuffled: names may be many.
    """
    def runs(c: Column, n: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))

    fitting = F.lit(RUNS[0])
    for n in RUNS[1:]:
        fitting = F.when(F.length("person") >= n, n).otherwise(fitting)
    names = people.select(F.lower("name").alias("person")).where(F.length("person") >= RUNS[0]).distinct()
    split = names.select("person", F.explode(runs(F.col("person"), fitting)).alias("part"))
    names = split.join(split.groupBy("part").count().hint("merge"), "part").groupBy("person").agg(F.min(F.struct("count", "part"))["part"].alias("part"))
    lengths = [r["n"] for r in names.select(F.length("part").alias("n")).distinct().collect()]  # four at most
    if not lengths:
        return items.withColumn("known_person", F.array().cast("array<string>"))
    low = F.lower(F.coalesce("title", F.lit("")))
    cut = F.concat(*[F.when(F.length(low) >= n, runs(low, F.lit(n))).otherwise(F.array().cast("array<string>")) for n in lengths])
    hits = items.select("ord", low.alias("low"), F.explode(cut).alias("part")).join(names.hint("merge"), "part").where(F.contains("low", "person"))
    found = hits.groupBy("ord").agg(F.slice(F.array_sort(F.collect_set("person")), 1, most).alias("known_person"))
    return items.join(found.hint("merge"), "ord", "left").withColumn("known_person", F.coalesce("known_person", F.array().cast("array<string>")))


def event_phase(start: Column, end: Column, today: Column) -> Column:
    """opens, continues or concludes today; null otherwise."""
    return F.when(start == today, "opens").when(end == today, "concludes").when((start < today) & (end > today), "continues")


def rule_fallback(title: Column) -> Column:
    """Sections without a model: not-gifts go, gifts and events stay."""
    return F.when(title.rlike(fixed.NOT_GIFT), F.lit(None).cast("string")).when(title.rlike(fixed.GIFT_LANG), "major_gift").when(title.rlike(fixed.CONVENED), "watching")
