"""Batched screening by an external model that the caller injects. Without one nothing is decided.

A verdict is the set of kept ids, and None means that there is none: rows of such a batch are
neither kept nor dropped (`kept` is null), so the caller holds them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazelark import fixed
from gazelark.functions import predicates as P
from gazelark.functions import text as X


def no_judge(batch: list[dict]) -> None:
    raise NotImplementedError("no model was given; pass judge=")


def screened(rows: DataFrame, judge: Callable[[list[dict]], set | None], size: int = 25, id_column: str = "ord") -> DataFrame:
    """rows with boolean `kept` (null: no verdict), `size` rows a call; only a partition's last call has fewer."""
    schema = T.StructType([*rows.schema, T.StructField("kept", T.BooleanType())])

    def run(frames):
        import pandas as pd

        def judged(part):
            verdict = judge(part.to_dict("records"))
            kept = [None] * len(part) if verdict is None else [i in verdict for i in part[id_column]]
            return part.assign(kept=pd.array(kept, dtype="boolean"))

        rest = None  # less than a call's rows, for the frame to come
        for frame in frames:
            rest = frame if rest is None or rest.empty else pd.concat([rest, frame], ignore_index=True)
            whole = len(rest) // size * size
            for a in range(0, whole, size):
                yield judged(rest.iloc[a : a + size])
            rest = rest.iloc[whole:]
        if rest is not None and len(rest):
            yield judged(rest)

    return rows.mapInPandas(run, schema)


def rescued(near: DataFrame, judge: Callable[[list[dict]], set | None], calls_left: int, least: int = 6, reserve: int = 20) -> DataFrame:
    """Near misses that the judge keeps, as major gifts; nothing while calls are scarce or rows few."""
    if calls_left <= reserve or near.limit(least).count() < least:
        return near.where(F.lit(False)).withColumn("stream", F.lit("major_gift"))
    return screened(near, judge).where("kept").drop("kept").withColumn("stream", F.lit("major_gift"))


EVENT = "source int, title string, date string, place string, scale string, kind string, notable string, newsworthy boolean, why string"
#: What a model may say of an event.
SCALES = ["national", "regional", "local", "online"]
KINDS = ["conference", "gala", "festival", "exhibition", "webinar", "mission", "award", "lecture", "other"]


def model_events(pages: DataFrame, extract: Callable[[list[dict]], list[dict] | None], today: Column, size: int = 10, calls: int | None = None, horizon: int = fixed.HORIZON_DAYS) -> DataFrame:
    """url, org, sig, read, events of pages(url, org, sector, text, sig): a model reads `size` pages a call.

    extract gets the pages of a batch and returns events (EVENT; `source` is the page's place in the
    batch), or None without a verdict: then, and beyond `calls` calls a run, `read` is false, so that
    the page is read another time. Events without a title, of another page, or out of the horizon go;
    scales and kinds that aren't known are empty. Batches are numbered over all pages, in the order of
    urls, and a batch is one group, so a lost executor repeats its own calls only.
    """
    from gazelark.operators.rank import batch_index

    kind = T._parse_datatype_string(EVENT)
    names = [f.name for f in kind]
    batched = batch_index(pages.select("url", "org", "sector", "text", "sig"), size, ["url", "sig"])
    within = batched if calls is None else batched.where(F.col("batch") < calls)

    def read(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["url", "sig"]).reset_index(drop=True)
        found = extract(pdf[["url", "org", "sector", "text"]].to_dict("records"))
        per_page: list[list[dict]] = [[] for _ in range(len(pdf))]
        for x in found or []:
            if isinstance(x.get("source"), int) and 0 <= x["source"] < len(pdf) and x.get("title") and x.get("date"):
                per_page[x["source"]].append({n: x.get(n) if n in ("source", "newsworthy") else str(x.get(n) or "") for n in names} | {"newsworthy": bool(x.get("newsworthy"))})
        return pd.DataFrame({"url": pdf["url"], "org": pdf["org"], "sig": pdf["sig"], "read": found is not None, "raw": [json.dumps(e) for e in per_page]})

    answers = within.groupBy("batch").applyInPandas(read, "url string, org string, sig string, read boolean, raw string")
    if calls is not None:
        unread = batched.where(F.col("batch") >= calls).select("url", "org", "sig", F.lit(False).alias("read"), F.lit("[]").alias("raw"))
        answers = answers.unionByName(unread)
    parsed = F.from_json("raw", f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in kind)}>>")

    def event(e: Column) -> Column:
        known = lambda c, values: F.when(c.isin(values), c).otherwise("")
        return F.struct(
            X.parse_date(e["date"]).alias("date"), X.truncate(e["title"], 180).alias("title"), X.truncate(e["place"], 80).alias("place"), F.col("url").alias("url"), F.lit("model").alias("how"), F.lit("model").alias("confidence"),
            known(e["scale"], SCALES).alias("scale"), known(e["kind"], KINDS).alias("kind"), e["notable"].alias("notable"), e["newsworthy"].alias("newsworthy"), e["why"].alias("why"), F.when(e["newsworthy"], 6).otherwise(0).alias("news_score"),
        )

    live = F.filter(F.transform(parsed, event), lambda e: F.coalesce(P.in_horizon(e["date"], today, horizon), F.lit(False)))
    return answers.select("url", "org", "sig", "read", live.alias("events"))


class Quota:
    """Calls a day, counted only when they succeed; a new UTC date starts anew."""

    def __init__(self, cap: int, today: str, used: int = 0, ledger_date: str | None = None):
        self.cap, self.today = cap, today
        self.used = used if ledger_date in (None, today) else 0

    @property
    def left(self) -> int:
        return max(0, self.cap - self.used)

    def spend(self, call: Callable[[], object]) -> object | None:
        """The call's result, or None without a call when none is left."""
        if not self.left:
            return None
        out = call()
        self.used += 1
        return out
