"""Searches of people: cleaning of the event log, sittings, outcomes and experiments.

One actor may have a third of all events. Sittings are therefore cut in two steps: events are ordered within
(actor, time bucket), and only the first and last event of each bucket are ordered per actor, so no task holds an actor's whole history.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.arrow import map_columns
from granary.functions.numeric import wilson
from granary.operators.inference import poisson_weights
from granary.operators.ranks import quantiles
from granary.session import keep

# Signs of robots in an agent's name, question words, the look of a name, and outcomes that count as failures.
ROBOT_SIGNS = ("bot", "crawl", "spider", "scrap", "curl", "wget", "python-requests", "postman", "monitor", "uptime", "headless")
QUESTION = r"(?i)\?$|^(?:how|what|why|when|where|which|can|is|are|does|do|comment|wie|c[oó]mo|hoe|wat)(?:[^\p{L}\p{N}_]|$)"
NAME = r"(?:^|\s)[A-ZÀ-Þ0-9][A-ZÀ-Þ0-9_\-.]{2,}(?:\s|$)"
FAILURES = ("zero", "reformulated", "repeat", "page_2")
GAP, FOLLOW, OVERLAP = 1800, 120, 0.2


def micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a time in any ISO form, without zone taken as UTC; null for what is none."""
    return F.unix_micros(stamp.try_cast("timestamp"))


def clean_events(events: DataFrame) -> DataFrame:
    """(event_no, t, actor, query, lang, results, page, arm, latency, agent, source): each delivered event once, the one loaded last.

    ``actor`` is a pseudonym of the user, else of the address; ``query`` the words in lower case; events without a readable time are left out. Events delivered
    twice are reduced before the shuffle. Equal load times fall by the row's other columns.
    """
    c = F.col
    rows = events.select(
        "event_no", micros(c("ts")).alias("t"), T.person_key(c("user_uuid"), c("ip")).alias("actor"), F.array_join(T.words(c("original_query")), " ").alias("query"),
        F.coalesce("original_query", F.lit("")).alias("raw"), F.coalesce("detected_lang", F.lit("unknown")).alias("lang"), F.coalesce("results_count", F.lit(0)).cast("long").alias("results"),
        F.coalesce("page", F.lit(1)).cast("long").alias("page"), F.nullif(F.trim("experiment_arm"), F.lit("")).alias("arm"), c("latency_ms").cast("long").alias("latency"),
        F.coalesce("user_agent", F.lit("")).alias("agent"), F.coalesce("search_source", F.lit("")).alias("source"), c("loaded_at").alias("loaded"),
    )
    fields = [f for f in rows.columns if f not in ("event_no", "loaded")]
    last = rows.groupBy("event_no").agg(F.max(F.struct("loaded", *fields)).alias("e"))
    return last.select("event_no", *[F.col(f"e.{f}").alias(f) for f in fields]).where("t IS NOT NULL")


ROBOTS = f"(?i){'|'.join(ROBOT_SIGNS)}"


def by_people(events: DataFrame) -> DataFrame:
    """Events of known actors whose agent is no robot."""
    return events.where(~F.regexp_like("agent", F.lit(ROBOTS)) & (F.col("actor") != ""))


def typed_by_people(events: DataFrame, least_chars: int = 3, most_chars: int = 120) -> DataFrame:
    """Searches whose text a person may have typed: of a usual length, with a letter, by an agent that is no robot."""
    asked = F.trim("raw")
    return events.where(F.length(asked).between(least_chars, most_chars) & F.regexp_like(asked, F.lit(r"\p{L}")) & ~F.regexp_like("agent", F.lit(ROBOTS)))


def span_days(events: DataFrame) -> DataFrame:
    """One row: days between the first and the last event."""
    return events.agg(((F.max("t") - F.min("t")) / 86_400_000_000).alias("days"))


def with_neighbours(events: DataFrame, payload: str = "query", bucket_seconds: int = 21_600) -> DataFrame:
    """Adds prev_t, next_t and next_payload of the same actor, in the order of (t, event_no)."""
    rows = events.withColumn("b", F.floor(F.col("t") / (bucket_seconds * 1_000_000)))
    here = Window.partitionBy("actor", "b").orderBy("t", "event_no")
    point = F.struct("t", "event_no", F.col(payload).alias("payload"))
    rows = rows.withColumns({"_before": F.lag("t").over(here), "_after": F.lead(point).over(here)})
    edges = rows.groupBy("actor", "b").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    along = Window.partitionBy("actor").orderBy("b")  # one row per bucket
    edges = edges.select("actor", "b", F.lag("last").over(along)["t"].alias("_left"), F.lead("first").over(along).alias("_right"))
    out = rows.join(edges, ["actor", "b"])
    after = F.coalesce("_after", "_right")
    return out.select(*events.columns, "b", F.coalesce("_before", "_left").alias("prev_t"), after["t"].alias("next_t"), after["payload"].alias("next_payload"))


def sittings(events: DataFrame, gap_seconds: int = GAP, bucket_seconds: int = 21_600) -> DataFrame:
    """Events with session_start: a sitting ends where the next event is more than the gap away; exactly the gap goes on."""
    rows = with_neighbours(events, bucket_seconds=bucket_seconds)
    opens = F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") > gap_seconds * 1_000_000)
    rows = rows.withColumn("_open", F.when(opens, F.col("t")))
    here = Window.partitionBy("actor", "b").orderBy("t", "event_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last("_open", ignorenulls=True).over(here))
    along = Window.partitionBy("actor").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("actor", "b").agg(F.max("_open").alias("o")).select("actor", "b", F.last("o", ignorenulls=True).over(along).alias("_carried"))
    out = rows.join(carried, ["actor", "b"])
    return out.select(*events.columns, "prev_t", "next_t", "next_payload", F.coalesce("_in", "_carried").alias("session_start"))


def sessions(events: DataFrame, gap_seconds: int = GAP) -> DataFrame:
    """(actor, session_start, session_end, n_events)."""
    cut = sittings(events, gap_seconds)
    return cut.groupBy("actor", "session_start").agg(F.max("t").alias("session_end"), F.count("*").alias("n_events"))


def outcomes(events: DataFrame, gap_seconds: int = GAP, follow_seconds: int = FOLLOW, overlap: float = OVERLAP) -> DataFrame:
    """Events with ``outcome``, inferred from the next event of the sitting, and ``seconds_to_next``.

    zero: nothing found; repeat: the same query within the follow window; reformulated: another that shares words; switched: one that
    shares none; settled: nothing follows; page_2: settled beyond the first page.
    """
    rows = with_neighbours(events)
    gap = (F.col("next_t") - F.col("t")) / 1e6
    gap = F.when(gap <= gap_seconds, gap)
    mine, theirs = (F.filter(F.split(c, " "), lambda w: w != "") for c in ("query", "next_payload"))
    soon = gap <= follow_seconds
    settled = F.when(F.col("page") > 1, "page_2").otherwise("settled")
    outcome = (
        F.when(F.col("results") == 0, "zero").when(soon & (F.col("query") == F.col("next_payload")), "repeat").when(soon & (T.jaccard(mine, theirs) >= overlap), "reformulated").when(soon, "switched").otherwise(settled)
    )
    return rows.select(*events.columns, outcome.alias("outcome"), gap.alias("seconds_to_next"))


def shape(query: Column) -> Column:
    """question, entity/name or topical phrase, by the words as typed."""
    return F.when(F.regexp_like(query, F.lit(QUESTION)), "question").when(F.regexp_like(query, F.lit(NAME)), "entity/name").otherwise("topical phrase")


def failure_rates(labelled: DataFrame, key: Column, least: int = 1) -> DataFrame:
    """(key, n, failures, rate, low, high) with Wilson bounds, for keys with at least ``least`` searches."""
    sums = labelled.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(F.col("outcome").isin(*FAILURES).cast("long")).alias("failures")).where(F.col("n") >= least)
    low, high = wilson(F.col("failures"), F.col("n"))
    return sums.select("key", "n", "failures", (F.col("failures") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def in_one_arm(labelled: DataFrame) -> DataFrame:
    """Searches with an arm, of actors that were in that arm alone."""
    rows = labelled.where("arm IS NOT NULL")
    crossed = rows.groupBy("actor").agg(F.min("arm").alias("a"), F.max("arm").alias("z")).where("a <> z").select("actor")
    return rows.join(crossed, "actor", "left_anti")


def arm_summary(labelled: DataFrame) -> DataFrame:
    """(arm, actors, searches, failures, rate, share, low, high): the share of the actors with its Wilson bounds."""
    per_actor = in_one_arm(labelled).groupBy("arm", "actor").agg(F.count("*").alias("n"), F.sum(F.col("outcome").isin(*FAILURES).cast("long")).alias("f"))
    arms = per_actor.groupBy("arm").agg(F.count("*").alias("actors"), F.sum("n").alias("searches"), F.sum("f").alias("failures"))
    total = arms.agg(F.sum("actors").alias("total"))
    low, high = wilson(F.col("actors"), F.col("total"))
    return arms.crossJoin(F.broadcast(total)).select(  # the total is one row
        "arm", "actors", "searches", "failures", (F.col("failures") / F.col("searches")).alias("rate"), (F.col("actors") / F.col("total")).alias("share"), low.alias("low"), high.alias("high")
    )


def cluster_bootstrap(labelled: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(arm, rate, low, high, rounds): failure rates with intervals that resample people, not searches.

    Every actor draws a Poisson(1) weight per round from a hash of its key, so that no actor list is gathered: each batch adds up
    ``rounds`` weighted sums per arm, and only these vectors are shuffled.
    """
    per_actor = keep(in_one_arm(labelled).groupBy("arm", "actor").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("outcome").isin(*FAILURES).cast("double")).alias("f")))
    keyed = per_actor.select("arm", F.xxhash64("actor", F.lit(seed)).alias("h"), "n", "f")

    def make():
        def work(arms, hashes, n, f):
            sums: dict[str, np.ndarray] = {}
            values, names = np.array([n, f]), np.array(arms, object)
            for at, weights in poisson_weights(hashes, rounds):
                for a in sorted(set(arms[at])):
                    mine = names[at] == a
                    sums[a] = sums.get(a, 0.0) + values[:, at][:, mine] @ weights[mine]
            return [*zip(*[(a, r, s[0, r], s[1, r]) for a, s in sums.items() for r in range(rounds)])] or [[]] * 4

        return work

    sums = map_columns(keyed, make, "arm string, r int, n double, f double").groupBy("arm", "r").agg((F.sum("f") / F.nullif(F.sum("n"), F.lit(0.0))).alias("rate"))
    seen = per_actor.groupBy("arm").agg((F.sum("f") / F.sum("n")).alias("rate"))
    spread = quantiles(sums, "rate", ["arm"], {"low": 0.025, "high": 0.975}).withColumnRenamed("n", "rounds")
    return seen.join(spread, "arm")
