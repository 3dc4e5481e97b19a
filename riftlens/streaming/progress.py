"""Progress events as a stream: folding them to a state per key, in batch and in Structured Streaming.

Events: (key, seq, kind, files, id, chapter).  ``static``, ``clustering``, ``clusters`` and ``final`` set the phase,
``reviewed`` notes a chapter for an id, other kinds change nothing.  Within a key the sequence number decides, so events
may come in any order and more than once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: the phase that an event of a kind sets
PHASES = {"static": "static", "clustering": "clustering", "clusters": "review", "final": "final"}


def _phase():
    p = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, phase in PHASES.items():
        p = p.when(F.col("kind") == kind, phase)
    return p


def fold(events: DataFrame) -> DataFrame:
    """The state of each key after all its events: phase, files, reviewed (number of ids noted)."""
    e = events.withColumn("__phase", _phase())
    return e.groupBy("key").agg(F.max_by("__phase", F.when(F.col("__phase").isNotNull(), F.col("seq"))).alias("phase"), F.max_by("files", F.when((F.col("kind") == "static") & F.col("files").isNotNull(), F.col("seq"))).alias("files"), F.count_distinct(F.when(F.col("kind") == "reviewed", F.col("id"))).alias("reviewed"))


def chapters(events: DataFrame) -> DataFrame:
    """The last noted chapter of each id: key, id, chapter."""
    return events.where("kind = 'reviewed'").groupBy("key", "id").agg(F.coalesce(F.max_by("chapter", "seq"), F.lit("")).alias("chapter"))


def stream_fold(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same state as a streaming aggregate (complete or update mode); ``at`` is the event time.

    The ids that a key has noted are kept as a set in the aggregate's state, so repeated events count once.
    """
    e = events.withWatermark("at", late).withColumn("__phase", _phase())
    return e.groupBy("key").agg(F.max_by("__phase", F.when(F.col("__phase").isNotNull(), F.col("seq"))).alias("phase"), F.max_by("files", F.when((F.col("kind") == "static") & F.col("files").isNotNull(), F.col("seq"))).alias("files"), F.size(F.collect_set(F.when(F.col("kind") == "reviewed", F.col("id")))).cast("long").alias("reviewed"))


def newest_only(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results of the highest request number of each key; answers to older requests are stale."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "request_no").alias("r")).select(*keys, "r.*")


def fold_verdicts(actions: DataFrame) -> DataFrame:
    """(session, card_id) that stand as passed after pass, unpass and undo actions in order of ``seq``.

    An undo takes back the last pass of the session's history and clears that card's verdict only.
    """
    kind = actions.schema["session"].dataType.simpleString()

    def replay(block: pd.DataFrame) -> pd.DataFrame:
        state = Session([])
        for action, card in block.sort_values("seq", kind="stable")[["kind", "card_id"]].itertuples(index=False, name=None):
            state.act(action, card)
        return pd.DataFrame({"session": pd.Series([block["session"].iloc[0]] * len(state.passed), dtype="object"), "card_id": pd.Series(list(state.passed), dtype="object")})

    return actions.groupBy("session").applyInPandas(replay, f"session {kind}, card_id string")


# fixed value: how many steps back a session keeps
HISTORY = 100


class Session:
    """What one reader's actions make of a list of cards: place, history, passes, threads read and settled."""

    def __init__(self, cards: list[str]):
        self.cards, self.at, self.screen = cards, 0, "review"
        self.back: list[int] = []
        self.passes: list[str] = []
        self.passed: dict[str, None] = {}
        self.unread: dict[str, None] = {}
        self.resolved: dict[str, None] = {}

    def go(self, to: int) -> None:
        to = max(0, min(len(self.cards) - 1, to))
        if to != self.at:
            self.back = [*self.back, self.at][-HISTORY:]
        self.at = to

    def forward(self) -> None:
        if self.at >= len(self.cards) - 1:
            self.screen = "summary"
        else:
            self.go(self.at + 1)

    def act(self, kind: str, target: str | None = None) -> None:
        """One action; ``target`` is a card, a thread or a place in the list, as the action takes it.  Unknown ones change nothing."""
        here = self.cards[self.at] if self.cards else None
        if kind == "pass" and (card := target or here):
            self.passes.append(card)
            self.passed[card] = None
            self.forward()
        elif kind == "unpass" and (card := target or here):
            self.passed.pop(card, None)
            self.passes = [c for c in self.passes if c != card]
        elif kind == "undo" and self.passes:
            card = self.passes.pop()
            self.passed.pop(card, None)
            if card in self.cards:
                self.go(self.cards.index(card))
        elif kind == "next":
            self.forward()
        elif kind == "prev" and self.at > 0:
            self.go(self.at - 1)
        elif kind == "goto" and target is not None:
            self.go(int(target))
        elif kind == "back" and self.back:
            self.at = max(0, min(len(self.cards) - 1, self.back.pop()))
        elif kind == "answered" and target:
            self.unread.setdefault(target)
        elif kind == "read" and target:
            self.unread.pop(target, None)
        elif kind == "resolve" and target:
            if target in self.resolved:
                del self.resolved[target]
            else:
                self.resolved[target] = None


SESSION = "at int, screen string, back array<int>, passed array<string>, unread array<string>, resolved array<string>"


def fold_sessions(actions: DataFrame, cards: DataFrame) -> DataFrame:
    """The state of each session after its actions (session, seq, kind, target) over its cards (session, pos, card_id).

    Sessions are folded side by side; one session is what one reader did, so it fits into a task.
    """
    kind = actions.schema["session"].dataType.simpleString()

    def replay(done: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        state = Session(listed.sort_values("pos", kind="stable")["card_id"].tolist())
        for action, target in done.sort_values("seq", kind="stable")[["kind", "target"]].itertuples(index=False, name=None):
            state.act(action, target)
        key = (done if len(done) else listed)["session"].iloc[0]
        row = (key, state.at, state.screen, state.back, sorted(state.passed), sorted(state.unread), sorted(state.resolved))
        return pd.DataFrame([row], columns=["session", "at", "screen", "back", "passed", "unread", "resolved"])

    return actions.groupBy("session").cogroup(cards.groupBy("session")).applyInPandas(replay, f"session {kind}, {SESSION}")


def emitted(files: DataFrame, clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """The events that an analysis of each key sends, in order: key, seq, kind, files, id, chapter.

    ``files`` has key and files, ``clusters`` key, pos, cluster_id, ``labels`` key, cluster_id, title, done_at.  First the
    count of files, then the clustering and its clusters, a reviewed event for each label in the order of completion, last
    the end; what the labels are gathered to does not depend on that order.
    """
    none, no_files = F.lit(None).cast("string"), F.lit(None).cast("int")
    step = lambda df, n, kind, files, name, chapter, at: df.select("key", F.lit(n).alias("__n"), at.alias("__at"), F.lit(kind).alias("kind"), files.alias("files"), name.alias("id"), chapter.alias("chapter"))
    first = F.lit(0).cast("long")
    every = files.select("key", "files")
    events = step(every, 0, "static", F.col("files").cast("int"), none, none, first)
    events = events.unionByName(step(every, 1, "clustering", no_files, none, none, first))
    events = events.unionByName(step(clusters.select("key").distinct(), 2, "clusters", no_files, none, none, first))
    said = labels.join(clusters.select("key", "cluster_id"), ["key", "cluster_id"], "left_semi")
    events = events.unionByName(step(said, 3, "reviewed", no_files, F.col("cluster_id"), F.col("title"), F.col("done_at").cast("long")))
    events = events.unionByName(step(every, 4, "final", no_files, none, none, first))
    w = Window.partitionBy("key").orderBy("__n", "__at", "id")
    return events.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).select("key", "seq", "kind", "files", "id", "chapter")


def gathered(results: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """What parallel calls return, in the fixed order of their requests whatever order they came in: keys, values.

    ``results`` has one row for each call; of repeated answers to one request the first in value counts, so a call that was
    made again after a lost executor changes nothing.
    """
    once = results.groupBy(*keys, *order).agg(F.min(value).alias("__v"))
    row = F.struct(*order, "__v")
    return once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["__v"]).alias("values"))
