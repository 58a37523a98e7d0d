"""Substring dedup by recompression.

Words of a text are symbols. Rounds shorten the text: runs of a repeated symbol become
one run symbol, then adjacent symbols merge to a pair symbol where a random bit of the
left one is 1 and of the right one 0. What a round does at a place depends on the
symbols beside it only, so equal stretches get equal symbols but for their margins:
after two rounds a pair symbol spans at most 4 words and depends on at most 3 words of
context at each side. Two equal windows of 13 words have equal symbols within their
middle 7 words, and where no run fills them at least one lies whole in there.

Each step is a Spark round over all documents: groups of documents send their distinct
things, Spark brings equal ones together, and answers go back for those that two
different documents share. A symbol's global name is a fingerprint of what it stands
for, so it is the same wherever Spark meets it.

1. Name: runs, pairs of words and whole texts. Those that two documents share keep
   their name; a run or pair without one occurs in one document only, so no window
   around it can repeat elsewhere, and nothing is built on it. A text that is a smaller
   doc_id's whole text again is settled here.
2. Reveal: pairs of named symbols merge once more; each window left picks the interior
   symbol with the smallest name, in its context. Spark tells which picks are shared.
3. Verify: windows with a shared pick are compared over all their words, by two
   unrelated names of the 13 words, of 64 and 32 bits; Spark finds the smallest doc_id of each.
4. Words in windows that a smaller doc_id has are removed.

So a window is removed only if its runs, pairs and pick are shared and all its words
agree, in a group of documents or across groups alike. Two different windows are taken
for one only where 96 bits agree.

Null or empty text has no words. A null doc_id, or one that is not a number, counts as
larger than any other. Rows that repeat a doc_id are the same document, so none precedes
the other. Texts shorter than a window stay as they are. A very long text is a group by
itself or with few others. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigil.llm import common, grouping

WINDOW = 13
CONTEXT = 3
INNER = WINDOW - 2 * CONTEXT
LONGEST = 4  # words of a pair symbol after both rounds
NONE = np.uint64(2**64 - 1)
RUN = np.uint64(0x52554E)
LAST = 2**63 - 1
WHOLE, SYMBOL, PICK, SAME = range(4)

ASKED = "x long, y long, grp long, lo long, span long"


def pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return common.mixed(common.mixed(left * common.ODD) + right)


class Symbols:
    """The symbols of a group's texts, in order: first word, name, whether it is a run, whether one document alone has it."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = len(words)
        same = np.zeros(n + 1, bool)
        same[1:-1] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        self.start = np.flatnonzero(~same[:-1])
        self.run = (same[:-1] | same[1:])[self.start]
        self.name = np.where(self.run, common.mixed(words[self.start] ^ RUN), words[self.start])
        self.dead = np.zeros(len(self.start), bool)
        self.words, self.doc = n, doc

    def end(self) -> np.ndarray:
        return np.r_[self.start[1:], self.words].astype(np.int64)

    def pairs(self, turn: int) -> np.ndarray:
        """Index of the left symbol of each pair that merges."""
        bit = (common.mixed(self.name + np.uint64(turn)) >> np.uint64(63)).astype(bool)
        still = self.run | self.dead
        side = self.doc[self.start]
        return np.flatnonzero(bit[:-1] & ~bit[1:] & ~still[:-1] & ~still[1:] & (side[1:] == side[:-1])) if len(bit) > 1 else np.zeros(0, np.int64)

    def merge(self, left: np.ndarray, name: np.ndarray, dead: np.ndarray) -> None:
        self.name[left], self.dead[left] = name, dead
        stay = np.ones(len(self.start), bool)
        stay[left + 1] = False
        self.start, self.name, self.run, self.dead = self.start[stay], self.name[stay], self.run[stay], self.dead[stay]


class Answers:
    """What Spark answered to one group, by kind; find() gives the position of each (x, y), -1 where there is none."""

    def __init__(self, table: pa.Table | None, kind: int):
        own = table.filter(pc.equal(table.column("kind"), kind)) if table is not None and table.num_rows else None
        x, y, z = ((pc.fill_null(own.column(c), 0).to_numpy() for c in "xyz") if own is not None else (np.zeros(0, np.int64) for _ in range(3)))
        x, y = x.view(np.uint64), y.view(np.uint64)
        mark = self._mark(x, y)
        order = np.argsort(mark, kind="stable")
        self.mark, self.x, self.y, self.z = mark[order], x[order], y[order], z[order]
        self.longest = int(np.diff(np.r_[np.flatnonzero(np.r_[True, self.mark[1:] != self.mark[:-1]]), len(order)]).max()) if len(order) else 0

    @staticmethod
    def _mark(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return common.mixed(x * common.ODD + y)

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        if len(self.mark):
            at = np.searchsorted(self.mark, self._mark(x, y))
            for step in range(self.longest):  # more than one only where marks agree by chance
                j = np.minimum(at + step, len(self.mark) - 1)
                out[(self.x[j] == x) & (self.y[j] == y)] = j[(self.x[j] == x) & (self.y[j] == y)]
        return out


class Group:
    """One group of documents and what is known of its symbols so far."""

    def __init__(self, table: pa.Table, answer: pa.Table | None = None):
        self.table = table
        self.order = table.column("__order").to_numpy()
        self.words, self.first = self._tokens(0)
        self.doc = np.repeat(np.arange(len(self.order)), np.diff(self.first))
        self.symbols = Symbols(self.words, self.doc) if len(self.words) else None
        self.answer = answer

    def _tokens(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for batch in self.table.select(["text"]).combine_chunks().to_batches(max_chunksize=common.ARROW_ROWS):
            for part in common.slices(batch):
                words, first, _, _ = common.hashed_words(part.column("text"), lower=False, seed=seed)
                parts.append(words)
                counts.append(np.diff(first))
        return np.concatenate(parts), np.cumsum(np.concatenate(counts))

    def wholes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold a window, and two names of their whole texts."""
        count = np.diff(self.first)
        place = np.arange(len(self.words)) - np.repeat(self.first[:-1], count)
        names = []
        for seed in common.BYTE_SEEDS:
            sums = np.r_[np.uint64(0), np.cumsum(common.mixed(self.words * common.ODD + common.mixed(place.astype(np.uint64) + seed)))]
            names.append(common.mixed((sums[self.first[1:]] - sums[self.first[:-1]]) ^ count.astype(np.uint64)))
        some = np.flatnonzero(count >= WINDOW)
        return some, names[0][some], names[1][some] >> np.uint64(32) | np.uint64(1)

    def repeats(self) -> np.ndarray:
        """Whether each document is the whole text of a smaller doc_id again."""
        doc, x, y = self.wholes()
        found = Answers(self.answer, WHOLE)
        at = found.find(x, y)
        out = np.zeros(len(self.order), bool)
        out[doc[at >= 0]] = found.z[at[at >= 0]] < self.order[doc[at >= 0]]
        return out

    def name(self, known: bool) -> None:
        """Merges pairs of words. known: runs and pairs that Spark did not find in two documents are dead.

        Nothing in a window that repeats elsewhere is dead, so its symbols are the same either way.
        """
        s = self.symbols
        left = s.pairs(1)
        name = pair_name(s.name[left], s.name[left + 1])
        if known:
            named = Answers(self.answer, SYMBOL)
            runs = np.flatnonzero(s.run)
            s.dead[runs] = named.find(s.name[runs], np.zeros(len(runs), np.uint64)) < 0
        s.merge(left, name, named.find(name, np.zeros(len(name), np.uint64)) < 0 if known else np.zeros(len(left), bool))

    def windows(self, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each window without a dead symbol in its middle, and its pick."""
        s = self.symbols
        left = s.pairs(2)
        s.merge(left, pair_name(s.name[left], s.name[left + 1]), np.zeros(len(left), bool))
        start, end = s.start, s.end()
        step = np.zeros(len(self.words) + 1, np.int32)
        short = s.dead & (end - start <= INNER)
        # a symbol lies in the middle of windows from end - CONTEXT - INNER to start - CONTEXT
        lo, hi = np.maximum(end[short] - CONTEXT - INNER, 0), np.maximum(start[short] - CONTEXT + 1, 0)
        np.add.at(step, lo, 1)
        np.add.at(step, np.maximum(hi, lo), -1)
        window = common.inside_documents(self.first, WINDOW)
        window = window[(np.cumsum(step)[window] == 0) & ~settled[self.doc[window]]]
        fits = ~s.run & ~s.dead & (start - CONTEXT >= self.first[self.doc[start]]) & (end + CONTEXT <= self.first[self.doc[start] + 1])
        best = np.full(len(window), NONE)
        for length in range(1, LONGEST + 1):
            own = np.flatnonzero(fits & (end - start == length))
            at = np.full(len(self.words), NONE)
            at[start[own]] = common.chained(self.words, start[own] - CONTEXT, length + 2 * CONTEXT) ^ common.mixed(s.name[own])
            for k in range(INNER - length + 1):
                np.minimum(best, at[window + CONTEXT + k], out=best)
        bare = best == NONE  # a run fills the middle
        best[bare] = common.mixed(self.words[window[bare] + WINDOW // 2] ^ RUN)
        return window, best

    def candidates(self, settled: np.ndarray) -> np.ndarray:
        """Starts of the windows whose pick another document has too."""
        window, pick = self.windows(settled)
        return window[Answers(self.answer, PICK).find(pick, np.zeros(len(pick), np.uint64)) >= 0]

    def names(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return common.chained(self.words, window, WINDOW), common.chained(self._tokens(1)[0], window, WINDOW, 1) >> np.uint64(32)


def _question(group: int, x: np.ndarray, y: np.ndarray, order: np.ndarray, ordered: np.ndarray) -> pa.Table:
    """One row for each distinct (x, y), with the smallest order (lo) and what the largest is above it (span).

    What is not ordered (symbols and picks) only needs to be told whether two documents
    have it: lo is 0 and span says whether the group alone answers that. Rows of a
    doc_id are in one group, so other groups' documents are others.
    """
    by = np.lexsort((y, x))
    x, y, order, ordered = x[by], y[by], order[by], ordered[by]
    at = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)])
    lo, hi = (f.reduceat(order, at) if len(at) else order[:0] for f in (np.minimum, np.maximum))
    ordered = ordered[at]
    lo, span = np.where(ordered, lo, 0), np.where(ordered, hi - lo, lo < hi)
    return pa.table([x[at].view(np.int64), y[at].view(np.int64), np.full(len(at), group, np.int64), lo.astype(np.int64), span.astype(np.int64)], names=["x", "y", "grp", "lo", "span"])


def _shared(asked: DataFrame, kind: Column, ordered: Column) -> DataFrame:
    """The questions about something that two documents have; z is the smallest doc_id where there is an order (and one of the group is larger), else null."""
    same = W.partitionBy("x", "y")
    found = asked.withColumns({"least": F.min("lo").over(same), "several": (F.min("grp").over(same) < F.max("grp").over(same)) | (F.max("span").over(same) > 0)})
    z = F.when(ordered, F.col("least"))
    return found.where(F.when(ordered, F.col("least") < F.col("lo") + F.col("span")).otherwise(F.col("several"))).select("grp", kind.cast("int").alias("kind"), "x", "y", z.alias("z"))


def ask_names(key: tuple, table: pa.Table) -> pa.Table:
    """Symbols have y = 0, whole texts an odd y."""
    group = Group(table)
    x = y = np.zeros(0, np.uint64)
    order = np.zeros(0, np.int64)
    if group.symbols is not None:
        s = group.symbols
        doc, one, other = group.wholes()
        runs, left = np.flatnonzero(s.run), s.pairs(1)
        names = np.r_[s.name[runs], pair_name(s.name[left], s.name[left + 1])]
        x, y = np.r_[one, names], np.r_[other, np.zeros(len(names), np.uint64)]
        order = group.order[np.r_[doc, group.doc[s.start[np.r_[runs, left]]]]]
    return _question(key[0].as_py(), x, y, order, y > 0)


def ask_picks(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
    pick, order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if table.num_rows and (group := Group(table, answer)).symbols is not None:
        settled = group.repeats()
        group.name(True)
        window, pick = group.windows(settled)
        order = group.order[group.doc[window]]
    return _question(key[0].as_py(), pick, np.zeros(len(pick), np.uint64), order, np.zeros(len(pick), bool))


def ask_windows(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
    x = y = np.zeros(0, np.uint64)
    order = np.zeros(0, np.int64)
    if table.num_rows and (group := Group(table, answer)).symbols is not None:
        settled = group.repeats()
        group.name(False)
        window = group.candidates(settled)
        x, y = group.names(window)
        order = group.order[group.doc[window]]
    return _question(key[0].as_py(), x, y, order, np.ones(len(x), bool))


def removed_words(group: Group) -> np.ndarray:
    """Whether each word of the group lies in a window that a smaller doc_id has. Only windows with a shared pick have an answer."""
    settled = group.repeats()
    same = Answers(group.answer, SAME)
    window = common.inside_documents(group.first, WINDOW)
    window = window[~settled[group.doc[window]]]
    some = np.unique(same.x)
    if len(some):
        one = common.chained(group.words, window, WINDOW)
        window = window[some[np.minimum(np.searchsorted(some, one), len(some) - 1)] == one]
    at = same.find(*group.names(window)) if len(some) else np.full(len(window), -1)
    seen = np.flatnonzero(at >= 0)
    gone = window[seen[same.z[at[seen]] < group.order[group.doc[window[seen]]]]]
    step = np.zeros(len(group.words) + 1, np.int32)
    np.add.at(step, gone, 1)
    np.add.at(step, gone + WINDOW, -1)
    return (np.cumsum(step[:-1]) > 0) | settled[group.doc]


def _remove(table: pa.Table, answer: pa.Table) -> pa.Table:
    group = Group(table, answer)
    removed = removed_words(group) if group.symbols is not None else np.zeros(0, bool)
    n_removed = np.diff(np.r_[0, np.cumsum(removed)][group.first])
    kept = []
    for k, text in enumerate(table.column("text")):
        words = (text.as_py() or "").encode("utf-8").split()
        if n_removed[k]:
            words = [words[i] for i in np.flatnonzero(~removed[group.first[k] : group.first[k + 1]])]
        kept.append(b" ".join(words).decode("utf-8"))
    return pa.table({"doc_id": table.column("doc_id"), "kept": pa.array(kept, pa.string()), "n_words": np.diff(group.first).astype(np.int64), "n_removed": n_removed.astype(np.int64)})


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the words that stay, joined by one space), n_words, n_removed."""
    spark = docs.sparkSession
    common.tune(spark)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").try_cast("long"), F.lit(LAST)).alias("__order"))
    spread = grouping.dealt(rows, common.groups_for(spark, common.text_bytes(docs)))
    whole = F.col("y") != 0
    named = _shared(spread.groupBy("grp").applyInArrow(ask_names, ASKED), F.when(whole, WHOLE).otherwise(SYMBOL), whole)
    picks = _shared(spread.groupBy("grp").cogroup(named.groupBy("grp")).applyInArrow(ask_picks, ASKED), F.lit(PICK), F.lit(False))
    wholes = named.where("z is not null")
    windows = _shared(spread.groupBy("grp").cogroup(wholes.unionByName(picks).groupBy("grp")).applyInArrow(ask_windows, ASKED), F.lit(SAME), F.lit(True))
    answers = wholes.unionByName(windows)
    return spread.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_remove, f"doc_id {dict(docs.dtypes)['doc_id']}, kept string, n_words long, n_removed long")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
