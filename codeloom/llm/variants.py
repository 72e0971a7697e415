"""Spelling variants by composing vocabulary acceptors with a one-edit transducer.

Two words are near if one insertion, deletion or replacement of a code point
turns one into the other.  With A the minimised acceptor of the vocabulary and E
the transducer that copies its input but for exactly one edit, the accepted
paths of A o E o A are the near pairs.  They are enumerated by partitions of the
composition: a partition fixes what both words share before the edit (its
initial state) or after it (its final one).  The words of length L as the
shorter side, and those of length L and L + 1 as the other, stand in two
partitions each: by their first L // 2 code points, for edits behind them, and by
their last L - L // 2, for edits before them.  A partition with too many words is
halved again in the same way, its remaining middle parts taken for words, until
it is small or the edit's place is known; what is left then is bounded by the
alphabet.  So no partition grows with the vocabulary and no pair is lost.

Within a task one acceptor is built from the sorted middle parts of all its
partitions, by joining states of equal right language; before the edit both
sides of the composition are read along one prefix, after it along pairs of
states whose common words are found once and remembered.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-z\u00C0-\u00FF]"
KEY = ["size", "prefix", "suffix"]
#: Middle parts longer than this are always halved.
LONGEST = 64
NEAR = "word string, n_near long, top struct<less: long, word: string>"


class Acceptor:
    """Deterministic acceptors that share their states: two states of equal right language are one."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict = {}
        self._common: dict = {}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, tuple(arcs.items()))  # words come sorted, so equal arcs stand in equal order
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return state

    def add(self, words: list[str]) -> int:
        """Start state of the minimised acceptor of sorted, distinct words."""
        path: list[tuple[bool, dict]] = [("" in words[:1], {})]  # states along the last word that may still change
        last = ""
        for word in words:
            if not word:
                continue
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(path, last, same)
            path.extend((False, {}) for _ in word[same:])
            path[-1] = (True, {})
            last = word
        self._close(path, last, 0)
        return self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(*path.pop())
            path[-1][1][word[len(path) - 1]] = state

    def common(self, p: int, q: int) -> list[str]:
        """Words that both states accept."""
        key = (p, q) if p <= q else (q, p)
        found = self._common.get(key)
        if found is None:
            few, many = self.arcs[p], self.arcs[q]
            if len(few) > len(many):
                few, many = many, few
            found = [""] if self.final[p] and self.final[q] else []
            for c, state in few.items():
                other = many.get(c)
                if other is not None:
                    found += [c + x for x in self.common(state, other)]
            self._common[key] = found
        return found

    def one_edit(self, short: int, long: int | None, at_end: bool):
        """Accepted pairs of the composition: (word, other), edited where they first differ.

        ``short`` starts the words of one length, which are paired with each other
        by a replacement; ``long`` those one longer, reached by an insertion, which
        may be behind the last code point only if ``at_end``.
        """
        open_ = [(short, long, "")]
        while open_:
            p, q, read = open_.pop()
            arcs = list(self.arcs[p].items())
            for k, (c, s) in enumerate(arcs):
                for d, t in arcs[:k]:
                    for rest in self.common(s, t):
                        yield read + c + rest, read + d + rest
            longer = self.arcs[q] if q is not None else {}
            for d, t in longer.items():
                for rest in self.common(p, t):
                    if rest[:1] != d and (rest or at_end):
                        yield read + rest, read + d + rest
            open_ += [(s, longer.get(c), read + c) for c, s in arcs]


def letter_runs(docs: DataFrame, id_col: str, text_col: str, least: int, noise: int | None) -> DataFrame:
    """word: the runs of ``least`` letters or more of every text, A-Z in lower case.

    With ``noise``, a run loses one code point where ``noise`` divides the CRC-32 h
    of ``<id>:<run>``: that at h modulo the run's length.  A null id is written as nothing.
    """
    low = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(low, F.lit(f"({LETTERS}{{{least},}})"))).alias("run"),
    )
    if noise is None:
        return runs.select(F.col("run").alias("word"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % noise == 0, less).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word"))


def vocabulary(words: DataFrame, least: int, occurrences: int) -> DataFrame:
    """word, n: the distinct words of ``least`` code points and ``occurrences`` or more."""
    counted = words.where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= occurrences)


def _side(vocab: DataFrame, longer: bool) -> DataFrame:
    """Both partitions of each word, as the shorter side or as one longer than that."""
    size = F.char_length("word") - int(longer)
    half = F.floor(size / 2).cast("int")
    rows = vocab.where(size >= 1).select("word", "n", F.lit(longer).alias("longer"), size.alias("size"), half.alias("half"))
    rest = F.col("size") - F.col("half")
    all_ = F.char_length("word")
    behind = F.struct(
        F.substring(F.col("word"), F.lit(1), F.col("half")).alias("prefix"),
        F.lit("").alias("suffix"),
        F.substring(F.col("word"), F.col("half") + 1, all_).alias("mid"),
    )
    before = F.struct(
        F.lit("").alias("prefix"),
        F.substring(F.col("word"), all_ - rest + 1, rest).alias("suffix"),
        F.substring(F.col("word"), F.lit(1), all_ - rest).alias("mid"),
    )
    return rows.select("n", "longer", "size", F.inline(F.array(behind, before)))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row of a large partition in the two partitions of its halved middle part."""
    left = F.col("size") - F.char_length("prefix") - F.char_length("suffix")
    rows = rows.withColumn("half", F.floor(left / 2).cast("int")).withColumn("rest", (left - F.floor(left / 2)).cast("int"))
    mid, all_ = F.col("mid"), F.char_length("mid")
    behind = F.struct(
        F.concat("prefix", F.substring(mid, F.lit(1), F.col("half"))).alias("prefix"),
        F.col("suffix"),
        F.substring(mid, F.col("half") + 1, all_).alias("mid"),
    )
    before = F.struct(
        F.col("prefix"),
        F.concat(F.substring(mid, all_ - F.col("rest") + 1, F.col("rest")), F.col("suffix")).alias("suffix"),
        F.substring(mid, F.lit(1), all_ - F.col("rest")).alias("mid"),
    )
    return rows.select("n", "longer", "size", F.inline(F.array(behind, before)))


def _partitions(vocab: DataFrame, most: int) -> DataFrame:
    """Rows (n, longer, size, prefix, suffix, mid) of partitions of at most ``most`` words, or of one open place."""
    rows = stage(_side(vocab, False).union(_side(vocab, True)), "partitions")
    left = F.col("size") - F.char_length("prefix") - F.char_length("suffix")
    settled = None
    while True:
        sizes = rows.groupBy(*KEY).agg(F.count("*").alias("rows"))
        large = sizes.where(((F.col("rows") > most) | (left > LONGEST)) & (left >= 2)).select(*KEY)
        large = stage(large, "large")
        if large.isEmpty():
            return rows if settled is None else settled.union(rows)
        small = rows.join(large, KEY, "left_anti").select(*rows.columns)
        settled = small if settled is None else settled.union(small)
        rows = stage(_halved(rows.join(large, KEY, "left_semi")), "partitions")


def _enumerate(key, table):
    """Near pairs within a task's partitions: for each word how many it has, and the most frequent."""
    table = table.sort_by([(c, "ascending") for c in (*KEY, "longer", "mid")])
    cols = [table.column(c).to_pylist() for c in (*KEY, "longer", "mid", "n")]
    acceptor, first = Acceptor(), 0
    near: dict[str, int] = {}
    best: dict[str, tuple[int, str]] = {}
    starts = []  # partition, start states and counts by middle part of both sides
    rows = list(zip(*cols))
    while first < len(rows):
        own, end = rows[first][:3], first
        sides: tuple[dict, dict] = ({}, {})
        while end < len(rows) and rows[end][:3] == own:
            sides[rows[end][3]][rows[end][4]] = rows[end][5]
            end += 1
        first = end
        if not sides[0] or len(sides[0]) + len(sides[1]) < 2:
            continue
        starts.append((own, acceptor.add(sorted(sides[0])), acceptor.add(sorted(sides[1])) if sides[1] else None, sides))
    for (_, prefix, suffix), short, long, (shorts, longs) in starts:
        for word, other in acceptor.one_edit(short, long, not suffix):
            n, m = shorts[word], shorts[other] if len(other) == len(word) else longs[other]
            word, other = prefix + word + suffix, prefix + other + suffix
            for a, b, count in ((word, other, m), (other, word, n)):
                near[a] = near.get(a, 0) + 1
                if a not in best or (-count, b) < best[a]:
                    best[a] = (-count, b)
    top = pa.array([{"less": best[w][0], "word": best[w][1]} for w in near], pa.struct([("less", pa.int64()), ("word", pa.string())]))
    return pa.table({"word": pa.array(list(near), pa.string()), "n_near": pa.array(list(near.values()), pa.int64()), "top": top})


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that each word's forms lead to, by doubling the steps."""
    at = stage(forms, "roots")
    while True:
        on = at.select(F.col("word").alias("_on"), F.col("root").alias("_next"))
        if at.join(on, F.col("root") == F.col("_on"), "left_semi").isEmpty():
            return at
        at = at.join(on, F.col("root") == F.col("_on"), "left").select("word", F.coalesce("_next", "root").alias("root"))
        at = stage(at, "roots")


def group_variants(vocab: DataFrame, factor: int = 5, most: int = 16384, task_rows: int = 16384) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``vocab`` (word, n).

    ``n_near`` counts the near words, ``form`` is that of largest n (ties: the
    smallest in code-point order) if its n is at least ``factor`` times the word's,
    else null, ``form_n`` its n; ``root`` is where following the forms ends, the
    word itself if it has none.

    * Repeated words count as one with the sum of their n; empty words and nulls in
      either column are left out.  Other columns are not looked at.
    * Empty table: empty result.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its word")
    vocab = vocab.where("word <> '' and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    vocab = stage(vocab, "vocabulary")
    tasks = max(1, -(-4 * vocab.count() // task_rows))
    rows = _partitions(vocab, most)
    rows = rows.withColumn("task", F.pmod(F.xxhash64(*KEY), F.lit(tasks)))
    found = rows.groupBy("task").applyInArrow(_enumerate, NEAR)
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("top").alias("top"))
    top = F.col("top.word")
    leads = -F.col("top.less") >= factor * F.col("n")
    all_ = vocab.join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, top).alias("form"),
        F.when(leads, -F.col("top.less")).alias("form_n"),
    )
    all_ = stage(all_, "variants")
    roots = _roots(all_.where("form is not null").select("word", F.col("form").alias("root")))
    root: Column = F.coalesce("root", "word")
    return all_.join(roots, "word", "left").select("word", "form", root.alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 6,
    occurrences: int = 5,
    factor: int = 5,
    noise: int | None = None,
    **more,
) -> DataFrame:
    """Spelling variants among all words of the texts; see ``letter_runs``, ``vocabulary`` and ``group_variants``.

    * Null and empty texts have no words; a very long text is one row of many words.
    * Repeated rows count again.  Other columns are not looked at.  Empty table: empty result.
    """
    words = letter_runs(docs, id_col, text_col, least, noise)
    return group_variants(vocabulary(words, least, occurrences), factor, **more)
