"""Language-model scoring with a probabilistic suffix tree.

The model learns level by level.  A run of up to ``longest`` words is a candidate
context if it occurs at least ``count`` times in training, whatever the size of
the corpus, so contexts and the next-symbol counts they gather grow with it.  A
candidate stays if the next-symbol distribution it brings diverges from its
suffix's by at least ``least`` nats per occurrence (each occurrence judged by the
counts without itself), or if a longer context that stays ends with it, so that
the path to each is there.  A token is scored in the longest context that stays
and ends just before it; each distribution is smoothed by that of its suffix:

    P(w | s) = (c(s w) + weight P(w | suffix of s)) / (c(s) + weight)

down to the token frequencies, P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

Documents are cut into chunks of bounded size where they are read; what travels
on is their tokens' places among the chunk's distinct words, packed, and not
their texts.  A chunk asks for the totals of
its distinct n-grams and adds its own training counts to them; buckets of
n-grams sum up and answer every chunk in the order it asked, by what the other
chunks hold.  Where no other chunk asked for an n-gram, none holds a longer one
around it either, so those are not asked for: their counts are the chunk's own.
The divergences are then summed by the same buckets: a chunk sends its part for
each candidate it asked about, in that order and without the n-grams, and learns
which of them pass; in the same way the suffixes that a longer context needs are
marked.  So no count, context or distribution passes
through the driver or is broadcast.  The packed tokens and each level's answers are dealt to
the chunks once and read there by every later level.  Words and n-grams are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from codeloom.llm.words import LOWER, chunks, hashes, mix, pack, pack_sorted, release, slices, spans, unpack, unpack_sorted

END = np.uint64(0x5851F42D4C957F2D)
TURN = np.uint64(0xD1342543DE82EF95)
#: Most partitions of an exchange; beyond them a partition holds several chunks, one after the other.
MOST_PARTS = 1 << 14
#: Kinds of answers beside the totals, which have their level's number.
PASSED, NEEDED = 100, 200
#: Parts of divergences are sent as whole numbers of this fraction.
FINE = 1 << 20
SENT = "bucket int, chunk long, kind int, totals binary"
STATE = "chunk long, words long, n long, tokens binary, sizes binary, held binary"
ASK = "bucket int, chunk long, keys binary, counts binary"
ANSWER = "chunk long, bucket int, kind int, totals binary"
STATS = "tokens long, kinds long"


def _joined(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(context * TURN + symbol)


class Tree(NamedTuple):
    """What makes a context: see ``score_texts``."""

    count: int
    share: float
    longest: int
    weight: float
    least: float


def _floor(tree: Tree, n: int) -> float:
    """Occurrences that a candidate context needs."""
    return max(tree.share * n, tree.count)


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique`` with the inverse, by one sort of the upper bits with the places in the lower ones."""
    n = len(grams)
    if not n:
        return grams, np.empty(0, np.int64)
    low = np.uint64((1 << n.bit_length()) - 1)
    base = grams.min()
    free = 64 - max(int(grams.max() - base).bit_length(), 1)
    at = (np.sort(((grams - base) << np.uint64(free)) & ~low | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    rising = grams[at]
    if (rising[1:] < rising[:-1]).any():  # some differ in the lower bits alone: nearly in order
        again = np.argsort(rising, kind="stable")
        at, rising = at[again], rising[again]
    new = np.ones(n, bool)
    new[1:] = rising[1:] != rising[:-1]
    of = np.empty(n, np.int64)
    of[at] = np.cumsum(new) - 1
    return rising[new], of


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, and how many each text has."""
    tokens, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, _, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, word = spans(data, offsets)
        n = np.diff(word)
        out = np.empty(len(starts) + len(n), np.uint64)
        out[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = hashes(data, starts, ends)
        out[word[1:] + np.arange(len(n))] = END
        tokens.append(out)
        sizes.append(n + 1)
    return np.concatenate(tokens), np.concatenate(sizes)


def _cut(batches, chunk_bytes: int):
    """Tables of whole rows of about ``chunk_bytes`` of text, or of as many tiny rows as weigh as much.

    The cuts follow from the rows alone, not from how they come in batches.
    """
    held, size = [], 0
    for b in batches:
        weight = np.maximum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), 16).tolist()
        first = 0
        for k, w in enumerate(weight):
            size += w
            if size >= chunk_bytes:
                yield pa.Table.from_batches([*held, b.slice(first, k + 1 - first)])
                held, size, first = [], 0, k + 1
        if first < b.num_rows:
            held.append(b.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _read(batches, chunk_bytes: int):
    """Each chunk of a task: its number, ids, held-out flags, token hashes and texts' sizes.

    The number is made of the content and the place, so that a second reading
    that gives other chunks cannot be taken for the first.
    """
    part = TaskContext.get().partitionId()
    for k, table in enumerate(_cut(batches, chunk_bytes)):
        release()
        h, sizes = _tokens(table.column("_text").combine_chunks())
        name = hashlib.blake2b(h.tobytes() + sizes.tobytes(), digest_size=8, key=f"{part}:{k}".encode()).digest()
        number = int.from_bytes(name, "big") >> 1
        held = table.column("_held").combine_chunks().to_numpy(zero_copy_only=False)
        yield number, table.column("_id").combine_chunks(), held, h, sizes


def _words(tree: Tree, buckets: int, chunk_bytes: int):
    """The chunks' first questions: their distinct words and training counts."""

    def run(batches):
        for number, _, held, h, sizes in _read(batches, chunk_bytes):
            keys, of = _distinct(h)
            own = np.bincount(of[np.repeat(~held, sizes)], minlength=len(keys))
            yield from _pack(number, {"keys": keys, "own": own}, buckets, np.uint32).to_batches()

    return run


def _states(chunk_bytes: int, names: list[str]):
    """The chunks' tokens as places among their sorted distinct words."""

    def run(batches):
        for number, ids, held, h, sizes in _read(batches, chunk_bytes):
            keys, of = _distinct(h)
            tokens = pa.compress(pack(of.astype(np.uint32)), "zstd", asbytes=True)
            cols = [[number], [len(keys)], [len(h)], [tokens], [sizes.astype(np.uint32).tobytes()], [np.packbits(held).tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), ids], names=names)

    return run


class Chunk:
    """Tokens of one chunk, and its distinct n-grams as far as the answers reach.

    The arrays by level hold: ``keys`` the sorted distinct n-grams, ``of`` the
    place of each occurrence's n-gram among them, ``at`` the occurrences' tokens,
    ``own`` the chunk's training counts, ``ask`` which n-grams it asks for,
    ``cuts`` where each bucket's questions lie among those, ``sole`` the n-grams
    that no other chunk has and ``total`` the corpus's counts.
    """

    def __init__(self, table: pa.Table, tree: Tree):
        if table.num_rows != 1:
            raise ValueError("the documents read differently a second time: write them to a table first")
        row = {c: table.column(c)[0] for c in table.column_names}
        self.sizes = np.frombuffer(row["sizes"].as_py(), np.uint32).astype(np.int64)
        self.held = np.unpackbits(np.frombuffer(row["held"].as_py(), np.uint8), count=len(self.sizes)).astype(bool)
        self.ids = row["ids"].values
        n = row["n"].as_py()
        of = unpack(pa.decompress(row["tokens"].as_py(), 4 * n, "zstd", asbytes=True), np.uint32).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)
        self.ends = np.zeros(n, bool)
        self.ends[self.first + self.sizes - 1] = True
        self.tree = tree
        words = row["words"].as_py()
        own = np.bincount(of[self.train], minlength=words)
        self.levels: list[dict] = [{"of": of, "at": np.arange(n), "own": own, "ask": np.ones(words, bool)}]

    def _level(self, grams: np.ndarray, at: np.ndarray, sole: np.ndarray | None = None) -> None:
        """The next level; ``sole``: occurrences of n-grams that no other chunk has."""
        keys, of = _distinct(grams)
        own = np.bincount(of[self.train[at]], minlength=len(keys))
        ask = np.ones(len(keys), bool)
        if sole is not None:
            ask[of[sole]] = False
        if sole is not None:
            ask |= own >= self.floor  # it may be a context
        self.levels.append({"keys": keys, "of": of, "at": at, "own": own, "ask": ask})

    def learn(self, answers: pa.Table, buckets: int, upto: int) -> None:
        """Fill in the totals of levels up to ``upto``, and open the next level after each."""
        kinds = answers.column("kind").to_numpy()
        bucket = answers.column("bucket").to_pylist()
        totals = answers.column("totals").to_pylist()
        of_kind = lambda kind: {bucket[k]: totals[k] for k in np.flatnonzero(kinds == kind).tolist()}
        self.n = answers.column("n")[0].as_py()
        self.v = answers.column("v")[0].as_py()
        self.floor = _floor(self.tree, self.n)
        for level in range(min(upto, self.tree.longest) + 1):
            mine, here = of_kind(level), self.levels[level]
            if level:
                here["cuts"] = list(slices(here["keys"][here["ask"]], buckets))
                told = [unpack(mine[k], np.int64) for k, _, _ in here["cuts"]]
            else:  # with each word's number among all of them
                order = sorted(mine)
                both = [np.split(np.frombuffer(mine[k], np.uint8), 2) for k in order]
                told = [unpack(a.tobytes(), np.int64) for a, _ in both]
                edges = np.cumsum([0, *map(len, told)]).tolist()
                here["cuts"] = list(zip(order, edges, edges[1:]))
                if edges[-1] != len(here["own"]):
                    raise ValueError("the documents read differently a second time: write them to a table first")
                here["keys"] = np.concatenate([unpack_sorted(b.tobytes()) * np.uint64(buckets) + np.uint64(k) for k, (_, b) in zip(order, both)])
                self.h = here["keys"][here["of"]]
            told = np.concatenate(told) if told else np.empty(0, np.int64)
            # zero: no other chunk has it; else one more than the others' training counts
            here["sole"] = ~here["ask"]
            here["sole"][here["ask"]] = told == 0
            here["total"] = here["own"].astype(np.int64)
            here["total"][here["ask"]] += np.maximum(told - 1, 0)
            if level < self.tree.longest:
                self._open(level)
        #: By context length: which of this chunk's n-grams pass the test, and which a longer context needs.
        self.passed = [self._told(of_kind(PASSED + k), self.levels[k]) for k in range(self.tree.longest)] if upto > self.tree.longest else []
        self.needed = [self._told(of_kind(NEEDED + k), self.levels[k]) for k in range(self.tree.longest)] if upto > self.tree.longest + 1 else []

    def candidates(self, here: dict):
        """(bucket, places of the candidate contexts among the n-grams asked about there)."""
        asked = np.flatnonzero(here["ask"])
        often = here["total"][asked] >= self.floor
        for k, a, b in here["cuts"]:
            yield k, asked[a:b][often[a:b]]

    def _told(self, mine: dict, here: dict) -> np.ndarray:
        out = np.zeros(len(here["keys"]), bool)
        for k, places in self.candidates(here):
            if k in mine:
                out[places] = np.unpackbits(np.frombuffer(mine[k], np.uint8), count=len(places))
        return out

    def _open(self, level: int) -> None:
        """Occurrences whose preceding ``level + 1`` tokens are a frequent n-gram."""
        here = self.levels[level]
        frequent = here["total"] >= self.floor
        after = here["at"] + 1
        ok = frequent[here["of"]] & ~self.ends[here["at"]]
        here["frequent"] = ok
        at = after[ok]
        context = here["keys"][here["of"][ok]]
        here["next"] = np.full(len(self.h) + 1, -1)
        here["next"][at] = here["of"][ok]  # by token: the place of the context that ends before it
        sole = here["sole"][here["of"]]
        ends = np.zeros(len(self.h), bool)  # by token: this level's n-gram that ends with it is here alone
        ends[here["at"]] = sole
        self._level(_joined(context, self.h[at]), at, sole[ok] | ends[at])

    def _chain(self, level: int, stays=None) -> np.ndarray:
        """Smoothed probability of each token, in contexts of up to ``level`` words that stay."""
        base = self.levels[0]
        p = (base["total"][base["of"]] + 0.5) / (self.n + 0.5 * (self.v + 1))
        open_ = np.ones(len(self.h), bool)
        for k in range(1, level + 1):
            here, before = self.levels[k], self.levels[k - 1]
            at, context = here["at"], before["next"][here["at"]]
            ok = open_[at] & stays[k - 1][context]
            at, context = at[ok], context[ok]
            open_ = np.zeros(len(self.h), bool)
            open_[at] = True
            p[at] = (here["total"][here["of"][ok]] + self.tree.weight * p[at]) / (before["total"][context] + self.tree.weight)
        return p

    def divergences(self) -> list[np.ndarray]:
        """For each context length, this chunk's part of its n-grams' divergence from their suffixes."""
        less = self.train.astype(np.int64)  # a training token is judged by the counts without itself
        base, out = self.levels[0], []
        p = (base["total"][base["of"]] - less + 0.5) / (self.n - less + 0.5 * (self.v + 1))
        for level in range(1, self.tree.longest + 1):
            here, before = self.levels[level], self.levels[level - 1]
            at = here["at"]
            context = before["next"][at]
            count = here["total"][here["of"]] - less[at]
            longer = (count + self.tree.weight * p[at]) / (before["total"][context] - less[at] + self.tree.weight)
            train = self.train[at]
            gain = np.log(longer[train] / p[at[train]])
            p[at] = longer
            out.append(np.bincount(context[train], gain, len(before["keys"])))
        return out

    def suffixes(self) -> list[np.ndarray]:
        """For each context length, which n-grams end a longer context of this chunk that stays."""
        use = [x.copy() for x in self.passed]
        for k in range(len(use) - 1, 0, -1):
            here = self.levels[k]
            ok = here["frequent"] & use[k][here["of"]]
            use[k - 1][self.levels[k - 1]["next"][here["at"][ok] + 1]] = True
        return use

    def stays(self) -> list[np.ndarray]:
        """For each context length, which of this chunk's n-grams of that length stay as contexts."""
        return [a | b for a, b in zip(self.passed, self.needed)]


def _pack(chunk: int, level: dict, buckets: int, kind) -> pa.Table:
    ask = level.get("ask", slice(None))
    keys, own = level["keys"][ask], level["own"][ask].astype(kind)
    rows = [(k, chunk, pack_sorted(keys[a:b]), pack(own[a:b])) for k, a, b in slices(keys, buckets)]
    cols = list(zip(*rows)) if rows else [[]] * 4
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["bucket", "chunk", "keys", "counts"])


def _asker(level: int, tree: Tree, buckets: int):
    def run(key, table, answers):
        release()
        chunk = Chunk(table, tree)
        chunk.learn(answers, buckets, level - 1)
        return _pack(key[0].as_py(), chunk.levels[level], buckets, np.uint32)

    return run


def _sender(kind: int, tree: Tree, buckets: int):
    """What a chunk knows of its candidates: parts of the divergences, as whole numbers of 2**-20, or bits."""

    def run(key, table, answers):
        release()
        chunk = Chunk(table, tree)
        chunk.learn(answers, buckets, tree.longest + (kind == NEEDED))
        rows = []
        for k, x in enumerate(chunk.divergences() if kind == PASSED else chunk.suffixes()[:-1]):
            if kind == PASSED:
                x = np.rint(x * FINE).astype(np.int64)
                x = ((x << 1) ^ (x >> 63)).view(np.uint64)  # small numbers of either sign have high bytes of zero
            for bucket, places in chunk.candidates(chunk.levels[k]):
                if len(places):
                    rows.append((bucket, key[0].as_py(), k, pack(x[places]) if kind == PASSED else np.packbits(x[places]).tobytes()))
        cols = list(zip(*rows)) if rows else [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["bucket", "chunk", "kind", "totals"])

    return run


def _unpacked(table: pa.Table):
    """A bucket's n-grams: each chunk's number of them, the place of each among the distinct ones, and the counts."""
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
    distinct, of = _distinct(np.concatenate(keys))
    return [len(k) for k in keys], of, counts, np.bincount(of, counts, len(distinct)).astype(np.int64)


def _answers(table: pa.Table, kind: int, back: list) -> pa.Table:
    kinds = pa.array(np.full(len(back), kind, np.int32))
    cols = {"chunk": table.column("chunk"), "bucket": table.column("bucket"), "kind": kinds, "totals": pa.array(back, pa.binary())}
    return pa.table(cols)


def _totals(level: int, tree: Tree):
    """Sum the counts of a bucket's n-grams and answer each chunk in the order it asked:
    zero if no other chunk asked, else one more than the others' counts."""

    def run(key, table):
        sizes, of, counts, total = _unpacked(table)
        answer = np.where(np.bincount(of, minlength=len(total))[of] == 1, 0, total[of] - counts + 1)
        cuts = np.cumsum(sizes)[:-1]
        back = [pack(x) for x in np.split(answer, cuts)]
        if not level:  # words also get their place in the bucket, as a number to go by
            back = [a + pack_sorted(x.astype(np.uint64)) for a, x in zip(back, np.split(of, cuts))]
        return _answers(table, level, back)

    return run


def _judge(kind: int, tree: Tree):
    """Add up what the chunks sent about a bucket's candidates, and tell each chunk which of them pass (or are needed)."""

    def level_of(table, sent, level):
        sizes, of, _, total = _unpacked(table)
        often = total >= _floor(tree, sent.column("n")[0].as_py())
        given = dict(zip(sent.column("chunk").to_pylist(), sent.column("totals").to_pylist()))
        asked = [x[often[x]] for x in np.split(of, np.cumsum(sizes)[:-1])]
        sums = np.zeros(len(total), np.int64)
        for chunk, x in zip(table.column("chunk").to_pylist(), asked):
            if len(x) and kind == PASSED:
                z = unpack(given[chunk], np.uint64)
                sums[x] += (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)
            elif len(x):
                sums[x] += np.unpackbits(np.frombuffer(given[chunk], np.uint8), count=len(x))
        good = sums >= tree.least * FINE * total if kind == PASSED else sums > 0
        return _answers(table, kind + level, [np.packbits(good[x]).tobytes() for x in asked])

    def run(key, table, sent):
        release()
        out = []
        for level in sorted(set(sent.column("kind").to_pylist())):
            out.append(level_of(table.filter(pc.equal(table.column("level"), level)), sent.filter(pc.equal(sent.column("kind"), level)), level))
        return pa.concat_tables(out) if out else _answers(table.slice(0, 0), kind, [])

    return run


def _stats(key, table):
    """Training tokens of a bucket, and how many of them differ."""
    keys = np.concatenate([unpack_sorted(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()])
    return pa.table({"tokens": pa.array([int(counts.sum(dtype=np.int64))]), "kinds": pa.array([len(np.unique(keys[counts > 0]))])})


def _score(tree: Tree, buckets: int, names: list[str]):
    def run(key, table, answers):
        release()
        chunk = Chunk(table, tree)
        chunk.learn(answers, buckets, tree.longest + 2)
        known = chunk.levels[0]["total"][chunk.levels[0]["of"]] > 0
        sums = lambda x: np.add.reduceat(x, chunk.first)
        out = {
            "_id": chunk.ids,
            "held_out": pa.array(chunk.held),
            "n_tokens": pa.array(chunk.sizes),
            "n_known": pa.array(sums(known.astype(np.int64))),
            "train_tokens": pa.array(np.full(len(chunk.sizes), chunk.n)),
            "base_score": pa.array(sums(np.log10(chunk._chain(0)))),
            "score": pa.array(sums(np.log10(chunk._chain(tree.longest, chunk.stays())))),
        }
        return pa.table([out[c] for c in names], names=names)

    return run


def score_texts(
    docs: DataFrame,
    held_out,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: float = 0.0,
    weight: float = 2000.0,
    least: float = 0.01,
    chunk_bytes: int = 8 << 20,
    count: int = 7,
    longest: int = 2,
) -> DataFrame:
    """One row per input row: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the A-Z-lowered text and one end.  ``held_out`` is a
    boolean column of ``docs``; the other rows train.  ``base_score`` sums the
    log10 of the token frequencies' probabilities, ``score`` those of the tree.
    A context has at most ``longest`` words (one exchange for each) and at least
    ``count`` occurrences in training; ``share`` of the tokens can be asked of it
    besides.

    * Null text: empty, one token.  A null in ``held_out`` counts as false.
    * Null and repeated ids, and repeated rows, count and are scored one by one.
      Other columns are not looked at.  Empty table: empty result.
    * ``docs`` is read twice and must come in the same order both times, as files
      do; where it does not, the job ends with an error that says so.
    """
    tree = Tree(count, share, longest, weight, least)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary"))), F.count("*")).first()
    n_chunks = max(1, -(-(total[0] or 0) // chunk_bytes), -(-total[1] // max(1, chunk_bytes // 16)))
    buckets = max(1, n_chunks // 2)
    source = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held")
    )
    # dealt by number, so that each exchange stays as it is for every level that reads it
    parts = min(n_chunks, MOST_PARTS)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in STATE.split(", ")] + ["ids"]
    states = source.mapInArrow(_states(chunk_bytes, names), f"{STATE}, ids array<{kind}>")
    by_chunk = states.repartition(parts, "chunk").groupBy("chunk")
    by_bucket = min(buckets, MOST_PARTS)
    asked = [source.mapInArrow(_words(tree, buckets, chunk_bytes), ASK).repartition(by_bucket, "bucket")]
    stats = asked[0].groupBy("bucket").applyInArrow(_stats, STATS).agg(F.sum("tokens").alias("n"), F.sum("kinds").alias("v"))
    stats = stats.select(F.struct("n", "v"))

    def answered(level):
        return asked[level].groupBy("bucket").applyInArrow(_totals(level, tree), ANSWER).repartition(parts, "chunk")

    answers = answered(0)

    def known():
        return answers.withColumn("s", stats.scalar()).select("chunk", "bucket", "kind", "totals", "s.n", "s.v").groupBy("chunk")

    for level in range(1, longest + 1):
        more = by_chunk.cogroup(known()).applyInArrow(_asker(level, tree, buckets), ASK)
        asked.append(more.repartition(by_bucket, "bucket"))
        answers = answers.union(answered(level))
    about = asked[0].withColumn("level", F.lit(0))
    for level in range(1, longest):
        about = about.union(asked[level].withColumn("level", F.lit(level)))
    for kind in (PASSED, NEEDED) if longest > 1 else (PASSED,):  # nothing is longer than the longest
        sent = by_chunk.cogroup(known()).applyInArrow(_sender(kind, tree, buckets), SENT).repartition(by_bucket, "bucket")
        sent = sent.withColumn("s", stats.scalar()).select("bucket", "chunk", "kind", "totals", "s.n")
        told = about.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(_judge(kind, tree), ANSWER)
        answers = answers.union(told.repartition(parts, "chunk"))
    fields = [
        StructField("_id", docs.schema[id_col].dataType),
        StructField("held_out", BooleanType()),
        *(StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        *(StructField(c, DoubleType()) for c in ("base_score", "score")),
    ]
    run = _score(tree, buckets, [f.name for f in fields])
    return by_chunk.cogroup(known()).applyInArrow(run, StructType(fields)).withColumnRenamed("_id", id_col)
