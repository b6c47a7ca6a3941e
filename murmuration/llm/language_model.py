"""A hierarchical Pitman-Yor language model and the log probability of every document.

Words are customers of restaurants in three levels. Every preceding word has a restaurant of the first level, its room;
its parent is the restaurant of that word's class, its last byte, which all words of the class share; the parent of every
class is the root, whose own base is uniform over the known words and one unknown. Each table of a restaurant sends one
customer to its parent.

Seating is sampled by Gibbs sweeps over numbers of tables, one for each dish in each restaurant. Given everybody else, a
dish with c customers has t tables with a chance proportional to a ** t * S(c, t): a is the weight of a new table, S a
generalized Stirling number of the restaurant's discount. The tables are kept with the counts from sweep to sweep; within
one sweep the words are drawn side by side, given the restaurants' totals after the last sweep. Predictive probabilities
of the samples after the burn-in are averaged. A draw's randomness comes from the word's hash, so partitions change
nothing.

Counts of pairs (word, room) are gathered by buckets of words, in blocks of arrays. Pairs that occur once in the corpus
sit at one table or none, so they are only counted by the sweeps; for the other pairs (kept) a sweep draws the tables. What a
room holds in all is summed by buckets of rooms after each sweep, and sent back to the pairs' blocks: no task holds all
rooms. For scoring, the most frequent pairs (a bounded table) are looked up where the text is read; all other pairs of a
document travel in arrays to the task that holds their room's bucket, which sends back sums for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memory
from .hashing import uniform
from .store import materialize, release

#: Classes (256 last bytes and the start of a text). A room's number is its class, then 55 bits of its word's hash; a draw's
#: randomness depends on its slot, one of SLOTS in the class, which rooms may share.
SLOTS = 256
CLASSES = 257
CONTEXTS = CLASSES * SLOTS
HASH = np.uint64(55)
START = np.uint64(256) << HASH
#: Up to so many customers a dish's tables are drawn exactly.
EXACT = 128
#: Pairs that the readers hold themselves, 25 bytes each.
HOT_PAIRS = 1 << 20
#: Tokens whose pairs are summed before they leave a task, and tokens and texts scored at once.
BUFFER = 1 << 21
SCORED = 1 << 20
SCORED_TEXTS = 1 << 15
#: Bytes of texts to a bucket of words or rooms, on average, and buckets at least; pairs of a block, where a word has no more.
BUCKET_BYTES = 1 << 24
LEAST_BUCKETS = 8
BLOCK = 1 << 17
GROUP = 256
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Strengths of the three levels (word contexts, classes, root), and sweeps left out and sampled."""

    strengths: tuple[float, float, float] = (1.0, 1.0, 1.0)
    burn_in: int = 2
    samples: int = 2
    seed: int = 11


@dataclass(frozen=True)
class Totals:
    """What the sweeps know of the whole corpus: customers and tables of every restaurant, by level, and the discounts."""

    customers: tuple[np.ndarray, np.ndarray, float] = field(repr=False)
    tables: tuple[np.ndarray, np.ndarray, float] = field(repr=False)
    discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    known: int = 0

    @property
    def tokens(self) -> int:
        return int(self.customers[0].sum())


class Reader:
    """Texts to 64-bit word hashes and contexts; words are hashed once per worker."""

    def __init__(self):
        import xxhash

        digest = xxhash.xxh64_intdigest
        self.memory = Memory(lambda words: [digest(w) for w in words])
        self.end = digest(b"")

    def rooms(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, rooms) of each text's tokens: its words in lower case (A-Z) and the end."""
        texts = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        self.memory.prepare(set().union(*texts))
        known = self.memory.young
        for words in texts:
            n = len(words)
            hashes = np.empty(n + 1, np.uint64)
            hashes[:n] = np.fromiter(map(known.__getitem__, words), np.uint64, n)
            hashes[n] = self.end
            rooms = np.empty(n + 1, np.uint64)
            rooms[0] = START
            rooms[1:] = np.fromiter((w[-1] for w in words), np.uint64, n) << HASH
            rooms[1:] |= hashes[:n] >> np.uint64(9)
            yield hashes, rooms

    def read(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, slots) of each text's tokens."""
        for hashes, rooms in self.rooms(texts):
            yield hashes, slot_of(rooms)


def slot_of(rooms: np.ndarray) -> np.ndarray:
    return (rooms >> HASH) * np.uint64(SLOTS) + (rooms >> np.uint64(31)) % np.uint64(SLOTS)


_reader: list[Reader] = []


def _read(texts):
    if not _reader:
        _reader.append(Reader())
    return _reader[0].rooms(texts)


def pair_key(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words + contexts.astype(np.uint64) * _SPREAD


class Seating:
    """The dishes of some words in all restaurants, as flat arrays: pairs (word, context), groups (word, class), words.

    Of a batch, contexts are slots, whose restaurants are in the totals; a block's pairs bring the customers and tables of
    their rooms, and `ones` counts the pairs of each group that are not among them and sit at one table.
    """

    ones, rooms, place = 0.0, None, None

    def __init__(self, batch):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        flat = {k: column[k].flatten().to_numpy(zero_copy_only=False) for k in ("u", "train", "n", "t") if k in column}
        sizes = column["u"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        self.w = column["w"].to_numpy().view(np.uint64)
        self.u, self.n = flat["u"].astype(np.int64), flat.get("n")
        self.train, self.t = flat["train"].astype(np.float64), flat["t"].astype(np.float64)
        self.word = np.repeat(np.arange(len(sizes)), sizes)
        kind = self.u // SLOTS
        first = np.concatenate([[True], (self.word[1:] != self.word[:-1]) | (kind[1:] != kind[:-1])])[: len(self.u)]
        self.group = np.cumsum(first) - 1
        self.group_word, self.group_class = self.word[first], kind[first]
        sent = self.received(self.t, self.group, self.group_class)
        if "t1" in column:
            self.t1 = column["t1"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            self.t0 = column["t0"].to_numpy(zero_copy_only=False).astype(np.float64)
        else:
            self.t1 = np.minimum(sent, 1.0)
            self.t0 = np.minimum(self.received(self.t1, self.group_word, self.w), 1.0)

    @classmethod
    def of_block(cls, x: dict[str, np.ndarray]) -> Seating:
        """The kept pairs of a block; `t`, `t1`, `t0` are as after the last sweep, or one table where there are customers."""
        s = cls.__new__(cls)
        s.w, s.train, s.group = x["w"].view(np.uint64), x["kt"].astype(np.float64), np.repeat(np.arange(len(x["kg"])), x["kg"])
        s.group_word, s.group_class, s.ones = np.repeat(np.arange(len(s.w)), x["gs"]), x["gk"].astype(np.int64), x["ones"].astype(np.float64)
        s.word = s.group_word[s.group]
        s.u = slot_of(x["ku"].view(np.uint64)).astype(np.int64)
        s.t = x["t"].astype(np.float64) if "t" in x else np.minimum(s.train, 1.0)
        s.t1 = x["t1"].astype(np.float64) if "t" in x else np.minimum(s.sent(), 1.0)
        s.t0 = x["t0"].astype(np.float64) if "t" in x else np.minimum(s.received(s.t1, s.group_word, s.w), 1.0)
        # Rooms of one slot draw each on their own.
        same = s.word * CONTEXTS + s.u
        order = np.argsort(same, kind="stable")
        first = np.flatnonzero(np.diff(same[order], prepend=-1))
        rank = np.empty(len(same), np.int64)
        rank[order] = np.arange(len(same)) - np.repeat(first, np.diff(first, append=len(same)))
        s.place = s.u + 1 + 2 * CONTEXTS * rank
        return s

    def sent(self) -> np.ndarray:
        """Customers of each group."""
        return self.received(self.t, self.group, self.group_class) + self.ones

    def held(self, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each pair's restaurant."""
        return self.rooms or (totals.customers[0][self.u], totals.tables[0][self.u])

    @staticmethod
    def received(tables: np.ndarray, to: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Customers that tables send to each dish of the level above."""
        return np.bincount(to, weights=tables, minlength=len(like))

    def classes(self, totals: Totals, s: Settings) -> np.ndarray:
        """The predictive probability of each group, given all seatings."""
        d, all_c, all_t = totals.discounts, totals.customers, totals.tables
        c0 = self.received(self.t1, self.group_word, self.w)
        base = 1.0 / (totals.known + 1)
        p0 = (c0 - d[2] * self.t0 + (s.strengths[2] + d[2] * all_t[2]) * base) / (s.strengths[2] + all_c[2])
        k = self.group_class
        return (self.sent() - d[1] * self.t1 + (s.strengths[1] + d[1] * all_t[1][k]) * p0[self.group_word]) / (s.strengths[1] + all_c[1][k])

    def likely(self, totals: Totals, s: Settings) -> np.ndarray:
        """The predictive probability of each pair, given all seatings."""
        d, (room_c, room_t) = totals.discounts[0], self.held(totals)
        return (self.train - d * self.t + (s.strengths[0] + d * room_t) * self.classes(totals, s)[self.group]) / (s.strengths[0] + room_c)

    def sweep(self, totals: Totals, s: Settings, step: int) -> None:
        """Draws the tables of every dish anew, from the restaurants of words up to the root."""
        d, all_c, all_t = totals.discounts, totals.customers, totals.tables
        base = 1.0 / (totals.known + 1)
        k, room_t = self.group_class, self.held(totals)[1]
        c0 = self.received(self.t1, self.group_word, self.w)
        c1 = self.sent()
        root = (s.strengths[2] + d[2] * all_t[2]) * base
        p0 = (c0 - d[2] * self.t0 + root) / (s.strengths[2] + all_c[2])
        # A dish's own customers are not among everybody else: they leave the parent, with its tables if no others stay.
        others = c1[self.group] - self.t
        held = np.minimum(self.t1[self.group], others)
        up = (s.strengths[1] + d[1] * all_t[1][k]) * p0[self.group_word]
        p1 = (others - d[1] * held + up[self.group]) / (s.strengths[1] + all_c[1][k])[self.group]
        fresh = (s.strengths[0] + d[0] * np.maximum(room_t - self.t, 0.0)) * p1
        self.t = draw(self.train, fresh, d[0], self.chance(self.word, self.u + 1 if self.place is None else self.place, s, step))
        c1 = self.sent()
        others = c0[self.group_word] - self.t1
        held = np.minimum(self.t0[self.group_word], others)
        p0 = (others - d[2] * held + root) / (s.strengths[2] + all_c[2])
        fresh = (s.strengths[1] + d[1] * np.maximum(all_t[1][k] - self.t1, 0.0)) * p0
        self.t1 = draw(c1, fresh, d[1], self.chance(self.group_word, k + CONTEXTS + 1, s, step))
        c0 = self.received(self.t1, self.group_word, self.w)
        fresh = (s.strengths[2] + d[2] * np.maximum(all_t[2] - self.t0, 0.0)) * base
        self.t0 = draw(c0, fresh, d[2], self.chance(np.arange(len(self.w)), np.zeros(len(self.w), np.int64), s, step))

    def chance(self, word: np.ndarray, place: np.ndarray, s: Settings, step: int) -> np.ndarray:
        """A number in (0, 1) for each dish that depends on its word, its restaurant and the sweep alone."""
        with np.errstate(over="ignore"):
            return uniform(self.w[word] + place.astype(np.uint64) * _SPREAD + np.uint64((s.seed << 20) + step))


@lru_cache(maxsize=8)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers S(c, t): S(c + 1, t) = S(c, t - 1) + (c - t * discount) * S(c, t)."""
    found = np.full((most + 1, most + 1), -np.inf)
    found[0, 0] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for c in range(most):
            found[c + 1, 1:] = np.logaddexp(found[c, :-1], np.log(np.maximum(c - t * discount, 0.0)) + found[c, 1:])
    return found


def draw(customers: np.ndarray, fresh: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    """Numbers of tables for dishes with so many customers, where a new table weighs `fresh`; `chance` is in (0, 1).

    Up to EXACT customers by inversion of their exact distribution. Larger parties are seated in turn, an eighth of
    those seated at a time, with the expected number of new tables rounded at random.
    """
    tables = np.minimum(customers, 1.0)
    order = np.flatnonzero((customers > 1) & (customers <= EXACT))
    order = order[np.argsort(customers[order], kind="stable")]
    size, start = np.unique(customers[order], return_index=True)
    logs = stirling(discount)
    for c, at in zip(size.astype(int), np.split(order, start[1:])):
        weight = logs[c, 1 : c + 1] + np.log(fresh[at])[:, None] * np.arange(1, c + 1)
        weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        tables[at] = 1 + (weight < (chance[at] * weight[:, -1])[:, None]).sum(axis=1)
    active = np.flatnonzero(customers > EXACT)
    seated, turn = np.ones(len(active)), chance[active]
    while len(active):
        t, a = tables[active], fresh[active]
        step = np.minimum(np.maximum(1.0, np.floor(seated / 8)), customers[active] - seated)
        expected = step * a / (seated + (step - 1) / 2 - discount * t + a)
        tables[active] = t + np.minimum(np.floor(expected + turn), step)
        seated, turn = seated + step, (turn + 0.6180339887498949) % 1.0
        left = seated < customers[active]
        active, seated, turn = active[left], seated[left], turn[left]
    return tables


def _discount(once: float, twice: float) -> float:
    return float(min(0.95, max(0.05, once / (once + 2 * twice)))) if once else 0.5


def count_pairs(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (b, w, size, u, train, n) of arrays: the pairs of each task's texts in sums, by buckets of words; docs has held and text."""
    ddl = "b int, w array<bigint>, size array<int>, u array<bigint>, train array<int>, n array<int>"
    fields = _fields(ddl)

    def flush(words, rooms, held):
        w, u, h = np.concatenate(words), np.concatenate(rooms), np.concatenate(held)
        key = pair_key(w, u)
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first, n = order[starts], np.diff(starts, append=len(key)).astype(np.int32)
        train = np.add.reduceat((~h[order]).astype(np.int32), starts)
        by = np.argsort(w[first])
        w, u, train, n = w[first[by]], u[first[by]], train[by], n[by]
        of = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        b, ends = _dealt(bucket_of(w, buckets))
        words_end = np.searchsorted(of, ends).astype(np.int32)
        size = np.diff(of, append=len(w)).astype(np.int32)
        return _table(
            fields, len(b), b=b, w=_lists(words_end, w[of].view(np.int64)), size=_lists(words_end, size),
            u=_lists(ends, u.view(np.int64)), train=_lists(ends, train), n=_lists(ends, n),
        )

    def run(batches: Iterator) -> Iterator:
        words, rooms, held, size = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                for out, (w, u) in zip(some.column(0).to_pylist(), _read(some.column(1).to_pylist()), strict=True):
                    words.append(w)
                    rooms.append(u)
                    held.append(np.full(len(w), out))
                    size += len(w)
                if size >= BUFFER:
                    yield flush(words, rooms, held)
                    words, rooms, held, size = [], [], [], 0
        if size:
            yield flush(words, rooms, held)

    return docs.select("held", "text").mapInArrow(run, ddl).repartitionById(buckets, F.col("b"))


def word_blocks(parts: DataFrame) -> DataFrame:
    """One row per block of whole words, of arrays: words (w, training count c, number of groups gs), groups (class gk, pairs
    at one table that are not kept), kept pairs (room ku, kt of kn in training) and pairs met once (ru, rt); kg and rg count them by group."""
    ddl = "b int, block bigint, w array<bigint>, c array<bigint>, gs array<int>, gk array<smallint>, ones array<int>, ku array<bigint>, kg array<int>, kt array<bigint>, kn array<bigint>, ru array<bigint>, rg array<int>, rt array<tinyint>"
    fields = _fields(ddl)

    def run(batches: Iterator) -> Iterator:
        found = {name: [] for name in ("b", "w", "size", "u", "train", "n")}
        for batch in batches:
            for name, parts in found.items():
                x = batch.column(batch.schema.get_field_index(name))
                parts.append((x if name == "b" else x.flatten()).to_numpy())
        if not found["b"]:
            return
        b, w, size, u, train, n = map(np.concatenate, found.values())
        w, u = np.repeat(w, size), u.view(np.uint64)
        order = np.lexsort((u, w))
        w, u = w[order], u[order]
        word = np.concatenate([[True], w[1:] != w[:-1]])
        starts = np.flatnonzero(word | np.concatenate([[True], u[1:] != u[:-1]]))
        train, n = (np.add.reduceat(x[order].astype(np.int64), starts) for x in (train, n))
        w, u, word = w[starts], u[starts], word[starts]
        kind = (u >> HASH).astype(np.int16)
        first = word | np.concatenate([[True], kind[1:] != kind[:-1]])
        group, words = np.cumsum(first) - 1, np.flatnonzero(word)
        groups = np.flatnonzero(first)
        cuts = np.append(words[np.flatnonzero(np.diff(words // BLOCK, prepend=-1))], len(w))
        for i, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            of, own = words[slice(*np.searchsorted(words, (low, high)))], groups[slice(*np.searchsorted(groups, (low, high)))]
            kept = np.flatnonzero(n[low:high] > 1) + low
            rare = np.flatnonzero(n[low:high] == 1) + low
            columns = {
                "w": w[of], "c": np.add.reduceat(train[low:high], of - low), "gs": np.diff(np.searchsorted(own, of), append=len(own)).astype(np.int32), "gk": kind[own],
                "ones": np.bincount(group[rare] - group[low], train[rare], len(own)).astype(np.int32),
                "ku": u[kept].view(np.int64), "kg": np.bincount(group[kept] - group[low], minlength=len(own)).astype(np.int32), "kt": train[kept], "kn": n[kept],
                "ru": u[rare].view(np.int64), "rg": np.bincount(group[rare] - group[low], minlength=len(own)).astype(np.int32), "rt": train[rare].astype(np.int8),
            }
            yield _table(fields, 1, b=b[:1], block=np.array([(int(b[0]) << 32) + i]), **{k: _lists([0, len(x)], x) for k, x in columns.items()})

    return parts.mapInArrow(run, ddl)


#: Kinds of rows between the sweeps: a block's pairs, its tables, what it asks of rooms and is told, and rooms' sums.
BLOCKS, TABLES, ASKED, TOLD, ROOMS = range(5)
_STEP = "kind int, b int, block bigint, r int, us array<bigint>, cs array<bigint>, ts array<bigint>, t array<bigint>, t1 array<bigint>, t0 array<bigint>, p1 array<float>, sum array<float>, sums array<bigint>"
_KEPT = ("w", "c", "gs", "gk", "ones", "ku", "kg", "kt")
_RARE = ("kn", "ru", "rg", "rt")


def room_bucket(rooms: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(rooms.view(np.uint64) << np.uint64(9), buckets)


def _by_room(rooms: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rooms by bucket, the buckets that occur, and the ends of their runs."""
    bucket = room_bucket(rooms, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, *_dealt(bucket[order])


def _whole_blocks(batches: Iterator, buckets: int) -> Iterator[tuple[int, int, dict[str, np.ndarray], Seating]]:
    """(b, block, arrays, seating) of blocks whose rows stand together, the block's pairs first."""

    def ready(at, x, told):
        s = Seating.of_block(x)
        if told:
            order = _by_room(x["ku"], buckets)[0]
            s.rooms = np.zeros(len(order)), np.zeros(len(order))
            for i in range(2):
                s.rooms[i][order] = np.concatenate([part[i] for _, part in sorted(told.items())])
        return (*at, x, s)

    at, x, told = None, {}, {}
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns))
        for i in range(batch.num_rows):
            here = column["b"][i].as_py(), column["block"][i].as_py()
            kind = column["kind"][i].as_py()
            if here != at and at is not None:
                yield ready(at, x, told)
                x, told = {}, {}
            at = here
            if kind == TOLD:
                told[column["r"][i].as_py()] = column["cs"][i].values.to_numpy(), column["ts"][i].values.to_numpy()
                continue
            for name in (*_KEPT, *_RARE) if kind == BLOCKS else ("t", "t1", "t0", "p1", "sum"):
                if name in column and column[name][i].is_valid:
                    x[name] = column[name][i].values.to_numpy()
    if at is not None:
        yield ready(at, x, told)


def _sampled(x: dict[str, np.ndarray], s: Seating, totals: Totals, settings: Settings) -> None:
    """Adds a sample: the groups' probabilities, and the kept pairs' to their sums."""
    x["p1"] = np.concatenate([x.get("p1", np.zeros(0)), s.classes(totals, settings)])
    x["sum"] = x.get("sum", 0.0) + s.likely(totals, settings)


def _seated(blocks: DataFrame, buckets: int, settings: Settings, totals: Totals | None = None, step: int = -1) -> DataFrame:
    """Each block's tables after a sweep (of step -1: before all), their sums, and what they ask of rooms."""
    fields = _fields(_STEP)

    def run(batches: Iterator) -> Iterator:
        for b, block, x, s in _whole_blocks(batches, buckets):
            if step >= settings.burn_in:
                _sampled(x, s, totals, settings)
            if step >= 0:
                s.sweep(totals, settings, step)
            c1, c0, k = s.sent(), s.received(s.t1, s.group_word, s.w), s.group_class
            counts = [(c == n).sum() for c in (s.train, c1, c0) for n in (1, 2)]
            counts[0] += s.ones.sum()
            sums = np.concatenate([np.bincount(k, c1, CLASSES), np.bincount(k, s.t1, CLASSES), [c0.sum(), s.t0.sum(), (s.t0 > 0).sum(), x["c"].sum()], counts])
            told = {"t": s.t, "t1": s.t1, "t0": s.t0, "sums": sums}
            columns = {name: _lists([0, len(v)], v.astype(np.int64)) for name, v in told.items()}
            columns |= {name: _lists([0, len(x[name])], x[name].astype(np.float32)) for name in ("p1", "sum") if name in x}
            yield _table(fields, 1, kind=[TABLES], b=[b], block=[block], **columns)
            order, r, ends = _by_room(x["ku"], buckets)
            if len(r):
                yield _table(
                    fields, len(r), kind=[ASKED] * len(r), b=[b] * len(r), block=[block] * len(r), r=r, us=_lists(ends, x["ku"][order]),
                    cs=_lists(ends, x["kt"][order]), ts=_lists(ends, s.t[order].astype(np.int64)),
                )

    return blocks.mapInArrow(run, _STEP)


def _heard(asked: DataFrame, buckets: int) -> DataFrame:
    """What each room holds of all that is sent to its bucket: to every asking block in the order it asked, and by room."""
    fields = _fields(_STEP)

    def run(batches: Iterator) -> Iterator:
        askers, us, cs, ts = [], [], [], []
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                askers.append((column["kind"][i].as_py(), column["b"][i].as_py(), column["block"][i].as_py(), column["r"][i].as_py()))
                us.append(column["us"][i].values.to_numpy())
                cs.append(column["cs"][i].values.to_numpy() if column["cs"][i].is_valid else np.ones(len(us[-1]), np.int64))
                ts.append(column["ts"][i].values.to_numpy() if column["ts"][i].is_valid else cs[-1])
        if not askers:
            return
        rooms, at = np.unique(np.concatenate(us), return_inverse=True)
        c, t = (np.bincount(at, np.concatenate(x), len(rooms)).astype(np.int64) for x in (cs, ts))
        start = 0
        for (kind, b, block, r), u in zip(askers, us):
            of = at[start : start + len(u)]
            start += len(u)
            if kind == ASKED:
                yield _table(fields, 1, kind=[TOLD], b=[b], block=[block], r=[r], cs=_lists([0, len(of)], c[of]), ts=_lists([0, len(of)], t[of]))
        order, r, ends = _by_room(rooms, buckets)
        yield _table(fields, len(r), kind=[ROOMS] * len(r), r=r, us=_lists(ends, rooms[order]), cs=_lists(ends, c[order]), ts=_lists(ends, t[order]))

    return asked.repartitionById(buckets, F.col("r")).mapInArrow(run, _STEP)


def _rare_rooms(blocks: DataFrame, buckets: int) -> DataFrame:
    """The rooms of training pairs met once, to their buckets: a customer at a table each."""
    fields = _fields(_STEP)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                rooms = batch.column(0)[i].values.to_numpy()[batch.column(1)[i].values.to_numpy() > 0]
                order, r, ends = _by_room(rooms, buckets)
                if len(r):
                    yield _table(fields, len(r), kind=[ROOMS] * len(r), r=r, us=_lists(ends, rooms[order]))

    return blocks.select("ru", "rt").mapInArrow(run, _STEP)


def _totals(state: DataFrame, discounts: tuple[float, float, float] | None = None) -> Totals:
    """Customers and tables of the classes and the root; the discounts, if not given, from dishes with one and two customers."""
    found = state.where(F.col("kind") == TABLES).select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    sums = np.zeros(2 * CLASSES + 10)
    for r in found:
        sums[r.pos] = r.n
    c1, t1, (c0, t0, known, tokens), counts = np.split(sums, [CLASSES, 2 * CLASSES, 2 * CLASSES + 4])
    guess = tuple(_discount(*counts[2 * i : 2 * i + 2]) for i in range(3))
    # Rooms are in no one's totals: what is known of them all is their customers.
    return Totals((np.array([tokens]), c1, c0), (np.zeros(1), t1, t0), discounts or guess, int(known))


def _met(blocks: DataFrame, state: DataFrame, heard: DataFrame, buckets: int, *more: str) -> DataFrame:
    """Blocks with their tables and what they are told of rooms, rows of a block together."""
    pairs = blocks.select(F.lit(BLOCKS).alias("kind"), "b", "block", *_KEPT, *more)
    tables = state.where(F.col("kind") == TABLES).select("kind", "b", "block", "t", "t1", "t0", "p1", "sum")
    told = heard.where(F.col("kind") == TOLD).select("kind", "b", "block", "r", "cs", "ts")
    every = pairs.unionByName(tables, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    return every.repartitionById(buckets, F.col("b")).sortWithinPartitions("b", "block", "kind")


def chain(blocks: DataFrame, buckets: int, settings: Settings) -> tuple[DataFrame, Totals, list[DataFrame]]:
    """The sweeps: burn-in, then a sweep between samples. Returns scores, the last totals and the rooms' sums of each sample.

    Scores are blocks: w, c, gs, of kept pairs ku, kg, kn and mean, of pairs met once ru, rg, rt, and p1: the groups'
    probabilities, sample by sample.
    """
    spark = blocks.sparkSession
    single = materialize(_heard(_rare_rooms(blocks, buckets), buckets), "lm-single")
    first = blocks.select(F.lit(BLOCKS).alias("kind"), "b", "block", *_KEPT)
    state, rooms, totals = materialize(_seated(first, buckets, settings), "lm-tables"), [], None
    for step in range(settings.burn_in + settings.samples):
        totals = _totals(state, totals and totals.discounts)
        asked = state.where(F.col("kind") == ASKED).unionByName(single)
        heard = materialize(_heard(asked, buckets), "lm-rooms")
        if step >= settings.burn_in:
            # The rooms are the same at every step, in the same order: the first sample names them.
            rooms.append(materialize(heard.where(F.col("kind") == ROOMS).select("r", *(() if rooms else ("us",)), "cs", "ts"), "lm-rooms"))
        if step == settings.burn_in + settings.samples - 1:
            break
        after = materialize(_seated(_met(blocks, state, heard, buckets), buckets, settings, totals, step), "lm-tables")
        for x in (state, heard):
            release(spark, x)
        state = after
    ddl = "b int, block bigint, w array<bigint>, c array<bigint>, gs array<int>, ku array<bigint>, kg array<int>, kn array<bigint>, mean array<float>, ru array<bigint>, rg array<int>, rt array<tinyint>, p1 array<float>"
    fields = _fields(ddl)

    def run(batches: Iterator) -> Iterator:
        for b, block, x, s in _whole_blocks(batches, buckets):
            _sampled(x, s, totals, settings)
            x["mean"], x["p1"] = (x["sum"] / settings.samples).astype(np.float32), x["p1"].astype(np.float32)
            yield _table(fields, 1, b=[b], block=[block], **{name: _lists([0, len(x[name])], x[name]) for name in fields.names[2:]})

    scores = materialize(_met(blocks, state, heard, buckets, *_RARE).mapInArrow(run, ddl), "lm-scores")
    for x in (state, single, heard):
        release(spark, x)
    return scores, totals, rooms


def _kept(batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, rooms, words' training counts, counts, means) of the kept pairs of each block of scores."""
    column = dict(zip(batch.schema.names, batch.columns))
    for i in range(batch.num_rows):
        w, c, gs, ku, kg, kn, mean = (column[name][i].values.to_numpy() for name in ("w", "c", "gs", "ku", "kg", "kn", "mean"))
        word = np.repeat(np.repeat(np.arange(len(w)), gs), kg)
        yield pair_key(w.view(np.uint64)[word], ku.view(np.uint64)), ku, c[word], kn, mean


def hot_pairs(scores: DataFrame, most: int = HOT_PAIRS):
    """The kept pairs above a count, as many as fit the bound: sorted keys, counts, scores (arrays), and the count."""

    def sizes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                n, pairs = np.unique(batch.column(0)[i].values.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(pairs)], names=["n", "pairs"])

    by_count = scores.select("kn").mapInArrow(sizes, "n bigint, pairs bigint").groupBy("n").agg(F.sum("pairs").alias("pairs"))
    # From the largest count down; at most the bound's number of distinct counts is looked at.
    limit, held = None, 0
    for r in by_count.orderBy(F.desc("n")).limit(most).toLocalIterator():
        held += r.pairs
        if held > most:
            break
        limit = r.n
    if limit is None:
        return np.array([], np.uint64), np.array([], np.int64), np.array([]), None

    def often(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for p, _, c, n, mean in _kept(batch):
                hot = n >= limit
                yield pa.RecordBatch.from_arrays([pa.array(p[hot].view(np.int64)), pa.array(c[hot]), pa.array(mean[hot])], names=["p", "c", "mean"])

    hot = scores.select("w", "c", "gs", "ku", "kg", "kn", "mean").mapInArrow(often, "p bigint, c bigint, mean float").toArrow()
    p = hot.column("p").to_numpy().view(np.uint64)
    order = np.argsort(p)
    return p[order], hot.column("c").to_numpy()[order], np.log10(hot.column("mean").to_numpy()[order].astype(np.float64)), limit


def bucket_of(p: np.ndarray, buckets: int) -> np.ndarray:
    """Each key's bucket: even ranges of the keys."""
    return (((p >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur in a rising list, and the ends of their runs."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[starts], np.append(starts, len(bucket)).astype(np.int32)


#: What travels to the buckets of rooms: rooms' sums, kept pairs with their scores, pairs met once with what makes theirs, then
#: pairs of documents, and what is known of documents already.
SUMS, SCORES, ONCE, PAIRS, HEADS = range(5)


def _table(fields, rows: int, **columns):
    """A batch of a schema, null in all columns that are not given."""
    import pyarrow as pa

    def column(f):
        x = columns.get(f.name)
        if x is None:
            return pa.nulls(rows, f.type)
        return x if isinstance(x, pa.Array) else pa.array(x, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in fields], schema=fields)


def _fields(ddl: str):
    """The Arrow schema of a schema's text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _lists(ends, values: np.ndarray, kind=None):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def add_one(c, tokens: int, known: int):
    """The base model: log10 of the add-one estimate for a word with training count c."""
    return np.log10((c + 1.0) / (tokens + 1.0 * (known + 1)))


def score_documents(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `held` is a boolean column over `docs`: rows where it is true (not null) are scored but not learned from. Tokens
    are the words without ASCII white space, A-Z in lower case, and an end; null and empty texts have the end alone.
    Words are known by 64-bit hashes. Without training rows every probability is the base's. Rows that repeat are
    learned and scored each; an empty table gives no rows. Other columns are not read. The sampled score is the same
    in a rerun, whatever the partitions, up to the rounding of sums.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(held, F.lit(False)).alias("held"),
        F.col(text_col).cast("string").alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    blocks = materialize(word_blocks(count_pairs(rows, buckets)), "lm-words")
    scores, totals, rooms = chain(blocks, buckets, settings)
    release(spark, blocks)
    keys, counts, likely, limit = hot_pairs(scores)
    shared = spark.sparkContext.broadcast((keys, counts, likely))
    tokens, known = totals.tokens, totals.known
    # Counts of words and of pairs in a text: int where no count can be beyond it.
    count = "int" if tokens < 1 << 30 else "bigint"
    strength, discount, samples = settings.strengths[0], totals.discounts[0], settings.samples
    head = f"rid bigint, doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    sent = f"b int, kind int, {head}, ps array<bigint>, ks array<{count}>, at array<int>, means array<float>, us array<bigint>, cs array<bigint>, ts array<bigint>, sample int"
    fields, heads = _fields(sent), _fields(head)
    pa_float = fields.field("means").type.value_type

    def rest(batches: Iterator) -> Iterator:
        many = fields.field("ks").type.value_type
        for batch in batches:
            for p, u, c, n, mean in _kept(batch):
                rare = np.flatnonzero(n < limit) if limit is not None else np.arange(len(n))
                order, b, ends = _by_room(u[rare], buckets)
                order = rare[order]
                if len(b):
                    yield _table(fields, len(b), b=b, kind=[SCORES] * len(b), ps=_lists(ends, p[order].view(np.int64)), ks=_lists(ends, c[order], many), means=_lists(ends, mean[order], pa_float))
            column = dict(zip(batch.schema.names, batch.columns))
            found, size = [], 0
            for i in range(batch.num_rows):
                w, c, gs, u, group, train, p1 = (column[name][i].values.to_numpy() for name in ("w", "c", "gs", "ru", "rg", "rt", "p1"))
                group = np.repeat(np.arange(len(group)), group)
                word = np.repeat(np.arange(len(w)), gs)[group]
                found.append((pair_key(w.view(np.uint64)[word], u.view(np.uint64)), u, 2 * c[word] + train, p1.reshape(samples, -1)[:, group].T))
                size += len(u)
                if size and (size >= SCORED or i == batch.num_rows - 1):
                    p, u, k, p1 = map(np.concatenate, zip(*found))
                    found, size = [], 0
                    bucket = room_bucket(u, buckets)
                    order = np.lexsort((u, bucket))
                    u, (b, ends) = u[order], _dealt(bucket[order])
                    own = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                    rooms_end = np.searchsorted(own, ends).astype(np.int32)
                    # A pair met once carries its word's count, whether it was in training, and its class's probability in each sample.
                    yield _table(
                        fields, len(b), b=b, kind=[ONCE] * len(b), ps=_lists(ends, p[order].view(np.int64)), ks=_lists(ends, k[order], many),
                        means=_lists(ends * samples, p1[order].ravel(), pa_float), us=_lists(rooms_end, u[own]), at=_lists(rooms_end, np.diff(own, append=len(u)).astype(np.int32)),
                    )

    def once(row, rooms, sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, words' training counts, mean probabilities) of pairs met once."""
        ks, us, p1 = row["ks"], row["us"], row["means"].astype(np.float64).reshape(-1, samples)
        train, mean, held = ks % 2, 0.0, np.zeros((2, len(us)))
        if rooms is not None:
            j = np.minimum(np.searchsorted(rooms, us), len(rooms) - 1)
            known = rooms[j] == us
        for i in range(samples):
            if rooms is not None:
                held[:, known] = [x[j[known]] for x in sums[i]]
            c, t = np.repeat(held, row["at"], axis=1)
            mean = mean + ((1 - discount) * train + (strength + discount * t) * p1[:, i]) / (strength + c) / samples
        return row["ps"].view(np.uint64), ks // 2, mean

    def read(batches: Iterator) -> Iterator:
        keys, counts, likely = shared.value
        base, heard = add_one(counts, tokens, known), counts > 0

        def flush(told, found) -> Iterator:
            import pyarrow as pa

            sizes = np.array([len(w) for w, _ in found])
            texts = len(sizes)
            u = np.concatenate([u for _, u in found])
            p = pair_key(np.concatenate([w for w, _ in found]), u)
            order = np.argsort(p, kind="stable")
            p, u, at = p[order], u[order], np.repeat(np.arange(texts, dtype=np.uint16), sizes)[order]
            starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (at[1:] != at[:-1])]))
            k = np.diff(starts, append=len(p))
            p, u, at = p[starts], u[starts], at[starts]
            i = np.minimum(np.searchsorted(keys, p), max(0, len(keys) - 1))
            hit = keys[i] == p if len(keys) else np.zeros(len(p), bool)
            i, kh, ah = i[hit], k[hit], at[hit]
            of = lambda x: np.bincount(ah, weights=kh * x, minlength=texts)
            rid, ids, out = (pa.concat_arrays(x) for x in zip(*told))
            rids = rid.to_numpy()
            yield _table(
                fields, texts, b=(rids % buckets).astype(np.int32), kind=np.full(texts, HEADS, np.int32), rid=rid, doc_id=ids, held_out=out,
                n_tokens=sizes, n_known=of(heard[i]).astype(np.int64), base_score=of(base[i]), score=of(likely[i]),
            )
            p, u, k, at = p[~hit], u[~hit], k[~hit], at[~hit]
            # By bucket, and there by text, so that texts stand in runs.
            order = np.argsort(at, kind="stable")
            bucket = room_bucket(u[order], buckets)
            again = np.argsort(bucket, kind="stable")
            order = order[again]
            b, ends = _dealt(bucket[again])
            if len(b):
                offsets = (rids - rids[0]).astype(np.int32)
                yield _table(
                    fields, len(b), b=b, kind=np.full(len(b), PAIRS, np.int32), rid=np.full(len(b), rids[0]), ps=_lists(ends, p[order].view(np.int64)),
                    ks=_lists(ends, k[order], fields.field("ks").type.value_type), at=_lists(ends, offsets[at[order]]),
                )

        told, found, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                told.append(some.columns[:3])
                for x in _read(some.column(3).to_pylist()):
                    found.append(x)
                    size += len(x[0])
                if size >= SCORED or len(found) + GROUP > SCORED_TEXTS:
                    yield from flush(told, found)
                    told, found, size = [], [], 0
        if found:
            yield from flush(told, found)

    def meet(batches: Iterator) -> Iterator:
        held, table, of, named, sums = [], None, None, None, {}
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            b, kind = column["b"].to_numpy(), column["kind"].to_numpy()
            ready = np.flatnonzero(kind == HEADS)
            if len(ready):
                yield batch.take(ready).select(heads.names)
            for i in np.flatnonzero(kind != HEADS).tolist():
                if b[i] != of:
                    held, table, of, named, sums = [], None, b[i], None, {}
                row = {name: column[name][i].values.to_numpy() for name in ("ps", "ks", "at", "means", "us", "cs", "ts") if column[name][i].is_valid}
                if kind[i] == SUMS:
                    sums[column["sample"][i].as_py()] = row["cs"], row["ts"]
                    named = row.get("us", named)
                    continue
                if kind[i] == SCORES:
                    held.append((row["ps"].view(np.uint64), row["ks"], row["means"].astype(np.float64)))
                    continue
                if kind[i] == ONCE:
                    held.append(once(row, named, sums))
                    continue
                if table is None:
                    p0, c0, m0 = map(np.concatenate, zip(*held))
                    order = np.argsort(p0)
                    held, table = [], (p0[order], c0[order], m0[order])
                at, k = row["at"], row["ks"]
                j = np.searchsorted(table[0], row["ps"].view(np.uint64))
                c, mean = table[1][j], table[2][j]
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                found = [np.add.reduceat(x, starts) for x in (k * (c > 0), k * add_one(c, tokens, known), k * np.log10(mean))]
                yield _table(heads, len(starts), rid=column["rid"][i].as_py() + at[starts].astype(np.int64), n_known=found[0].astype(np.int64), base_score=found[1], score=found[2])

    # A bucket's scores come before the documents' pairs.
    every = scores.mapInArrow(rest, sent).unionByName(rows.mapInArrow(read, sent))
    for i, heard in enumerate(rooms):
        whole = heard.withColumnRenamed("r", "b").withColumns({"kind": F.lit(SUMS), "sample": F.lit(i)})
        every = every.unionByName(whole, allowMissingColumns=True)
    parts = every.repartitionById(buckets, F.col("b")).sortWithinPartitions("b", "kind").mapInArrow(meet, head)
    return parts.groupBy("rid").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
    ).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame, column: str = "score") -> float:
    """Perplexity per token over the held-out rows."""
    r = scored.where("held_out").agg(F.sum(column).alias("s"), F.sum("n_tokens").alias("n")).first()
    return 10 ** (-r.s / r.n) if r.n else float("nan")
