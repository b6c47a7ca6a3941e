"""Frequent phrases and how strongly their words belong together, from vertical positional inverted lists.

The corpus is read once into blocks: the words of some documents of one language as codes of a block vocabulary, so that
a block holds, for every word, the list of its positions. Phrases grow a word at a time: in every block the sorted
positions of the frequent phrases are merge-joined with the postings of the words that stand right after them, and the
length of a joined list is that phrase's frequency in the block. Spark sums the lengths; what is frequent is a table, and
the blocks learn of it for the next word.

Sets of frequent phrases are counted. Up to `HELD` phrases go to the tasks as sorted arrays; beyond that every block
gets only its own phrases, by a join on the block. Both give the same lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, release, sized

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: A phrase goes if a longer candidate around it has at least this many hundredths of its frequency.
COVER = 100
#: UTF-8 bytes of text in the blocks that a task fills side by side, one for each language.
BLOCK_BYTES = 8 << 20
#: Frequent phrases of one length that tasks hold (24 bytes each); more are joined block by block.
HELD = 2_000_000
#: Salts of the first of two rounds of ranking: the second sees this many times `TOP` rows of a language at most.
SALTS = 32

_END = b"\xff"  # a byte that UTF-8 never has: the end of a piece
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(0xFF if c in _ENDS else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
INDEX = "block long, lang string, words array<string>, counts array<bigint>, codes binary"
#: Bits that number the rows of a partition in Spark's increasing ids.
_ROW_BITS = 33


class _Codes(dict):
    """Numbers for words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """What xxhash64(lang, word) gives for each word."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang, 42)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64).view(np.int64)


def _block(lang: str, texts: list[bytes]) -> dict:
    codes = _Codes({_END: 0})
    words = _END.join(texts).translate(_PLAIN).replace(_END, b" \xff ").split()
    at = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
    names = list(codes)[1:]
    counts = np.bincount(at, minlength=len(codes))[1:]
    return {"lang": lang, "words": [w.decode() for w in names], "counts": counts, "codes": at.tobytes()}


def index(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The corpus as blocks: a vocabulary with counts, and a code for every word (0 ends a piece)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])
        part, made, size = TaskContext.get().partitionId(), 0, 0
        open_texts: dict[str, list[bytes]] = {}

        def blocks() -> Iterator:
            nonlocal made
            for lang in list(open_texts):
                row = _block(lang, open_texts.pop(lang)) | {"block": part << 32 | made}
                made += 1
                yield pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                open_texts.setdefault(lang, []).append(data)
                size += len(data)
                if size >= block_bytes:
                    yield from blocks()
                    size = 0
        yield from blocks()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Known:
    """Frequent phrases by length: sorted keys (place of the phrase without its last word, place of that word), and ids."""

    keys: list[np.ndarray]
    ids: list[np.ndarray]


def known(words: tuple[np.ndarray, np.ndarray], longer: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Known:
    """From the hashes and ids of words, and for each greater length the ids of (phrase before, last word, phrase)."""
    by = np.argsort(words[0])
    keys, ids = [words[0][by]], [words[1][by]]

    def place(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        order = np.argsort(held)
        return order[np.searchsorted(held, wanted, sorter=order)] if len(order) else np.zeros(0, np.int64)

    for prefix, word, own in longer:
        key = place(ids[-1], prefix) * len(keys[0]) + place(ids[0], word)
        by = np.argsort(key)
        keys.append(key[by])
        ids.append(own[by])
    return Known(keys, ids)


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in sorted keys, -1 where it has none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def extended(hashes: np.ndarray, codes: np.ndarray, frequent: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a block one word longer than the longest known: (id before, last word, length of the list)."""
    of_code = np.concatenate([[-1], _place(frequent.keys[0], hashes)])
    number = of_code[codes]
    postings = np.flatnonzero(number >= 0)
    word = number[postings]
    at, phrase, n_words = postings, word, len(frequent.keys[0])
    for length in range(1, len(frequent.keys) + 1):
        following = _place(postings, at + length)
        hit = following >= 0
        if length > 1:
            # The same phrase without its first word is a list of this length, too.
            hit &= _place(at, at + 1) >= 0
        at, key = at[hit], phrase[hit] * n_words + word[following[hit]]
        if length < len(frequent.keys):
            phrase = _place(frequent.keys[length], key)
            at, phrase = at[phrase >= 0], phrase[phrase >= 0]
    found, lengths = np.unique(key, return_counts=True)
    return frequent.ids[-1][found // max(n_words, 1)], frequent.ids[0][found % max(n_words, 1)], lengths


def _lists(blocks: DataFrame, held, depth: int) -> DataFrame:
    """(block, prefix, word, n) of every block. `held` is a broadcast of Known, or None where rows carry their own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                block, lang, words, codes, *own = (batch.column(i)[row] for i in range(batch.num_columns))
                array = lambda x: x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)
                if held is None:
                    columns = [array(x) for x in own]
                    frequent = known((columns[0], columns[1]), [tuple(columns[i : i + 3]) for i in range(2, 3 * depth - 1, 3)])
                else:
                    frequent = held.value
                prefix, word, n = extended(word_hashes(lang.as_py(), words.as_py()), np.frombuffer(codes.as_py(), np.int32), frequent)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block.as_py())), pa.array(prefix), pa.array(word), pa.array(n.astype(np.int64))], names=["block", "prefix", "word", "n"])

    return blocks.mapInArrow(run, "block long, prefix long, word long, n long")


def _own(blocks: DataFrame, levels: list[DataFrame], lists: list[DataFrame]) -> DataFrame:
    """The blocks with the frequent phrases that each of them has, length by length."""
    out = blocks.select("block", "lang", "words", "codes")
    words = blocks.select("block", "lang", F.explode("words").alias("w")).select("block", F.xxhash64("lang", "w").alias("hash")).join(levels[0].select("hash", "id").hint("merge"), "hash")
    out = out.join(words.groupBy("block").agg(F.collect_list("hash").alias("hash1"), F.collect_list("id").alias("id1")), "block", "left")
    for k, (level, local) in enumerate(zip(levels[1:], lists), 2):
        mine = local.select("block", "prefix", "word").join(level.select("prefix", "word", "id").hint("merge"), ["prefix", "word"])
        per = mine.groupBy("block").agg(*[F.collect_list(c).alias(f"{c}{k}") for c in ("prefix", "word", "id")])
        out = out.join(per, "block", "left")
    return out


def _held(levels: list[DataFrame]):
    """The sets of frequent phrases as arrays in every task."""
    spark = levels[0].sparkSession

    def columns(df: DataFrame) -> tuple[np.ndarray, ...]:
        found = df.toArrow()
        return tuple(found.column(c).to_numpy() for c in df.columns)

    words = columns(levels[0].select("hash", "id"))
    return spark.sparkContext.broadcast(known(words, [columns(x.select("prefix", "word", "id")) for x in levels[1:]]))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """The table written, with ids from 0 without gaps: small numbers, as the lists are full of them."""
    rows = materialize(df.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", _ROW_BITS).cast("int")
    sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1))]).tolist()
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), part + 1)
    return rows.withColumn("id", first + F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_id")


def frequent_phrases(blocks: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, held: int = HELD) -> DataFrame:
    """lang, phrase (space-joined), words (how many), f: every phrase of 1 to `max_words` words met `min_count` times.

    Counts are exact: overlapping occurrences count, none reaches over the end of a piece. Words are known by 64-bit
    hashes within a language; two words of one hash end the job with an error rather than share a count.
    """
    none = F.lit(None).cast("long")
    entries = blocks.select("block", "lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("block", "lang", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    hashed = entries.withColumn("hash", F.xxhash64("lang", "word"))
    check = F.crc32("word") % (1 << 16)
    often = hashed.groupBy("hash").agg(F.sum("n").alias("f"), F.min("block").alias("block"), F.sum(F.col("n") * check).alias("checks")).where(F.col("f") >= min_count)
    # One block tells what word a hash stands for; the sum of a second hash tells whether all others mean the same.
    named = hashed.drop("n").join(sized(materialize(often, "counts")), ["hash", "block"])
    alone = F.when(F.col("checks") == check * F.col("f"), F.col("word")).otherwise(F.raise_error(F.lit("two words share a hash")).cast("string"))
    levels = [_numbered(named.select("hash", none.alias("prefix"), none.alias("word"), "lang", alone.alias("phrase"), "f"), "words")]
    sizes, lists = [levels[0].count()], []
    while sizes[-1] and len(levels) < max_words:
        if max(sizes) <= held:
            arrays = _held(levels)
            local = _lists(blocks.select("block", "lang", "words", "codes"), arrays, len(levels))
        else:
            # The lists of earlier lengths that were counted without their blocks are joined again here.
            while len(lists) < len(levels) - 1:
                k = len(lists) + 1
                lists.append(materialize(_lists(_own(blocks, levels[:k], lists), None, k), "lists"))
            local = materialize(_lists(_own(blocks, levels, lists), None, len(levels)), "lists")
            lists.append(local)
            arrays = None
        counts = local.groupBy("prefix", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
        before, last = levels[-1], levels[0]
        named = counts.join(sized(before.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head")), 3 * sizes[-1]), "prefix")
        named = named.join(sized(last.select(F.col("id").alias("word"), F.col("phrase").alias("tail")), 3 * sizes[0]), "word")
        levels.append(_numbered(named.select("prefix", "word", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"), "phrases"))
        sizes.append(levels[-1].count())
        if arrays is not None:
            arrays.unpersist()
    for x in lists:
        release(x.sparkSession, x)
    numbered = [x.select("lang", "phrase", F.lit(i).alias("words"), "f") for i, x in enumerate(levels, 1)]
    return reduce(DataFrame.unionByName, numbered)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    cover: int = COVER,
    held: int = HELD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `max_words` words of each language.

    A-Z are lowered, texts are cut at `.,;:!?` and line ends into pieces, pieces at spaces and tabs into words. a, l and
    r are the frequencies of a phrase and of its parts at the cut that scores least, n the words of the language, and
    score floor(1000 a n / (l r)) in exact integers. A phrase inside a longer candidate of the same frequency goes.
    Order: score, a, then the phrase by its bytes. A null language is `und`, null and empty texts have no words, rows
    that repeat count again; an empty table gives no rows. Other columns are not read.
    """
    blocks = materialize(index(docs, text_col, lang_col, block_bytes), "index")
    f = materialize(frequent_phrases(blocks, min_count, max_words, held), "frequent")
    rows = f.count()
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    candidates = f.where("words > 1").withColumnRenamed("f", "a").withColumn("parts", F.split("phrase", " "))
    join_words = lambda at, n: F.array_join(F.slice("parts", at, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join_words(F.lit(1), F.col("k")).alias("left"), join_words(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(sized(f.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), 3 * rows), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(totals, "lang").withColumns({"up": (big("a") * 1000).cast("decimal(19,0)") * big("n"), "down": big("l") * big("r")}).withColumn("score", F.expr("up div down"))
    least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    inner = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.select("lang", "a", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("from"))
    around = inner.groupBy("lang", join_words(F.col("from"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = least.join(around, ["lang", "phrase"], "left").where((F.col("longer") * 100 < F.col("a") * cover) | F.col("longer").isNull())
    # First within salts of a language, then among the best of each: no task ranks a whole language.
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("_r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
