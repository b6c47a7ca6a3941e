"""Terms, weights, retrieval, language models and overlap scores of documents.

Documents are rows (id, text). Everything is an explode into terms and aggregates per term or per document and term;
nothing holds a vocabulary in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, sized
from .strings import subsequence_length

TOKEN = r"(?U)\b\w\w+\b"
WORD = r"[A-Za-z']+"
#: Matches of patterns that a task holds before it gives them on.
MATCHES = 1 << 16
#: Bytes of labels' weights that travel with a job, labels at most, and characters whose trigrams a task holds at a time.
GRAM_BYTES, LABELS, CHARS = 48 << 20, 256, 1 << 20


def tokens(df: DataFrame, id_col: str, text_col: str, pattern: str = TOKEN, lowercase: bool = True) -> DataFrame:
    """(id, pos, term): every match of the token pattern, in order."""
    text = F.lower(text_col) if lowercase else F.col(text_col)
    return df.select(id_col, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "term"))


def ngrams(terms: Column, low: int, high: int) -> Column:
    """All n-grams of an array of terms, for n from low to high, joined by a space."""
    return F.flatten(F.array(*[_grams_of(terms, n) for n in range(low, high + 1)]))


def _grams_of(terms: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.size(terms) - n + 1), lambda i: F.array_join(F.slice(terms, i, n), " "))
    return F.when(F.size(terms) >= n, grams).otherwise(F.array().cast("array<string>"))


def count_terms(df: DataFrame, id_col: str, text_col: str, ngram_range=(1, 1), min_df: float = 1, max_df: float = 1.0, max_features: int | None = None, binary: bool = False) -> DataFrame:
    """(id, term, tf), over the terms whose document frequency lies in the bounds (int: counts, float: shares).

    A document's terms are counted where its text stands; only rows that share an id meet in a shuffle.
    """
    words = F.regexp_extract_all(F.lower(text_col), F.lit(TOKEN), F.lit(0))
    if ngram_range != (1, 1):
        df = df.select(id_col, words.alias("_w"))
        words = ngrams(F.col("_w"), *ngram_range)
    tf = _runs(df.select(id_col, F.sort_array(words).alias("_t")), id_col)
    if not df.groupBy(id_col).count().where("count > 1").isEmpty():
        tf = tf.groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))
    if (min_df, max_df, max_features) != (1, 1.0, None):
        # Counted once, and written: the bounds and the result read the table, not the texts.
        tf = materialize(tf, "counted")
        n = df.count() if isinstance(min_df, float) or isinstance(max_df, float) else 1
        low = min_df * n if isinstance(min_df, float) else min_df
        high = max_df * n if isinstance(max_df, float) else max_df
        terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df").between(low, high))
        if max_features is not None:
            terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
        tf = tf.join(sized(materialize(terms.select("term"), "bounded")), "term", "left_semi").select(id_col, "term", "tf")
    return tf.withColumn("tf", F.lit(1).cast("long")) if binary else tf


def _runs(df: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf) from (id, _t: sorted terms): where a term differs from the one before it, its run begins."""
    begins = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: (i == 1) | (F.get("_t", i - 1) != F.get("_t", i - 2)))
    starts = df.select(id_col, "_t", F.when(F.size("_t") > 0, begins).alias("_b"))
    run = lambda j: F.struct(F.get("_t", F.get("_b", j) - 1).alias("term"), (F.coalesce(F.get("_b", j + 1), F.size("_t") + 1) - F.get("_b", j)).cast("long").alias("tf"))
    listed = starts.select(id_col, F.when(F.size("_b") > 0, F.transform(F.sequence(F.lit(0), F.size("_b") - 1), run)).alias("_r"))
    # An inner explode, or a filter on the arrays, would have Spark compute them anew in a filter below, term by term.
    return listed.select(id_col, F.explode_outer("_r").alias("_r")).where("_r is not null").select(id_col, "_r.term", "_r.tf")


def vocabulary(tf: DataFrame) -> DataFrame:
    """(term, index): terms in code point order, numbered from 0 without one task for all of them."""
    from .ordering import numbered

    return numbered(tf.select("term").distinct(), ["term"]).select("term", F.col("_at").alias("index"))


def tfidf(df: DataFrame, id_col: str, text_col: str, smooth: bool = True, norm: str | None = "l2", **options) -> DataFrame:
    """(id, term, weight): tf * (ln((n + s) / (df + s)) + 1), each document scaled to length one."""
    # Counted once, and written: frequencies, weights and lengths read the table of terms, not the texts.
    tf = materialize(count_terms(df, id_col, text_col, **options), "terms")
    s, n = 1 if smooth else 0, df.count()
    idf = materialize(tf.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.ln((n + s) / (F.col("df") + s)) + 1).alias("idf")), "idf")
    weighed = tf.join(sized(idf), "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("weight"))
    if norm is None:
        return weighed
    # Lengths are summed in the tasks first; only beyond what is broadcast do all terms go to their documents.
    size = F.sqrt(F.sum(F.col("weight") ** 2)) if norm == "l2" else F.sum(F.abs("weight"))
    lengths = materialize(weighed.groupBy(id_col).agg(size.alias("_l")).withColumnRenamed(id_col, "_id"), "lengths")
    met = weighed.join(sized(lengths), F.col(id_col).eqNullSafe(F.col("_id")))
    return met.select(id_col, "term", (F.col("weight") / F.col("_l")).alias("weight"))


def hashed_terms(df: DataFrame, id_col: str, text_col: str, n_features: int = 1 << 18, alternate_sign: bool = True) -> DataFrame:
    """(id, feature, value): white-space tokens summed into hashed features."""
    flat = df.select(id_col, F.explode(F.split(F.trim(F.lower(text_col)), r"\s+")).alias("term")).where("term <> ''")
    h = F.xxhash64("term")
    sign = F.when(F.shiftright(h, 62).bitwiseAND(F.lit(1)) == 0, 1.0).otherwise(-1.0) if alternate_sign else F.lit(1.0)
    return flat.groupBy(id_col, F.pmod(h, F.lit(n_features)).cast("int").alias("feature")).agg(F.sum(sign).alias("value"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, id, score): all documents that share a term with a query, scored; join and sum, no pair without a term."""
    tf = materialize(count_terms(docs, id_col, text_col), "terms")
    n, total = docs.count(), tf.agg(F.sum("tf")).first()[0] or 0
    asked = materialize(tokens(queries, query_id, query_text).select(query_id, "term"), "asked")
    # Only the queries' terms and the documents that have one of them are looked at from here on.
    wanted = asked.select("term").distinct()
    found = materialize(tf.join(sized(wanted), "term"), "found")
    idf = found.groupBy("term").agg(F.count("*").alias("df")).select("term", F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    lengths = tf.groupBy(id_col).agg(F.sum("tf").alias("len"))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (total / n if total else 1.0)))
    gains = found.join(sized(lengths, n), id_col).join(sized(idf), "term").select("term", id_col, (F.col("idf") * gain).alias("_g"))
    return gains.join(sized(asked), "term").groupBy(query_id, id_col).agg(F.sum("_g").alias("score"))


def top_per_query(scores: DataFrame, query_id: str, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bigrams(df: DataFrame, id_col: str, text_col: str, pattern: str = WORD) -> DataFrame:
    """(id, pos, a, b): neighbouring words."""
    words = df.select(id_col, F.regexp_extract_all(F.lower(text_col), F.lit(pattern), F.lit(0)).alias("_t"))
    n = F.greatest(F.size("_t") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_t", 1, n), F.slice("_t", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # Outer: else Spark reads the texts once more for a filter on the pairs.
    return words.select(id_col, F.posexplode_outer(pairs).alias("pos", "g")).where("g is not null").select(id_col, "pos", "g.a", "g.b")


def collocations(df: DataFrame, id_col: str, text_col: str, min_count: int = 2, top_k: int | None = 10) -> DataFrame:
    """a, b, n, pmi: the word pairs that stand together more than chance would have it; all of them without `top_k`."""
    words = tokens(df, id_col, text_col, WORD)
    uni = words.groupBy("term").agg(F.count("*").alias("c"))
    n1 = F.broadcast(words.agg(F.count("*").alias("n1")))
    big = bigrams(df, id_col, text_col)
    n2 = F.broadcast(big.agg(F.count("*").alias("n2")))
    pairs = big.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    joined = pairs.join(uni.select(F.col("term").alias("a"), F.col("c").alias("ca")), "a").join(uni.select(F.col("term").alias("b"), F.col("c").alias("cb")), "b").crossJoin(n1).crossJoin(n2)
    pmi = F.log2((F.col("n") / F.col("n2")) / (F.col("ca") / F.col("n1") * (F.col("cb") / F.col("n1"))))
    scored = joined.select("a", "b", "n", pmi.alias("pmi"))
    return scored if top_k is None else scored.orderBy(F.desc("pmi"), F.desc("n"), "a", "b").limit(top_k)


def _bigram_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, n), counted once and written: what follows reads pairs, not texts."""
    return materialize(bigrams(df, id_col, text_col).groupBy("a", "b").agg(F.count("*").alias("n")), "bigrams")


def kneser_ney(df: DataFrame, id_col: str, text_col: str, discount: float = 0.75) -> DataFrame:
    """(a, b, p): interpolated Kneser-Ney probabilities of the bigrams seen."""
    counts = _bigram_counts(df, id_col, text_col)
    context = materialize(counts.groupBy("a").agg(F.sum("n").alias("na"), F.count("*").alias("ka")), "contexts")
    ends = materialize(counts.groupBy("b").agg(F.count("*").alias("kb")), "ends")
    kinds = F.broadcast(counts.agg(F.count("*").alias("k")))
    p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("na") + discount * F.col("ka") / F.col("na") * (F.col("kb") / F.col("k"))
    return counts.join(sized(context), "a").join(sized(ends), "b").crossJoin(kinds).select("a", "b", p.alias("p"))


def add_k_bigrams(df: DataFrame, id_col: str, text_col: str, k: float = 1.0) -> DataFrame:
    """(a, b, p): bigram probabilities with k added to every count."""
    words = tokens(df, id_col, text_col, WORD)
    v = F.broadcast(words.agg(F.count_distinct("term").alias("v")))
    counts = _bigram_counts(df, id_col, text_col)
    context = materialize(counts.groupBy("a").agg(F.sum("n").alias("na")), "contexts")
    return counts.join(sized(context), "a").crossJoin(v).select("a", "b", ((F.col("n") + k) / (F.col("na") + k * F.col("v"))).alias("p"))


def good_turing(counts: DataFrame, count_col: str) -> DataFrame:
    """(r, n, adjusted): counts of counts and the adjusted count (r + 1) n[r + 1] / n[r] where the next one exists."""
    g = counts.groupBy(F.col(count_col).alias("r")).agg(F.count("*").alias("n"))
    nxt = g.select((F.col("r") - 1).alias("r"), F.col("n").alias("m"))
    return g.join(nxt, "r", "left").select("r", "n", F.coalesce((F.col("r") + 1) * F.col("m") / F.col("n"), F.col("r").cast("double")).alias("adjusted"))


def trigram_counts(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """(keep..., gram, n): character trigrams of the lower-cased text padded with two blanks before and one after."""
    t = F.concat(F.lit("  "), F.lower(text_col), F.lit(" "))
    # Characters first: the i-th of a string is found by going through all before it.
    part = lambda i: F.slice("_c", i, F.size("_c") - 2)
    grams = F.zip_with(F.zip_with(part(1), part(2), lambda x, y: F.concat(x, y)), part(3), lambda x, y: F.concat(x, y))
    flat = df.select(*keep, F.split(t, "").alias("_c")).select(*keep, F.explode(grams).alias("gram"))
    return flat.groupBy(*keep, "gram").agg(F.count("*").alias("n"))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of padded texts as numbers, 21 bits a character, and how many each text has."""
    sizes = np.array([len(t) + 1 for t in texts])
    c = np.frombuffer("".join([f"  {t} " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = np.ones(len(c), bool)
    ends = np.cumsum(sizes + 2)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    return c[at] << 42 | c[at + 1] << 21 | c[at + 2], sizes


def _batches_of_texts(batches: Iterator) -> Iterator[tuple[list, list[str]]]:
    """The first column and the texts of rows that have a text, CHARS at a time."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None:
                continue
            keys.append(key)
            texts.append(text)
            size += len(text)
            if size >= CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
        if texts:
            yield keys, texts


def _coded_counts(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(label, code, n): the trigrams of each label's texts, summed in the tasks first."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[label_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator) -> Iterator:
        for keys, texts in _batches_of_texts(batches):
            codes, sizes = _codes(texts)
            names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            label = np.repeat([names[k] for k in keys], sizes)
            for k, i in names.items():
                found, n = np.unique(codes[label == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), arrow), pa.array(found), pa.array(n)], names=["label", "code", "n"])

    told = df.select(label_col, F.lower(text_col).alias("t")).where("t is not null").mapInArrow(run, f"label {kind.simpleString()}, code bigint, n bigint")
    return told.groupBy("label", "code").agg(F.sum("n").alias("n"))


def language_scores(train: DataFrame, docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, predicted): naive Bayes over character trigrams, add-one, without prior; ties to the first label.

    The labels' weights of at most GRAM_BYTES, counted first, travel to the texts, which are scored where they stand; others
    meet the texts' trigrams in a join.
    """
    c = materialize(_coded_counts(train, text_col, label_col), "grams")
    total = c.groupBy("label").agg(F.sum("n").alias("total"))
    v = c.agg(F.count_distinct("code").alias("v")).first().v
    n = total.count()
    if not 0 < n <= LABELS or v * 8 * (n + 1) > GRAM_BYTES:
        return _joined_scores(train, docs, id_col, text_col, label_col)
    labels = total.orderBy("label").collect()
    held = c.select("code").distinct().orderBy("code").toArrow().column("code").to_numpy()
    weights = np.zeros((n, v))
    for i, r in enumerate(labels):
        # A text that has no label's trigram, or a label that is null, gains nothing.
        own = c.where(F.col("label") == F.lit(r.label)).select("code", "n").toArrow()
        weights[i, np.searchsorted(held, own.column("code").to_numpy())] = np.log(own.column("n").to_numpy() + 1.0)
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator) -> Iterator:
        for keys, texts in _batches_of_texts(batches):
            codes, sizes = _codes(texts)
            at = np.minimum(np.searchsorted(held, codes), len(held) - 1)
            known = held[at] == codes
            starts = np.cumsum(sizes) - sizes
            gains = [np.add.reduceat(np.where(known, w[at], 0.0), starts) for w in weights]
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(np.stack(gains, 1).ravel()))], names=["id", "size", "gains"])

    told = docs.where(F.col(id_col).isNotNull()).select(id_col, F.lower(text_col).alias("t")).where("t is not null").mapInArrow(run, f"id {kind.simpleString()}, size bigint, gains array<double>")
    sums = told.groupBy("id").agg(F.sum("size").alias("size"), *[F.sum(F.col("gains")[i]).alias(f"g{i}") for i in range(n)])
    each = F.array(*[F.struct((F.col(f"g{i}") - F.col("size") * math.log(r.total + v)).alias("s"), F.lit(r.label).alias("label")) for i, r in enumerate(labels)])
    scored = sums.select("id", each.alias("e")).withColumn("m", F.array_max("e.s"))
    top = F.filter("e", lambda x: F.abs(x["s"] - F.col("m")) < 1e-9)
    return scored.select(F.col("id").alias(id_col), F.array_min(F.transform(top, lambda x: x["label"])).alias("predicted"))


def _joined_scores(train: DataFrame, docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """As `language_scores`, by joins."""
    c = materialize(trigram_counts(train, text_col, label_col), "grams")
    total = c.groupBy(F.col(label_col).alias("label")).agg(F.sum("n").alias("total"))
    v = F.broadcast(c.agg(F.count_distinct("gram").alias("v")))
    base = total.crossJoin(v).select("label", (F.col("total") + F.col("v")).alias("under"))
    mine = materialize(trigram_counts(docs, text_col, id_col), "own-grams")
    size = mine.groupBy(id_col).agg(F.sum("n").alias("size"))
    # A gram that a label lacks adds ln(1 / under) to it; what it has adds ln(count + 1) on top.
    hits = mine.join(sized(c.select("gram", F.col(label_col).alias("label"), F.col("n").alias("m"))), "gram").groupBy(id_col, "label").agg(F.sum(F.col("n") * F.ln(F.col("m") + 1.0)).alias("gain"))
    every = size.join(F.broadcast(base))
    scored = materialize(every.join(hits, [id_col, "label"], "left").select(id_col, "label", (F.coalesce("gain", F.lit(0.0)) - F.col("size") * F.ln("under")).alias("s")), "scored")
    best = F.max(F.struct("s", F.lit(0).alias("z")))
    top = scored.groupBy(id_col).agg(best.alias("m"))
    return scored.join(top, id_col).where(F.abs(F.col("s") - F.col("m.s")) < 1e-9).groupBy(id_col).agg(F.min("label").alias("predicted"))


def soundex(word: Column) -> Column:
    """The Soundex code of the letters of a word; 0000 without letters."""
    letters = F.regexp_replace(word, "[^A-Za-z]", "")
    return F.when(F.coalesce(letters, F.lit("")) == "", "0000").otherwise(F.soundex(letters))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ; other lengths raise."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), differ).otherwise(F.raise_error(F.lit("strings differ in length")).cast("int"))


def _gram_counts(df: DataFrame, id_col: str, text_col: str, n: int, chars: bool) -> DataFrame:
    if chars:
        grams = F.transform(F.sequence(F.lit(1), F.length("_s") - n + 1), lambda i: F.substr(F.col("_s"), i, F.lit(n)))
        base = df.select(id_col, F.regexp_replace(text_col, r"\s+", "").alias("_s")).where(F.length("_s") >= n)
    else:
        base = df.select(id_col, F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0)).alias("_s")).where(F.size("_s") >= n)
        grams = ngrams(F.col("_s"), n, n)
    return base.select(id_col, F.explode(grams).alias("g")).groupBy(id_col, "g").agg(F.count("*").alias("c"))


def overlaps(df: DataFrame, id_col: str, reference: str, candidate: str, n: int, chars: bool = False) -> DataFrame:
    """(id, hit, ref, cand): clipped common n-grams of two text columns, and the n-grams of each."""
    r = _gram_counts(df, id_col, reference, n, chars)
    c = _gram_counts(df, id_col, candidate, n, chars).withColumnRenamed("c", "d")
    both = r.join(c, [id_col, "g"], "full").groupBy(id_col).agg(
        F.sum(F.least(F.coalesce("c", F.lit(0)), F.coalesce("d", F.lit(0)))).alias("hit"),
        F.sum(F.coalesce("c", F.lit(0))).alias("ref"), F.sum(F.coalesce("d", F.lit(0))).alias("cand"),
    )
    return df.select(id_col).join(both, id_col, "left").select(id_col, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("hit", "ref", "cand")])


def rouge_n(df: DataFrame, id_col: str, reference: str, candidate: str, n: int = 1) -> DataFrame:
    o = overlaps(df, id_col, reference, candidate, n)
    p = F.when(F.col("cand") > 0, F.col("hit") / F.col("cand")).otherwise(0.0)
    r = F.when(F.col("ref") > 0, F.col("hit") / F.col("ref")).otherwise(0.0)
    return o.select(id_col, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def chrf(df: DataFrame, id_col: str, reference: str, candidate: str, max_n: int = 6, beta: float = 2.0) -> DataFrame:
    """Mean F-beta over character n-grams, for the n at which both sides have any."""
    parts = [overlaps(df, id_col, reference, candidate, n, chars=True) for n in range(1, max_n + 1)]
    every = parts[0]
    for o in parts[1:]:
        every = every.unionByName(o)
    p, r = F.col("hit") / F.col("cand"), F.col("hit") / F.col("ref")
    f = F.when(F.col("hit") > 0, (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(0.0)
    return every.groupBy(id_col).agg(F.coalesce(F.avg(F.when((F.col("ref") > 0) & (F.col("cand") > 0), f)), F.lit(0.0)).alias("chrf"))


def rake(df: DataFrame, id_col: str, text_col: str, stopwords: list[str], top_k: int = 5) -> DataFrame:
    """(id, phrase, score): runs of content words, scored by the sum of (degree + frequency) / frequency of their words.

    Stop words and the marks .,!?;:()" end a run; digits and all other characters only part words. A row is a document
    and is scored where it stands; nothing is shuffled.
    """
    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"[a-z']+|[.,!?;:()\"]"), F.lit(0))
    marks = F.transform(words, lambda w: F.when(w.isin(*stopwords, *'.,!?;:()"'), "\n").otherwise(w))
    phrases = F.filter(F.transform(F.split(F.array_join(marks, " "), "\n"), lambda p: F.trim(p)), lambda p: p != "")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, out, scores = [], [], []
            for i, found in enumerate(batch.column(1).to_pylist()):
                n, degree = Counter(), Counter()
                for phrase in found or ():
                    own = phrase.split(" ")
                    for w in own:
                        n[w] += 1
                        degree[w] += len(own) - 1
                scored = [(sum((degree[w] + n[w]) / n[w] for w in p.split(" ")), p) for p in set(found or ())]
                for score, phrase in sorted(scored, key=lambda x: (-round(x[0], 9), x[1]))[:top_k]:
                    at.append(i)
                    out.append(phrase)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(out, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "phrase", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, phrases.alias("phrases")).mapInArrow(run, f"`{id_col}` {kind}, phrase string, score double")


def word_array(text: Column) -> Column:
    """The words that the overlap scores count."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bleu(df: DataFrame, id_col: str, reference: str, candidate: str, max_n: int = 4) -> DataFrame:
    """(id, bleu): geometric mean of clipped n-gram precisions with a penalty for short candidates.

    Candidates of fewer than max_n words use fewer n; a precision of zero, or no words, gives zero.
    """
    sizes = df.select(id_col, F.size(word_array(F.col(reference))).alias("r"), F.size(word_array(F.col(candidate))).alias("c"))
    every = [overlaps(df, id_col, reference, candidate, n).withColumn("n", F.lit(n)) for n in range(1, max_n + 1)]
    flat = every[0]
    for o in every[1:]:
        flat = flat.unionByName(o)
    used = flat.join(sizes, id_col).where((F.col("n") <= F.col("c")))
    per = used.groupBy(id_col, "r", "c").agg(F.min("hit").alias("least"), F.avg(F.ln(F.greatest("hit", F.lit(1)) / F.greatest("cand", F.lit(1)))).alias("mean"))
    short = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.greatest("c", F.lit(1))))
    scored = per.select(id_col, F.when(F.col("least") == 0, 0.0).otherwise(short * F.exp("mean")).alias("bleu"))
    return df.select(id_col).join(scored, id_col, "left").select(id_col, F.coalesce("bleu", F.lit(0.0)).alias("bleu"))


def rouge_l(df: DataFrame, id_col: str, reference: str, candidate: str, beta: float = 1.2) -> DataFrame:
    """(id, rouge_l): F measure of the longest common subsequence of words."""
    r, c = word_array(F.col(reference)), word_array(F.col(candidate))
    common = df.select(id_col, subsequence_length(r, c).alias("l"), F.size(r).alias("r"), F.size(c).alias("c"))
    p, q = F.col("l") / F.greatest("c", F.lit(1)), F.col("l") / F.greatest("r", F.lit(1))
    return common.select(id_col, F.when(F.col("l") > 0, (1 + beta**2) * p * q / (q + beta**2 * p + 1e-12)).otherwise(0.0).alias("rouge_l"))


def meteor(df: DataFrame, id_col: str, reference: str, candidate: str, alpha: float = 0.9, gamma: float = 0.5, beta: float = 3.0) -> DataFrame:
    """(id, meteor): a mean of precision and recall, less for matches that are scattered over many runs.

    A candidate's word is matched while the reference still has one to spare, from left to right.
    """
    r = tokens(df, id_col, reference, WORD).groupBy(id_col, "term").agg(F.count("*").alias("have"))
    sizes = df.select(id_col, F.size(word_array(F.col(reference))).alias("r"), F.size(word_array(F.col(candidate))).alias("c"))
    c = tokens(df, id_col, candidate, WORD).withColumn("turn", F.row_number().over(Window.partitionBy(id_col, "term").orderBy("pos")))
    marked = c.join(r, [id_col, "term"], "left").withColumn("hit", (F.col("turn") <= F.coalesce("have", F.lit(0))).cast("int"))
    begins = (F.col("hit") == 1) & (F.coalesce(F.lag("hit").over(Window.partitionBy(id_col).orderBy("pos")), F.lit(0)) == 0)
    per = marked.withColumn("begins", begins.cast("int")).groupBy(id_col).agg(F.sum("hit").alias("m"), F.sum("begins").alias("k"))
    joined = df.select(id_col).join(per, id_col, "left").join(sizes, id_col)
    p, q = F.col("m") / F.col("c"), F.col("m") / F.col("r")
    score = p * q / (alpha * p + (1 - alpha) * q) * (1 - gamma * F.pow(F.col("k") / F.col("m"), F.lit(beta)))
    return joined.select(id_col, F.when(F.col("m") > 0, score).otherwise(0.0).alias("meteor"))


# How letters of English sound in a metaphone key. Groups are replaced first, in this order; then each
# letter takes the first row that has it and whose condition on the next letter holds. "" is silent; others sound as they are.
SOUND_GROUPS = {"PH": "F", "GH": "", "TH": "0", "SH": "X", "CH": "X"}
SOUNDS = [
    ("AEIOU", "not first", ""),
    ("C", "before IEY", "S"), ("C", "", "K"), ("Q", "", "K"), ("V", "", "F"), ("Z", "", "S"),
    ("WY", "before no vowel", ""),
]


def metaphone(word: Column) -> Column:
    """A consonant key of how an English word sounds, by the table of sounds; a letter that the key ends in adds nothing."""
    w = F.regexp_replace(F.upper(F.regexp_replace(word, "[^A-Za-z]", "")), r"([^C])\1", "$1")
    for group, sound in SOUND_GROUPS.items():
        w = F.replace(w, F.lit(group), F.lit(sound))
    letters = F.filter(F.split(w, ""), lambda c: c != "")
    pairs = F.transform(letters, lambda c, i: F.struct(c.alias("c"), F.coalesce(F.get(letters, i + 1), F.lit("-")).alias("after"), i.alias("i")))

    def sound_of(e: Column) -> Column:
        holds = {
            "": F.lit(True), "not first": e["i"] > 0, "before IEY": e["after"].isin(*"IEY"), "before no vowel": ~e["after"].isin(*"AEIOU"),
        }
        return F.coalesce(*[F.when(e["c"].isin(*of) & holds[when], F.lit(sound)) for of, when, sound in SOUNDS], e["c"])

    return F.aggregate(pairs, F.lit(""), lambda key, e: F.when(~e["c"].isin(*"AEIOU") & F.endswith(key, e["c"]), key).otherwise(F.concat(key, sound_of(e))))


def pattern_matches(df: DataFrame, id_col: str, text_col: str, patterns: list[str]) -> DataFrame:
    """(id, pattern, start): every place of every pattern, overlapping ones too, in one automaton pass over each text.

    The patterns are a parameter and travel with the plan, so they have to be few enough for a task's memory.
    """
    wanted = sorted({p for p in patterns if p})

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for p in wanted:
            automaton.add_word(p, p)
        automaton.make_automaton()

        def table(batch, at, found, starts):
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int64())], names=["id", "pattern", "start"])

        for batch in batches:
            # One text at a time, and matches leave when there are many: a batch of long texts has millions of them.
            at, found, starts = [], [], []
            for i in range(batch.num_rows if wanted else 0):
                for end, p in automaton.iter(batch.column(1)[i].as_py() or ""):
                    at.append(i)
                    found.append(p)
                    starts.append(end + 1 - len(p))
                    if len(at) == MATCHES:
                        yield table(batch, at, found, starts)
                        at, found, starts = [], [], []
            yield table(batch, at, found, starts)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, pattern string, start bigint")


def dictionary_terms(df: DataFrame, id_col: str, map_col: str) -> DataFrame:
    """(id, feature, value): a map column as numbered-by-name features: `name` for numbers, `name=value` for strings.

    The vectorizer of dictionaries in long form; the vocabulary is the distinct features.
    """
    flat = df.select(id_col, F.explode(map_col).alias("k", "v"))
    number = F.col("v").try_cast("double") if hasattr(F.col("v"), "try_cast") else F.expr("try_cast(v as double)")
    return flat.select(id_col, F.when(number.isNotNull(), F.col("k")).otherwise(F.concat("k", F.lit("="), "v")).alias("feature"), F.coalesce(number, F.lit(1.0)).alias("value"))


def topic_coherence(topics: DataFrame, docs_terms: DataFrame, id_col: str) -> DataFrame:
    """UMass coherence per topic of (topic, rank, term), against (id, term) pairs."""
    have = docs_terms.join(topics.select("term").distinct(), "term", "left_semi").select(id_col, "term").distinct()
    df = have.groupBy("term").agg(F.count("*").alias("d"))
    a = topics.select("topic", F.col("rank").alias("i"), F.col("term").alias("wi"))
    b = topics.select("topic", F.col("rank").alias("j"), F.col("term").alias("wj"))
    pairs = a.join(b, "topic").where("j < i")
    both = have.select(id_col, F.col("term").alias("wi")).join(have.select(id_col, F.col("term").alias("wj")), id_col).where("wi <> wj").groupBy("wi", "wj").agg(F.count("*").alias("n"))
    scored = pairs.join(both, ["wi", "wj"], "left").join(df.select(F.col("term").alias("wj"), "d"), "wj", "left")
    return scored.groupBy("topic").agg(F.sum(F.ln((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("d", F.lit(0)) + 1e-12))).alias("coherence"))
