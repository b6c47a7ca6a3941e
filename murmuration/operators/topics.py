"""Latent Dirichlet allocation by variational expectation and maximisation over a table of term counts.

Terms are numbered once, and a document's row is the arrays of its distinct terms and their counts, written once. Tasks
improve many documents side by side: one array holds the terms of all of them, and documents that no longer move leave it.
A document's step needs the topics' weights of its own terms only. Weights of at most WEIGHT_BYTES, counted first, travel
with a round's job; others meet the documents in a join on the term. What documents expect of a topic and term is summed in
the tasks, then by term. Topics are a table by term; only k totals, the bound and weights that travel come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import digamma_array, log_gamma_array
from ..store import materialize, release, sized
from .ordering import numbered

#: Inner rounds of a document's mixture, and the mean change that ends them.
INNER, MOVED = 100, 1e-5
#: Bytes of topics' weights that travel with a job; terms of documents that are improved side by side.
WEIGHT_BYTES, TERMS = 24 << 20, 1 << 18


def _log_theta(gamma: np.ndarray) -> np.ndarray:
    return digamma_array(gamma) - digamma_array(gamma.sum(1, keepdims=True))


def _mixtures(counts: np.ndarray, beta: np.ndarray, sizes: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents' variational mixtures, and beta times what each of their terms expects; beta: terms x topics.

    The terms of one document stand together, `sizes` of them, one at least.
    """
    gamma = np.ones((len(sizes), beta.shape[1]))
    at, n, b, size = np.arange(len(sizes)), counts, beta, sizes
    for _ in range(INNER):
        theta = np.exp(_log_theta(gamma[at]))
        share = n / (np.einsum("tk,tk->t", b, np.repeat(theta, size, 0)) + 1e-100)
        told = alpha + theta * np.add.reduceat(share[:, None] * b, np.cumsum(size) - size, 0)
        going = np.abs(told - gamma[at]).mean(1) >= MOVED
        gamma[at] = told
        if not going.any():
            break
        if not going.all():
            kept = np.repeat(going, size)
            at, n, b, size = at[going], n[kept], b[kept], size[going]
    theta = np.repeat(np.exp(_log_theta(gamma)), sizes, 0)
    return gamma, beta * theta * (counts / (np.einsum("tk,tk->t", beta, theta) + 1e-100))[:, None]


def _documents(documents: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, terms, n, beta): a row for each document, beta flattened by term."""
    flat = documents.select("id", F.explode(F.arrays_zip("terms", "n")).alias("x")).select("id", F.col("x.terms").alias("at"), F.col("x.n").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("at", "n", "beta")))
    return flat.join(weights, "at").groupBy("id").agg(listed.alias("l")).select("id", F.col("l.at").alias("terms"), F.col("l.n").alias("n"), F.flatten("l.beta").alias("beta"))


def _step(documents: DataFrame, held: np.ndarray | None, k: int, alpha: float, kind: str, give: str) -> DataFrame:
    """`give` is "topics": (at, expected) and documents' share of the bound (at null); or "mixtures": (id, mixture).

    `held` are the weights by number of the term; without it the documents bring their own.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def table(x: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, k, dtype=np.int32)), pa.array(x.ravel()))

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, counts = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            beta = None if held is not None else batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):
                begin = ends[first] - sizes[first]
                last = max(first + 1, int(np.searchsorted(ends, begin + TERMS, "right")))
                of, part = slice(begin, ends[last - 1]), sizes[first:last]
                own = held[terms[of]] if held is not None else beta[of]
                gamma, expected = _mixtures(counts[of], own, part, alpha)
                if give == "mixtures":
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), table(gamma / gamma.sum(1, keepdims=True))], names=["id", "mixture"])
                else:
                    log_theta = _log_theta(gamma)
                    bounds = counts[of] @ np.log(np.einsum("tk,tk->t", own, np.repeat(np.exp(log_theta), part, 0)) + 1e-100)
                    bounds += ((alpha - gamma) * log_theta + log_gamma_array(gamma)).sum() - log_gamma_array(gamma.sum(1)).sum()
                    bounds += len(part) * (log_gamma_array(np.array([alpha * k]))[0] - k * log_gamma_array(np.array([alpha]))[0])
                    found, place = np.unique(terms[of], return_inverse=True)
                    told = np.stack([np.bincount(place, expected[:, j], len(found)) for j in range(k)], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([*found.tolist(), None], pa.int64()), table(np.vstack([told, np.full((1, k), bounds)]))], names=["at", "expected"])
                first = last

    return documents.mapInArrow(run, "at bigint, expected array<double>" if give == "topics" else f"id {kind}, mixture array<double>")


def latent_dirichlet(counts: DataFrame, id_col: str, topics: int = 10, alpha: float = 0.1, eta: float = 0.01, rounds: int = 20, seed: int = 5) -> tuple[DataFrame, DataFrame, list[float]]:
    """(term, weights: its probability in each topic), (id, mixture), and the bound on the log likelihood of every round.

    `counts` is (id, term, tf), as `text.count_terms` gives. The bound never falls, up to the rounding and the end of
    the inner rounds. Starts are drawn by hash of the term. Documents without terms have no mixture.
    """
    k = topics
    kind = counts.schema[id_col].dataType.simpleString()
    c = materialize(counts.select(F.col(id_col).alias("id"), F.col("term").cast("string").alias("term"), F.col("tf").cast("double").alias("n")).where("term is not null and n > 0"), "counts")
    words = materialize(numbered(c.select("term").distinct(), ["term"]).select(F.col("_at").cast("long").alias("at"), "term"), "words")
    size = words.count()
    listed = F.sort_array(F.collect_list(F.struct("at", "n")))
    documents = c.join(sized(words, size), "term").groupBy("id").agg(listed.alias("l")).select("id", F.col("l.at").alias("terms"), F.col("l.n").alias("n"))
    documents = materialize(documents, "documents")
    draw = lambda j: F.pmod(F.xxhash64(F.concat(F.lit(f"{seed}:{j}:"), F.col("term"))), F.lit(1_000_003)) / 1_000_003.0
    lam = materialize(words.select("at", F.array(*[0.5 + draw(j) for j in range(k)]).alias("lam")), "topics")

    def step(weights: DataFrame, give: str) -> DataFrame:
        if size * k * 8 > WEIGHT_BYTES:
            return _step(_documents(documents, weights.select("at", "beta")), None, k, alpha, kind, give)
        told = weights.select("at", "beta").toArrow()
        held = np.zeros((size, k))
        if told.num_rows:
            held[told.column("at").to_numpy()] = told.column("beta").combine_chunks().flatten().to_numpy().reshape(-1, k)
        return _step(documents, held, k, alpha, kind, give)

    bounds: list[float] = []
    for _ in range(rounds):
        total = _totals(lam, k)
        weights = _log_weights(lam, total, k)
        told = step(weights, "topics").groupBy("at").agg(F.array(*[F.sum(F.col("expected")[j]) for j in range(k)]).alias("e"))
        told = materialize(told, "told")
        bound = (told.where("at is null").select(F.col("e")[0]).first() or [0.0])[0]
        bounds.append(bound + _topic_bound(weights, total, eta, size, k))
        new = F.array(*[F.lit(eta) + F.col("e")[j] for j in range(k)])
        after = materialize(told.where("at is not null").select("at", new.alias("lam")), "topics")
        for x in (lam, told):
            release(x.sparkSession, x)
        lam = after
    total = _totals(lam, k)
    mixtures = step(_log_weights(lam, total, k), "mixtures")
    share = F.array(*[F.col("lam")[j] / float(total[j]) for j in range(k)])
    return lam.join(sized(words, size), "at").select("term", share.alias("weights")), mixtures.withColumnRenamed("id", id_col), bounds


def _totals(lam: DataFrame, k: int) -> np.ndarray:
    return np.array([x or 0.0 for x in lam.agg(*[F.sum(F.col("lam")[j]) for j in range(k)]).first()])


def _log_weights(lam: DataFrame, total: np.ndarray, k: int) -> DataFrame:
    """(at, lam, log_beta, beta): expected log weights of each topic, and their exponentials."""
    base = digamma_array(np.maximum(total, 1e-300))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        doubles = pa.list_(pa.float64())
        for batch in batches:
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            log = digamma_array(own) - base
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(log), doubles), pa.array(list(np.exp(log)), doubles)], names=["at", "lam", "log_beta", "beta"])

    return lam.select("at", "lam").mapInArrow(run, "at bigint, lam array<double>, log_beta array<double>, beta array<double>")


def _topic_bound(weights: DataFrame, total: np.ndarray, eta: float, size: int, k: int) -> float:
    """What the topics' own distributions add to the bound."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own, log = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([float(((eta - own) * log + log_gamma_array(own)).sum())])], names=["b"])

    found = weights.select("lam", "log_beta").mapInArrow(run, "b double").agg(F.sum("b")).first()[0] or 0.0
    g = lambda x: float(log_gamma_array(np.atleast_1d(np.asarray(x, float))).sum())
    return found - g(total) + k * (g(eta * max(size, 1)) - size * g(eta))


def top_terms(topics: DataFrame, n: int = 10) -> DataFrame:
    """(topic, rank, term): the heaviest terms of each topic, as `text.topic_coherence` reads them; ties by term."""
    k = topics.select(F.max(F.size("weights"))).first()[0] or 0
    found = None
    for j in range(k):
        best = topics.select("term", F.col("weights")[j].alias("w")).orderBy(F.desc("w"), "term").limit(n)
        listed = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "term"))).alias("l"))
        one = listed.select(F.lit(j).cast("long").alias("topic"), F.posexplode("l.term").alias("rank", "term")).select("topic", F.col("rank").cast("long").alias("rank"), "term")
        found = one if found is None else found.unionByName(one)
    return found
