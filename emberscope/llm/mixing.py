"""Mixing to target weights with soft domain membership; DataFrame functions only.

A classifier learned from labelled rows gives every document posteriors over the domains.  Document rates, numbers not
below zero, are then fitted so that the expected tokens of each domain, ``sum(rate * tokens * posterior)``, meet targets in
the least-squares sense.  Each step of the projected gradient is one aggregation over the documents, whose result has one
number per domain; the rates themselves stay in the table.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.common import fresh, saved

#: At most about this many labelled rows teach the classifier.  Its vocabulary are all their terms that tell a domain:
#: in ``LEAST_ROWS`` texts at least, and more frequent in a domain than in the others by ``LEAST_GAP`` deviations.  Among n
#: texts a term that tells them apart without fail has sqrt(n), so of few texts the share ``LEAST_SHARE`` of that is asked for.
SAMPLE, LEAST_ROWS, LEAST_GAP, LEAST_SHARE = 10_000, 5, 4.0, 0.15
#: Longer words are a second term by their beginning.
BEGINNING = 5
#: Posteriors are calibrated: evidence of n terms counts as that of n ** temper, and each domain has an intercept.  These
#: lose least on the part of the labelled rows, one in ``HELD_OUT``, that the vocabulary of the trial was not learned from.
TEMPERS, HELD_OUT = tuple(i / 10 for i in range(3, 11)), 3
DOMAINS = ("good", "low", "toxic")
#: Shares of the token budget; the budget is the tokens there are.
TARGETS = {"good": 0.85, "low": 0.10, "toxic": 0.05}
STEPS, STEPS_A_TABLE, TOLERANCE = 64, 16, 1e-6


#: Letters and digits of ASCII come first: most characters need no look at their Unicode class.
_SYMBOLS = r"[^a-zA-Z0-9\s.,;:?'\"\-\p{L}\p{N}]"


def _term_rows(documents: DataFrame, *columns: str, once: bool = False) -> DataFrame:
    """One row per term: the words of a text, the beginnings of longer ones, and terms for its form.

    These tell symbols per word, the share of different words, and how many words there are.  Words are cut at blanks
    and punctuation.  The words are a column of their own, so that a text is cut once.  With ``once`` a repeated word is one row.
    """
    words = documents.select(
        *columns, F.split(F.lower("text"), r"[\s.,;:!?]+", -1).alias("words"), F.regexp_count("text", F.lit(_SYMBOLS)).alias("symbols")
    )
    different = words.select(*columns, "symbols", "words", F.greatest(F.size("words"), F.lit(1)).alias("n"), F.array_distinct("words").alias("different"))
    levels = {
        "symbols": F.floor(F.log2(1 + 8 * F.col("symbols") / F.col("n"))),
        "different": F.floor(8 * F.size("different") / F.col("n")),
        "words": F.floor(F.log2("n")),
    }
    form = F.array(*(F.concat(F.lit(f"\x01{name[:3]}"), level.cast("string")) for name, level in levels.items()))
    whole = different.select(*columns, F.explode(F.concat("different" if once else "words", form)).alias("word"))
    beginning = F.concat(F.lit("\x02"), F.substring("word", 1, BEGINNING))
    longer = (F.length("word") > BEGINNING) & ~F.startswith("word", F.lit("\x01"))
    return whole.select(*columns, F.explode(F.when(longer, F.array(F.col("word"), beginning)).otherwise(F.array("word"))).alias("term"))


def domains_of_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` of quality and toxicity labels; rows without a label of either kind are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


class Classifier(NamedTuple):
    """``vocabulary``: ``(term, w_<domain>...)``; logarithms of the priors; the tempering exponent."""

    vocabulary: DataFrame
    prior: list[float]
    temper: float


def learn(documents: DataFrame, labelled: DataFrame, domains: tuple[str, ...], sample: int = SAMPLE) -> Classifier:
    """Term weights from labelled documents, tempered as held-out rows want it.

    Of several domains of an id the last by name counts.  Without labelled rows all domains are equally likely.
    """
    ids = labelled.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    share = min(1.0, sample / max(1, ids.count()))
    drawn = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = _texts(documents).join(F.broadcast(drawn), "doc_id")  # about ``sample`` rows of an id and a name
    rows = rows.groupBy(F.xxhash64("text").alias("fp")).agg(F.max("domain").alias("domain"), F.any_value("text").alias("text"))
    rows = saved(rows.withColumn("held", F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(HELD_OUT)) == 0))
    terms = saved(_term_rows(rows, "fp", "domain", "held", once=True))
    trial = _weighted(rows.where("not held"), terms.where("not held"), domains)
    evidence = terms.where("held").join(F.broadcast(trial[0]), "term").groupBy("fp", "domain").agg(
        F.count("*").alias("hits"), *(F.sum(f"w_{d}").alias(f"s_{d}") for d in domains)
    )
    # about a third of the sample, a few numbers a row
    prior, temper = _calibrated(evidence.select("domain", "hits", *(f"s_{d}" for d in domains)).collect(), domains, trial[1])
    vocabulary, counted = _weighted(rows, terms, domains)
    return Classifier(vocabulary, [a + b - c for a, b, c in zip(counted, prior, trial[1])], temper)


def _calibrated(rows: list, domains: tuple[str, ...], prior: list[float]) -> tuple[list[float], float]:
    """Intercepts and exponent under which the held-out rows lose least; without rows the prior and 1."""
    if not rows:
        return prior, 1.0
    hits = np.array([r.hits for r in rows], float)[:, None]
    evidence = np.array([[r[f"s_{d}"] for d in domains] for r in rows])
    true = np.array([[float(r.domain == d) for d in domains] for r in rows])
    found = []
    for temper in TEMPERS:
        base, shift = np.array(prior) + evidence * hits ** (temper - 1), np.zeros(len(domains))
        for _ in range(200):  # the loss is convex in the shift, and no step of this length raises it
            z = base + shift
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            shift += 2 * ((true - p).sum(axis=0) - shift) / (len(rows) + 2)
        found.append((-np.log((p * true).sum(axis=1) + 1e-300).mean(), temper, shift))
    _, temper, shift = min(found, key=lambda x: x[:2])
    return [float(x) for x in np.array(prior) + shift], temper


def _logits(domains: tuple[str, ...], prior: list[float], temper: float) -> list[F.Column]:
    scale = F.pow(F.coalesce("hits", F.lit(1)).cast("double"), F.lit(temper - 1))
    return [p + F.coalesce(f"s_{d}", F.lit(0.0)) * scale for d, p in zip(domains, prior)]


def _weighted(rows: DataFrame, terms: DataFrame, domains: tuple[str, ...]) -> tuple[DataFrame, list[float]]:
    """``(term, w_<domain>...)`` of every term that passes, and the logarithms of the priors."""
    sizes = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    prior = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    seen = terms.select("fp", "domain", "term").distinct().groupBy("term").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in domains))

    def gap(d: str) -> F.Column:
        size, rest = sizes.get(d, 0), total - sizes.get(d, 0)
        share = F.col("n") / total if total else F.lit(0.0)
        return (F.col(f"n_{d}") / max(1, size) - (F.col("n") - F.col(f"n_{d}")) / max(1, rest)) / F.sqrt(
            share * (1 - share) * (1 / max(1, size) + 1 / max(1, rest)) + F.lit(1e-12)
        )

    weights = (F.log((F.col(f"n_{d}") + 0.5) / (sizes.get(d, 0) + 1.0) / ((F.col("n") + 0.5) / (total + 1.0))).alias(f"w_{d}") for d in domains)
    passes = reduce(or_, (gap(d) >= min(LEAST_GAP, LEAST_SHARE * total**0.5) for d in domains))
    return saved(seen.where((F.col("n") >= LEAST_ROWS) & passes).select("term", *weights)), prior


def posteriors(documents: DataFrame, model: Classifier, domains: tuple[str, ...]) -> DataFrame:
    """``(doc_id, fp, n_tokens, p_<domain>...)``, one row per input row; ``fp`` is a hash of the text.

    Tokens are runs without ASCII blanks.  A text without terms of the vocabulary has the priors.  Every different word is
    evidence once, and its beginning with it; evidence is summed where a text is read, so one row a text is shuffled.
    """
    source = _texts(documents).withColumn("fp", F.xxhash64("text"))
    rows = source.withColumn("row", F.monotonically_increasing_id())  # equal rows are summed each by itself
    hits = (
        _term_rows(rows, "doc_id", "fp", "row", once=True).join(F.broadcast(model.vocabulary), "term")  # terms of the labelled sample
        .groupBy("doc_id", "fp", "row").agg(F.count("*").alias("hits"), *(F.sum(f"w_{d}").alias(f"s_{d}") for d in domains))
        .groupBy("doc_id", "fp").agg(F.max("hits").alias("hits"), *(F.max(f"s_{d}").alias(f"s_{d}") for d in domains))
    )
    base = source.select("doc_id", "fp", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"))
    joined = base.join(hits, (base.doc_id.eqNullSafe(hits.doc_id)) & (base.fp == hits.fp), "left").select(base["*"], "hits", *(f"s_{d}" for d in domains))
    joined = joined.select("doc_id", "fp", "n_tokens", *(z.alias(f"z_{d}") for z, d in zip(_logits(domains, model.prior, model.temper), domains)))
    top = F.greatest(*(F.col(f"z_{d}") for d in domains)) if len(domains) > 1 else F.col(f"z_{domains[0]}")
    powers = joined.select("doc_id", "fp", "n_tokens", *(F.exp(F.col(f"z_{d}") - top).alias(f"e_{d}") for d in domains))
    mass = reduce(add, (F.col(f"e_{d}") for d in domains))
    return powers.select("doc_id", "fp", "n_tokens", *((F.col(f"e_{d}") / mass).alias(f"p_{d}") for d in domains))


class Fit(NamedTuple):
    """``members`` with ``rate``; by domain what the totals miss of their targets, as a share of the budget; steps taken."""

    members: DataFrame
    missed: dict[str, float]
    steps: int


def fitted_rates(members: DataFrame, targets: dict[str, float], tokens: float | None = None) -> DataFrame:
    return fit(members, targets, tokens).members


def fit(members: DataFrame, targets: dict[str, float], tokens: float | None = None) -> Fit:
    """Add ``rate`` to ``(n_tokens, p_<domain>...)`` rows: least squares on the token totals of the domains.

    Minimises the squares of ``sum(rate * n_tokens * p_d) - target_d`` over rates >= 0, starting from rates of 1.  The
    gradient is taken in the metric of the tokens, so a document moves by its posteriors alone.  Steps are tried in this
    order, and the first that lowers the loss is taken: scaled by the Gram matrix of the rows whose rate is above zero,
    exact while no rate reaches zero; a quarter of it; the length that the last step's curvature suggests (Barzilai and
    Borwein); one over the largest eigenvalue of the Gram matrix, which always lowers it.  Ends when all totals are within
    ``TOLERANCE`` of the budget, when no step gains anything, or after ``STEPS`` steps.  Targets that rates can meet are met
    in a few steps; of others the loss nears the least one slowly, and ``missed`` tells what is left.
    """
    domains = tuple(targets)
    size = len(domains)
    n, p = F.col("n_tokens"), [F.col(f"p_{d}") for d in domains]
    members = members.drop("rate").withColumn("rate", F.lit(1.0))

    def sums(tried: F.Column, rate: F.Column) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Totals, Gram matrix of the open rows, tokens, and how far the rates moved."""
        pairs = [(i, j) for i in range(size) for j in range(i, size)]
        open_ = F.when(tried > 0, n).otherwise(0)
        moved = F.sum(n * (tried - rate) * (tried - rate))
        row = members.agg(F.sum(n), moved, *(F.sum(tried * n * x) for x in p), *(F.sum(open_ * p[i] * p[j]) for i, j in pairs)).first()
        gram = np.zeros((size, size))
        for (i, j), value in zip(pairs, row[2 + size :]):
            gram[i, j] = gram[j, i] = value or 0
        return np.array([x or 0 for x in row[2 : 2 + size]], float), gram, float(row[0] or 0), float(row[1] or 0)

    totals, gram, available, _ = sums(F.col("rate"), F.col("rate"))
    if not available:
        return Fit(members, dict.fromkeys(domains, 0.0), 0)
    budget = available if tokens is None else float(tokens)
    safe = 1 / float(np.linalg.eigvalsh(gram)[-1])
    aim = np.array([targets[d] for d in domains]) / sum(targets.values()) * budget
    rate, gap, length, attempt, steps = F.col("rate"), totals - aim, safe, 0, 0
    while steps < STEPS and np.abs(gap).max() > TOLERANCE * budget and attempt < 4:
        steps += 1
        scaled = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ gap
        move = (scaled, scaled / 4, length * gap, safe * gap)[attempt]
        tried = F.greatest(F.lit(0.0), rate - reduce(add, (x * float(m) for x, m in zip(p, move))))
        totals, tried_gram, _, moved = sums(tried, rate)
        change = totals - aim - gap
        if (totals - aim) @ (totals - aim) < gap @ gap * (1 - 1e-7):
            length = moved / max(change @ change, 1e-300)
            rate, gap, gram, attempt = tried, totals - aim, tried_gram, 0
        else:
            attempt += 1
        if steps % STEPS_A_TABLE == 0:
            members, rate = saved(members.withColumn("rate", rate)), F.col("rate")
    return Fit(members.withColumn("rate", rate), {d: float(g) / budget for d, g in zip(domains, gap)}, steps)


def mixed(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``(doc_id, fp, n_tokens, p_<domain>..., rate, missed)``, one row per input row.

    ``missed``, the same in all rows: the largest miss of a target, as a share of the budget.  A null text has no tokens.  Equal rows are rated alike.  An empty table gives an empty result.
    """
    domains = tuple(targets)
    model = learn(documents, domains_of_labels(labels), domains)
    found = fit(saved(posteriors(documents, model, domains)), targets)
    return found.members.withColumn("missed", F.lit(max(map(abs, found.missed.values()))))


def mixture(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents with a rate above zero, with their columns and ``n_tokens``, posteriors and ``rate``.

    Columns of the documents with one of these names give way to them.
    """
    rates = mixed(documents, labels, targets).where("rate > 0").dropDuplicates(["doc_id", "fp"])
    added = [x for x in rates.columns if x not in ("doc_id", "fp")]
    rest = documents.drop(*added)
    ident, name = fresh("id"), fresh("fp")
    rates = rates.select(F.col("doc_id").alias(ident), F.col("fp").alias(name), *added)
    fp = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rest.join(rates, rest.doc_id.eqNullSafe(F.col(ident)) & (fp == F.col(name))).select(*rest.columns, *added)
